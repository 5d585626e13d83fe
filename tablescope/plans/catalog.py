"""Registered queries (one per operator) and the DuckDB SQL that must give the same rows.

Each query reads the given tables (or frames Spark derives from them) whole.  The SQL
side is written independently from the Spark code, per column with UNION ALL, so a
mistake in a shared Spark primitive cannot hide in both.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

from tablescope.operators import missing, outliers, profile, types
from tablescope.plans import inputs as I

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


# --------------------------------------------------------------------------- SQL helpers

def U(parts: Sequence[str]) -> str:
    return "\nUNION ALL\n".join(parts)


def PCT(part: str, whole: str, d: int = 2) -> str:
    return f"round(coalesce(({part}) * 100.0 / NULLIF(({whole}), 0), 0.0), {d})"


def SIG(x: str) -> str:
    e = f"floor(log10(abs({x}))) - 9"
    return f"CASE WHEN ({x}) = 0 OR ({x}) IS NULL THEN ({x}) ELSE round(({x}) / pow(10.0, {e})) * pow(10.0, {e}) END"


LINEITEM_NUM = I.LINEITEM_NUMERIC
ORDERS_COLS = [("o_orderkey", "bigint"), ("o_custkey", "bigint"), ("o_orderstatus", "string"),
               ("o_totalprice", "double"), ("o_orderdate", "timestamp_ntz"), ("o_orderpriority", "string")]
DL_COLS = ["doc_id", "text", "lang", "source", "n_chars", "quality", "toxic"]
DL = I.DOCS_LABELS_SQL
CO = I.CUSTOMER_ORDERS_SQL
CO_NUM = I.CUSTOMER_ORDERS_NUMERIC


# --------------------------------------------------------------------------- summaries

def _column_summary_sql(tbl: str, cols) -> str:
    parts = []
    for i, (c, dt) in enumerate(cols):
        parts.append(
            f"SELECT '{c}' AS \"column\", {i} AS position, '{dt}' AS data_type, "
            f"{PCT(f'count(*) - count({c})', 'count(*)')} AS missing_pct, "
            f"CAST(count(DISTINCT {c}) AS BIGINT) AS unique_values, "
            f"(SELECT string_agg(v, ', ' ORDER BY v) FROM (SELECT DISTINCT CAST({c} AS VARCHAR) AS v FROM {tbl} "
            f"WHERE {c} IS NOT NULL ORDER BY v LIMIT 3)) AS sample_values FROM {tbl}")
    return U(parts)


@register("column_summary", _column_summary_sql("orders", ORDERS_COLS))
def q_column_summary(spark, sf):
    return profile.column_summary(I.table(spark, sf, "orders"))


_MC = U([f"SELECT '{c}' AS c, {i} AS pos, count(*) - count({c}) AS mc, count(*) AS r FROM t"
         for i, c in enumerate(DL_COLS)])


@register("missing_profile", f"""
WITH t AS {DL}, m AS ({_MC}), p AS (SELECT *, {PCT('mc', 'r')} AS p FROM m)
SELECT c AS "column", CAST(mc AS BIGINT) AS missing_count, p AS missing_pct,
       CASE WHEN p > 50 THEN 'High' WHEN p > 20 THEN 'Medium' ELSE 'Low' END AS severity,
       p = 100 AS completely_missing, p > 50 AS high_missing FROM p""")
def q_missing_profile(spark, sf):
    return missing.missing_profile(I.docs_labels(spark, sf))


@register("missing_summary", f"""
WITH t AS {DL}, m AS ({_MC}), p AS (SELECT *, mc * 100.0 / r AS p FROM m)
SELECT CAST(count_if(mc > 0) AS BIGINT) AS columns_with_missing,
       round(avg(CASE WHEN mc > 0 THEN p END), 2) AS avg_missing_pct,
       CAST(max(r) * {len(DL_COLS)} AS BIGINT) AS total_cells, CAST(sum(mc) AS BIGINT) AS missing_cells,
       {PCT('sum(mc)', f'max(r) * {len(DL_COLS)}')} AS overall_missing_pct,
       CAST(count_if(p = 100) AS BIGINT) AS empty_columns,
       (SELECT c FROM p WHERE mc > 0 ORDER BY p DESC, c LIMIT 1) AS worst_column,
       (SELECT round(p, 2) FROM p WHERE mc > 0 ORDER BY p DESC, c LIMIT 1) AS worst_pct
FROM p""")
def q_missing_summary(spark, sf):
    return missing.missing_summary(I.docs_labels(spark, sf))


@register("missing_bar", f"""
WITH t AS {DL}, m AS ({_MC})
SELECT c AS "column", CAST(mc AS BIGINT) AS missing_count, {PCT('mc', 'r')} AS missing_pct
FROM m WHERE mc > 0""")
def q_missing_bar(spark, sf):
    return missing.missing_bar(I.docs_labels(spark, sf))


_PAT = "concat_ws(',', " + ", ".join(f"CASE WHEN {c} IS NULL THEN '{c}' END" for c in DL_COLS) + ")"


@register("missing_combinations", f"""
WITH t AS {DL}, g AS (SELECT {_PAT} AS columns, count(*) AS n FROM t GROUP BY 1)
SELECT columns, CAST(n AS BIGINT) AS n, {PCT('n', '(SELECT sum(n) FROM g)')} AS pct
FROM g WHERE columns <> ''""")
def q_missing_combinations(spark, sf):
    return missing.missing_combinations(I.docs_labels(spark, sf))


def _missing_together_sql() -> str:
    pairs = [(a, b) for a in DL_COLS for b in DL_COLS if a != b]
    sums = ", ".join([f"count_if({c} IS NULL) AS m_{c}" for c in DL_COLS] +
                     [f"count_if({a} IS NULL AND {b} IS NULL) AS b_{a}__{b}" for a, b in pairs])
    rows = U([f"SELECT {j} AS ord, '{a}' AS column_a, '{b}' AS column_b, m_{a} AS am, b_{a}__{b} AS bm FROM s"
              for j, (a, b) in enumerate(pairs)])
    return f"""
WITH t AS {DL}, s AS (SELECT {sums} FROM t), r AS ({rows})
SELECT column_a, column_b, CAST(am AS BIGINT) AS a_missing, CAST(bm AS BIGINT) AS both_missing,
       round(bm / am, 4) AS share
FROM r WHERE am > 0 AND bm / am > 0.8"""


@register("missing_together", _missing_together_sql())
def q_missing_together(spark, sf):
    return missing.missing_together(I.docs_labels(spark, sf))


def _missing_corr_sql() -> str:
    cols = DL_COLS
    ind = ", ".join(f"CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END AS {c}" for c in cols)
    rows = U([f"SELECT '{a}' AS feature1, '{b}' AS feature2, count(*) AS n, corr({a}, {b}) AS r, "
              f"sum({a}) AS ma, sum({b}) AS mb FROM i" for a, b in _pairs_early(cols)])
    return f"""
WITH t AS {DL}, i AS (SELECT {ind} FROM t), p AS ({rows})
SELECT feature1, feature2, CAST(n AS BIGINT) AS n, round(r, 4) AS pearson FROM p
WHERE ma > 0 AND mb > 0 AND abs(r) > 0.5"""


def _pairs_early(cols):
    return [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]]


@register("missing_correlation", _missing_corr_sql())
def q_missing_correlation(spark, sf):
    return missing.missing_correlation(I.docs_labels(spark, sf))


@register("data_density", f"""
WITH t AS {DL}
SELECT CAST(count(*) AS BIGINT) AS "rows", CAST({len(DL_COLS)} AS BIGINT) AS columns,
       CAST({' + '.join(f'count({c})' for c in DL_COLS)} AS BIGINT) AS non_null_cells,
       {PCT(' + '.join(f'count({c})' for c in DL_COLS), f'count(*) * {len(DL_COLS)}')} AS density
FROM t""")
def q_data_density(spark, sf):
    return profile.data_density(I.docs_labels(spark, sf))


def _dup_sql(tbl: str, cols: Sequence[str]) -> str:
    return f"""
WITH g AS (SELECT count(*) AS n FROM {tbl} GROUP BY {', '.join(cols)})
SELECT CAST(sum(n) AS BIGINT) AS "rows", CAST(count(*) AS BIGINT) AS distinct_rows,
       CAST(sum(n - 1) AS BIGINT) AS duplicate_rows, {PCT('sum(n - 1)', 'sum(n)')} AS duplicate_pct FROM g"""


@register("duplicate_rows", _dup_sql("lineitem", I.LINEITEM_COLS))
def q_duplicate_rows(spark, sf):
    return profile.duplicate_rows(I.table(spark, sf, "lineitem"))


@register("duplicate_texts", _dup_sql("documents", ["text"]))
def q_duplicate_texts(spark, sf):
    return profile.duplicate_rows(I.table(spark, sf, "documents").select("text"))


# --------------------------------------------------------------------------- numeric

def _numeric_profile_sql(tbl: str, cols: Sequence[str]) -> str:
    parts = []
    for i, c in enumerate(cols):
        parts.append(f"""
SELECT * FROM (WITH s AS (SELECT avg({c}) AS m, quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM {tbl}),
a AS (SELECT count({c}) AS n, avg({c}) AS mean, stddev_samp({c}) AS std, min({c}) AS mn, max({c}) AS mx,
        avg(pow({c} - s.m, 3)) / pow(avg(pow({c} - s.m, 2)), 1.5) AS sk,
        avg(pow({c} - s.m, 4)) / pow(avg(pow({c} - s.m, 2)), 2) - 3 AS ku,
        count_if({c} = 0) AS zc, count_if({c} < 0) AS nc, var_samp({c}) AS v, count(DISTINCT {c}) AS uc,
        count_if({c} < s.q1 - 1.5 * (s.q3 - s.q1) OR {c} > s.q3 + 1.5 * (s.q3 - s.q1)) AS oc
      FROM {tbl}, s),
b AS (SELECT *, {PCT('zc', 'n')} AS zp, {PCT('oc', 'n')} AS op FROM a)
SELECT '{c}' AS "column", {i} AS position, CAST(n AS BIGINT) AS n, round(mean, 4) AS mean, round(std, 4) AS std,
       round(mn, 4) AS min, round(mx, 4) AS max, round(sk, 4) AS skewness, round(ku, 4) AS kurtosis,
       coalesce(abs(sk) > 2, false) AS highly_skewed, coalesce(abs(sk) > 1 AND abs(sk) <= 2, false) AS moderately_skewed,
       CAST(zc AS BIGINT) AS zero_count, zp AS zero_pct, CAST(nc AS BIGINT) AS negative_count,
       {PCT('nc', 'n')} AS negative_pct, {SIG('v')} AS variance,
       round(coalesce(std / NULLIF(mean, 0), 0.0), 4) AS cv, coalesce(v < 0.01, false) AS low_variance,
       CAST(uc AS BIGINT) AS unique_count, round(uc / n, 4) AS unique_ratio, CAST(oc AS BIGINT) AS outlier_count,
       op AS outlier_pct,
       concat_ws(',', CASE WHEN abs(sk) > 2 THEN 'highly_skewed' END, CASE WHEN v < 0.01 THEN 'low_variance' END,
                 CASE WHEN op > 10 THEN 'many_outliers' END, CASE WHEN zp > 50 THEN 'mostly_zeros' END) AS issues
FROM b)""")
    return U(parts)


@register("numeric_profile", _numeric_profile_sql("lineitem", LINEITEM_NUM))
def q_numeric_profile(spark, sf):
    return profile.numeric_profile(I.table(spark, sf, "lineitem"), LINEITEM_NUM)


@register("numeric_profile_orders", _numeric_profile_sql("orders", ["o_totalprice", "o_custkey"]))
def q_numeric_profile_orders(spark, sf):
    return profile.numeric_profile(I.table(spark, sf, "orders"), ["o_totalprice", "o_custkey"])


# --------------------------------------------------------------------------- categorical

def _hist_sql(tbl: str, cols: Sequence[str]) -> str:
    return U([f"SELECT '{c}' AS c, {i} AS pos, CAST({c} AS VARCHAR) AS v, count(*) AS n FROM {tbl} "
              f"WHERE {c} IS NOT NULL GROUP BY {c}" for i, c in enumerate(cols)])


def _categorical_profile_sql(tbl: str, cols: Sequence[str]) -> str:
    return f"""
WITH h AS ({_hist_sql(tbl, cols)}),
d AS (SELECT c, v, n, row_number() OVER (PARTITION BY c ORDER BY n DESC, v) AS rn FROM h),
g AS (SELECT c, min(pos) AS pos, sum(n) AS n, count(*) AS u, log2(sum(n)) - sum(n * log2(n)) / sum(n) AS ent,
             min(n) AS min_n, max(n) AS max_n,
             bool_or(lower(v) IN ('null', 'none', 'na', 'n/a', 'unknown', 'missing', '')) AS has_null_like,
             sum(n * length(v)) AS len_sum, max(length(v)) AS max_len, min(length(v)) AS min_len,
             bool_or(contains(v, ' ') AND trim(v) <> v) AS ws, count(DISTINCT lower(v)) AS lu
      FROM h GROUP BY c),
x AS (SELECT g.*, d.v AS dom_v, d.n * 100.0 / g.n AS dom_pct FROM g JOIN d ON g.c = d.c AND d.rn = 1)
SELECT c AS "column", pos AS position, CAST(n AS BIGINT) AS n, CAST(u AS BIGINT) AS unique_values,
       round(u / n, 4) AS unique_ratio, u > n * 0.5 AS high_cardinality, u > n * 0.8 AS very_high_cardinality,
       u / n > 0.95 AS potential_id, dom_v AS dominant_value, round(dom_pct, 2) AS dominant_pct,
       dom_pct > 90 AS highly_dominant, dom_pct >= 70 AND dom_pct <= 90 AS moderately_dominant,
       round(ent, 4) AS entropy, round(ent, 4) > log2(u) * 0.9 AS uniform, u = 2 AS is_binary,
       CASE WHEN u = 2 THEN round(min_n / max_n, 3) END AS binary_balance, has_null_like,
       round(len_sum / n, 2) AS avg_len, CAST(max_len AS BIGINT) AS max_len, CAST(min_len AS BIGINT) AS min_len,
       lu < u AS case_issue, ws AS whitespace_issue,
       concat_ws(',', CASE WHEN u > n * 0.5 THEN 'high_cardinality' END,
                 CASE WHEN dom_pct > 90 THEN 'single_value_dominant' END,
                 CASE WHEN u / n > 0.95 THEN 'likely_id_column' END, CASE WHEN lu < u THEN 'case_sensitivity' END,
                 CASE WHEN ws THEN 'whitespace_issues' END) AS issues
FROM x"""


PART_STR = ["p_name", "p_brand", "p_type"]


@register("categorical_profile", _categorical_profile_sql("part", PART_STR))
def q_categorical_profile(spark, sf):
    return profile.categorical_profile(I.table(spark, sf, "part"), PART_STR)


@register("categorical_profile_lineitem",
          _categorical_profile_sql("lineitem", ["l_returnflag", "l_linestatus"]))
def q_categorical_profile_lineitem(spark, sf):
    return profile.categorical_profile(I.table(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus"])


@register("top_categories", f"""
WITH h AS ({_hist_sql('part', PART_STR)}),
d AS (SELECT c, v, n, row_number() OVER (PARTITION BY c ORDER BY n DESC, v) AS rn, sum(n) OVER (PARTITION BY c) AS tot FROM h)
SELECT c AS "column", CAST(rn AS BIGINT) AS rank, v AS value, CAST(n AS BIGINT) AS n, {PCT('n', 'tot')} AS pct
FROM d WHERE rn <= 10""")
def q_top_categories(spark, sf):
    return profile.top_categories(I.table(spark, sf, "part"), PART_STR)


# --------------------------------------------------------------------------- datetime / boolean

def _datetime_profile_sql(tbl: str, cols: Sequence[str]) -> str:
    return U([f"""
SELECT '{c}' AS "column", {i} AS position, CAST(count({c}) AS BIGINT) AS n, min({c}) AS min_ts, max({c}) AS max_ts,
       CAST(floor((epoch_us(max({c})) - epoch_us(min({c}))) / 86400000000) AS BIGINT) AS range_days,
       CAST(count(DISTINCT {c}) AS BIGINT) AS unique_dates,
       CAST(count({c}) - count(DISTINCT {c}) AS BIGINT) AS duplicate_dates,
       bool_or(hour({c}) <> 0 OR minute({c}) <> 0) AS has_time,
       max(year({c})) <> min(year({c})) AS spans_years,
       bool_and(hour({c}) >= 9 AND hour({c}) <= 17) AS business_hours_only
FROM {tbl}""" for i, c in enumerate(cols)])


@register("datetime_profile", _datetime_profile_sql("orders", ["o_orderdate"]))
def q_datetime_profile(spark, sf):
    return profile.datetime_profile(I.table(spark, sf, "orders"), ["o_orderdate"])


@register("datetime_profile_events", _datetime_profile_sql("events", ["ts"]))
def q_datetime_profile_events(spark, sf):
    return profile.datetime_profile(I.table(spark, sf, "events"), ["ts"])


@register("boolean_profile", U([f"""
SELECT * FROM (WITH a AS (SELECT count({c}) AS n, count_if({c} = 1) AS t FROM labels)
SELECT '{c}' AS "column", CAST(n AS BIGINT) AS n, CAST(t AS BIGINT) AS true_count, CAST(n - t AS BIGINT) AS false_count,
       {PCT('t', 'n')} AS true_pct, round(least(t, n - t) / NULLIF(greatest(t, n - t), 0), 3) AS balance_ratio,
       coalesce(least(t, n - t) / NULLIF(greatest(t, n - t), 0) > 0.3, false) AS well_balanced FROM a)"""
                                      for c in ["quality", "toxic"]]))
def q_boolean_profile(spark, sf):
    return profile.boolean_profile(I.table(spark, sf, "labels"), ["quality", "toxic"])


# --------------------------------------------------------------------------- cardinality & co

@register("cardinality_profile", f"""
WITH r AS (SELECT count(*) AS rows FROM orders),
u AS ({U([f"SELECT '{c}' AS c, '{dt}' AS dt, count(DISTINCT {c}) AS u FROM orders" for c, dt in ORDERS_COLS])})
SELECT c AS "column", dt AS data_type, CAST(u AS BIGINT) AS unique_count, round(u * 100.0 / r.rows, 2) AS unique_pct,
       CASE WHEN u = r.rows THEN 'Unique (ID-like)' WHEN u * 100.0 / r.rows > 95 THEN 'Very High'
            WHEN u * 100.0 / r.rows > 50 THEN 'High' WHEN u * 100.0 / r.rows > 10 THEN 'Medium' ELSE 'Low' END AS cardinality,
       u = r.rows AS id_like
FROM u, r""")
def q_cardinality_profile(spark, sf):
    return profile.cardinality_profile(I.table(spark, sf, "orders"))


@register("constant_columns", f"""
WITH t AS (SELECT *, 'x' AS tag FROM nation)
SELECT "column", data_type, value FROM ({U([
    f"SELECT '{c}' AS \"column\", '{dt}' AS data_type, min(CAST({c} AS VARCHAR)) AS value, count(DISTINCT {c}) AS d FROM t"
    for c, dt in [("n_nationkey", "int"), ("n_name", "string"), ("n_regionkey", "int"), ("tag", "string")]])}) WHERE d <= 1""")
def q_constant_columns(spark, sf):
    from pyspark.sql import functions as F
    return profile.constant_columns(I.table(spark, sf, "nation").withColumn("tag", F.lit("x")))


@register("zero_values", f"""
WITH a AS ({U([f"SELECT '{c}' AS c, count_if({c} = 0) AS z, count(*) AS r FROM lineitem" for c in
               ['l_orderkey', 'l_partkey', 'l_suppkey', 'l_linenumber'] + LINEITEM_NUM])}),
p AS (SELECT *, {PCT('z', 'r')} AS p FROM a)
SELECT c AS "column", CAST(z AS BIGINT) AS zero_count, p AS zero_pct,
       CASE WHEN p > 70 THEN 'High' WHEN p > 30 THEN 'Medium' ELSE 'Low' END AS severity, p > 50 AS heavy
FROM p WHERE z > 0""")
def q_zero_values(spark, sf):
    return profile.zero_values(I.table(spark, sf, "lineitem"))


@register("duplicate_columns", """
WITH t AS (SELECT o_orderkey, o_custkey, o_orderkey AS key_copy, o_totalprice FROM orders)
SELECT 'o_orderkey' AS column_a, 'key_copy' AS column_b FROM t HAVING bool_and(o_orderkey IS NOT DISTINCT FROM key_copy)
UNION ALL SELECT 'o_orderkey', 'o_custkey' FROM t HAVING bool_and(o_orderkey IS NOT DISTINCT FROM o_custkey)
UNION ALL SELECT 'o_custkey', 'key_copy' FROM t HAVING bool_and(o_custkey IS NOT DISTINCT FROM key_copy)""")
def q_duplicate_columns(spark, sf):
    o = I.table(spark, sf, "orders")
    return profile.duplicate_columns(o.select("o_orderkey", "o_custkey", o.o_orderkey.alias("key_copy"),
                                              "o_totalprice"))


@register("column_bytes", f"""
WITH b AS ({U([f"SELECT '{c}' AS c, {i} AS pos, '{dt}' AS dt, CAST({expr} AS BIGINT) AS bytes FROM customer"
               for i, (c, dt, expr) in enumerate([
                   ("c_custkey", "bigint", "count(c_custkey) * 8"), ("c_name", "string", "coalesce(sum(strlen(c_name)), 0)"),
                   ("c_nationkey", "int", "count(c_nationkey) * 4"), ("c_acctbal", "double", "count(c_acctbal) * 8"),
                   ("c_mktsegment", "string", "coalesce(sum(strlen(c_mktsegment)), 0)")])])})
SELECT c AS "column", bytes, pos AS position, dt AS data_type,
       row_number() OVER (ORDER BY bytes DESC, pos) AS size_rank FROM b""")
def q_column_bytes(spark, sf):
    return profile.column_bytes(I.table(spark, sf, "customer"))


@register("grouped_mean", """
SELECT l_returnflag, CAST(count(*) AS BIGINT) AS n, round(avg(l_quantity), 4) AS l_quantity,
       round(avg(l_extendedprice), 4) AS l_extendedprice, round(avg(l_discount), 4) AS l_discount,
       round(avg(l_tax), 4) AS l_tax FROM lineitem GROUP BY l_returnflag""")
def q_grouped_mean(spark, sf):
    li = I.table(spark, sf, "lineitem")
    return profile.grouped_mean(li, "l_returnflag", LINEITEM_NUM)


# --------------------------------------------------------------------------- target

@register("class_balance", f"""
WITH c AS (SELECT CAST(quality AS VARCHAR) AS class, count(*) AS n FROM labels WHERE quality IS NOT NULL GROUP BY 1),
s AS (SELECT sum(n) AS tot, count(*) AS k, min(n) AS mn, max(n) AS mx FROM c)
SELECT class, CAST(n AS BIGINT) AS n, {PCT('n', 'tot')} AS pct, CAST(k AS BIGINT) AS n_classes,
       CASE WHEN k >= 2 THEN round(mx / mn, 2) END AS imbalance_ratio,
       CASE WHEN k < 2 THEN 'single_class' WHEN mx / mn > 10 THEN 'severely_imbalanced'
            WHEN mx / mn > 3 THEN 'moderately_imbalanced' ELSE 'balanced' END AS status,
       CASE WHEN k < 2 THEN 'critical' WHEN mx / mn > 10 THEN 'high' WHEN mx / mn > 3 THEN 'medium' ELSE 'low' END AS severity,
       n = mn AS is_minority, n = mx AS is_majority
FROM c, s""")
def q_class_balance(spark, sf):
    return profile.class_balance(I.table(spark, sf, "labels"), "quality")


@register("class_distribution", """
WITH c AS (SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_orderpriority IS NOT NULL GROUP BY 1)
SELECT CAST(count(*) AS BIGINT) AS n_classes, CAST(sum(n) AS BIGINT) AS n,
       round(log2(sum(n)) - sum(n * log2(n)) / sum(n), 4) AS entropy,
       round(1 - sum(n * n) / (sum(n) * sum(n)), 4) AS gini FROM c""")
def q_class_distribution(spark, sf):
    return profile.class_distribution(I.table(spark, sf, "orders"), "o_orderpriority")


@register("regression_target_profile", """
WITH s AS (SELECT avg(o_totalprice) AS m FROM orders)
SELECT 'o_totalprice' AS "column", CAST(count(o_totalprice) AS BIGINT) AS n, round(avg(o_totalprice), 4) AS mean,
       round(quantile_cont(o_totalprice, 0.5), 4) AS median, round(stddev_samp(o_totalprice), 4) AS std,
       round(min(o_totalprice), 4) AS min, round(max(o_totalprice), 4) AS max,
       round(max(o_totalprice) - min(o_totalprice), 4) AS range,
       round(quantile_cont(o_totalprice, 0.75) - quantile_cont(o_totalprice, 0.25), 4) AS iqr,
       round(avg(pow(o_totalprice - s.m, 3)) / pow(avg(pow(o_totalprice - s.m, 2)), 1.5), 4) AS skewness,
       round(avg(pow(o_totalprice - s.m, 4)) / pow(avg(pow(o_totalprice - s.m, 2)), 2) - 3, 4) AS kurtosis
FROM orders, s""")
def q_regression_target_profile(spark, sf):
    return profile.regression_target_profile(I.table(spark, sf, "orders"), "o_totalprice")


@register("target_overview", """
WITH a AS (SELECT count(*) AS r, count(*) - count(o_orderpriority) AS mc, count(o_orderpriority) AS n,
                  count(DISTINCT o_orderpriority) AS u FROM orders)
SELECT 'o_orderpriority' AS "column", CAST(mc AS BIGINT) AS missing_count, round(mc * 100.0 / r, 2) AS missing_pct,
       CAST(u AS BIGINT) AS unique_count, round(u / n, 4) AS unique_ratio,
       CASE WHEN n < 10 THEN 'unknown' ELSE 'classification' END AS task_type FROM a""")
def q_target_overview(spark, sf):
    return profile.target_overview(I.table(spark, sf, "orders"), "o_orderpriority")


# --------------------------------------------------------------------------- outliers

def _iqr_cte(tbl: str, cols: Sequence[str]) -> str:
    return U([f"SELECT '{c}' AS c, quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3, "
              f"count({c}) AS n, min({c}) AS mn, max({c}) AS mx FROM {tbl}" for c in cols])


def _iqr_count(tbl: str, cols: Sequence[str]) -> str:
    return U([f"SELECT '{c}' AS c, count_if({c} < b.lo OR {c} > b.hi) AS oc FROM {tbl}, "
              f"(SELECT lo, hi FROM b WHERE c = '{c}') b" for c in cols])


@register("outliers_iqr", f"""
WITH q AS ({_iqr_cte('lineitem', LINEITEM_NUM)}),
b AS (SELECT *, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM q),
o AS ({_iqr_count('lineitem', LINEITEM_NUM)})
SELECT b.c AS "column", round(q1, 4) AS q1, round(q3, 4) AS q3, round(lo, 4) AS lower, round(hi, 4) AS upper,
       CAST(n AS BIGINT) AS n, CAST(oc AS BIGINT) AS n_outliers, {PCT('oc', 'n')} AS pct
FROM b JOIN o ON b.c = o.c""")
def q_outliers_iqr(spark, sf):
    return outliers.outliers_iqr(I.table(spark, sf, "lineitem"), LINEITEM_NUM)


_CO_ALL = ["c_custkey", "c_acctbal", "c_nationkey", "n_orders", "total_spent", "avg_order"]


@register("outlier_report", f"""
WITH q AS ({_iqr_cte(CO, _CO_ALL)}),
b AS (SELECT *, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM q),
o AS ({_iqr_count(CO, _CO_ALL)}),
p AS (SELECT b.*, oc, {PCT('oc', 'n')} AS p FROM b JOIN o ON b.c = o.c)
SELECT c AS "column", CAST(oc AS BIGINT) AS n_outliers, p AS pct, round(lo, 4) AS lower, round(hi, 4) AS upper,
       round(mn, 4) AS min, round(mx, 4) AS max,
       CASE WHEN p > 10 THEN 'High' WHEN p > 5 THEN 'Medium' ELSE 'Low' END AS severity
FROM p WHERE oc > 0""")
def q_outlier_report(spark, sf):
    return outliers.outlier_report(I.customer_orders(spark, sf))


@register("outliers_zscore", U([f"""
SELECT * FROM (WITH s AS (SELECT avg({c}) AS m, stddev_pop({c}) AS sd, count({c}) AS n FROM lineitem)
SELECT '{c}' AS "column", round(s.m, 4) AS mean, round(s.sd, 4) AS std_pop, CAST(s.n AS BIGINT) AS n,
       CAST(count_if(abs({c} - s.m) / NULLIF(s.sd, 0) > 3) AS BIGINT) AS n_outliers,
       {PCT(f'count_if(abs({c} - s.m) / NULLIF(s.sd, 0) > 3)', 's.n')} AS pct
FROM lineitem, s GROUP BY s.m, s.sd, s.n)""" for c in LINEITEM_NUM]))
def q_outliers_zscore(spark, sf):
    return outliers.outliers_zscore(I.table(spark, sf, "lineitem"), LINEITEM_NUM)


CUST_NUM = ["c_acctbal", "c_nationkey"]


@register("outliers_modified_z", U([f"""
SELECT * FROM (WITH s AS (SELECT median({c}) AS med FROM customer),
d AS (SELECT median(abs({c} - s.med)) AS mad FROM customer, s)
SELECT '{c}' AS "column", round(s.med, 4) AS median, round(d.mad, 4) AS mad, CAST(count({c}) AS BIGINT) AS n,
       CAST(count_if(CASE WHEN d.mad = 0 THEN abs({c} - s.med) > 0 ELSE abs(0.6745 * abs({c} - s.med) / d.mad) > 3.5 END) AS BIGINT) AS n_outliers,
       {PCT(f'count_if(CASE WHEN d.mad = 0 THEN abs({c} - s.med) > 0 ELSE abs(0.6745 * abs({c} - s.med) / d.mad) > 3.5 END)', f'count({c})')} AS pct
FROM customer, s, d GROUP BY s.med, d.mad)""" for c in CUST_NUM]))
def q_outliers_modified_z(spark, sf):
    return outliers.outliers_modified_z(I.table(spark, sf, "customer"), CUST_NUM)


@register("outliers_by_group", """
WITH q AS (SELECT l_returnflag AS g, quantile_cont(l_extendedprice, 0.25) AS q1, quantile_cont(l_extendedprice, 0.75) AS q3
           FROM lineitem WHERE l_returnflag IS NOT NULL AND l_extendedprice IS NOT NULL GROUP BY 1),
b AS (SELECT g, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM q)
SELECT b.g AS "group", round(lo, 4) AS lower, round(hi, 4) AS upper, CAST(count(l_extendedprice) AS BIGINT) AS n,
       CAST(count_if(l_extendedprice < lo OR l_extendedprice > hi) AS BIGINT) AS n_outliers
FROM lineitem JOIN b ON lineitem.l_returnflag = b.g GROUP BY b.g, lo, hi""")
def q_outliers_by_group(spark, sf):
    return outliers.outliers_by_group(I.table(spark, sf, "lineitem"), "l_returnflag", "l_extendedprice")


_ROW_FLAG = " OR ".join(f"coalesce({c} < (SELECT lo FROM b WHERE c = '{c}') OR {c} > (SELECT hi FROM b WHERE c = '{c}'), false)"
                        for c in LINEITEM_NUM)


@register("outlier_rows", f"""
WITH q AS ({_iqr_cte('lineitem', LINEITEM_NUM)}),
b AS (SELECT c, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM q),
a AS (SELECT count(*) AS r, count_if({_ROW_FLAG}) AS o FROM lineitem)
SELECT CAST(r AS BIGINT) AS "rows", CAST(o AS BIGINT) AS outlier_rows, {PCT('o', 'r')} AS pct,
       {PCT('o', 'r')} > 5 AS flagged,
       CASE WHEN {PCT('o', 'r')} > 15 THEN 'high' WHEN {PCT('o', 'r')} > 5 THEN 'medium' END AS severity FROM a""")
def q_outlier_rows(spark, sf):
    return outliers.outlier_rows(I.table(spark, sf, "lineitem"), LINEITEM_NUM)


@register("outliers_pairwise", f"""
WITH q AS ({_iqr_cte('lineitem', ['l_quantity', 'l_discount'])}),
b AS (SELECT c, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM q),
a AS (SELECT count(*) AS r, count_if({' OR '.join(f"({c} < (SELECT lo FROM b WHERE c = '{c}') OR {c} > (SELECT hi FROM b WHERE c = '{c}'))" for c in ['l_quantity', 'l_discount'])}) AS o
      FROM lineitem WHERE l_quantity IS NOT NULL AND l_discount IS NOT NULL)
SELECT CAST(r AS BIGINT) AS "rows", CAST(o AS BIGINT) AS outlier_rows, {PCT('o', 'r')} AS pct FROM a""")
def q_outliers_pairwise(spark, sf):
    return outliers.outliers_pairwise(I.table(spark, sf, "lineitem"), "l_quantity", "l_discount")


# --------------------------------------------------------------------------- types

_OT = I.ORDERS_AS_TEXT_SQL


@register("schema_types", f"""
WITH t AS {_OT}, s AS ({U([
    "SELECT 'key_text' AS c, 0 AS pos, 'string' AS dt, count(key_text) AS nn, count(DISTINCT key_text) AS d, "
    "count(try_cast(key_text AS DOUBLE)) AS num_ok, count(try_strptime(key_text, '%Y-%m-%d %H:%M:%S')) AS date_ok, "
    "min(trim(key_text)) AS lo, max(trim(key_text)) AS hi, count(*) AS r FROM t",
    "SELECT 'date_text', 1, 'string', count(date_text), count(DISTINCT date_text), count(try_cast(date_text AS DOUBLE)), "
    "count(try_strptime(date_text, '%Y-%m-%d %H:%M:%S')), min(trim(date_text)), max(trim(date_text)), count(*) FROM t",
    "SELECT 'o_orderstatus', 2, 'string', count(o_orderstatus), count(DISTINCT o_orderstatus), "
    "count(try_cast(o_orderstatus AS DOUBLE)), 0, min(trim(o_orderstatus)), max(trim(o_orderstatus)), count(*) FROM t",
    "SELECT 'big_order', 3, 'string', count(big_order), count(DISTINCT big_order), count(try_cast(big_order AS DOUBLE)), "
    "0, min(trim(big_order)), max(trim(big_order)), count(*) FROM t",
    "SELECT 'mixed_text', 4, 'string', count(mixed_text), count(DISTINCT mixed_text), "
    "count(try_cast(mixed_text AS DOUBLE)), 0, min(trim(mixed_text)), max(trim(mixed_text)), count(*) FROM t",
    "SELECT 'o_totalprice', 5, 'double', count(o_totalprice), count(DISTINCT o_totalprice), NULL, NULL, "
    "NULL, NULL, count(*) FROM t",
    "SELECT 'o_orderdate', 6, 'timestamp_ntz', count(o_orderdate), count(DISTINCT o_orderdate), NULL, NULL, "
    "NULL, NULL, count(*) FROM t"])})
SELECT c AS "column", pos AS position, dt AS data_type,
       CASE WHEN nn = 0 THEN 'empty' WHEN dt LIKE 'timestamp%' THEN 'datetime'
            WHEN dt = 'string' AND date_ok > 0.8 * nn THEN 'datetime'
            WHEN d = 2 AND [lo, hi] IN (['False', 'True'], ['false', 'true'], ['FALSE', 'TRUE'], ['No', 'Yes'],
                 ['no', 'yes'], ['NO', 'YES'], ['N', 'Y'], ['n', 'y'], ['0', '1'], ['Female', 'Male'], ['F', 'M'],
                 ['Active', 'Inactive']) THEN 'boolean'
            WHEN dt = 'double' THEN 'numeric' WHEN dt = 'string' AND num_ok = nn THEN 'numeric'
            ELSE 'categorical' END AS semantic_type,
       CAST(nn AS BIGINT) AS non_null, CAST(d AS BIGINT) AS n_distinct, CAST(r AS BIGINT) AS "rows"
FROM s""")
def q_schema_types(spark, sf):
    return types.schema_types(I.orders_as_text(spark, sf))


@register("mixed_type_columns", """
WITH t AS (SELECT CASE WHEN o_orderstatus = 'F' THEN CAST(o_totalprice AS VARCHAR) ELSE o_orderpriority END AS mixed_text,
                  o_orderstatus FROM orders),
s AS (SELECT 'mixed_text' AS c, count(mixed_text) AS nn, count(try_cast(mixed_text AS DOUBLE)) AS ok FROM t
      UNION ALL SELECT 'o_orderstatus', count(o_orderstatus), count(try_cast(o_orderstatus AS DOUBLE)) FROM t)
SELECT c AS "column", CAST(nn AS BIGINT) AS non_null, CAST(ok AS BIGINT) AS numeric_values,
       round(ok * 100.0 / nn, 2) AS numeric_pct FROM s WHERE ok > 0 AND ok < nn""")
def q_mixed_type_columns(spark, sf):
    return types.mixed_type_columns(I.orders_as_text(spark, sf))


@register("datetime_like_strings", f"""
WITH t AS {_OT}, s AS ({U([f"SELECT '{c}' AS c, count({c}) AS nn, count_if(length({c}) > 8 AND regexp_matches({c}, '[-/:]')) AS dl FROM t"
                           for c in ['key_text', 'date_text', 'o_orderstatus', 'big_order', 'mixed_text']])})
SELECT c AS "column", CAST(nn AS BIGINT) AS non_null, CAST(dl AS BIGINT) AS date_like,
       round(dl * 100.0 / nn, 2) AS date_like_pct FROM s WHERE nn > 0 AND dl >= 0.7 * nn""")
def q_datetime_like_strings(spark, sf):
    return types.datetime_like_strings(I.orders_as_text(spark, sf))


@register("robust_numeric_columns", f"""
WITH t AS {_OT}, s AS ({U([
    f"SELECT '{c}' AS c, count({x}) AS nn, var_samp({x}) AS v, count(*) AS r FROM t"
    for c, x in [("key_text", "try_cast(key_text AS DOUBLE)"), ("date_text", "try_cast(date_text AS DOUBLE)"),
                 ("o_orderstatus", "try_cast(o_orderstatus AS DOUBLE)"), ("big_order", "try_cast(big_order AS DOUBLE)"),
                 ("mixed_text", "try_cast(mixed_text AS DOUBLE)"), ("o_totalprice", "o_totalprice")]])})
SELECT c AS "column", CAST(nn AS BIGINT) AS non_null, {SIG('v')} AS variance FROM s
WHERE nn >= greatest(10.0, r * 0.1) AND v > 1e-10""")
def q_robust_numeric_columns(spark, sf):
    return types.robust_numeric_columns(I.orders_as_text(spark, sf))


@register("robust_categorical_columns", f"""
WITH s AS ({U([f"SELECT '{c}' AS c, count({c}) AS nn, count(DISTINCT {c}) AS d FROM part" for c in PART_STR])})
SELECT c AS "column", CAST(nn AS BIGINT) AS non_null, CAST(d AS BIGINT) AS n_distinct, round(d / nn, 4) AS unique_ratio
FROM s WHERE d >= 2 AND d / nn <= 0.5""")
def q_robust_categorical_columns(spark, sf):
    return types.robust_categorical_columns(I.table(spark, sf, "part"))


@register("structure_flags", f"""
WITH s AS ({U([f"SELECT '{c}' AS c, {i} AS pos, count(DISTINCT {c}) AS d, count({c}) AS nn, count(*) AS r, "
               f"{'var_samp(' + c + ')' if dt in ('bigint', 'double') else 'NULL'} AS v, {str(dt == 'string').lower()} AS cat FROM orders"
               for i, (c, dt) in enumerate(ORDERS_COLS)])})
SELECT c AS "column", pos AS position, CAST(d AS BIGINT) AS n_distinct, cat AND d >= 2 AND d <= 0.5 * nn AS categorical,
       cat AND d >= 2 AND d <= 0.5 * nn AND d > least(50.0, r * 0.05) AS high_cardinality,
       coalesce(v < 1e-6, false) AS low_variance, nn = 0 AS completely_missing, (r - nn) * 100.0 / r > 80 AS mostly_missing
FROM s""")
def q_structure_flags(spark, sf):
    return types.structure_flags(I.table(spark, sf, "orders"))


@register("task_type", """
WITH a AS (SELECT count(o_orderpriority) AS n, count(DISTINCT o_orderpriority) AS d FROM orders)
SELECT 'o_orderpriority' AS "column", CAST(n AS BIGINT) AS n, CAST(d AS BIGINT) AS n_distinct,
       round(d / n, 4) AS unique_ratio, CASE WHEN n < 10 THEN 'unknown' ELSE 'classification' END AS task_type FROM a
UNION ALL
SELECT * FROM (WITH a AS (SELECT count(o_totalprice) AS n, count(DISTINCT o_totalprice) AS d FROM orders)
SELECT 'o_totalprice', CAST(n AS BIGINT), CAST(d AS BIGINT), round(d / n, 4),
       CASE WHEN n < 10 THEN 'unknown' ELSE 'regression' END FROM a)
UNION ALL
SELECT * FROM (WITH a AS (SELECT count(c_nationkey) AS n, count(DISTINCT c_nationkey) AS d FROM customer)
SELECT 'c_nationkey', CAST(n AS BIGINT), CAST(d AS BIGINT), round(d / n, 4),
       CASE WHEN n < 10 THEN 'unknown' WHEN d > 50 AND d / n > 0.3 THEN 'regression' ELSE 'classification' END FROM a)""")
def q_task_type(spark, sf):
    return (types.task_type(I.table(spark, sf, "orders"), "o_orderpriority")
            .unionByName(types.task_type(I.table(spark, sf, "orders"), "o_totalprice"))
            .unionByName(types.task_type(I.table(spark, sf, "customer"), "c_nationkey")))


# --------------------------------------------------------------------------- scores

_DLS = DL
_DLS_COLS = DL_COLS


@register("health_score", f"""
WITH t AS {_DLS},
a AS (SELECT count(*) AS r, {' + '.join(f'count_if({c} IS NULL)' for c in _DLS_COLS)} AS mc FROM t),
d AS (SELECT coalesce(sum(n - 1), 0) AS dup FROM (SELECT count(*) AS n FROM t GROUP BY ALL_COLS)),
k AS (SELECT ({' + '.join(f'CASE WHEN count(DISTINCT {c}) <= 1 THEN 1 ELSE 0 END' for c in _DLS_COLS)}) AS const FROM t),
m AS (SELECT ({' + '.join(f'CASE WHEN count(try_cast({c} AS DOUBLE)) > 0 AND count(try_cast({c} AS DOUBLE)) < count({c}) THEN 1 ELSE 0 END' for c in ['text', 'lang', 'source'])}) AS mixed FROM t),
p AS (SELECT least(round(mc * 100.0 / (r * {len(_DLS_COLS)}), 2) * 2, 30.0) AS mp,
             least(round(dup * 100.0 / r, 2) * 1.5, 20.0) AS dp, const * 5.0 AS cp, mixed * 10.0 AS tp FROM a, d, k, m),
s AS (SELECT *, round(greatest(0.0, 100.0 - mp - dp - cp - tp), 1) AS score FROM p)
SELECT round(mp, 2) AS missing_penalty, round(dp, 2) AS duplicate_penalty, cp AS constant_penalty, tp AS type_penalty,
       score, CASE WHEN score >= 90 THEN 'A - Excellent' WHEN score >= 80 THEN 'B - Good' WHEN score >= 70 THEN 'C - Fair'
                   WHEN score >= 60 THEN 'D - Poor' ELSE 'F - Critical Issues' END AS grade FROM s""".replace(
    "ALL_COLS", ", ".join(_DLS_COLS)))
def q_health_score(spark, sf):
    from tablescope.operators import scores
    return scores.health_score(I.docs_labels(spark, sf))


# --------------------------------------------------------------------------- correlations

def _pairs(cols):
    return [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]]


def _avg_rank(c: str) -> str:
    return f"(rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0)"


def _pair_sql(tbl: str, a: str, b: str) -> str:
    """One pair: n, raw pearson r and spearman rho over rows where both are present."""
    return (f"SELECT '{a}' AS feature1, '{b}' AS feature2, count(*) AS n, corr(x, y) AS r, corr(rx, ry) AS rho "
            f"FROM (SELECT {a} AS x, {b} AS y, {_avg_rank(a)} AS rx, {_avg_rank(b)} AS ry FROM {tbl} "
            f"WHERE {a} IS NOT NULL AND {b} IS NOT NULL AND NOT isnan({a}::DOUBLE) AND NOT isnan({b}::DOUBLE))")


def _pairs_cte(tbl: str, cols) -> str:
    return U([_pair_sql(tbl, a, b) for a, b in _pairs(cols)])


_STRENGTH = ("CASE WHEN abs(coalesce(r, 0)) >= 0.9 THEN 'very_strong' WHEN abs(coalesce(r, 0)) >= 0.7 THEN 'strong' "
             "WHEN abs(coalesce(r, 0)) >= 0.5 THEN 'moderate' WHEN abs(coalesce(r, 0)) >= 0.3 THEN 'weak' "
             "ELSE 'very_weak' END")


def _corr_pairs_sql(tbl, cols):
    return f"""
WITH p AS ({_pairs_cte(tbl, cols)})
SELECT feature1, feature2, CAST(n AS BIGINT) AS n, round(r, 4) AS pearson, round(rho, 4) AS spearman,
       {_STRENGTH} AS strength FROM p"""


@register("corr_pairs", _corr_pairs_sql("lineitem", LINEITEM_NUM))
def q_corr_pairs(spark, sf):
    from tablescope.operators import assoc
    return assoc.corr_pairs(I.table(spark, sf, "lineitem"), LINEITEM_NUM)


@register("corr_pairs_nullable", _corr_pairs_sql(CO, CO_NUM))
def q_corr_pairs_nullable(spark, sf):
    from tablescope.operators import assoc
    return assoc.corr_pairs(I.customer_orders(spark, sf), CO_NUM)


def _kendall_sql(tbl, cols):
    """tau-b over all ordered pairs of rows; each pair of columns over the rows where both are present."""
    both = " UNION ALL ".join(f"SELECT '{a}' AS feature1, '{b}' AS feature2, CAST({a} AS DOUBLE) AS x, CAST({b} AS DOUBLE) AS y FROM {tbl} "
                              f"WHERE {a} IS NOT NULL AND {b} IS NOT NULL" for i, a in enumerate(cols) for b in cols[i + 1:])
    return f"""
WITH v AS ({both}),
s AS (SELECT p.feature1, p.feature2, sign(p.x - q.x) AS sx, sign(p.y - q.y) AS sy
      FROM v p JOIN v q ON p.feature1 = q.feature1 AND p.feature2 = q.feature2),
n AS (SELECT feature1, feature2, count(*) AS n FROM v GROUP BY ALL),
t AS (SELECT feature1, feature2, sum(sx * sy) / nullif(sqrt(sum(abs(sx))) * sqrt(sum(abs(sy))), 0) AS tau FROM s GROUP BY ALL)
SELECT feature1, feature2, CAST(n AS BIGINT) AS n, round(tau, 4) AS kendall FROM t JOIN n USING (feature1, feature2)"""


@register("corr_kendall", _kendall_sql(CO, CO_NUM))
def q_corr_kendall(spark, sf):
    from tablescope.operators import kendall
    return kendall.corr_kendall(I.customer_orders(spark, sf), CO_NUM)


@register("corr_kendall_part", _kendall_sql("part", ["p_size", "p_retailprice", "p_partkey"]))
def q_corr_kendall_part(spark, sf):
    from tablescope.operators import kendall
    return kendall.corr_kendall(I.table(spark, sf, "part"), ["p_size", "p_retailprice", "p_partkey"])


@register("corr_top_pairs", f"""
WITH p AS ({_pairs_cte(CO, CO_NUM)})
SELECT feature1, feature2, CAST(n AS BIGINT) AS n, round(r, 4) AS pearson FROM p WHERE r IS NOT NULL
ORDER BY abs(r) DESC, feature1, feature2 LIMIT 5""")
def q_corr_top_pairs(spark, sf):
    from tablescope.operators import assoc
    return assoc.corr_top_pairs(I.customer_orders(spark, sf), CO_NUM)


@register("corr_strong", f"""
WITH p AS ({_pairs_cte(CO, CO_NUM)})
SELECT feature1, feature2, CAST(n AS BIGINT) AS n, round(r, 4) AS pearson, abs(r) > 0.9 AS very_strong,
       CASE WHEN r > 0 THEN 'positive' ELSE 'negative' END AS direction
FROM p WHERE abs(r) > 0.7""")
def q_corr_strong(spark, sf):
    from tablescope.operators import assoc
    return assoc.corr_strong(I.customer_orders(spark, sf), CO_NUM)


@register("corr_detailed", f"""
WITH p AS ({_pairs_cte(CO, CO_NUM)})
SELECT feature1, feature2, CAST(n AS BIGINT) AS n, round(r, 4) AS pearson, round(rho, 4) AS spearman,
       {_STRENGTH} AS strength, CASE WHEN r > 0 THEN 'positive' ELSE 'negative' END AS direction
FROM p WHERE abs(r) > 0.3 AND n > 10""")
def q_corr_detailed(spark, sf):
    from tablescope.operators import assoc
    return assoc.corr_detailed(I.customer_orders(spark, sf), CO_NUM).drop("p_value", "significant")


@register("corr_network_edges", f"""
WITH p AS ({_pairs_cte(CO, CO_NUM)})
SELECT feature1, feature2, round(r, 4) AS pearson, round(abs(r), 4) AS weight FROM p WHERE abs(r) >= 0.4""")
def q_corr_network_edges(spark, sf):
    from tablescope.operators import assoc
    return assoc.corr_network_edges(I.customer_orders(spark, sf), CO_NUM, threshold=0.4)


@register("corr_distribution", f"""
WITH p AS ({_pairs_cte(CO, CO_NUM)}),
b AS (SELECT CAST(least(floor((r + 1.0) / 0.1), 19) AS INTEGER) AS bin FROM p WHERE r IS NOT NULL)
SELECT bin, round(bin * 0.1 - 1.0, 4) AS lower, round((bin + 1) * 0.1 - 1.0, 4) AS upper,
       CAST(count(*) AS BIGINT) AS pairs FROM b GROUP BY bin""")
def q_corr_distribution(spark, sf):
    from tablescope.operators import assoc
    return assoc.corr_distribution(I.customer_orders(spark, sf), CO_NUM)


_FM = f"""(SELECT {', '.join(f'coalesce({c}, (SELECT median({c}) FROM s)) AS {c}' for c in CO_NUM)}
FROM s)"""


@register("corr_advanced_summary", f"""
WITH base AS {CO}, s AS (SELECT {', '.join(CO_NUM)} FROM base
                        WHERE ({' + '.join(f'CASE WHEN {c} IS NOT NULL THEN 1 ELSE 0 END' for c in CO_NUM)}) >= 2),
p AS ({_pairs_cte(_FM, CO_NUM)}), q AS (SELECT * FROM p WHERE r IS NOT NULL)
SELECT CAST({len(CO_NUM)} AS BIGINT) AS features, round(avg(abs(r)), 4) AS mean_abs_corr,
       round(max(abs(r)), 4) AS max_abs_corr, round(min(abs(r)), 4) AS min_abs_corr,
       CAST(count_if(abs(r) > 0.8) AS BIGINT) AS pairs_above_08,
       CAST((SELECT count(DISTINCT f) FROM (SELECT feature1 AS f FROM q WHERE abs(r) > 0.8
             UNION ALL SELECT feature2 FROM q WHERE abs(r) > 0.8)) AS BIGINT) AS features_in_high_pairs,
       (SELECT feature1 FROM q WHERE abs(r) > 0.8 ORDER BY abs(r) DESC LIMIT 1) AS top_feature1,
       (SELECT feature2 FROM q WHERE abs(r) > 0.8 ORDER BY abs(r) DESC LIMIT 1) AS top_feature2
FROM q""")
def q_corr_advanced_summary(spark, sf):
    from tablescope.operators import assoc
    return assoc.corr_advanced_summary(I.customer_orders(spark, sf), CO_NUM)


@register("multicollinearity_groups", f"""
WITH p AS ({_pairs_cte(CO, CO_NUM)}), e AS (SELECT feature1, feature2 FROM p WHERE abs(r) > 0.8),
n AS (SELECT feature1 AS f FROM e UNION SELECT feature2 FROM e),
c AS (SELECT f, (SELECT min(x) FROM (SELECT feature1 AS x FROM e WHERE feature2 = f OR feature1 = f
                                     UNION ALL SELECT feature2 FROM e WHERE feature1 = f OR feature2 = f)) AS comp FROM n)
SELECT comp AS component, string_agg(f, ',' ORDER BY f) AS features, CAST(count(*) AS BIGINT) AS size,
       CASE WHEN count(*) > 2 THEN 'high' ELSE 'medium' END AS severity FROM c GROUP BY comp""")
def q_multicollinearity_groups(spark, sf):
    from tablescope.operators import assoc
    return assoc.multicollinearity_groups(I.customer_orders(spark, sf), CO_NUM)


@register("linear_fit", """
SELECT 'n_orders' AS x, 'total_spent' AS y, CAST(regr_count(total_spent, n_orders) AS BIGINT) AS n,
       round(regr_slope(total_spent, n_orders), 4) AS slope, round(regr_intercept(total_spent, n_orders), 4) AS intercept,
       round(regr_r2(total_spent, n_orders), 4) AS r2, round(corr(n_orders, total_spent), 4) AS r
FROM """ + CO)
def q_linear_fit(spark, sf):
    from tablescope.operators import assoc
    return assoc.linear_fit(I.customer_orders(spark, sf), "n_orders", "total_spent").drop("p_value")


@register("quick_corr", f"""
WITH p AS ({_pairs_cte(CO, CO_NUM)})
SELECT feature1, feature2, round(r, 4) AS pearson, CASE WHEN abs(r) > 0.7 THEN 'strong' ELSE 'moderate' END AS label
FROM p WHERE abs(r) > 0.3""")
def q_quick_corr(spark, sf):
    from tablescope.operators import assoc
    return assoc.quick_corr(I.customer_orders(spark, sf), CO_NUM)


@register("quick_skew", U([f"""
SELECT '{c}' AS "column", round(avg({c}), 4) AS mean, round(median({c}), 4) AS median,
       round(abs(avg({c}) - median({c})) / NULLIF(abs(median({c})), 0), 4) AS relative_gap,
       coalesce(abs(avg({c}) - median({c})) / NULLIF(abs(median({c})), 0) > 0.1, false) AS skewed FROM {CO}"""
                            for c in CO_NUM]))
def q_quick_skew(spark, sf):
    from tablescope.operators import assoc
    return assoc.quick_skew(I.customer_orders(spark, sf), CO_NUM)


# --------------------------------------------------------------------------- tests & categorical association

def _chi2_sql(src: str, a: str, b: str, fill: str, yates: bool = True) -> str:
    """SELECT feature1, feature2, n, rows, cols, chi2 (raw), dof, low_expected."""
    core = f"""
ct AS (SELECT coalesce(CAST({a} AS VARCHAR), '{fill}') AS a, coalesce(CAST({b} AS VARCHAR), '{fill}') AS b,
              count(*) AS o FROM {src} GROUP BY 1, 2),
rr AS (SELECT a, sum(o) AS R FROM ct GROUP BY a), cc AS (SELECT b, sum(o) AS C FROM ct GROUP BY b),
sh AS (SELECT (SELECT count(*) FROM rr) AS nr, (SELECT count(*) FROM cc) AS nc, (SELECT sum(o) FROM ct) AS N,
              (SELECT min(R) FROM rr) AS minR, (SELECT min(C) FROM cc) AS minC),
cell AS (SELECT rr.a, cc.b, coalesce(ct.o, 0) AS o, rr.R * cc.C / sh.N AS e, sh.nr, sh.nc
         FROM rr CROSS JOIN cc CROSS JOIN sh LEFT JOIN ct ON ct.a = rr.a AND ct.b = cc.b),
x AS (SELECT CASE WHEN {str(yates).lower()} AND max(nr) = 2 AND max(nc) = 2
                  THEN sum(pow(o + sign(e - o) * least(0.5, abs(e - o)) - e, 2) / e)
                  ELSE sum(pow(o - e, 2) / e) END AS chi2 FROM cell)
SELECT '{a}' AS feature1, '{b}' AS feature2, CAST(N AS BIGINT) AS n, CAST(nr AS BIGINT) AS rows,
       CAST(nc AS BIGINT) AS cols, greatest(0.0, chi2) AS chi2, CAST((nr - 1) * (nc - 1) AS BIGINT) AS dof,
       minR * minC / N < 5 AS low_expected FROM sh, x"""
    return core


def _even_dof_p(x: str, dof: str) -> str:
    """Chi-square upper tail for even dof: exp(-x/2) * sum_{j < dof/2} (x/2)^j / j!."""
    return (f"(exp(-({x}) / 2) * (SELECT sum(pow(({x}) / 2, j) / factorial(CAST(j AS INTEGER))) "
            f"FROM range(CAST(({dof}) / 2 AS BIGINT)) t(j)))")


def _chi_square_sql(src: str, a: str, b: str, fill: str, with_p: bool = True) -> str:
    p = _even_dof_p("chi2", "dof")
    pcols = f"round({p}, 6) AS p_value, {p} < 0.05 AS significant, " if with_p else ""
    return f"""
WITH {_chi2_sql(src, a, b, fill).strip().replace(chr(10) + "SELECT '", chr(10) + ", res AS (SELECT '", 1)})
SELECT feature1, feature2, n, rows, cols, round(chi2, 4) AS chi2, dof, {pcols}
       round(sqrt(chi2 / NULLIF(n * (least(rows, cols) - 1), 0)), 4) AS cramers_v, low_expected FROM res"""


@register("chi_square", _chi_square_sql("orders", "o_orderstatus", "o_orderpriority", "Unknown"))
def q_chi_square(spark, sf):
    from tablescope.operators import stat_tests
    return stat_tests.chi_square(I.table(spark, sf, "orders"), "o_orderstatus", "o_orderpriority")


@register("chi_square_flags", _chi_square_sql("lineitem", "l_returnflag", "l_linestatus", "Unknown"))
def q_chi_square_flags(spark, sf):
    from tablescope.operators import stat_tests
    return stat_tests.chi_square(I.table(spark, sf, "lineitem"), "l_returnflag", "l_linestatus")


@register("chi_square_yates", _chi_square_sql("labels", "quality", "toxic", "Unknown", with_p=False))
def q_chi_square_yates(spark, sf):
    from tablescope.operators import stat_tests
    return stat_tests.chi_square(I.table(spark, sf, "labels"), "quality", "toxic").drop("p_value", "significant")


@register("contingency", f"""
WITH ct AS (SELECT coalesce(CAST(quality AS VARCHAR), 'Unknown') AS quality, coalesce(lang, 'Unknown') AS lang,
                   count(*) AS n FROM {DL} GROUP BY 1, 2)
SELECT quality, lang, CAST(n AS BIGINT) AS n, {PCT('n', 'sum(n) OVER (PARTITION BY quality)')} AS row_pct,
       {PCT('n', 'sum(n) OVER (PARTITION BY lang)')} AS col_pct, {PCT('n', 'sum(n) OVER ()')} AS total_pct FROM ct""")
def q_contingency(spark, sf):
    from tablescope.operators import stat_tests
    return stat_tests.contingency(I.docs_labels(spark, sf), "quality", "lang")


def _cat_deps_sql() -> str:
    cols = ["length_band", "quality", "toxic"]
    parts = []
    for i, a in enumerate(cols):
        for b in cols[i + 1:]:
            parts.append(f"SELECT * FROM ({_chi_square_sql(I.BANDED_DOCUMENTS_SQL, a, b, 'Missing')})")
    return f"""
WITH u AS ({U(parts)})
SELECT feature1, feature2, cramers_v, chi2, p_value,
       CASE WHEN cramers_v >= 0.5 THEN 'very_strong' WHEN cramers_v >= 0.3 THEN 'strong'
            WHEN cramers_v >= 0.15 THEN 'moderate' WHEN cramers_v >= 0.05 THEN 'weak' ELSE 'negligible' END AS strength
FROM u WHERE rows * cols >= 4 AND p_value < 0.05 AND cramers_v > 0.1"""


@register("categorical_dependencies", _cat_deps_sql())
def q_categorical_dependencies(spark, sf):
    from tablescope.operators import stat_tests
    return stat_tests.categorical_dependencies(I.banded_documents(spark, sf), ["length_band", "quality", "toxic"])


def _group_effect_sql(src: str, g: str, x: str, kruskal: bool) -> str:
    stat = ("round(h, 4)" if kruskal else "round((ssb_k / (k - 1)) / (ssw / (nk - k)), 4)")
    ptail = f"round({_even_dof_p('h', 'k - 1')}, 6) AS p_value, {_even_dof_p('h', 'k - 1')} < 0.05 AS significant, " \
        if kruskal else ""
    return f"""
WITH d AS (SELECT coalesce(CAST({g} AS VARCHAR), 'Missing') AS g, CAST({x} AS DOUBLE) AS x FROM {src} WHERE {x} IS NOT NULL),
gs AS (SELECT g, count(*) AS n, avg(x) AS m, var_samp(x) AS v FROM d GROUP BY g),
al AS (SELECT count(*) AS N, avg(x) AS M, var_samp(x) AS V FROM d),
kept AS (SELECT * FROM gs WHERE n > 2),
ks AS (SELECT count(*) AS k, sum(n) AS nk, sum(n * m) / sum(n) AS mk FROM kept),
kd AS (SELECT d.* FROM d JOIN kept USING (g)),
rk AS (SELECT g, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS r FROM kd),
ties AS (SELECT sum(pow(t, 3) - t) AS tt FROM (SELECT count(*) AS t FROM kd GROUP BY x)),
rs AS (SELECT sum(pow(R, 2) / ng) AS sr2 FROM (SELECT g, sum(r) AS R, count(*) AS ng FROM rk GROUP BY g)),
s AS (SELECT al.N, ks.k, ks.nk,
             (SELECT sum(n * pow(m - ks.mk, 2)) FROM kept) AS ssb_k,
             (SELECT sum((n - 1) * coalesce(v, 0)) FROM kept) AS ssw,
             (SELECT sum(n * pow(m - al.M, 2)) FROM kept) AS ssb_all, (al.N - 1) * al.V AS sst,
             (12.0 / (ks.nk * (ks.nk + 1)) * rs.sr2 - 3 * (ks.nk + 1)) / (1 - ties.tt / (pow(ks.nk, 3) - ks.nk)) AS h
      FROM al, ks, rs, ties)
SELECT '{g}' AS categorical_feature, '{x}' AS numeric_feature, '{'kruskal_wallis' if kruskal else 'anova'}' AS test,
       {stat} AS statistic, {ptail}
       round(coalesce(ssb_all / NULLIF(sst, 0), 0.0), 4) AS eta_squared,
       CASE WHEN coalesce(ssb_all / NULLIF(sst, 0), 0.0) >= 0.14 THEN 'large'
            WHEN coalesce(ssb_all / NULLIF(sst, 0), 0.0) >= 0.06 THEN 'medium'
            WHEN coalesce(ssb_all / NULLIF(sst, 0), 0.0) >= 0.01 THEN 'small' ELSE 'negligible' END AS effect,
       CAST(k AS BIGINT) AS groups
FROM s WHERE N >= 10 AND k >= 2"""


@register("group_effect", _group_effect_sql("lineitem", "l_returnflag", "l_extendedprice", kruskal=False))
def q_group_effect(spark, sf):
    from tablescope.operators import stat_tests
    return stat_tests.group_effect(I.table(spark, sf, "lineitem"), "l_returnflag", "l_extendedprice",
                                   method="anova").drop("p_value", "significant")


@register("group_effect_kruskal", _group_effect_sql("events", "event_type", "value", kruskal=True))
def q_group_effect_kruskal(spark, sf):
    from tablescope.operators import stat_tests
    return stat_tests.group_effect(I.table(spark, sf, "events"), "event_type", "value", method="kruskal")


def _jb_sql(tbl: str, cols) -> str:
    return U([f"""
SELECT * FROM (WITH s AS (SELECT avg({c}) AS m FROM {tbl}),
a AS (SELECT count({c}) AS n, avg(pow({c} - s.m, 3)) / pow(avg(pow({c} - s.m, 2)), 1.5) AS sk,
             avg(pow({c} - s.m, 4)) / pow(avg(pow({c} - s.m, 2)), 2) - 3 AS ku FROM {tbl}, s),
b AS (SELECT *, n / 6.0 * (sk * sk + ku * ku / 4.0) AS jb FROM a)
SELECT '{c}' AS "column", CAST(n AS BIGINT) AS n, round(sk, 4) AS skewness, round(ku, 4) AS kurtosis,
       round(jb, 4) AS jb_stat, round(exp(-jb / 2.0), 6) AS jb_pvalue, exp(-jb / 2.0) > 0.05 AS jb_normal FROM b)"""
              for c in cols])


@register("jarque_bera", _jb_sql("lineitem", LINEITEM_NUM))
def q_jarque_bera(spark, sf):
    from tablescope.operators import stat_tests
    return stat_tests.jarque_bera(I.table(spark, sf, "lineitem"), LINEITEM_NUM)


@register("distribution_shape", f"""
WITH j AS ({_jb_sql('orders', ['o_totalprice', 'o_custkey'])})
SELECT "column", n, skewness, kurtosis,
       CASE WHEN abs(skewness) < 0.5 THEN 'approximately_normal' WHEN skewness > 1 THEN 'right_skewed'
            WHEN skewness < -1 THEN 'left_skewed' ELSE 'moderately_skewed' END AS shape, jb_normal,
       abs(skewness) > 1 OR NOT jb_normal AS transformation_needed FROM j""")
def q_distribution_shape(spark, sf):
    from tablescope.operators import stat_tests
    return stat_tests.distribution_shape(I.table(spark, sf, "orders"), ["o_totalprice", "o_custkey"])


@register("normality_test")
def q_normality_test(spark, sf):
    from tablescope.operators import stat_tests
    return stat_tests.normality_test(I.table(spark, sf, "orders"), "o_totalprice")


# --------------------------------------------------------------------------- target suite

def _decile_bin_sql(x: str, edges: str) -> str:
    terms = [f"CASE WHEN {edges}[1] < {x} THEN 1 ELSE 0 END"] + [
        f"CASE WHEN {edges}[{k}] > {edges}[{k - 1}] AND {edges}[{k}] < {x} THEN 1 ELSE 0 END" for k in range(2, 10)]
    return f"CAST(({' + '.join(terms)}) AS VARCHAR)"


_DEC = "[0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]"


@register("mutual_information", f"""
WITH e AS (SELECT quantile_cont(o_totalprice, {_DEC}) AS et, quantile_cont(o_custkey, {_DEC}) AS ec FROM orders),
s AS (SELECT o_orderpriority AS y, 'o_totalprice' AS feature, 'numeric' AS type, {_decile_bin_sql('o_totalprice', 'et')} AS x
      FROM orders, e WHERE o_totalprice IS NOT NULL
      UNION ALL SELECT o_orderpriority, 'o_custkey', 'numeric', {_decile_bin_sql('o_custkey', 'ec')} FROM orders, e
      WHERE o_custkey IS NOT NULL
      UNION ALL SELECT o_orderpriority, 'o_orderstatus', 'categorical', o_orderstatus FROM orders),
j AS (SELECT feature, type, x, y, count(*) AS nxy FROM s WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY ALL),
m AS (SELECT *, sum(nxy) OVER (PARTITION BY feature, x) AS nx, sum(nxy) OVER (PARTITION BY feature, y) AS ny,
             sum(nxy) OVER (PARTITION BY feature) AS N FROM j)
SELECT feature, type, CAST(max(N) AS BIGINT) AS n,
       round(greatest(0.0, sum(nxy / N * ln(nxy * N / (nx * ny)))), 4) AS mi FROM m GROUP BY feature, type""")
def q_mutual_information(spark, sf):
    from tablescope.operators import target
    o = I.table(spark, sf, "orders").select("o_totalprice", "o_custkey", "o_orderstatus", "o_orderpriority")
    return target.mutual_information(o, "o_orderpriority")


_TA_NUM = ["c_acctbal", "total_spent", "avg_order"]


@register("target_associations", f"""
WITH p AS ({U([_pair_sql(CO, c, 'n_orders') for c in _TA_NUM])}),
num AS (SELECT feature1 AS feature, n, CASE WHEN abs(coalesce(r, 0)) >= abs(coalesce(rho, 0)) THEN 'pearson'
                                         ELSE 'spearman' END AS method,
               CASE WHEN abs(coalesce(r, 0)) >= abs(coalesce(rho, 0)) THEN r ELSE rho END AS score FROM p WHERE n > 10),
cv AS (SELECT * FROM ({_chi_square_sql(CO, 'c_mktsegment', 'n_orders', 'Missing', with_p=False)})),
u AS (SELECT feature, CAST(n AS BIGINT) AS n, method, score FROM num
      UNION ALL SELECT 'c_mktsegment', n, 'cramers_v', cramers_v FROM cv)
SELECT feature, n, method, round(score, 4) AS score FROM u WHERE abs(score) > 0.1""")
def q_target_associations(spark, sf):
    from tablescope.operators import target
    return target.target_associations(I.customer_orders(spark, sf), "n_orders",
                                      _TA_NUM + ["c_mktsegment"])


@register("feature_importance", f"""
WITH p AS ({U([_pair_sql(CO, c, 'n_orders') for c in _TA_NUM])}),
cv AS (SELECT * FROM ({_chi_square_sql(CO, 'c_mktsegment', 'n_orders', 'Missing', with_p=False)})),
u AS (SELECT feature1 AS feature, 'abs_pearson' AS method, abs(r) AS importance FROM p WHERE n > 10
      UNION ALL SELECT 'c_mktsegment', 'cramers_v', cramers_v FROM cv)
SELECT feature, method, round(importance, 4) AS importance FROM u WHERE importance IS NOT NULL""")
def q_feature_importance(spark, sf):
    from tablescope.operators import target
    return target.feature_importance(I.customer_orders(spark, sf), "n_orders", _TA_NUM + ["c_mktsegment"])


def _interaction_sql() -> str:
    feats = ["c_acctbal", "total_spent", "avg_order", "n_orders"]
    pairs = _pairs(feats)
    singles = U([f"SELECT '{c}' AS f, abs(corr({c}, c_nationkey)) AS rs FROM {CO}" for c in feats])
    inter = U([f"SELECT '{a}' AS feature1, '{b}' AS feature2, abs(corr({a} * {b}, c_nationkey)) AS ri FROM {CO}"
               for a, b in pairs])
    return f"""
WITH s AS ({singles}), i AS ({inter}),
t AS (SELECT i.*, greatest(coalesce(s1.rs, 0), coalesce(s2.rs, 0)) AS best FROM i
      JOIN s s1 ON s1.f = i.feature1 JOIN s s2 ON s2.f = i.feature2 WHERE ri IS NOT NULL)
SELECT feature1, feature2, round(ri, 4) AS interaction_corr, round(best, 4) AS best_single,
       round(ri - best, 4) AS gain, ri - best > 0 AS beneficial FROM t"""


@register("interaction_strength", _interaction_sql())
def q_interaction_strength(spark, sf):
    from tablescope.operators import target
    co = I.customer_orders(spark, sf).select("c_nationkey", "c_acctbal", "total_spent", "avg_order", "n_orders")
    return target.interaction_strength(co, "c_nationkey")


@register("mi_bands", f"""
WITH m AS ({ORACLE['mutual_information']}),
q AS (SELECT quantile_cont(mi, 0.8) AS hi, quantile_cont(mi, 0.2) AS lo, avg(CASE WHEN type = 'numeric' THEN mi END) AS mn,
             avg(CASE WHEN type = 'categorical' THEN mi END) AS mc FROM m)
SELECT feature, type, mi, CASE WHEN mi > hi THEN 'high' WHEN mi < lo THEN 'low' ELSE 'middle' END AS band,
       round(mn / NULLIF(mc, 0), 4) AS numeric_to_categorical,
       CASE WHEN mn / NULLIF(mc, 0) > 1.5 THEN 'numeric' WHEN mc / NULLIF(mn, 0) > 1.5 THEN 'categorical' END AS dominant_type
FROM m, q""")
def q_mi_bands(spark, sf):
    from tablescope.operators import target
    o = I.table(spark, sf, "orders").select("o_totalprice", "o_custkey", "o_orderstatus", "o_orderpriority")
    return target.mi_bands(target.mutual_information(o, "o_orderpriority"))


# --------------------------------------------------------------------------- quality checks

def _format_checks_sql(tbl: str, cols: Sequence[str]) -> str:
    return U([f"""
SELECT '{c}' AS "column", CAST(count({c}) AS BIGINT) AS n, CAST(count_if(regexp_matches({c}, '^\\s|\\s$')) AS BIGINT) AS padded,
       CAST(count(DISTINCT {c}) - count(DISTINCT lower({c})) AS BIGINT) AS case_variants,
       CAST(count_if(regexp_matches({c}, '[^\\w\\s\\-\\.\\,\\(\\)\\[\\]]')) AS BIGINT) AS unusual,
       count_if(regexp_matches({c}, '[^\\w\\s\\-\\.\\,\\(\\)\\[\\]]')) > count({c}) * 0.1 AS encoding_issue,
       CAST(count_if(regexp_matches({c}, '\\\\u[0-9a-fA-F]{{4}}|\\\\x[0-9a-fA-F]{{2}}')) AS BIGINT) AS escapes,
       CAST(count_if(lower({c}) IN ('null', 'none', 'na', 'n/a', 'nan', 'nil', 'undefined', '')) AS BIGINT) AS null_like,
       count_if(regexp_matches({c}, '[,;|]')) > count({c}) * 0.3 AND
       (CASE WHEN bool_or(contains({c}, ',')) THEN 1 ELSE 0 END + CASE WHEN bool_or(contains({c}, ';')) THEN 1 ELSE 0 END
        + CASE WHEN bool_or(contains({c}, '|')) THEN 1 ELSE 0 END) > 1 AS mixed_separators
FROM {tbl}""" for c in cols])


@register("format_checks", _format_checks_sql("part", PART_STR))
def q_format_checks(spark, sf):
    from tablescope.operators import quality
    return quality.format_checks(I.table(spark, sf, "part"), PART_STR)


_RR = "(SELECT o_totalprice, o_totalprice / 5000 - 20 AS customer_age, o_totalprice / 5000 AS discount_rate FROM orders)"


@register("range_rules", f"""
SELECT 'o_totalprice' AS "column", 'negative_money' AS rule, CAST(count_if(o_totalprice < 0) AS BIGINT) AS n_invalid FROM {_RR}
UNION ALL SELECT 'customer_age', 'age_range', CAST(count_if(customer_age < 0 OR customer_age > 150) AS BIGINT) FROM {_RR}
UNION ALL SELECT 'discount_rate', 'percent_range', CAST(count_if(discount_rate < 0 OR discount_rate > 100) AS BIGINT) FROM {_RR}""")
def q_range_rules(spark, sf):
    from pyspark.sql import functions as F
    from tablescope.operators import quality
    o = I.table(spark, sf, "orders").select("o_totalprice", (F.col("o_totalprice") / 5000 - 20).alias("customer_age"),
                                            (F.col("o_totalprice") / 5000).alias("discount_rate"))
    return quality.range_rules(o)


_MDF = ("(SELECT CASE WHEN o_orderstatus = 'F' THEN strftime(o_orderdate, '%m/%d/%Y') "
        "WHEN o_orderstatus = 'O' THEN strftime(o_orderdate, '%Y-%m-%d') ELSE strftime(o_orderdate, '%d.%m.%Y') END "
        "AS mixed_dates, strftime(o_orderdate, '%Y-%m-%d') AS iso_dates FROM orders)")


@register("mixed_date_formats", U([f"""
SELECT '{c}' AS "column", array_to_string(list_sort(list_distinct(list(CASE WHEN contains({c}, '/') THEN 'slash_format'
       WHEN contains({c}, '-') THEN 'dash_format' WHEN contains({c}, '.') THEN 'dot_format' END))), ',') AS formats,
       len(list_distinct(list(CASE WHEN contains({c}, '/') THEN 'slash_format' WHEN contains({c}, '-') THEN 'dash_format'
       WHEN contains({c}, '.') THEN 'dot_format' END))) > 1 AS inconsistent FROM {_MDF}""" for c in ["mixed_dates", "iso_dates"]]))
def q_mixed_date_formats(spark, sf):
    from pyspark.sql import functions as F
    from tablescope.operators import quality
    o = I.table(spark, sf, "orders")
    d = o.select(F.when(F.col("o_orderstatus") == "F", F.date_format("o_orderdate", "MM/dd/yyyy"))
                 .when(F.col("o_orderstatus") == "O", F.date_format("o_orderdate", "yyyy-MM-dd"))
                 .otherwise(F.date_format("o_orderdate", "dd.MM.yyyy")).alias("mixed_dates"),
                 F.date_format("o_orderdate", "yyyy-MM-dd").alias("iso_dates"))
    return quality.mixed_date_formats(d, ["mixed_dates", "iso_dates"])


_DL_NUM = ["doc_id", "n_chars", "quality", "toxic"]


def _warnings_sql() -> str:
    """Missing, numeric, categorical and dataset warnings, one SELECT per column and rule."""
    parts = [f"SELECT '{c}' AS \"column\", CASE WHEN p > 90 THEN 'critical_missing' ELSE 'high_missing' END AS warning, "
             f"CASE WHEN p > 90 THEN 'high' ELSE 'medium' END AS severity, round(p, 4) AS value "
             f"FROM (SELECT (count(*) - count({c})) * 100.0 / count(*) AS p FROM t) WHERE p > 50" for c in DL_COLS]
    for c in _DL_NUM:
        num = (f"(SELECT var_samp({c}) AS v, avg(pow({c} - (SELECT avg({c}) FROM t), 3)) / NULLIF(pow(var_pop({c}), 1.5), 0) AS sk, "
               f"count_if({c} IN (-999, -99, 999999, -1)) AS ph, count_if({c} < (SELECT lo FROM b WHERE c = '{c}') "
               f"OR {c} > (SELECT hi FROM b WHERE c = '{c}')) * 100.0 / count({c}) AS o FROM t)")
        parts += [f"SELECT '{c}', '{w}', '{sev}', round({val}, 4) FROM {num} WHERE {cond}" for w, sev, val, cond in [
            ("zero_variance", "medium", "v", "v < 1e-10"), ("many_outliers", "medium", "o", "o > 20"),
            ("extreme_skewness", "medium", "abs(sk)", "abs(sk) > 3"), ("suspicious_values", "high", "ph", "ph > 0")]]
    for c in ["text", "lang", "source"]:
        cat = (f"(SELECT count(*) AS u, count(*) / sum(n) AS ur, max(n) * 100.0 / sum(n) AS dom FROM "
               f"(SELECT count(*) AS n FROM t WHERE {c} IS NOT NULL GROUP BY {c}))")
        parts += [f"SELECT '{c}', '{w}', '{sev}', round({val}, 4) FROM {cat} WHERE {cond}" for w, sev, val, cond in [
            ("high_cardinality", "medium", "u", "ur > 0.8"), ("single_value_dominance", "medium", "dom", "dom > 95"),
            ("potential_id_column", "low", "ur", "ur > 0.95")]]
    parts += ["SELECT NULL, 'small_dataset', 'medium', count(*) FROM t HAVING count(*) < 100",
              f"SELECT NULL, 'high_dimensionality', 'high', round({len(DL_COLS)} / count(*), 4) FROM t HAVING count(*) < {len(DL_COLS)}"]
    return f"""
WITH t AS {DL}, q AS ({_iqr_cte('t', _DL_NUM)}),
b AS (SELECT c, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM q), w AS ({U(parts)})
SELECT "column", warning, severity, CAST(value AS DOUBLE) AS value FROM w"""


@register("warnings_report", _warnings_sql())
def q_warnings_report(spark, sf):
    from tablescope.operators import quality
    return quality.warnings_report(I.docs_labels(spark, sf))


@register("dataset_profile")
def q_dataset_profile(spark, sf):
    from tablescope.operators import quality
    return quality.dataset_profile(I.docs_labels(spark, sf))


@register("findings")
def q_findings(spark, sf):
    from tablescope.operators import findings
    return findings.findings(I.table(spark, sf, "orders"), target="o_orderpriority")


@register("key_findings")
def q_key_findings(spark, sf):
    from tablescope.operators import findings
    return findings.key_findings(I.docs_labels(spark, sf))


@register("action_items")
def q_action_items(spark, sf):
    from tablescope.operators import findings
    return findings.action_items(I.docs_labels(spark, sf))


@register("interaction_bands", f"""
WITH i AS ({_interaction_sql()})
SELECT round(quantile_cont(interaction_corr, 0.8), 4) AS q80, CAST(count(*) AS BIGINT) AS pairs,
       CAST(count_if(gain > 0.05) AS BIGINT) AS gain_above_005, CAST(count_if(beneficial) AS BIGINT) AS beneficial,
       round(avg(gain), 4) AS mean_gain, round(count_if(gain < 0) / count(*), 4) AS negative_share,
       round(count_if(gain < 0) / count(*), 4) > 0.7 AS mostly_negative FROM i""")
def q_interaction_bands(spark, sf):
    from tablescope.operators import target
    co = I.customer_orders(spark, sf).select("c_nationkey", "c_acctbal", "total_spent", "avg_order", "n_orders")
    return target.interaction_bands(target.interaction_strength(co, "c_nationkey"))


_LI_NUM = I.LINEITEM_COLS[:8]


@register("dataset_bands", f"""
WITH a AS (SELECT count(*) AS r, round(({' + '.join(f'count({c})' for c in I.LINEITEM_COLS)}) * 100.0 / (count(*) * 11), 2) AS density,
           {' + '.join(f'CASE WHEN count_if({c} IN (-999, -99, 999999, -1)) > 0 THEN 1 ELSE 0 END' for c in _LI_NUM)} AS high FROM lineitem),
p AS ({U([f"SELECT corr({x}, {y}) AS r FROM lineitem" for x, y in _pairs(_LI_NUM)])}),
k AS (SELECT count_if(abs(r) > 0.3) AS pairs FROM p)
SELECT CAST(r AS BIGINT) AS "rows", density, CAST(high AS BIGINT) AS high_warnings, CAST(pairs AS BIGINT) AS related_pairs,
       CASE WHEN pairs = 0 THEN 'none' WHEN pairs < 5 THEN 'few' WHEN pairs < 15 THEN 'many' ELSE 'very_many' END AS relationship_band,
       CASE WHEN r < 100 THEN 'tiny' WHEN r < 1000 THEN 'small' WHEN r < 10000 THEN 'medium' WHEN r < 100000 THEN 'large'
            ELSE 'very_large' END AS size_band,
       CASE WHEN density >= 95 THEN 'excellent' WHEN density >= 85 THEN 'good' WHEN density >= 70 THEN 'fair' ELSE 'poor' END AS completeness_band,
       CASE WHEN high = 0 THEN 'clean' WHEN high <= 3 THEN 'minor' WHEN high <= 6 THEN 'moderate' ELSE 'severe' END AS warning_band,
       'numeric' AS dominant_type FROM a, k""")
def q_dataset_bands(spark, sf):
    from tablescope.operators import findings
    return findings.dataset_bands(I.table(spark, sf, "lineitem"))


_OP_ORDERS = f"""
WITH q AS ({_iqr_cte('orders', ['o_orderkey', 'o_custkey', 'o_totalprice'])}),
b AS (SELECT *, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM q),
o AS ({_iqr_count('orders', ['o_orderkey', 'o_custkey', 'o_totalprice'])}),
w AS (SELECT count_if(oc * 100.0 / n > 20) AS many FROM b JOIN o ON b.c = o.c),
ph AS (SELECT {' + '.join(f'CASE WHEN count_if({c} IN (-999, -99, 999999, -1)) > 0 THEN 1 ELSE 0 END' for c in ['o_orderkey', 'o_custkey', 'o_totalprice'])} AS high FROM orders),
t AS (SELECT count(*) AS r, 6 AS k, {' + '.join(f'count({c})' for c, _ in ORDERS_COLS)} AS nn,
             {' + '.join(f'CASE WHEN count({c}) < count(*) THEN 1 ELSE 0 END' for c, _ in ORDERS_COLS)} AS cm,
             count(DISTINCT o_orderstatus) AS d1, count(o_orderstatus) AS n1,
             count(DISTINCT o_orderpriority) AS d2, count(o_orderpriority) AS n2 FROM orders),
f AS (SELECT *, CASE WHEN d1 >= 2 AND d1 <= 0.5 * n1 THEN 1 ELSE 0 END + CASE WHEN d2 >= 2 AND d2 <= 0.5 * n2 THEN 1 ELSE 0 END AS rc,
             CASE WHEN d1 >= 2 AND d1 <= 0.5 * n1 AND d1 > least(50.0, r * 0.05) THEN 1 ELSE 0 END
             + CASE WHEN d2 >= 2 AND d2 <= 0.5 * n2 AND d2 > least(50.0, r * 0.05) THEN 1 ELSE 0 END AS hc FROM t),"""


@register("complexity_score", _OP_ORDERS + """
s AS (SELECT *, round(30 * least(k / 100.0, 1.0) + 20 * least(hc / 10.0, 1.0) + 25.0 * cm / k + 25.0 * rc / k, 4) AS cs FROM f)
SELECT CAST(k AS BIGINT) AS columns, CAST(hc AS BIGINT) AS high_cardinality_columns, CAST(cm AS BIGINT) AS columns_with_missing,
       CAST(rc AS BIGINT) AS n_robust_categorical, cs AS complexity_score,
       CASE WHEN cs > 70 THEN 'High' WHEN cs < 30 THEN 'Low' ELSE 'Medium' END AS readiness_complexity FROM s""")
def q_complexity_score(spark, sf):
    from tablescope.operators import findings
    return findings.complexity_score(I.table(spark, sf, "orders"))


_PRIORITY_ORDERS = _OP_ORDERS + """
g AS (SELECT f.*, w.many, ph.high, round(nn * 100.0 / (r * k), 2) AS density, round((r * k - nn) * 100.0 / (r * k), 2) AS miss,
             (CASE WHEN d1 > 0.5 * n1 THEN 1 ELSE 0 END) / 1.0 AS heavy FROM f, w, ph),
p AS (SELECT *, round((least(miss / 50.0, 1.0) + heavy + least(many / 3.0, 1.0) + least(high / 10.0, 1.0)) / 4.0, 4) AS pc,
             CASE WHEN r >= 10000 THEN 1.0 WHEN r >= 1000 THEN 0.8 WHEN r >= 100 THEN 0.5 ELSE 0.2 END AS sf FROM g),
z AS (SELECT *, (density / 100 + sf + 0.6 + (1 - pc) + 1.0) / 5.0 AS score FROM p)"""


@register("investment_priority", _PRIORITY_ORDERS + """
SELECT density, CAST(sf AS DOUBLE) AS size_factor, CAST(0.6 AS DOUBLE) AS width_factor, pc AS processing_complexity,
       CAST(1.0 AS DOUBLE) AS target_factor, round(score, 4) AS investment_priority,
       CASE WHEN score >= 0.8 THEN 'very_high' WHEN score >= 0.6 THEN 'high' WHEN score >= 0.4 THEN 'medium' ELSE 'low' END AS priority_band
FROM z""")
def q_investment_priority(spark, sf):
    from tablescope.operators import findings
    return findings.investment_priority(I.table(spark, sf, "orders"), target="o_orderpriority")


def _issues_sql(tbl: str, strs: Sequence[str], range_sql: str | None = None) -> str:
    """Issues of text columns (no dates among them) and of the range rules, from the SQL of the single checks."""
    fc = _format_checks_sql(tbl, strs)
    parts = [f"""SELECT "column", '{name}' AS issue, {n} AS n_values FROM ({fc}) WHERE {cond}""" for name, n, cond in [
        ("padded", "padded", "padded > 0"), ("case_variants", "case_variants", "case_variants > 0"),
        ("unusual_characters", "unusual", "encoding_issue"), ("escapes", "escapes", "escapes > 0"),
        ("null_like", "null_like", "null_like > 0"), ("mixed_separators", "CAST(NULL AS BIGINT)", "mixed_separators")]]
    parts += [f"""SELECT '{c}', 'mixed_types', CAST(count(try_cast({c} AS DOUBLE)) AS BIGINT) FROM {tbl}
HAVING count(try_cast({c} AS DOUBLE)) > 0 AND count(try_cast({c} AS DOUBLE)) < count({c})""" for c in strs]
    if range_sql:
        parts.append(f'SELECT "column", rule, n_invalid FROM ({range_sql}) WHERE n_invalid > 0')
    return U(parts)


def _rule_facts_ctes(tbl: str, cols, nums, strs, classes: str, range_sql: str | None = None) -> str:
    """CTE ``facts``: what the rules read beside the profile, for a target of classes."""
    skewed = " + ".join(f"CASE WHEN abs((SELECT avg(pow({c} - m, 3)) / pow(avg(pow({c} - m, 2)), 1.5) FROM {tbl} x, "
                        f"(SELECT avg({c}) AS m FROM {tbl} y) z)) > 2 THEN 1 ELSE 0 END" for c in nums)
    corrs = U([f"SELECT corr({a}, {b}) AS r, count_if({a} IS NOT NULL AND {b} IS NOT NULL) AS n FROM {tbl} x" for a, b in _pairs(nums)])
    return f"""fk AS (SELECT count_if(abs(r) > 0.3 AND n > 10) AS related, {f"count_if(abs(r) > 0.8)" if len(nums) > 2 else "0"} AS collinear FROM ({corrs})),
fc AS (SELECT count(*) AS classes, max(n) / min(n) AS ratio FROM (SELECT count(*) AS n FROM {tbl} x WHERE {classes} IS NOT NULL GROUP BY {classes})),
fi AS (SELECT count(*) AS issues FROM ({_issues_sql(tbl, strs, range_sql)})),
fn AS (SELECT {' + '.join(f'CASE WHEN count(DISTINCT {c}) <= 1 THEN 1 ELSE 0 END' for c in cols)} AS const,
              {' + '.join(f'CASE WHEN count(DISTINCT {c}) = count(*) THEN 1 ELSE 0 END' for c in cols)} AS ids,
              {' + '.join(f'CASE WHEN count(try_cast({c} AS DOUBLE)) > 0 AND count(try_cast({c} AS DOUBLE)) < count({c}) THEN 1 ELSE 0 END' for c in strs)} AS mixed,
              {skewed} AS skewed FROM {tbl} x),
facts AS (SELECT * FROM fk, fc, fi, fn)"""


def _findings_orders_sql() -> str:
    """Every rule over orders with a target: three numeric columns, one categorical, one date."""
    rules = [
        ("structure", "data_quality", "high", [("high_missing_columns", 8, True, "half > 0")]),
        ("structure", "feature_engineering", "medium", [("high_cardinality", 6, True, "hc > 0")]),
        ("structure", "dimensionality", "high", [("wide_table", 8, True, "k > 0.1 * r AND k > 10")]),
        ("structure", "analysis_strategy", "high", [("complex_dataset", 7, True, "cs > 70")]),
        ("preprocessing", "missing_values", "high", [("missing_values", 8, True, "half > 0")]),
        ("preprocessing", "encoding", "medium", [("encoding", 5, True, "heavy > 0")]),
        ("preprocessing", "scaling", "medium", [("scaling", 4, False, "3 > 1")]),
        ("preprocessing", "outliers", "medium", [("outliers", 6, True, "many > 0")]),
        ("feature_engineering", "datetime_features", "medium", [("datetime_features", 5, False, "1 > 0")]),
        ("modelling", "small_dataset", "high", [("small_dataset", 8, True, "r < 1000")]),
        ("modelling", "large_dataset", "medium", [("large_dataset", 5, False, "r > 100000")]),
        ("modelling", "dimensionality", "high", [("more_features_than_rows", 9, True, "k > r")]),
        ("data_collection", "completeness", "high", [("incomplete", 8, True, "miss > 20")]),
        ("data_collection", "sample_size", "high", [("too_few_rows", 8, True, "r < 100")]),
        ("data_collection", "sample_size", "medium", [("few_rows", 6, True, "r BETWEEN 100 AND 999")]),
        ("business", "data_richness", "high", [("density_high", 5, False, "density > 90")]),
        ("business", "data_richness", "medium", [("density_medium", 5, False, "density > 70 AND density <= 90")]),
        ("business", "data_richness", "low", [("density_low", 7, True, "density <= 70")]),
        ("business", "volume", "high", [("volume_high", 5, False, "r > 10000")]),
        ("business", "volume", "low", [("volume_low", 7, True, "r < 100")]),
        ("business", "complexity", "high", [("complexity_high", 6, True, "pc > 0.7")]),
        ("business", "complexity", "low", [("complexity_low", 4, False, "pc < 0.3")]),
        ("business", "opportunity", "medium", [("temporal", 4, False, "1 > 0")]),
        ("business", "risk", "high", [("quality_risk", 8, True, "high > 3")]),
        ("business", "risk", "medium", [("sample_risk", 6, True, "r < 1000")]),
        ("business", "quick_wins", "low", [("quick_win", 5, False, "density > 85 AND pc < 0.4")]),
        ("business", "strategic_value", "high", [("strategic", 5, False, "r > 10000 AND k > 10")]),
        ("key", "data_quality", "high", [("low_density", 10, True, "density < 70")]),
        ("key", "data_quality", "low", [("excellent_density", 7, False, "density > 95")]),
        ("key", "dataset_size", "high", [("tiny_dataset", 8, True, "r < 100")]),
        ("key", "dataset_size", "low", [("large_dataset", 5, False, "r > 10000")]),
        ("key", "dimensionality", "high", [("features_exceed_rows", 9, True, "k > r")]),
        ("key", "missing_data", "high", [("half_missing_columns", 8, True, "half > 0")]),
        ("key", "warnings", "high", [("many_high_warnings", 10, True, "high > 5")]),
        ("key", "warnings", "medium", [("some_high_warnings", 7, True, "high BETWEEN 1 AND 5")]),
        ("key", "business_value", "low", [("high_value", 6, False, "score > 0.8")]),
        ("key", "business_value", "high", [("low_value", 8, True, "score < 0.4")]),
        ("quality", "missing", "high", [("missing_rate", 8, True, "miss > 20")]),
        ("quality", "duplicates", "medium", [("duplicates", 6, True, "dup > 5")]),
        ("feature_engineering", "transformations", "medium", [("transformations", 5, False, "skewed > 0")]),
        ("feature_engineering", "feature_interactions", "low", [("interactions", 4, False, "related > 0")]),
        ("modelling", "classification_imbalanced", "high", [("imbalanced_classes", 9, True, "r >= 10 AND classes >= 2 AND ratio > 10")]),
        ("modelling", "classification_balanced", "medium", [("balanced_classes", 5, False, "r >= 10 AND NOT (classes >= 2 AND ratio > 10)")]),
        ("modelling", "multicollinearity", "medium", [("multicollinearity", 6, True, "collinear > 0")]),
        ("data_collection", "data_quality", "medium", [("quality_issues", 6, True, "issues > 0")]),
        ("key", "target", "high", [("class_imbalance", 9, True, "r >= 10 AND classes >= 2 AND ratio > 10")]),
        ("key", "target", "medium", [("target_suitable", 6, False, "r >= 10 AND NOT (classes >= 2 AND ratio > 10)")]),
        ("key", "relationships", "medium", [("many_related_pairs", 7, True, "related > 10")]),
        ("key", "relationships", "low", [("related_pairs", 5, False, "related BETWEEN 1 AND 10")]),
        ("quality", "constants", "medium", [("constant_columns", 6, True, "const > 0")]),
        ("quality", "types", "medium", [("type_issues", 6, True, "mixed > 0")]),
        ("quality", "identifiers", "low", [("id_like_columns", 4, True, "ids > 1")]),
        ("quality", "condition", "low", [("good_condition", 3, False, "NOT (miss > 20 OR dup > 5 OR const > 0 OR mixed > 0 OR ids > 1)")]),
    ]
    return _PRIORITY_ORDERS + f""",
s AS (SELECT round(30 * least(k / 100.0, 1.0) + 20 * least(hc / 10.0, 1.0) + 25.0 * cm / k + 25.0 * rc / k, 4) AS cs FROM f),
h AS (SELECT {' + '.join(f'CASE WHEN 2 * count({c}) < count(*) THEN 1 ELSE 0 END' for c, _ in ORDERS_COLS)} AS half FROM orders),
u AS (SELECT round(((SELECT count(*) FROM orders) - count(*)) * 100.0 / (SELECT count(*) FROM orders), 2) AS dup FROM (SELECT DISTINCT * FROM orders)),
{_rule_facts_ctes("orders", [c for c, _ in ORDERS_COLS], ["o_orderkey", "o_custkey", "o_totalprice"],
                  ["o_orderstatus", "o_orderpriority"], "o_orderpriority")},
e AS (SELECT * FROM z, s, h, u, facts), fs AS ({U([f"SELECT '{rs}' AS rule_set, '{name}' AS rule, '{cat}' AS category, '{sev}' AS severity, "
                                             f"CAST({pri} AS BIGINT) AS priority, {str(act).lower()} AS action_needed FROM e WHERE {cond}"
                                             for rs, cat, sev, entries in rules for name, pri, act, cond in entries])})"""


ORACLE["findings"] = _findings_orders_sql() + " SELECT * FROM fs"


@register("key_findings_orders", _findings_orders_sql() + """ SELECT * FROM fs WHERE rule_set = 'key'
UNION ALL SELECT 'key', 'summary', 'summary', 'medium', 5, count_if(action_needed) > floor(count(*) / 2)
FROM fs WHERE rule_set = 'key' HAVING count_if(action_needed) > 0""")
def q_key_findings_orders(spark, sf):
    from tablescope.operators import findings
    return findings.key_findings(I.table(spark, sf, "orders"), target="o_orderpriority")


# --------------------------------------------------------------------------- cleaning

@register("impute_median", f"""
SELECT c_custkey, c_acctbal, n_orders, round(coalesce(total_spent, (SELECT median(total_spent) FROM {CO})), 4) AS total_spent,
       round(coalesce(avg_order, (SELECT median(avg_order) FROM {CO})), 4) AS avg_order FROM {CO}""")
def q_impute_median(spark, sf):
    from pyspark.sql import functions as F
    from tablescope.operators import clean
    co = I.customer_orders(spark, sf).select("c_custkey", "c_acctbal", "n_orders", "total_spent", "avg_order")
    out = clean.impute_median(co, ["total_spent", "avg_order"])
    return out.select("c_custkey", "c_acctbal", "n_orders", 
                      (F.round(F.col("total_spent") * 10000) / 10000).alias("total_spent"),
                      (F.round(F.col("avg_order") * 10000) / 10000).alias("avg_order"))


@register("impute_mean_mode", f"""
WITH t AS (SELECT d.doc_id, d.lang, l.quality, CASE WHEN l.quality IS NULL THEN NULL ELSE d.source END AS source
           FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
md AS (SELECT source AS m FROM t WHERE source IS NOT NULL GROUP BY source ORDER BY count(*) DESC, source LIMIT 1)
SELECT doc_id, lang, round(coalesce(CAST(quality AS DOUBLE), (SELECT avg(quality) FROM t)), 4) AS quality,
       coalesce(source, (SELECT m FROM md)) AS source FROM t""")
def q_impute_mean_mode(spark, sf):
    from pyspark.sql import functions as F
    from tablescope.operators import clean
    t = I.docs_labels(spark, sf).select("doc_id", "lang", "quality",
                                         F.when(F.col("quality").isNull(), None).otherwise(F.col("source")).alias("source"))
    out = clean.impute_mean_mode(t, ["quality"], ["source"])
    return out.withColumn("quality", F.round(F.col("quality") * 10000) / 10000)


@register("drop_sparse_rows", f"""
SELECT CAST(count(*) AS BIGINT) AS rows_kept FROM {DL}
WHERE ({' + '.join(f'CASE WHEN {c} IS NOT NULL THEN 1 ELSE 0 END' for c in ['lang', 'quality', 'toxic'])}) >= 2""")
def q_drop_sparse_rows(spark, sf):
    from pyspark.sql import functions as F
    from tablescope.operators import clean
    return clean.drop_sparse_rows(I.docs_labels(spark, sf), ["lang", "quality", "toxic"], 0.5).agg(
        F.count(F.lit(1)).cast("long").alias("rows_kept"))


@register("drop_missing", f"""
SELECT CAST(count(*) AS BIGINT) AS rows_before, CAST(count_if(quality IS NOT NULL AND toxic IS NOT NULL) AS BIGINT) AS rows_after,
       CAST(count_if(quality IS NULL OR toxic IS NULL) AS BIGINT) AS rows_removed FROM {DL}""")
def q_drop_missing(spark, sf):
    return missing.drop_rows_report(I.docs_labels(spark, sf), ["quality", "toxic"])


@register("fill_constant", f"""
SELECT doc_id, coalesce(CAST(quality AS VARCHAR), 'Missing') AS quality FROM {DL}""")
def q_fill_constant(spark, sf):
    from tablescope.operators import clean
    return clean.fill_constant(I.docs_labels(spark, sf).select("doc_id", "quality"), ["quality"])


@register("coerce_numeric", """
SELECT o_orderkey, try_cast(CASE WHEN o_orderstatus = 'F' THEN CAST(o_totalprice AS VARCHAR) ELSE o_orderpriority END AS DOUBLE)
       AS mixed_text FROM orders""")
def q_coerce_numeric(spark, sf):
    from pyspark.sql import functions as F
    from tablescope.operators import clean
    o = I.table(spark, sf, "orders")
    t = o.select("o_orderkey", F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice").cast("string"))
                 .otherwise(F.col("o_orderpriority")).alias("mixed_text"))
    return clean.coerce_numeric(t, ["mixed_text"])


@register("filter_top_categories", """
WITH top AS (SELECT p_brand FROM part GROUP BY p_brand ORDER BY count(*) DESC, p_brand LIMIT 15)
SELECT p_partkey, p_brand FROM part WHERE p_brand IN (SELECT p_brand FROM top)""")
def q_filter_top_categories(spark, sf):
    from tablescope.operators import clean
    return clean.filter_top_categories(I.table(spark, sf, "part").select("p_partkey", "p_brand"), "p_brand", 15)


@register("filter_range", """
SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity >= 10 AND l_quantity <= 20""")
def q_filter_range(spark, sf):
    from tablescope.operators import clean
    li = I.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return clean.filter_range(li, "l_quantity", 10, 20)


@register("filter_eq", """SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'F'""")
def q_filter_eq(spark, sf):
    from tablescope.operators import clean
    return clean.filter_eq(I.table(spark, sf, "orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus", "F")


@register("quartile_bin", """
WITH q AS (SELECT quantile_cont(o_totalprice, [0.25, 0.5, 0.75]) AS e, min(o_totalprice) AS mn, max(o_totalprice) AS mx FROM orders)
SELECT o_orderkey, CAST(len(list_filter(list_filter(list_distinct(e), lambda v: v > mn AND v < mx),
                                        lambda v: v < o_totalprice)) AS INTEGER) AS o_totalprice_bin
FROM orders, q""")
def q_quartile_bin(spark, sf):
    from tablescope.operators import clean
    o = I.table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return clean.quartile_bin(o, "o_totalprice").select("o_orderkey", "o_totalprice_bin")


@register("zero_variance_guard", f"""
WITH t AS (SELECT *, 1.0 AS constant FROM customer)
{U([f"SELECT '{c}' AS \"column\", {SIG(f'var_samp({c})')} AS variance, coalesce(var_samp({c}) > 0, false) AS keep FROM t"
    for c in ['c_acctbal', 'c_nationkey', 'constant']])}""")
def q_zero_variance_guard(spark, sf):
    from pyspark.sql import functions as F
    from tablescope.functions.exprs import sig
    from tablescope.operators import clean
    c = I.table(spark, sf, "customer").withColumn("constant", F.lit(1.0))
    return clean.zero_variance_guard(c, ["c_acctbal", "c_nationkey", "constant"]).withColumn(
        "variance", sig(F.col("variance")))


@register("sample_n")
def q_sample_n(spark, sf):
    from tablescope.operators import clean
    return clean.sample_n(I.table(spark, sf, "orders"), 1000)


# --------------------------------------------------------------------------- scaling, encoding, segmentation

_SEG_NUM = ["c_acctbal", "n_orders", "total_spent", "avg_order"]


@register("scale_standard", f"""
SELECT c_custkey, {', '.join(f"round(coalesce(({c} - (SELECT avg({c}) FROM customer)) / NULLIF((SELECT stddev_pop({c}) FROM customer), 0), 0.0), 4) AS {c}" for c in ['c_acctbal', 'c_nationkey'])}
FROM customer""")
def q_scale_standard(spark, sf):
    from pyspark.sql import functions as F
    from tablescope.operators import segment
    c = I.table(spark, sf, "customer").select("c_custkey", "c_acctbal", "c_nationkey")
    s = segment.scale(c, ["c_acctbal", "c_nationkey"], "standard")
    return s.select("c_custkey", *[(F.round(F.col(x) * 10000) / 10000).alias(x) for x in ["c_acctbal", "c_nationkey"]])


@register("scale_minmax", f"""
SELECT c_custkey, {', '.join(f"round(coalesce(({c} - (SELECT min({c}) FROM customer)) / NULLIF((SELECT max({c}) - min({c}) FROM customer), 0), 0.0), 4) AS {c}" for c in ['c_acctbal', 'c_nationkey'])}
FROM customer""")
def q_scale_minmax(spark, sf):
    from pyspark.sql import functions as F
    from tablescope.operators import segment
    c = I.table(spark, sf, "customer").select("c_custkey", "c_acctbal", "c_nationkey")
    s = segment.scale(c, ["c_acctbal", "c_nationkey"], "minmax")
    return s.select("c_custkey", *[(F.round(F.col(x) * 10000) / 10000).alias(x) for x in ["c_acctbal", "c_nationkey"]])


@register("scale_robust", f"""
SELECT c_custkey, {', '.join(f"round(coalesce(({c} - (SELECT median({c}) FROM customer)) / NULLIF((SELECT quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) FROM customer), 0), 0.0), 4) AS {c}" for c in ['c_acctbal', 'c_nationkey'])}
FROM customer""")
def q_scale_robust(spark, sf):
    from pyspark.sql import functions as F
    from tablescope.operators import segment
    c = I.table(spark, sf, "customer").select("c_custkey", "c_acctbal", "c_nationkey")
    s = segment.scale(c, ["c_acctbal", "c_nationkey"], "robust")
    return s.select("c_custkey", *[(F.round(F.col(x) * 10000) / 10000).alias(x) for x in ["c_acctbal", "c_nationkey"]])


@register("label_encode", """
SELECT c_custkey, CAST(dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS DOUBLE) AS c_mktsegment FROM customer""")
def q_label_encode(spark, sf):
    from tablescope.operators import segment
    return segment.label_encode(I.table(spark, sf, "customer").select("c_custkey", "c_mktsegment"), ["c_mktsegment"])


@register("one_hot", f"""
SELECT c_custkey, {', '.join(f"CASE WHEN c_mktsegment = '{v}' THEN 1.0 ELSE 0.0 END AS c_mktsegment_{v}" for v in ['AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY'])}
FROM customer""")
def q_one_hot(spark, sf):
    from tablescope.operators import segment
    return segment.one_hot(I.table(spark, sf, "customer").select("c_custkey", "c_mktsegment"), ["c_mktsegment"])


@register("pca_variance")
def q_pca_variance(spark, sf):
    from tablescope.operators import segment
    return segment.pca(I.customer_orders(spark, sf), _SEG_NUM)["variance"]


@register("pca_loadings")
def q_pca_loadings(spark, sf):
    from tablescope.operators import segment
    return segment.pca(I.customer_orders(spark, sf), _SEG_NUM)["loadings"]


@register("pca_summary")
def q_pca_summary(spark, sf):
    from tablescope.operators import segment
    return segment.pca(I.customer_orders(spark, sf), _SEG_NUM)["summary"]


@register("kmeans")
def q_kmeans(spark, sf):
    from tablescope.operators import segment
    return segment.kmeans(I.customer_orders(spark, sf), _SEG_NUM, ["c_mktsegment"], k=3)


@register("elbow")
def q_elbow(spark, sf):
    from tablescope.operators import segment
    return segment.elbow(I.customer_orders(spark, sf), _SEG_NUM, ["c_mktsegment"])


@register("silhouette")
def q_silhouette(spark, sf):
    from tablescope.operators import segment
    return segment.silhouette(I.customer_orders(spark, sf), _SEG_NUM, ["c_mktsegment"], k=3)


@register("cluster_summary")
def q_cluster_summary(spark, sf):
    from tablescope.operators import segment
    return segment.cluster_summary(I.customer_orders(spark, sf), _SEG_NUM, ["c_mktsegment"], k=3)


@register("cluster_centers")
def q_cluster_centers(spark, sf):
    from tablescope.operators import segment
    return segment.cluster_centers(I.customer_orders(spark, sf), _SEG_NUM, ["c_mktsegment"], k=3)


@register("cluster_projection")
def q_cluster_projection(spark, sf):
    from tablescope.operators import segment
    return segment.cluster_projection(I.customer_orders(spark, sf), _SEG_NUM, ["c_mktsegment"], k=3)


_DENSITY_SQL = f"""
WITH RECURSIVE t AS (SELECT c_custkey, n_orders / 4 AS u, c_acctbal / 1000 AS v FROM {CO}),
p AS (SELECT u, v, count(*) AS w FROM t WHERE u IS NOT NULL AND v IS NOT NULL GROUP BY u, v),
near AS (SELECT a.u, a.v, b.u AS bu, b.v AS bv, b.w AS bw FROM p a JOIN p b
         ON (a.u - b.u) * (a.u - b.u) + (a.v - b.v) * (a.v - b.v) <= 0.25::DOUBLE * 0.25::DOUBLE),
core AS (SELECT u, v FROM near GROUP BY u, v HAVING sum(bw) >= 5),
link AS (SELECT n.u, n.v, n.bu, n.bv FROM near n JOIN core a ON a.u = n.u AND a.v = n.v JOIN core b ON b.u = n.bu AND b.v = n.bv),
reach AS (SELECT u, v, u AS ru, v AS rv FROM core
          UNION SELECT l.u, l.v, r.ru, r.rv FROM link l JOIN reach r ON r.u = l.bu AND r.v = l.bv),
named AS (SELECT u, v, min({{'x': ru, 'y': rv}}) AS c FROM reach GROUP BY u, v),
placed AS (SELECT n.u, n.v, min(m.c) AS c FROM near n JOIN named m ON m.u = n.bu AND m.v = n.bv GROUP BY n.u, n.v)
SELECT t.c_custkey, k.u IS NOT NULL AS core, coalesce(m.c, pl.c).x AS cluster_x, coalesce(m.c, pl.c).y AS cluster_y
FROM t LEFT JOIN core k ON k.u = t.u AND k.v = t.v LEFT JOIN named m ON m.u = t.u AND m.v = t.v
LEFT JOIN placed pl ON pl.u = t.u AND pl.v = t.v"""


def _customer_plane(spark, sf):
    return I.customer_orders(spark, sf).selectExpr("c_custkey", "n_orders / 4 AS u", "c_acctbal / 1000 AS v")


@register("density_clusters", _DENSITY_SQL)
def q_density_clusters(spark, sf):
    from tablescope.operators import density
    return density.density_clusters(_customer_plane(spark, sf), "u", "v", 0.25, 5).drop("u", "v")


@register("density_clusters_projection")
def q_density_clusters_projection(spark, sf):
    """Number of density clusters and of noise rows of the first two principal components."""
    from tablescope.operators import density, segment
    plane = segment.pca(I.customer_orders(spark, sf), CO_NUM, k=2)["projection"]
    return density.density_summary(density.density_clusters(plane, "pc1", "pc2", 0.5, 5))


_TOT = ", ".join(f"round(avg({c}), 2) AS {c}" for c in _SEG_NUM)


def _cluster_totals(spark, sf, **options):
    """Rows, clusters and row-weighted means over the clusters: they must be those of the whole input."""
    from pyspark.sql import functions as F
    from tablescope.operators import segment
    s = segment.cluster_summary(I.customer_orders(spark, sf), _SEG_NUM, ["c_mktsegment"], k=3, **options)
    return s.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("clusters"),
                 *[(F.round(F.sum(F.col(c) * F.col("n")) / F.sum("n") * 100) / 100).alias(c) for c in _SEG_NUM])


@register("cluster_totals", f"SELECT count(*) AS n, CAST(3 AS BIGINT) AS clusters, {_TOT} FROM {CO}")
def q_cluster_totals(spark, sf):
    return _cluster_totals(spark, sf)


@register("cluster_totals_dropped", f"""SELECT count(*) AS n, CAST(3 AS BIGINT) AS clusters, {_TOT} FROM {CO}
WHERE {' AND '.join(f'{c} IS NOT NULL' for c in [*_SEG_NUM, 'c_mktsegment'])}""")
def q_cluster_totals_dropped(spark, sf):
    return _cluster_totals(spark, sf, missing="drop", encoding="label", scaling="minmax")


@register("pca_two_features", """
WITH r AS (SELECT abs(corr(l_quantity, l_extendedprice)) AS r FROM lineitem)
SELECT 1 AS component, round((1 + r) / 2, 6) AS explained_variance_ratio, round((1 + r) / 2, 6) AS cumulative FROM r
UNION ALL SELECT 2, round((1 - r) / 2, 6), 1.0 FROM r""")
def q_pca_two_features(spark, sf):
    from pyspark.sql import functions as F
    from tablescope.operators import segment
    v = segment.pca(I.table(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice"])["variance"]
    return v.select("component", *[(F.round(F.col(c) * 1e6) / 1e6).alias(c) for c in ["explained_variance_ratio", "cumulative"]])


@register("category_codes", """
SELECT c_custkey, c_mktsegment, CAST(dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS INTEGER) AS c_mktsegment_code FROM customer""")
def q_category_codes(spark, sf):
    from tablescope.operators import segment
    return segment.category_codes(I.table(spark, sf, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment")


@register("select_types", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def q_select_types(spark, sf):
    return types.select_types(I.table(spark, sf, "orders"), "numeric")


# --------------------------------------------------------------------------- chart data

def _bin_sql(x: str, lo: str, hi: str, bins: int) -> str:
    return f"CAST(CASE WHEN {hi} = {lo} THEN 0 ELSE least(floor(({x} - {lo}) / ({hi} - {lo}) * {bins}), {bins - 1}) END AS INTEGER)"


@register("histogram", f"""
WITH m AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem),
g AS (SELECT {_bin_sql('l_extendedprice', 'lo', 'hi', 30)} AS bin, lo, hi, count(*) AS cnt FROM lineitem, m
      WHERE l_extendedprice IS NOT NULL GROUP BY ALL)
SELECT bin, round(lo + bin * (hi - lo) / 30, 4) AS lower, round(lo + (bin + 1) * (hi - lo) / 30, 4) AS upper,
       CAST(cnt AS BIGINT) AS count, round(cnt / (sum(cnt) OVER () * ((hi - lo) / 30)), 4) AS density,
       round(cnt / sum(cnt) OVER (), 4) AS probability FROM g""")
def q_histogram(spark, sf):
    from tablescope.operators import charts
    return charts.histogram(I.table(spark, sf, "lineitem"), "l_extendedprice", 30)


@register("box_stats", """
WITH q AS (SELECT l_returnflag AS g, quantile_cont(l_extendedprice, 0.25) AS q1, median(l_extendedprice) AS med,
                  quantile_cont(l_extendedprice, 0.75) AS q3 FROM lineitem WHERE l_returnflag IS NOT NULL
                  AND l_extendedprice IS NOT NULL GROUP BY 1)
SELECT q.g AS "group", CAST(count(*) AS BIGINT) AS n, round(q1, 4) AS q1, round(med, 4) AS median, round(q3, 4) AS q3,
       round(min(CASE WHEN x >= q1 - 1.5 * (q3 - q1) AND x <= q3 + 1.5 * (q3 - q1) THEN x END), 4) AS whisker_low,
       round(max(CASE WHEN x >= q1 - 1.5 * (q3 - q1) AND x <= q3 + 1.5 * (q3 - q1) THEN x END), 4) AS whisker_high,
       CAST(count_if(NOT (x >= q1 - 1.5 * (q3 - q1) AND x <= q3 + 1.5 * (q3 - q1))) AS BIGINT) AS fliers
FROM (SELECT l_returnflag AS g, l_extendedprice AS x FROM lineitem WHERE l_extendedprice IS NOT NULL) d JOIN q USING (g)
GROUP BY q.g, q1, med, q3""")
def q_box_stats(spark, sf):
    from tablescope.operators import charts
    return charts.box_stats(I.table(spark, sf, "lineitem"), "l_extendedprice", "l_returnflag")


@register("category_counts", f"""
WITH g AS (SELECT CAST(p_brand AS VARCHAR) AS category, count(*) AS n FROM part WHERE p_brand IS NOT NULL GROUP BY 1)
SELECT category, CAST(n AS BIGINT) AS n, {PCT('n', '(SELECT sum(n) FROM g)')} AS pct,
       CASE WHEN (SELECT count(*) FROM g) <= 10 THEN 'pie' ELSE 'bar' END AS chart
FROM g ORDER BY n DESC, category LIMIT 15""")
def q_category_counts(spark, sf):
    from tablescope.operators import charts
    return charts.category_counts(I.table(spark, sf, "part"), "p_brand")


@register("class_balance_chart", f"""
WITH g AS (SELECT o_orderpriority AS class, count(*) AS n FROM orders WHERE o_orderpriority IS NOT NULL GROUP BY 1)
SELECT class, CAST(n AS BIGINT) AS n, {PCT('n', '(SELECT sum(n) FROM g)')} AS pct FROM g ORDER BY n DESC, class LIMIT 15""")
def q_class_balance_chart(spark, sf):
    from tablescope.operators import charts
    return charts.class_balance_chart(I.table(spark, sf, "orders"), "o_orderpriority")


_TOPB = "(SELECT p_brand FROM part WHERE p_brand IS NOT NULL GROUP BY p_brand ORDER BY count(*) DESC, p_brand LIMIT 15)"


@register("count_by_target", f"""
SELECT p_brand AS category, p_type AS target, CAST(count(*) AS BIGINT) AS n FROM part
WHERE p_brand IN {_TOPB} GROUP BY 1, 2""")
def q_count_by_target(spark, sf):
    from tablescope.operators import charts
    return charts.count_by_target(I.table(spark, sf, "part"), "p_brand", "p_type")


@register("mean_target_by_category", f"""
SELECT p_brand AS category, CAST(count(*) AS BIGINT) AS n, round(avg(p_retailprice), 4) AS mean_target FROM part
WHERE p_brand IN {_TOPB} GROUP BY 1""")
def q_mean_target_by_category(spark, sf):
    from tablescope.operators import charts
    return charts.mean_target_by_category(I.table(spark, sf, "part"), "p_brand", "p_retailprice")


@register("bar_aggregate", """
SELECT c_mktsegment AS category, round(median(c_acctbal), 4) AS median FROM customer GROUP BY 1""")
def q_bar_aggregate(spark, sf):
    from tablescope.operators import charts
    return charts.bar_aggregate(I.table(spark, sf, "customer"), "c_mktsegment", "c_acctbal", "median")


@register("pivot_heatmap", """
SELECT l_returnflag AS x, l_linestatus AS y, round(avg(l_extendedprice), 4) AS mean FROM lineitem GROUP BY 1, 2""")
def q_pivot_heatmap(spark, sf):
    from tablescope.operators import charts
    return charts.pivot_heatmap(I.table(spark, sf, "lineitem"), "l_returnflag", "l_linestatus", "l_extendedprice")


@register("pivot_heatmap_median", """
SELECT l_returnflag AS x, l_linestatus AS y, round(median(l_extendedprice), 4) AS median FROM lineitem GROUP BY 1, 2""")
def q_pivot_heatmap_median(spark, sf):
    from tablescope.operators import charts
    return charts.pivot_heatmap(I.table(spark, sf, "lineitem"), "l_returnflag", "l_linestatus", "l_extendedprice", "median")


@register("density_2d", f"""
WITH m AS (SELECT min(l_quantity) AS xl, max(l_quantity) AS xh, min(l_discount) AS yl, max(l_discount) AS yh FROM lineitem)
SELECT {_bin_sql('l_quantity', 'xl', 'xh', 20)} AS xbin, {_bin_sql('l_discount', 'yl', 'yh', 20)} AS ybin,
       CAST(count(*) AS BIGINT) AS n FROM lineitem, m WHERE l_quantity IS NOT NULL AND l_discount IS NOT NULL GROUP BY 1, 2""")
def q_density_2d(spark, sf):
    from tablescope.operators import charts
    return charts.density_2d(I.table(spark, sf, "lineitem"), "l_quantity", "l_discount")


@register("stacked_counts", f"""
WITH ct AS (SELECT coalesce(l_returnflag, 'Unknown') AS l_returnflag, coalesce(l_linestatus, 'Unknown') AS l_linestatus,
                   count(*) AS n FROM lineitem GROUP BY 1, 2)
SELECT l_returnflag, l_linestatus, CAST(n AS BIGINT) AS n, {PCT('n', 'sum(n) OVER (PARTITION BY l_returnflag)')} AS row_pct,
       {PCT('n', 'sum(n) OVER (PARTITION BY l_linestatus)')} AS col_pct, {PCT('n', 'sum(n) OVER ()')} AS total_pct FROM ct""")
def q_stacked_counts(spark, sf):
    from tablescope.operators import charts
    return charts.stacked_counts(I.table(spark, sf, "lineitem"), "l_returnflag", "l_linestatus")


@register("line_mean", """
SELECT l_linenumber AS x, CAST(count(l_quantity) AS BIGINT) AS n, round(avg(l_quantity), 4) AS mean,
       round(avg(l_quantity) - 1.96 * stddev_samp(l_quantity) / sqrt(count(l_quantity)), 4) AS ci_low,
       round(avg(l_quantity) + 1.96 * stddev_samp(l_quantity) / sqrt(count(l_quantity)), 4) AS ci_high
FROM lineitem GROUP BY 1""")
def q_line_mean(spark, sf):
    from tablescope.operators import charts
    return charts.line_mean(I.table(spark, sf, "lineitem"), "l_linenumber", "l_quantity")


@register("density_grid")
def q_density_grid(spark, sf):
    from tablescope.operators import charts
    return charts.density_grid(I.table(spark, sf, "orders"), "o_totalprice")


@register("point_sample")
def q_point_sample(spark, sf):
    from tablescope.operators import charts
    return charts.point_sample(I.table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice")


@register("dataset_overview", f"""
WITH cs AS ({_column_summary_sql('orders', ORDERS_COLS)}),
m AS ({U([f"SELECT '{c}' AS c, count(*) - count({c}) AS mc, count(*) AS r FROM orders" for c, _ in ORDERS_COLS])}),
d AS (SELECT sum(n - 1) AS dup FROM (SELECT count(*) AS n FROM orders GROUP BY ALL_COLS))
SELECT cs."column", cs.position, cs.data_type, CAST(m.mc AS BIGINT) AS missing_count, cs.missing_pct, cs.unique_values,
       cs.sample_values, CAST(m.r AS BIGINT) AS "rows", CAST({len(ORDERS_COLS)} AS BIGINT) AS columns,
       CAST(d.dup AS BIGINT) AS dataset_duplicate_rows
FROM cs JOIN m ON cs."column" = m.c, d""".replace("ALL_COLS", ", ".join(c for c, _ in ORDERS_COLS)))
def q_dataset_overview(spark, sf):
    return profile.dataset_overview(I.table(spark, sf, "orders"))


@register("duplicate_rows_subset", U([
    f"SELECT '{name}' AS subset, * FROM ({_dup_sql('lineitem', cols)})"
    for name, cols in [("all_columns", I.LINEITEM_COLS),
                       ("without_id_columns", [c for c in I.LINEITEM_COLS if "id" not in c and "key" not in c]),
                       ("without_last_column", I.LINEITEM_COLS[:-1])]]))
def q_duplicate_rows_subset(spark, sf):
    return profile.duplicate_rows_subset(I.table(spark, sf, "lineitem"))


@register("preview_shape", """SELECT CAST(count(*) AS BIGINT) AS "rows", 11 AS columns FROM lineitem""")
def q_preview_shape(spark, sf):
    from tablescope.sources import io
    return io.preview(I.table(spark, sf, "lineitem"))[1]


def _mixed_sql(src: str, pairs) -> str:
    """Every pair with the test its groups call for; three groups each, so both tail probabilities are closed forms."""
    parts = []
    for g, x in pairs:
        parts.append(f"""
SELECT * FROM (WITH d AS (SELECT coalesce({g}, 'Missing') AS g, CAST({x} AS DOUBLE) AS x FROM {src} s WHERE {x} IS NOT NULL),
mm AS (SELECT g, count(*) AS n, avg(x) AS m FROM d GROUP BY g HAVING count(*) > 2),
sk AS (SELECT d.g, avg(pow(x - m, 3)) / NULLIF(pow(avg(pow(x - m, 2)), 1.5), 0) AS s, max(n) AS n
       FROM d JOIN mm ON d.g = mm.g GROUP BY d.g),
pick AS (SELECT bool_and(n < 30 OR coalesce(abs(s) < 2, false)) AS anova FROM sk),
a AS ({_group_effect_sql(src, g, x, kruskal=False)}),
h AS ({_group_effect_sql(src, g, x, kruskal=True)}),
raw AS (SELECT (sum(mm.n * pow(mm.m - t.m, 2)) / (count(*) - 1)) / (max(w.w) / (sum(mm.n) - count(*))) AS f,
               sum(mm.n) - count(*) AS d2
        FROM mm, (SELECT avg(x) AS m FROM d JOIN mm ON d.g = mm.g) t,
             (SELECT sum(pow(x - mm.m, 2)) AS w FROM d JOIN mm ON d.g = mm.g) w)
SELECT a.categorical_feature, a.numeric_feature, a.test, a.statistic,
       round(pow(1 + 2 * f / d2, -d2 / 2.0), 6) AS p_value, pow(1 + 2 * f / d2, -d2 / 2.0) < 0.05 AS significant,
       a.eta_squared, a.effect, a.groups FROM a, raw, pick WHERE anova
UNION ALL SELECT h.* FROM h, pick WHERE NOT anova)""")
    return f"SELECT * FROM ({U(parts)}) WHERE significant"


@register("mixed_interactions", _mixed_sql(I.BANDED_DOCUMENTS_SQL, [
    (g, x) for g in ("length_band", "quality") for x in ("n_chars", "root_chars")]))
def q_mixed_interactions(spark, sf):
    from tablescope.operators import stat_tests
    return stat_tests.mixed_interactions(I.banded_documents(spark, sf), ["length_band", "quality"], ["n_chars", "root_chars"])


@register("suggest_target", """
SELECT 'l_shipdate' AS "column", 'low_cardinality_last_column' AS reason FROM lineitem
HAVING count(DISTINCT l_shipdate) < 0.3 * count(*)""")
def q_suggest_target(spark, sf):
    return types.suggest_target(I.table(spark, sf, "lineitem").select("l_discount", "l_tax", "l_shipdate"))


def _filled(share: float) -> str:
    """Customer features of the rows that are filled to at least ``share``."""
    have = " + ".join(f"CASE WHEN {c} IS NULL THEN 0 ELSE 1 END" for c in CO_NUM)
    return f"(SELECT {', '.join(CO_NUM)} FROM {CO} t WHERE {have} >= {share * len(CO_NUM)})"


@register("feature_matrix", f"""
SELECT {', '.join(f'coalesce({c}, (SELECT quantile_cont({c}, 0.5) FROM {_filled(0.5)} m)) AS {c}' for c in CO_NUM)}
FROM {_filled(0.5)} x""")
def q_feature_matrix(spark, sf):
    from tablescope.operators import assoc
    return assoc.feature_matrix(I.customer_orders(spark, sf), CO_NUM)


def _feature_clusters_sql(cols, threshold: float) -> str:
    """Seeds in column order: a column that no earlier seed is linked to; each takes what is linked and free."""
    at = range(len(cols))
    link = ", ".join(f"coalesce(abs(corr({cols[i]}, {cols[j]})) > {threshold}, false) AS l{i}_{j}" for i in at for j in at if i < j)
    steps = [f"e AS (SELECT {link} FROM {_filled(0.7)} x)"]
    for j in at:
        taken = " OR ".join(f"(s{i} AND l{i}_{j})" for i in range(j)) or "false"
        steps.append(f"e{j} AS (SELECT *, NOT ({taken}) AS s{j} FROM {f'e{j - 1}' if j else 'e'})")
    parts = []
    for i in at:
        free = [f"CASE WHEN l{i}_{j} AND NOT ({' OR '.join(f'(s{k} AND l{k}_{j})' for k in range(i)) or 'false'}) THEN '{cols[j]}' END"
                for j in at if j > i]
        if free:
            size = " + ".join(f"CAST(({c}) IS NOT NULL AS BIGINT)" for c in free)
            parts.append(f"SELECT '{cols[i]}' AS seed, concat_ws(',', '{cols[i]}', {', '.join(free)}) AS features, "
                         f"CAST(1 + {size} AS BIGINT) AS size FROM e{len(cols) - 1} WHERE s{i}")
    return f"WITH {', '.join(steps)} SELECT * FROM ({U(parts)}) WHERE size > 1"


@register("feature_clusters", _feature_clusters_sql(CO_NUM, 0.7))
def q_feature_clusters(spark, sf):
    from tablescope.operators import assoc
    return assoc.feature_clusters(I.customer_orders(spark, sf), CO_NUM)


@register("quality_score", f"""
WITH t AS {DL},
a AS (SELECT count(*) AS r, {' + '.join(f'count_if({c} IS NULL)' for c in DL_COLS)} AS mc,
             {' + '.join(f'CASE WHEN coalesce(var_samp({c}) < 1e-6, false) THEN 1 ELSE 0 END' for c in _DL_NUM)} AS lv FROM t),
d AS (SELECT coalesce(sum(n - 1), 0) AS dup FROM (SELECT count(*) AS n FROM t GROUP BY {', '.join(DL_COLS)})),
s AS (SELECT greatest(0.0, 100 - mc * 100.0 / (r * {len(DL_COLS)}) * 2) AS c, greatest(0.0, 100 - dup * 100.0 / r * 5) AS k,
             greatest(0.0, 100 - lv * 100.0 / {len(_DL_NUM)} * 10) AS u FROM a, d)
SELECT round(c, 4) AS completeness, round(k, 4) AS consistency, round(u, 4) AS usefulness,
       round(c * 0.4 + k * 0.3 + u * 0.3, 4) AS quality_score FROM s""")
def q_quality_score(spark, sf):
    from tablescope.operators import scores
    return scores.quality_score(I.docs_labels(spark, sf))


@register("correlation_flags", f"""
WITH base AS {CO}, s AS (SELECT {', '.join(CO_NUM)} FROM base
                        WHERE ({' + '.join(f'CASE WHEN {c} IS NOT NULL THEN 1 ELSE 0 END' for c in CO_NUM)}) >= 2),
p AS ({_pairs_cte(_FM, CO_NUM)}), o AS (SELECT avg(abs(r)) AS m, count_if(abs(r) > 0.8) AS k FROM p WHERE r IS NOT NULL)
SELECT 'high_average' AS flag, round(m, 4) AS value FROM o WHERE m > 0.5
UNION ALL SELECT 'collinear_pairs', k FROM o WHERE k > 0 UNION ALL SELECT 'severe_collinearity', k FROM o WHERE k > 5
UNION ALL SELECT 'mostly_independent', round(m, 4) FROM o WHERE m < 0.2""")
def q_correlation_flags(spark, sf):
    from tablescope.operators import findings
    return findings.correlation_flags(I.customer_orders(spark, sf).select(*CO_NUM))


@register("target_flags_classes", """
WITH c AS (SELECT count(*) AS n FROM labels WHERE quality IS NOT NULL GROUP BY quality),
s AS (SELECT count(*) AS k, max(n) / min(n) AS ratio FROM c)
SELECT CASE WHEN k < 2 THEN 'single_class' WHEN ratio > 10 THEN 'severe_imbalance' WHEN ratio > 3 THEN 'moderate_imbalance'
            ELSE 'balanced' END AS flag, CASE WHEN k >= 2 THEN round(ratio, 2) END AS value FROM s""")
def q_target_flags_classes(spark, sf):
    from tablescope.operators import findings
    return findings.target_recommendation_flags(I.table(spark, sf, "labels"), "quality")


@register("target_flags_regression", """
WITH m AS (SELECT avg(o_totalprice) AS m FROM orders),
a AS (SELECT count(o_totalprice) AS n, avg(o_totalprice) AS mean, stddev_samp(o_totalprice) AS sd,
             avg(pow(o_totalprice - m.m, 3)) / pow(avg(pow(o_totalprice - m.m, 2)), 1.5) AS sk,
             avg(pow(o_totalprice - m.m, 4)) / pow(avg(pow(o_totalprice - m.m, 2)), 2) - 3 AS ku FROM orders, m),
b AS (SELECT *, n / 6.0 * (sk * sk + ku * ku / 4.0) AS jb FROM a)
SELECT 'highly_skewed' AS flag, round(abs(sk), 4) AS value FROM b WHERE abs(sk) > 2
UNION ALL SELECT 'moderately_skewed', round(abs(sk), 4) FROM b WHERE abs(sk) > 1 AND abs(sk) <= 2
UNION ALL SELECT 'high_variance', round(sd, 4) FROM b WHERE sd > 2 * mean
UNION ALL SELECT 'not_normal', round(jb, 4) FROM b WHERE exp(-jb / 2.0) <= 0.05
UNION ALL SELECT 'suitable', round(abs(sk), 4) FROM b WHERE abs(sk) <= 1 AND sd <= 2 * mean AND exp(-jb / 2.0) > 0.05""")
def q_target_flags_regression(spark, sf):
    from tablescope.operators import findings
    return findings.target_recommendation_flags(I.table(spark, sf, "orders"), "o_totalprice")


@register("readiness", _OP_ORDERS + """
s AS (SELECT cm, round(30 * least(k / 100.0, 1.0) + 20 * least(hc / 10.0, 1.0) + 25.0 * cm / k + 25.0 * rc / k, 4) AS cs FROM f)
SELECT cs AS complexity_score, CASE WHEN cs > 70 THEN 'High' WHEN cs < 30 THEN 'Low' ELSE 'Medium' END AS complexity,
       CAST(CASE WHEN cm > 0 THEN 1 ELSE 0 END AS BIGINT) AS issues, CASE WHEN cm > 0 THEN 'minor' ELSE 'ready' END AS readiness FROM s""")
def q_readiness(spark, sf):
    from tablescope.operators import findings
    return findings.readiness(I.table(spark, sf, "orders"))


_DOUBTFUL_SQL = ("(SELECT o_orderkey, o_custkey, o_orderkey + 1 AS next_key, o_orderpriority, o_totalprice, "
                 "o_totalprice / 5000 - 20 AS customer_age, o_totalprice / 5000 AS discount_rate, 'x' AS tag, "
                 "CASE WHEN o_orderkey < 100 THEN 1000.0 ELSE 1.0 END AS spikes, "
                 "CASE WHEN o_orderkey % 20 = 0 THEN 'rare' ELSE 'common' END AS outcome, "
                 "CASE WHEN o_orderstatus = 'F' THEN CAST(o_totalprice AS VARCHAR) ELSE o_orderpriority END AS mixed_text FROM orders)")
_DOUBTFUL_NUM = ["o_orderkey", "o_custkey", "next_key", "o_totalprice", "customer_age", "discount_rate", "spikes"]
_DOUBTFUL_STR = ["o_orderpriority", "tag", "mixed_text"]
_DOUBTFUL_RANGES = (f"SELECT 'o_totalprice' AS \"column\", 'negative_money' AS rule, CAST(count_if(o_totalprice < 0) AS BIGINT) AS n_invalid FROM {_DOUBTFUL_SQL} x "
                    f"UNION ALL SELECT 'customer_age', 'age_range', CAST(count_if(customer_age < 0 OR customer_age > 150) AS BIGINT) FROM {_DOUBTFUL_SQL} x "
                    f"UNION ALL SELECT 'discount_rate', 'percent_range', CAST(count_if(discount_rate < 0 OR discount_rate > 100) AS BIGINT) FROM {_DOUBTFUL_SQL} x")


def _doubtful_orders(spark, sf):
    """orders with names that range rules read, a constant, two identifiers, a spike, rare classes and mixed text."""
    from pyspark.sql import functions as F
    c = F.col
    return I.table(spark, sf, "orders").select(
        "o_orderkey", "o_custkey", (c("o_orderkey") + 1).alias("next_key"), "o_orderpriority", "o_totalprice",
        (c("o_totalprice") / 5000 - 20).alias("customer_age"), (c("o_totalprice") / 5000).alias("discount_rate"),
        F.lit("x").alias("tag"), F.when(c("o_orderkey") < 100, 1000.0).otherwise(1.0).alias("spikes"),
        F.when(c("o_orderkey") % 20 == 0, "rare").otherwise("common").alias("outcome"),
        F.when(c("o_orderstatus") == "F", c("o_totalprice").cast("string")).otherwise(c("o_orderpriority")).alias("mixed_text"))


@register("quality_issues", _issues_sql(_DOUBTFUL_SQL + " x", _DOUBTFUL_STR + ["outcome"], _DOUBTFUL_RANGES))
def q_quality_issues(spark, sf):
    from tablescope.operators import quality
    return quality.quality_issues(_doubtful_orders(spark, sf))


@register("rule_facts", f"""
WITH {_rule_facts_ctes(_DOUBTFUL_SQL, _DOUBTFUL_NUM + _DOUBTFUL_STR + ["outcome"], _DOUBTFUL_NUM, _DOUBTFUL_STR + ["outcome"], "outcome", _DOUBTFUL_RANGES)}
SELECT CAST(issues AS BIGINT) AS quality_issues, CAST(related AS BIGINT) AS related_pairs, collinear > 0 AS collinear,
       CAST(skewed AS BIGINT) AS highly_skewed_columns, 'classification' AS task_type,
       CASE WHEN classes < 2 THEN 'critical' WHEN ratio > 10 THEN 'high' WHEN ratio > 3 THEN 'medium' ELSE 'low' END AS imbalance FROM facts""")
def q_rule_facts(spark, sf):
    from tablescope.operators import findings
    return findings.rule_facts(_doubtful_orders(spark, sf), target="outcome").drop("target_normal")


@register("findings_doubtful", f"""
WITH {_rule_facts_ctes(_DOUBTFUL_SQL, _DOUBTFUL_NUM + _DOUBTFUL_STR + ["outcome"], _DOUBTFUL_NUM, _DOUBTFUL_STR + ["outcome"], "outcome", _DOUBTFUL_RANGES)}
SELECT rule_set, rule, CAST(priority AS BIGINT) AS priority, action_needed FROM (
SELECT 'feature_engineering' AS rule_set, 'transformations' AS rule, 5 AS priority, false AS action_needed, skewed > 0 AS hit FROM facts
UNION ALL SELECT 'feature_engineering', 'interactions', 4, false, related > 0 FROM facts
UNION ALL SELECT 'modelling', 'imbalanced_classes', 9, true, ratio > 10 FROM facts
UNION ALL SELECT 'modelling', 'balanced_classes', 5, false, ratio <= 10 FROM facts
UNION ALL SELECT 'modelling', 'multicollinearity', 6, true, collinear > 0 FROM facts
UNION ALL SELECT 'data_collection', 'quality_issues', 6, true, issues > 0 FROM facts
UNION ALL SELECT 'key', 'class_imbalance', 9, true, ratio > 10 FROM facts
UNION ALL SELECT 'key', 'target_suitable', 6, false, ratio <= 10 FROM facts
UNION ALL SELECT 'key', 'many_related_pairs', 7, true, related > 10 FROM facts
UNION ALL SELECT 'key', 'related_pairs', 5, false, related BETWEEN 1 AND 10 FROM facts
UNION ALL SELECT 'quality', 'constant_columns', 6, true, const > 0 FROM facts
UNION ALL SELECT 'quality', 'type_issues', 6, true, mixed > 0 FROM facts
UNION ALL SELECT 'quality', 'id_like_columns', 4, true, ids > 1 FROM facts) WHERE hit""")
def q_findings_doubtful(spark, sf):
    """The findings that rest on facts beside the profile and on constant, mixed and identifier columns."""
    from pyspark.sql import functions as F
    from tablescope.operators import findings
    f = findings.findings(_doubtful_orders(spark, sf), target="outcome").where(
        (F.col("rule_set").isin("feature_engineering", "quality") & ~F.col("rule").isin(
            "missing_rate", "duplicates", "datetime_features", "dimensionality"))
        | F.col("rule").isin("imbalanced_classes", "balanced_classes", "multicollinearity", "quality_issues", "class_imbalance",
                             "target_suitable", "many_related_pairs", "related_pairs"))
    return f.select("rule_set", "rule", "priority", "action_needed")


@register("findings_regression", """
WITH m AS (SELECT avg(o_totalprice) AS m FROM orders),
a AS (SELECT count(o_totalprice) AS n, count(DISTINCT o_totalprice) AS d, avg(pow(o_totalprice - m.m, 3)) / pow(avg(pow(o_totalprice - m.m, 2)), 1.5) AS sk,
             avg(pow(o_totalprice - m.m, 4)) / pow(avg(pow(o_totalprice - m.m, 2)), 2) - 3 AS ku FROM orders, m),
b AS (SELECT n, exp(-n / 12.0 * (sk * sk + ku * ku / 4.0)) > 0.05 AS normal FROM a)
SELECT 'modelling' AS rule_set, 'non_normal_target' AS rule, 'medium' AS severity FROM b WHERE n >= 10 AND NOT normal
UNION ALL SELECT 'modelling', 'normal_target', 'medium' FROM b WHERE n >= 10 AND normal
UNION ALL SELECT 'key', 'target_suitable', 'medium' FROM b WHERE n >= 10""")
def q_findings_regression(spark, sf):
    """The findings about a regression target."""
    from pyspark.sql import functions as F
    from tablescope.operators import findings
    f = findings.findings(I.table(spark, sf, "orders"), target="o_totalprice")
    return f.where(F.col("rule").contains("target") | F.col("rule").contains("class")).select("rule_set", "rule", "severity")


# --------------------------------------------------------------------------- names and types of columns

def _described(tbl: str) -> str:
    """(column, position, data_type) of a table, with the names Spark gives the types."""
    return f"""(SELECT column_name AS "column", CAST(row_number() OVER () - 1 AS INTEGER) AS position,
        CASE column_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'DOUBLE' THEN 'double' WHEN 'VARCHAR' THEN 'string'
             WHEN 'DATE' THEN 'date' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' END AS data_type
        FROM (DESCRIBE SELECT * FROM {tbl}))"""


_BASIC = ("CASE WHEN data_type IN ('bigint', 'int', 'double') THEN 'numeric' WHEN data_type IN ('date', 'timestamp_ntz') THEN 'datetime' "
          "ELSE 'categorical' END")


@register("basic_types", f"""SELECT *, {_BASIC} AS basic_type FROM {_described('lineitem')}""")
def q_basic_types(spark, sf):
    return types.basic_types(I.table(spark, sf, "lineitem"))


@register("dtype_summary", f"""SELECT data_type, count(*) AS n_columns FROM {_described('lineitem')} GROUP BY data_type""")
def q_dtype_summary(spark, sf):
    return types.dtype_summary(I.table(spark, sf, "lineitem"))


@register("name_flags", f"""
SELECT "column", position, regexp_matches("column", 'id|key|index|uuid') AS potential_id,
       regexp_matches("column", 'name|email|phone|address|ssn|social|id|user|customer|account|person|individual|contact|zip|postal|credit|card|license|passport|birth|age') AS potential_pii,
       regexp_matches("column", 'target|label|class|y|outcome') AS target_like FROM {_described('customer')}""")
def q_name_flags(spark, sf):
    return types.name_flags(I.table(spark, sf, "customer"))


def _names(kind: str) -> str:
    return f"(SELECT string_agg(\"column\", ',' ORDER BY position) FROM {_described('orders')} WHERE {_BASIC} = '{kind}')"


@register("basic_info", f"""
SELECT CAST(count(*) AS BIGINT) AS "rows", CAST(6 AS BIGINT) AS columns,
       CAST(8 * (count(o_orderkey) + count(o_custkey) + count(o_totalprice) + count(o_orderdate))
            + sum(strlen(o_orderstatus)) + sum(strlen(o_orderpriority)) AS BIGINT) AS bytes,
       {_names('numeric')} AS numeric_columns, {_names('categorical')} AS categorical_columns, {_names('datetime')} AS datetime_columns
FROM orders""")
def q_basic_info(spark, sf):
    return profile.basic_info(I.table(spark, sf, "orders"))


# --------------------------------------------------------------------------- files written and read back

def _csv_copy(df: DataFrame, name: str, **options) -> str:
    """The rows as CSV with a header below the checkpoint folder; the writer is Spark's."""
    from tablescope.session import work_path
    path = work_path(df.sparkSession, name)
    df.write.option("header", True).option("escape", '"').options(**options).csv(path)
    return path


@register("read_csv", """SELECT doc_id, text, lang, source, CAST(n_chars AS BIGINT) AS n_chars FROM documents""")
def q_read_csv(spark, sf):
    """documents as CSV, line breaks inside the quoted texts included, read back."""
    from tablescope.sources import io
    out = io.read_csv(spark, _csv_copy(I.table(spark, sf, "documents"), "documents-csv"))
    return out.withColumns({c: out[c].cast("long") for c in ("doc_id", "n_chars")})


@register("read_csv_auto", """SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer""")
def q_read_csv_auto(spark, sf):
    """customer as CSV with ';', the delimiter, the encoding and the types found from the files."""
    from tablescope.sources import io
    out = io.read_csv_auto(spark, _csv_copy(I.table(spark, sf, "customer"), "customer-csv", sep=";"))
    return out.withColumn("c_custkey", out.c_custkey.cast("long"))


@register("read_table", "SELECT * FROM nation")
def q_read_table(spark, sf):
    from tablescope.sources import io
    return io.read_table(spark, f"{sf.rstrip('/')}/nation.parquet")


@register("write_contingency_csv", ORACLE["contingency"])
def q_write_contingency_csv(spark, sf):
    from tablescope.session import work_path
    from tablescope.sources import io
    path = work_path(spark, "contingency")
    written = io.write_contingency_csv(I.docs_labels(spark, sf), "quality", "lang", path)
    back = io.read_csv(spark, path)
    return back.select(*[back[f.name].cast(f.dataType).alias(f.name) for f in written.schema])


@register("write_key_findings_csv", f"""
SELECT CAST(priority AS BIGINT) AS "Priority", category AS "Category", rule AS "Insight",
       CASE WHEN action_needed THEN 'Yes' ELSE 'No' END AS "Action Needed" FROM ({ORACLE['key_findings_orders']})""")
def q_write_key_findings_csv(spark, sf):
    from tablescope.operators import findings
    from tablescope.session import work_path
    from tablescope.sources import io
    path = work_path(spark, "key-findings")
    io.write_key_findings_csv(findings.key_findings(I.table(spark, sf, "orders"), target="o_orderpriority"), path)
    back = io.read_csv(spark, path)
    return back.withColumn("Priority", back.Priority.cast("long"))


@register("write_findings_json", f"""
SELECT 'contingency' AS result, concat_ws('|', quality, lang, n) AS item FROM ({ORACLE['contingency']})
UNION ALL SELECT 'missing', concat_ws('|', "column", missing_count, severity) FROM ({ORACLE['missing_profile']})""")
def q_write_findings_json(spark, sf):
    """Two results as one JSON document, read back as one document."""
    from pyspark.sql import functions as F
    from tablescope.operators import stat_tests
    from tablescope.session import work_path
    from tablescope.sources import io
    df = I.docs_labels(spark, sf)
    path = work_path(spark, "findings-json")
    io.write_findings_json({"contingency": stat_tests.contingency(df, "quality", "lang"),
                            "missing": missing.missing_profile(df)}, path, "documents")
    doc = spark.read.option("multiLine", True).json(path)
    parts = [doc.select(F.inline(f"results.{name}")).select(F.lit(name).alias("result"), F.concat_ws("|", *cols).alias("item"))
             for name, cols in (("contingency", ["quality", "lang", "n"]), ("missing", ["column", "missing_count", "severity"]))]
    return parts[0].unionAll(parts[1])


_QC_TYPES = ", ".join(f"('{c}', '{dt}')" for c, dt in ORDERS_COLS)
_QC_NUM = ["o_orderkey", "o_custkey", "o_totalprice"]


@register("write_quality_csv", f"""
WITH ty(c, dt) AS (VALUES {_QC_TYPES}), r AS (SELECT count(*) AS r FROM orders),
mz AS ({U([f"SELECT '{c}' AS c, 'Missing Values' AS a, count_if({c} IS NULL) AS n, 50 AS hi, 20 AS mid, 'missing cells' AS d FROM orders" for c, _ in ORDERS_COLS]
          + [f"SELECT '{c}', 'Zero Values', count_if({c} = 0), 70, 30, 'zero values' FROM orders" for c in _QC_NUM])}),
mp AS (SELECT *, {PCT('n', 'r')} AS p FROM mz, r),
q AS ({_iqr_cte('orders', _QC_NUM)}),
b AS (SELECT *, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM q),
o AS ({_iqr_count('orders', _QC_NUM)}),
op AS (SELECT b.c, oc, {PCT('oc', 'n')} AS p FROM b JOIN o ON b.c = o.c)
SELECT x.*, ty.dt AS "Data_Type" FROM (
SELECT a AS "Assessment_Type", c AS "Column", CAST(n AS BIGINT) AS "Issue_Count", p AS "Issue_Percentage",
       CASE WHEN p > hi THEN 'High' WHEN p > mid THEN 'Medium' ELSE 'Low' END AS "Severity" FROM mp WHERE n > 0
UNION ALL SELECT 'Outliers', c, CAST(oc AS BIGINT), p, CASE WHEN p > 10 THEN 'High' WHEN p > 5 THEN 'Medium' ELSE 'Low' END FROM op WHERE oc > 0
UNION ALL SELECT 'Cardinality', "column", unique_count, unique_pct, cardinality FROM ({ORACLE['cardinality_profile']})) x
JOIN ty ON x."Column" = ty.c""")
def q_write_quality_csv(spark, sf):
    """The quality table of orders as CSV, read back; the free text of ``Details`` is left out."""
    from tablescope.session import work_path
    from tablescope.sources import io
    path = work_path(spark, "quality")
    written = io.write_quality_csv(I.table(spark, sf, "orders"), path).drop("Details")
    back = io.read_csv(spark, path)
    return back.select(*[back[f.name].cast(f.dataType).alias(f.name) for f in written.schema])


@register("write_clustered_csv", f"""
SELECT c_custkey, round(c_acctbal, 4) AS c_acctbal, round(coalesce(avg_order, (SELECT median(avg_order) FROM {CO})), 4) AS avg_order,
       true AS labelled FROM {CO}""")
def q_write_clustered_csv(spark, sf):
    """Customers with gaps filled and a cluster of three each, written and read back."""
    from pyspark.sql import functions as F
    from tablescope.session import work_path
    from tablescope.sources import io
    path = work_path(spark, "clusters")
    df = I.customer_orders(spark, sf).select("c_custkey", "c_acctbal", "avg_order")
    io.write_clustered_csv(df, ["c_acctbal", "avg_order"], [], 3, path)
    back = io.read_csv(spark, path)
    return back.select(back.c_custkey.cast("long").alias("c_custkey"), *[
        (F.round(F.col(c) * 10000) / 10000).alias(c) for c in ("c_acctbal", "avg_order")],
        back.Cluster.between(0, 2).alias("labelled"))


# --------------------------------------------------------------------------- reports

@register("quality_report", f"""
WITH r AS (SELECT count(*) AS r FROM orders),
q AS ({_iqr_cte('orders', _QC_NUM)}),
b AS (SELECT *, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM q),
o AS ({_iqr_count('orders', _QC_NUM)}),
x AS (SELECT 'basic_info' AS section, CAST(NULL AS VARCHAR) AS "column", r AS value FROM r
UNION ALL SELECT 'density', NULL, r FROM r
UNION ALL SELECT 'duplicates', NULL, r FROM r, (VALUES ('all_columns'), ('without_id_columns'), ('without_last_column')) s(subset)
UNION ALL {U([f"SELECT 'missing', '{c}', count_if({c} IS NULL) FROM orders" for c, _ in ORDERS_COLS])}
UNION ALL {U([f"SELECT 'zero_values', '{c}', count_if({c} = 0) FROM orders HAVING count_if({c} = 0) > 0" for c in _QC_NUM])}
UNION ALL {U([f"SELECT 'cardinality', '{c}', count(DISTINCT {c}) FROM orders" for c, _ in ORDERS_COLS])}
UNION ALL {U([f"SELECT 'constant_columns', '{c}', NULL FROM orders HAVING count(DISTINCT {c}) <= 1" for c, _ in ORDERS_COLS])}
UNION ALL SELECT 'outliers', c, oc FROM o WHERE oc > 0
UNION ALL {U([f"SELECT 'mixed_types', '{c}', count(try_cast({c} AS DOUBLE)) FROM orders HAVING count(try_cast({c} AS DOUBLE)) > 0 AND count(try_cast({c} AS DOUBLE)) < count({c})" for c in ('o_orderstatus', 'o_orderpriority')])}
UNION ALL {U([f"SELECT 'format_checks', '{c}', count({c}) FROM orders" for c in ('o_orderstatus', 'o_orderpriority')])})
SELECT section, "column", CAST(value AS BIGINT) AS value FROM x""")
def q_quality_report(spark, sf):
    """The report over orders as one tall frame, with the count that each section holds of a column."""
    from pyspark.sql import functions as F
    from tablescope.plans import reports
    tall = reports.quality_report(I.table(spark, sf, "orders")).written()
    counts = {"basic_info": "rows", "density": "rows", "duplicates": "rows", "missing": "missing_count",
              "zero_values": "zero_count", "cardinality": "unique_count", "constant_columns": "none", "outliers": "n_outliers",
              "mixed_types": "numeric_values", "format_checks": "n"}
    value = F.coalesce(*[F.when(F.col("section") == s, F.get_json_object("row", f"$.{field}")) for s, field in counts.items()])
    return tall.where(F.col("section").isin(*counts)).select(
        "section", F.get_json_object("row", "$.column").alias("column"), value.cast("long").alias("value"))


@register("analysis_report")
def q_analysis_report(spark, sf):
    """Structure, missing values, components, mutual information and interactions of customers, one tall frame."""
    from tablescope.plans import reports
    co = I.customer_orders(spark, sf).select("c_nationkey", "c_acctbal", "total_spent", "avg_order", "n_orders")
    return reports.analysis_report(co, target="c_nationkey").written()


@register("insight_report")
def q_insight_report(spark, sf):
    """All stages of the insight report over orders, one tall frame."""
    from tablescope.plans import reports
    return reports.insight_report(I.table(spark, sf, "orders"), target="o_orderpriority").written()
