"""Column and dataset profiles.

Scalar statistics come from one wide aggregate per batch of columns (partial
aggregation on every task, one tiny final merge).  Distinct counts, dominant values,
entropy and value lengths come from the value histogram, never from many
``count_distinct`` in one aggregate (which multiplies rows through an Expand).
Quantiles are exact and come from the ranked histogram.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablescope.functions.constants import ID_NAME_PARTS, IQR_FACTOR, NULL_LIKE_PROFILE
from tablescope.functions.exprs import (
    as_double, as_string, canonical_bool, col, is_atomic, is_datetime, is_numeric,
    is_string, literal_rows, name_contains, nan_to_null, parse_timestamp, pct, r4, scalar_structs, sig, strip,
    tall_agg, rnd, with_scalars,
)
from tablescope.operators.histogram import (
    TYPED, exact_quantiles, numeric_histogram, top_k_per_group, value_histogram, wide_quantiles,
)


def _positions(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column, position, data_type): one row per column, broadcast to the tables joined with it."""
    return F.broadcast(literal_rows(df.sparkSession,
                                    [(c, i, df.schema[c].dataType.simpleString()) for i, c in enumerate(cols)],
                                    "column string, position int, data_type string"))


def _atomic(df: DataFrame) -> list[str]:
    return [c for c in df.columns if is_atomic(df.schema[c].dataType)]


# --------------------------------------------------------------------------- summaries

def missing_counts(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """(column, rows, missing_count) — one pass, ``count_if(c IS NULL)`` per column."""
    df = nan_to_null(df)
    cols = list(cols or df.columns)
    return tall_agg(df, cols, lambda c: {"missing_count": F.count_if(col(c).isNull()).cast("long")},
                    ["missing_count"], shared={"rows": F.count(F.lit(1)).cast("long")})


def distinct_counts(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """(column, unique_values) from the value histogram (nulls ignored, like ``nunique``)."""
    df = nan_to_null(df)
    cols = list(cols or _atomic(df))
    hist = value_histogram(df, cols).where(F.col("value").isNotNull())
    return hist.groupBy("column").agg(F.count(F.lit(1)).cast("long").alias("unique_values"))


def sample_values(df: DataFrame, cols: Sequence[str] | None = None, k: int = 3) -> DataFrame:
    """(column, sample_values): the k smallest distinct values (as text), comma-joined.

    k small scans, each for the least value above the one before, in place of a sort of all values.
    """
    df = nan_to_null(df)
    cols = list(cols or _atomic(df))
    base = df.select(*[as_string(c).alias(f"v{i}") for i, c in enumerate(cols)])
    found = base.agg(*[F.min(f"v{i}").alias(f"s0_{i}") for i in range(len(cols))])
    for step in range(1, k):
        least = with_scalars(base, found).agg(*[
            F.min(F.when(F.col(f"v{i}") > F.col(f"s{step - 1}_{i}"), F.col(f"v{i}"))).alias(f"s{step}_{i}")
            for i in range(len(cols))])
        found = found.crossJoin(F.broadcast(least))  # one row each
    return found.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.concat_ws(", ", *[F.col(f"s{s}_{i}") for s in range(k)]).alias("sample_values"),
                 F.col(f"s0_{i}").alias("_first")) for i, c in enumerate(cols)]))
    ).where(F.col("_first").isNotNull()).drop("_first")


def column_summary(df: DataFrame) -> DataFrame:
    """Column, data type, % missing (2 dp), unique values, three sample values."""
    df = nan_to_null(df)
    cols = _atomic(df)
    # every side has one row per column
    out = (missing_counts(df, cols).join(_positions(df, cols), "column")
           .join(F.broadcast(distinct_counts(df, cols)), "column", "left")
           .join(F.broadcast(sample_values(df, cols)), "column", "left"))
    return out.select(
        "column", "position", "data_type",
        pct(F.col("missing_count"), F.col("rows")).alias("missing_pct"),
        F.coalesce("unique_values", F.lit(0)).cast("long").alias("unique_values"),
        "sample_values").orderBy("position")


def duplicate_rows(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Rows equal to an earlier row (null-safe): rows - distinct rows, and its %."""
    df = nan_to_null(df)
    cols = list(cols or _atomic(df))
    groups = df.groupBy(*[col(c) for c in cols]).agg(F.count(F.lit(1)).alias("_n"))
    return groups.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).cast("long").alias("rows"),
        F.count(F.lit(1)).cast("long").alias("distinct_rows"),
        F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).cast("long").alias("duplicate_rows"),
    ).withColumn("duplicate_pct", pct(F.col("duplicate_rows"), F.col("rows")))


def duplicate_rows_subset(df: DataFrame) -> DataFrame:
    """Duplicates ignoring id-named columns, and ignoring the last column."""
    df = nan_to_null(df)
    cols = _atomic(df)
    no_id = [c for c in cols if not name_contains(c, ID_NAME_PARTS)]
    parts = [duplicate_rows(df, cols).select(F.lit("all_columns").alias("subset"), "*")]
    if no_id and len(no_id) < len(cols):
        parts.append(duplicate_rows(df, no_id).select(F.lit("without_id_columns").alias("subset"), "*"))
    if len(cols) > 1:
        parts.append(duplicate_rows(df, cols[:-1]).select(F.lit("without_last_column").alias("subset"), "*"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def dataset_overview(df: DataFrame) -> DataFrame:
    """Per column: type, missing count and %, unique, samples; shape and duplicates repeated."""
    df = nan_to_null(df)
    cols = _atomic(df)
    dup = duplicate_rows(df, cols).select(F.col("duplicate_rows").alias("dataset_duplicate_rows"))
    out = with_scalars(column_summary(df).join(
        F.broadcast(missing_counts(df, cols).select("column", "missing_count", "rows")), "column"), dup)
    return out.select("column", "position", "data_type", "missing_count", "missing_pct", "unique_values",
                      "sample_values", "rows", F.lit(len(df.columns)).cast("long").alias("columns"),
                      "dataset_duplicate_rows").orderBy("position")


def data_density(df: DataFrame) -> DataFrame:
    """100 x non-null cells / cells (2 dp)."""
    df = nan_to_null(df)
    k = len(df.columns)
    nn = sum([F.count(col(c)) for c in df.columns], F.lit(0))
    return df.agg(F.count(F.lit(1)).cast("long").alias("rows"), nn.cast("long").alias("non_null_cells")).select(
        "rows", F.lit(k).cast("long").alias("columns"), "non_null_cells",
        pct(F.col("non_null_cells"), F.col("rows") * k).alias("density"))


_FIXED_WIDTH = {"tinyint": 1, "smallint": 2, "int": 4, "bigint": 8, "float": 4, "double": 8,
                "boolean": 1, "date": 4, "timestamp": 8, "timestamp_ntz": 8}


def column_bytes(df: DataFrame) -> DataFrame:
    """Bytes held per column: UTF-8 length for strings, fixed width x non-nulls otherwise."""
    cols = _atomic(df)

    def make(c):
        dt = df.schema[c].dataType
        if is_string(dt):
            return {"bytes": F.coalesce(F.sum(F.octet_length(col(c))), F.lit(0)).cast("long")}
        w = _FIXED_WIDTH.get(dt.simpleString(), 16)
        return {"bytes": (F.count(col(c)) * w).cast("long")}

    t = tall_agg(df, cols, make, ["bytes"])
    return (t.join(_positions(df, cols), "column")
            .withColumn("size_rank", F.row_number().over(Window.orderBy(F.desc("bytes"), "position")))
            .orderBy("position"))


def basic_info(df: DataFrame) -> DataFrame:
    """One row: rows, columns, bytes held, and the names of the numeric, categorical and datetime columns
    by data type (joined by commas, null where there are none)."""
    from tablescope.operators.types import basic_types
    df = nan_to_null(df)
    names = basic_types(df).agg(*[
        F.expr(f"nullif(array_join(transform(array_sort(collect_list(CASE WHEN basic_type = '{kind}' "
               "THEN struct(position, `column`) END)), x -> x.`column`), ','), '')").alias(f"{kind}_columns")
        for kind in ("numeric", "categorical", "datetime")])
    size = with_scalars(df.agg(F.count(F.lit(1)).cast("long").alias("rows")).withColumn(
        "columns", F.lit(len(df.columns)).cast("long")), column_bytes(df).agg(F.sum("bytes").cast("long").alias("bytes")))
    return with_scalars(size, names)


# --------------------------------------------------------------------------- numeric

def numeric_profile(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """count, mean, std, min, max, skewness, kurtosis, zeros, negatives, variance, CV,
    unique count / ratio, IQR outlier %, and the issue flags."""
    df = nan_to_null(df)
    cols = list(cols or [c for c in df.columns if is_numeric(df.schema[c].dataType)])

    qs = wide_quantiles(exact_quantiles(df, cols, [0.25, 0.75]), ["column"], {0.25: "q1", 0.75: "q3"})
    spread = F.col("q3") - F.col("q1")
    bounds = qs.select("column", (F.col("q1") - IQR_FACTOR * spread).alias("lo"), (F.col("q3") + IQR_FACTOR * spread).alias("hi"))
    at = {c: F.col(f"__s{i}") for i, c in enumerate(cols)}

    def make(c):
        x = as_double(df, c)
        return {"outlier_count": F.count_if((x < at[c]["lo"]) | (x > at[c]["hi"])).cast("long"),
                "n": F.count(x).cast("long"), "mean": F.avg(x), "std": F.stddev_samp(x),
                "min": F.min(x), "max": F.max(x), "skewness": F.skewness(x), "kurtosis": F.kurtosis(x),
                "zero_count": F.count_if(x == 0).cast("long"), "negative_count": F.count_if(x < 0).cast("long"),
                "variance": F.var_samp(x)}

    fields = ["outlier_count", "n", "mean", "std", "min", "max", "skewness", "kurtosis", "zero_count",
              "negative_count", "variance"]
    base = tall_agg(with_scalars(df, scalar_structs(bounds, cols, ["lo", "hi"])), cols, make, fields)
    uniq = (numeric_histogram(df, cols).groupBy("column")
            .agg(F.count(F.lit(1)).cast("long").alias("unique_count")))
    t = base.join(F.broadcast(uniq), "column", "left").join(_positions(df, cols), "column")
    skew = F.col("skewness")
    highly = F.abs(skew) > 2
    moderately = (F.abs(skew) > 1) & (F.abs(skew) <= 2)
    low_var = F.col("variance") < 0.01
    outlier_pct = pct(F.col("outlier_count"), F.col("n"))
    zero_pct = pct(F.col("zero_count"), F.col("n"))
    issues = F.concat_ws(",", F.when(highly, "highly_skewed"), F.when(low_var, "low_variance"),
                         F.when(outlier_pct > 10, "many_outliers"), F.when(zero_pct > 50, "mostly_zeros"))
    return t.where(F.col("n") > 0).select(
        "column", "position", "n", r4(F.col("mean")).alias("mean"), r4(F.col("std")).alias("std"),
        r4(F.col("min")).alias("min"), r4(F.col("max")).alias("max"),
        r4(skew).alias("skewness"), r4(F.col("kurtosis")).alias("kurtosis"),
        F.coalesce(highly, F.lit(False)).alias("highly_skewed"),
        F.coalesce(moderately, F.lit(False)).alias("moderately_skewed"),
        "zero_count", zero_pct.alias("zero_pct"),
        "negative_count", pct(F.col("negative_count"), F.col("n")).alias("negative_pct"),
        sig(F.col("variance")).alias("variance"),
        r4(F.coalesce(F.try_divide(F.col("std"), F.col("mean")), F.lit(0.0))).alias("cv"),
        F.coalesce(low_var, F.lit(False)).alias("low_variance"),
        "unique_count", r4(F.col("unique_count") / F.col("n")).alias("unique_ratio"),
        F.coalesce("outlier_count", F.lit(0)).cast("long").alias("outlier_count"),
        outlier_pct.alias("outlier_pct"), issues.alias("issues"),
    ).orderBy("position")


# --------------------------------------------------------------------------- categorical

def categorical_profile(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Cardinality, dominance, entropy, balance, null-like values, lengths, case and
    whitespace faults, from the value histogram only."""
    df = nan_to_null(df)
    cols = list(cols or [c for c in df.columns if is_string(df.schema[c].dataType)])
    hist = value_histogram(df, cols).where(F.col("value").isNotNull())
    nlen = F.length("value")
    g = hist.groupBy("column").agg(
        F.sum("n").cast("long").alias("n"),
        F.count(F.lit(1)).cast("long").alias("unique_values"),
        F.min(F.struct((-F.col("n")).alias("neg"), F.col("value").alias("v"))).alias("_dom"),
        F.sum(F.col("n") * F.log2("n")).alias("_nlogn"),
        F.min("n").alias("_min_n"), F.max("n").alias("_max_n"),
        F.bool_or(F.lower("value").isin(NULL_LIKE_PROFILE)).alias("has_null_like"),
        F.sum(F.col("n") * nlen).alias("_len_sum"),
        F.max(nlen).cast("long").alias("max_len"), F.min(nlen).cast("long").alias("min_len"),
        F.bool_or(F.col("value").contains(" ") & (strip("value") != F.col("value"))).alias("whitespace_issue"))
    lower = (hist.select("column", F.lower("value").alias("lv")).distinct()
             .groupBy("column").agg(F.count(F.lit(1)).alias("_lower_distinct")))
    g = g.join(F.broadcast(lower), "column").join(_positions(df, cols), "column")
    n = F.col("n")
    u = F.col("unique_values")
    dom_n = -F.col("_dom.neg")
    dom_pct = dom_n * 100.0 / n
    entropy = F.log2(n) - F.col("_nlogn") / n
    case_issue = F.col("_lower_distinct") < u
    high_card = u > n * 0.5
    very_high = u > n * 0.8
    id_like = u / n > 0.95
    highly_dom = dom_pct > 90
    issues = F.concat_ws(",", F.when(high_card, "high_cardinality"), F.when(highly_dom, "single_value_dominant"),
                         F.when(id_like, "likely_id_column"), F.when(case_issue, "case_sensitivity"),
                         F.when(F.col("whitespace_issue"), "whitespace_issues"))
    return g.select(
        "column", "position", "n", "unique_values", r4(u / n).alias("unique_ratio"),
        high_card.alias("high_cardinality"), very_high.alias("very_high_cardinality"),
        id_like.alias("potential_id"),
        F.col("_dom.v").alias("dominant_value"), rnd(dom_pct, 2).alias("dominant_pct"),
        highly_dom.alias("highly_dominant"), ((dom_pct >= 70) & (dom_pct <= 90)).alias("moderately_dominant"),
        r4(entropy).alias("entropy"),
        (rnd(entropy, 4) > F.log2(u) * 0.9).alias("uniform"),
        (u == 2).alias("is_binary"),
        F.when(u == 2, rnd(F.col("_min_n") / F.col("_max_n"), 3)).alias("binary_balance"),
        "has_null_like", rnd(F.col("_len_sum") / n, 2).alias("avg_len"), "max_len", "min_len",
        case_issue.alias("case_issue"), "whitespace_issue", issues.alias("issues"),
    ).orderBy("position")


def top_categories(df: DataFrame, cols: Sequence[str] | None = None, k: int = 10) -> DataFrame:
    """(column, rank, value, n, pct): the k most frequent values (ties: value ascending)."""
    df = nan_to_null(df)
    cols = list(cols or [c for c in df.columns if is_string(df.schema[c].dataType)])
    hist = value_histogram(df, cols).where(F.col("value").isNotNull())
    tot = hist.groupBy("column").agg(F.sum("n").alias("_tot"))
    top = top_k_per_group(hist, ["column"], [F.desc("n"), F.asc("value")], k, ["value"])
    return top.join(F.broadcast(tot), "column").select(
        "column", F.col("rank").cast("long").alias("rank"), "value", F.col("n").cast("long").alias("n"),
        pct(F.col("n"), F.col("_tot")).alias("pct"))


# --------------------------------------------------------------------------- datetime / boolean

def datetime_profile(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """count, min, max, range in days, unique and duplicate timestamps, time part,
    multi-year span, business-hours-only (9 <= hour <= 17)."""
    df = nan_to_null(df)
    cols = list(cols or [c for c in df.columns if is_datetime(df.schema[c].dataType)])
    conv = df.select(*[(col(c).cast("timestamp_ntz") if is_datetime(df.schema[c].dataType)
                        else parse_timestamp(col(c)).cast("timestamp_ntz")).alias(c) for c in cols])

    def make(c):
        x = col(c)
        return {"n": F.count(x).cast("long"), "min_ts": F.min(x), "max_ts": F.max(x),
                "has_time": F.bool_or((F.hour(x) != 0) | (F.minute(x) != 0)),
                "min_year": F.min(F.year(x)), "max_year": F.max(F.year(x)),
                "business_hours_only": F.bool_and((F.hour(x) >= 9) & (F.hour(x) <= 17))}

    t = tall_agg(conv, cols, make, ["n", "min_ts", "max_ts", "has_time", "min_year", "max_year",
                                    "business_hours_only"])
    uniq = (value_histogram(conv, cols).where(F.col("value").isNotNull())
            .groupBy("column").agg(F.count(F.lit(1)).cast("long").alias("unique_dates")))
    span = F.unix_micros(F.col("max_ts").cast("timestamp")) - F.unix_micros(F.col("min_ts").cast("timestamp"))
    return t.join(F.broadcast(uniq), "column").join(_positions(df, cols), "column").where(F.col("n") > 0).select(
        "column", "position", "n", "min_ts", "max_ts",
        F.floor(span / F.lit(86400 * 1_000_000)).cast("long").alias("range_days"),
        "unique_dates", (F.col("n") - F.col("unique_dates")).alias("duplicate_dates"),
        "has_time", (F.col("max_year") != F.col("min_year")).alias("spans_years"),
        "business_hours_only").orderBy("position")


def boolean_profile(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """count, true / false counts, true %, balance ratio (3 dp), well balanced (> 0.3)."""
    df = nan_to_null(df)

    def make(c):
        b = canonical_bool(df, c)
        return {"n": F.count(b).cast("long"), "true_count": F.count_if(b).cast("long")}

    t = tall_agg(df, list(cols), make, ["n", "true_count"])
    f = F.col("n") - F.col("true_count")
    bal = rnd(F.try_divide(F.least("true_count", f), F.greatest("true_count", f)), 3)
    return t.where(F.col("n") > 0).select(
        "column", "n", "true_count", f.alias("false_count"),
        pct(F.col("true_count"), F.col("n")).alias("true_pct"), bal.alias("balance_ratio"),
        F.coalesce(bal > 0.3, F.lit(False)).alias("well_balanced"))


# --------------------------------------------------------------------------- cardinality & co

def cardinality_profile(df: DataFrame) -> DataFrame:
    """unique count and %, class (Unique / Very High / High / Medium / Low), sorted desc."""
    df = nan_to_null(df)
    cols = _atomic(df)
    t = (with_scalars(_positions(df, cols), df.agg(F.count(F.lit(1)).alias("rows")))
         .join(F.broadcast(distinct_counts(df, cols)), "column", "left").fillna(0, ["unique_values"]))
    p = F.coalesce(F.try_divide(F.col("unique_values") * 100.0, F.col("rows")), F.lit(0.0))
    cls = (F.when(F.col("unique_values") == F.col("rows"), "Unique (ID-like)").when(p > 95, "Very High")
           .when(p > 50, "High").when(p > 10, "Medium").otherwise("Low"))
    return t.select("column", "data_type", F.col("unique_values").alias("unique_count"),
                    rnd(p, 2).alias("unique_pct"), cls.alias("cardinality"),
                    (F.col("unique_values") == F.col("rows")).alias("id_like")
                    ).orderBy(F.desc("unique_count"), "column")


def constant_columns(df: DataFrame) -> DataFrame:
    """Columns with at most one distinct value (all-null included), the value and type.

    Such a column's smallest value is its largest: one scan, and nothing is shuffled."""
    df = nan_to_null(df)
    cols = _atomic(df)

    def make(c):
        x = col(c) if isinstance(df.schema[c].dataType, TYPED) else as_string(c)
        lo = F.min(x)
        if isinstance(df.schema[c].dataType, (T.FloatType, T.DoubleType)):
            lo = lo + F.lit(0.0).cast(df.schema[c].dataType)  # -0.0 counts as 0.0
        return {"value": lo.cast("string"), "same": F.min(x) == F.max(x)}

    g = tall_agg(df, cols, make, ["value", "same"]).where(F.coalesce("same", F.lit(True)))
    return (_positions(df, cols).join(F.broadcast(g), "column")
            .select("column", "data_type", "value").orderBy("column"))


def zero_values(df: DataFrame) -> DataFrame:
    """Numeric columns with zeros: count, % of all rows, severity (High > 70, Medium > 30)."""
    df = nan_to_null(df)
    cols = [c for c in df.columns if is_numeric(df.schema[c].dataType)]
    t = tall_agg(df, cols, lambda c: {"zero_count": F.count_if(col(c) == 0).cast("long")}, ["zero_count"],
                 shared={"rows": F.count(F.lit(1)).cast("long")})
    p = pct(F.col("zero_count"), F.col("rows"))
    return t.where(F.col("zero_count") > 0).select(
        "column", "zero_count", p.alias("zero_pct"),
        F.when(p > 70, "High").when(p > 30, "Medium").otherwise("Low").alias("severity"),
        (p > 50).alias("heavy")).orderBy(F.desc("zero_pct"), "column")


def duplicate_columns(df: DataFrame) -> DataFrame:
    """Column pairs of the same type equal in every row (NULL equals NULL)."""
    df = nan_to_null(df)
    cols = _atomic(df)
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]
             if df.schema[a].dataType == df.schema[b].dataType]
    spark = df.sparkSession
    if not pairs:
        return spark.createDataFrame([], "column_a string, column_b string")
    aggs = [F.bool_and(col(a).eqNullSafe(col(b))).alias(f"p{i}") for i, (a, b) in enumerate(pairs)]
    one = df.agg(*aggs)
    arr = F.array(*[F.struct(F.lit(a).alias("column_a"), F.lit(b).alias("column_b"), F.col(f"p{i}").alias("eq"))
                    for i, (a, b) in enumerate(pairs)])
    return one.select(F.explode(arr).alias("r")).select("r.*").where(F.col("eq")).drop("eq")


def grouped_mean(df: DataFrame, group: str, cols: Sequence[str] | None = None) -> DataFrame:
    """Mean of the numeric columns per group (and group size)."""
    cols = list(cols or [c for c in df.columns if c != group and is_numeric(df.schema[c].dataType)])
    return df.groupBy(col(group)).agg(F.count(F.lit(1)).cast("long").alias("n"),
                                      *[r4(F.avg(col(c))).alias(c) for c in cols])


# --------------------------------------------------------------------------- target

def class_balance(df: DataFrame, target: str) -> DataFrame:
    """Per class: count and %; with class count, imbalance ratio and status repeated."""
    df = nan_to_null(df)
    counts = df.where(col(target).isNotNull()).groupBy(as_string(target).alias("class")).agg(
        F.count(F.lit(1)).cast("long").alias("n"))
    t = with_scalars(counts, counts.agg(F.sum("n").alias("_tot"), F.count(F.lit(1)).cast("long").alias("n_classes"),
                                        F.min("n").alias("_min"), F.max("n").alias("_max")))
    ratio = F.col("_max") / F.col("_min")
    status = (F.when(F.col("n_classes") < 2, "single_class").when(ratio > 10, "severely_imbalanced")
              .when(ratio > 3, "moderately_imbalanced").otherwise("balanced"))
    severity = (F.when(F.col("n_classes") < 2, "critical").when(ratio > 10, "high")
                .when(ratio > 3, "medium").otherwise("low"))
    return t.select("class", "n", pct(F.col("n"), F.col("_tot")).alias("pct"), "n_classes",
                    F.when(F.col("n_classes") >= 2, rnd(ratio, 2)).alias("imbalance_ratio"),
                    status.alias("status"), severity.alias("severity"),
                    (F.col("n") == F.col("_min")).alias("is_minority"),
                    (F.col("n") == F.col("_max")).alias("is_majority"))


def class_distribution(df: DataFrame, target: str) -> DataFrame:
    """n classes, entropy (log2) and Gini impurity of the target distribution (4 dp)."""
    df = nan_to_null(df)
    counts = df.where(col(target).isNotNull()).groupBy(col(target)).agg(F.count(F.lit(1)).alias("n"))
    g = counts.agg(F.count(F.lit(1)).cast("long").alias("n_classes"), F.sum("n").cast("long").alias("n"),
                   F.sum(F.col("n") * F.log2("n")).alias("_nlogn"), F.sum(F.pow(F.col("n").cast("double"), 2)).alias("_n2"))
    n = F.col("n")
    return g.select("n_classes", "n", r4(F.log2(n) - F.col("_nlogn") / n).alias("entropy"),
                    r4(1 - F.col("_n2") / F.pow(n.cast("double"), 2)).alias("gini"))


def regression_target_profile(df: DataFrame, target: str) -> DataFrame:
    """count, mean, median, std, min, max, range, IQR, skewness, kurtosis (4 dp)."""
    df = nan_to_null(df)
    x = as_double(df, target)
    base = df.agg(F.count(x).cast("long").alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"),
                  F.min(x).alias("min"), F.max(x).alias("max"), F.skewness(x).alias("skewness"),
                  F.kurtosis(x).alias("kurtosis"))
    qs = wide_quantiles(exact_quantiles(df, [target], [0.25, 0.5, 0.75]), ["column"],
                        {0.25: "q1", 0.5: "median", 0.75: "q3"})
    # an all-null target has no quantile row but still its profile row
    row = qs.groupBy().agg(*[F.max(c).alias(c) for c in ("q1", "median", "q3")])
    return with_scalars(base, row).select(
        F.lit(target).alias("column"), "n", r4(F.col("mean")).alias("mean"), r4(F.col("median")).alias("median"),
        r4(F.col("std")).alias("std"), r4(F.col("min")).alias("min"), r4(F.col("max")).alias("max"),
        r4(F.col("max") - F.col("min")).alias("range"), r4(F.col("q3") - F.col("q1")).alias("iqr"),
        r4(F.col("skewness")).alias("skewness"), r4(F.col("kurtosis")).alias("kurtosis"))


def target_overview(df: DataFrame, target: str) -> DataFrame:
    """missing count / %, unique count / ratio (4 dp) and task type of the target."""
    from tablescope.operators.types import task_type
    df = nan_to_null(df)
    miss = df.agg(F.count(F.lit(1)).cast("long").alias("rows"),
                  F.count_if(col(target).isNull()).cast("long").alias("missing_count"))
    tt = task_type(df, target)
    return with_scalars(miss, tt).select(
        "column", "missing_count", pct(F.col("missing_count"), F.col("rows")).alias("missing_pct"),
        F.col("n_distinct").alias("unique_count"), "unique_ratio", "task_type")
