"""Data-quality checks that scan the data: mixed types, date formats, value ranges,
string formatting faults, and per-column / dataset warnings.

Every check is a ``count_if`` (or a histogram aggregate) in one pass per batch of
columns; whole columns are scanned, not the first 100 values.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablescope.functions.constants import (
    AGE_TOKENS, ESCAPED_UNICODE_PATTERN, NON_NEGATIVE_TOKENS, NULL_LIKE_FORMAT, PERCENT_TOKENS,
    PII_NAME_PARTS, PLACEHOLDER_VALUES, UNUSUAL_CHAR_PATTERN,
)
from tablescope.functions.exprs import (
    as_double, col, is_numeric, is_string, name_contains, name_has_token, name_tokens, nan_to_null, pct, r4, severity_rank,
    strip, tall_agg,
    with_scalars,
)
from tablescope.operators.histogram import value_histogram
from tablescope.operators.types import mixed_type_columns, typed_columns


def mixed_numeric_text(df: DataFrame) -> DataFrame:
    """String columns where some but not all values are numeric (whole column)."""
    return mixed_type_columns(df)


def mixed_date_formats(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Date-like string columns mixing '/', '-' and '.' separated forms."""
    def make(c):
        s = col(c).cast("string")
        kind = F.when(s.contains("/"), "slash_format").when(s.contains("-"), "dash_format").when(
            s.contains("."), "dot_format")
        return {"formats": F.array_sort(F.collect_set(kind))}
    t = tall_agg(nan_to_null(df), list(cols), make, ["formats"])
    return t.select("column", F.array_join("formats", ",").alias("formats"),
                    (F.size("formats") > 1).alias("inconsistent"))


def range_rules(df: DataFrame) -> DataFrame:
    """Name-driven validity rules on numeric columns (whole-token match on the name):
    age outside 0-150; price/cost/amount/salary/income/revenue below 0; percent/rate/ratio
    outside 0-100."""
    df = nan_to_null(df)
    rules = []
    for c in df.columns:
        if not is_numeric(df.schema[c].dataType):
            continue
        x = as_double(df, c)
        toks = name_tokens(c)
        if name_has_token(c, AGE_TOKENS):
            rules.append((c, "age_range", (x < 0) | (x > 150)))
        elif any(p in t for t in toks for p in NON_NEGATIVE_TOKENS):
            rules.append((c, "negative_money", x < 0))
        elif any(t.endswith(p) for t in toks for p in PERCENT_TOKENS):
            rules.append((c, "percent_range", (x < 0) | (x > 100)))
    if not rules:
        return df.sparkSession.createDataFrame([], "column string, rule string, n_invalid long")
    one = df.agg(*[F.count_if(cond).cast("long").alias(f"r{i}") for i, (_, _, cond) in enumerate(rules)])
    arr = F.array(*[F.struct(F.lit(c).alias("column"), F.lit(rule).alias("rule"), F.col(f"r{i}").alias("n_invalid"))
                    for i, (c, rule, _) in enumerate(rules)])
    return one.select(F.explode(arr).alias("r")).select("r.*")


def format_checks(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Per string column: padded values, case variants, unusual characters (> 10 %),
    literal unicode escapes, null-like strings, mixed list separators (> 30 % of values)."""
    df = nan_to_null(df)
    cols = list(cols or [c for c in df.columns if is_string(df.schema[c].dataType)])

    # patterns are matched once for each distinct value: they cost far more than a row
    hist = value_histogram(df, cols).where(F.col("value").isNotNull())
    s = F.col("value")
    hits = {"n": F.lit(True), "padded": s != strip(s), "unusual": s.rlike(UNUSUAL_CHAR_PATTERN),
            "escapes": s.rlike(ESCAPED_UNICODE_PATTERN), "null_like": F.lower(s).isin(NULL_LIKE_FORMAT), "with_sep": s.rlike("[,;|]")}
    seen = {"has_comma": s.contains(","), "has_semicolon": s.contains(";"), "has_pipe": s.contains("|")}
    found = hist.groupBy("column").agg(*[F.sum(F.when(hit, F.col("n")).otherwise(0)).cast("long").alias(k) for k, hit in hits.items()],
                                       *[F.bool_or(hit).alias(k) for k, hit in seen.items()])
    case = hist.groupBy("column").agg(F.count(F.lit(1)).alias("_u"), F.count_distinct(F.lower("value")).alias("_ul"))
    # columns without a value have a row too
    t = df.sparkSession.range(0, 1, 1, 1).select(F.explode(F.array(*[F.lit(c) for c in cols])).alias("column"))
    t = t.join(F.broadcast(found), "column", "left").join(F.broadcast(case), "column", "left")  # one row per column
    t = t.withColumns({k: F.coalesce(k, F.lit(0).cast("long")) for k in hits})
    seps = (F.when(F.col("has_comma"), 1).otherwise(0) + F.when(F.col("has_semicolon"), 1).otherwise(0)
            + F.when(F.col("has_pipe"), 1).otherwise(0))
    return t.select("column", "n", "padded", F.coalesce(F.col("_u") - F.col("_ul"), F.lit(0)).cast("long")
                    .alias("case_variants"), "unusual", (F.col("unusual") > F.col("n") * 0.1).alias("encoding_issue"),
                    "escapes", "null_like",
                    ((F.col("with_sep") > F.col("n") * 0.3) & (seps > 1)).alias("mixed_separators"))


def quality_issues(df: DataFrame) -> DataFrame:
    """(column, issue, n_values): every consistency, validity and formatting issue found.

    Consistency: text that is partly numeric, dates written in several ways.  Validity: values outside
    the range rules.  Formatting: what ``format_checks`` finds in text columns.  Case variants count
    distinct values; several date forms and mixed separators count no values (null)."""
    df = nan_to_null(df)
    c = F.col
    strs = [n for n in df.columns if is_string(df.schema[n].dataType)]
    parts = [range_rules(df).where(c("n_invalid") > 0).select("column", c("rule").alias("issue"),
                                                            c("n_invalid").alias("n_values"))]
    if strs:
        typed = typed_columns(df.select(*[col(n) for n in strs]))
        dates = mixed_date_formats(df, strs).where("inconsistent").join(
            F.broadcast(typed.where(c("semantic_type") == "datetime").select("column")), "column")  # a row per column
        parts += [
            mixed_type_columns(df).select("column", F.lit("mixed_types").alias("issue"), c("numeric_values").alias("n_values")),
            dates.select("column", F.lit("date_formats").alias("issue"), F.lit(None).cast("long").alias("n_values"))]
        found = [("padded", c("padded"), c("padded") > 0), ("case_variants", c("case_variants"), c("case_variants") > 0),
                 ("unusual_characters", c("unusual"), c("encoding_issue")), ("escapes", c("escapes"), c("escapes") > 0),
                 ("null_like", c("null_like"), c("null_like") > 0),
                 ("mixed_separators", F.lit(None).cast("long"), c("mixed_separators"))]
        each = F.array(*[F.struct(F.lit(name).alias("issue"), n.alias("n_values"), hit.alias("hit"))
                         for name, n, hit in found])
        parts.append(format_checks(df, strs).select("column", F.inline(each)).where("hit").drop("hit"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


# --------------------------------------------------------------------------- warnings

def _numeric_stats(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    from tablescope.operators.outliers import _iqr_counts
    ph = [float(v) for v in PLACEHOLDER_VALUES]
    base = tall_agg(df, list(cols), lambda c: {
        "variance": F.var_samp(as_double(df, c)), "skewness": F.skewness(as_double(df, c)),
        "placeholders": F.count_if(as_double(df, c).isin(ph)).cast("long")},
        ["variance", "skewness", "placeholders"])
    share = _iqr_counts(df, cols).select("column", (F.col("n_outliers") * 100.0 / F.col("n")).alias("outlier_pct"))
    return base.join(F.broadcast(share), "column", "left")  # one row per column


def _categorical_stats(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column, unique_values, unique_ratio, dominant_pct) of string columns, not rounded."""
    hist = value_histogram(df, cols).where(F.col("value").isNotNull())
    return hist.groupBy("column").agg(F.sum("n").alias("_n"), F.count(F.lit(1)).alias("unique_values"),
                                      F.max("n").alias("_top")).select(
        "column", "unique_values", (F.col("unique_values") / F.col("_n")).alias("unique_ratio"),
        (F.col("_top") * 100.0 / F.col("_n")).alias("dominant_pct"))


def warnings_report(df: DataFrame) -> DataFrame:
    """(column, warning, severity, value) for the column, numeric, categorical and dataset
    rules, ordered high -> low."""
    from tablescope.operators.profile import missing_counts
    df = nan_to_null(df)
    c = F.col
    mc = missing_counts(df).withColumn("p", c("missing_count") * 100.0 / c("rows"))
    parts = [_warned(mc, [("critical_missing", "high", c("p"), c("p") > 90),
                          ("high_missing", "medium", c("p"), (c("p") > 50) & (c("p") <= 90))])]
    nums = [n for n in df.columns if is_numeric(df.schema[n].dataType)]
    if nums:
        parts.append(_warned(_numeric_stats(df, nums), [
            ("zero_variance", "medium", c("variance"), c("variance") < 1e-10),
            ("many_outliers", "medium", c("outlier_pct"), c("outlier_pct") > 20),
            ("extreme_skewness", "medium", F.abs("skewness"), F.abs("skewness") > 3),
            ("suspicious_values", "high", c("placeholders"), c("placeholders") > 0)]))
    strs = [n for n in df.columns if is_string(df.schema[n].dataType)]
    if strs:
        parts.append(_warned(_categorical_stats(df, strs), [
            ("high_cardinality", "medium", c("unique_values"), c("unique_ratio") > 0.8),
            ("single_value_dominance", "medium", c("dominant_pct"), c("dominant_pct") > 95),
            ("potential_id_column", "low", c("unique_ratio"), c("unique_ratio") > 0.95)]))
    k = float(len(df.columns))
    n = df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(None).cast("string").alias("column"), "rows")
    parts.append(_warned(n, [("small_dataset", "medium", c("rows"), c("rows") < 100),
                             ("high_dimensionality", "high", F.try_divide(F.lit(k), c("rows")), F.lit(k) > c("rows"))]))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return in_order(out)


def in_order(warnings: DataFrame) -> DataFrame:
    """Warnings from high to low severity."""
    return warnings.orderBy(F.desc(severity_rank(F.col("severity"))), "warning", "column")


def _warned(stats: DataFrame, rules: Sequence[tuple[str, str, Column, Column]]) -> DataFrame:
    """(column, warning, severity, value) of the rules (warning, severity, value, condition) that hold
    on a row; the statistics are read once for all rules."""
    each = [F.struct(F.lit(w).alias("warning"), F.lit(sev).alias("severity"), r4(v.cast("double")).alias("value"),
                     hit.alias("hit")) for w, sev, v, hit in rules]
    return stats.select("column", F.inline(F.array(*each))).where("hit").drop("hit")


def dataset_profile(df: DataFrame, target: str | None = None, warnings: DataFrame | None = None) -> DataFrame:
    """One row that the scores, bands and findings read: size, type counts, density,
    missing / duplicate rates, high-cardinality and warning counts.  ``warnings``: the frame's
    ``warnings_report`` where there is one already."""
    from tablescope.operators.profile import duplicate_rows
    from tablescope.operators.types import many_categories, usable_categorical
    df = nan_to_null(df)
    k = len(df.columns)
    feature = F.lit(True) if target is None else F.col("column") != target
    many = F.col("n_distinct") > 0.5 * F.col("non_null")
    # the target counts as a column in the structure figures, as in the original tool's structure analysis
    tc = typed_columns(df).agg(
        F.count_if(feature & (F.col("semantic_type") == "categorical") & many).cast("long").alias("many_valued_categorical"),
        *[F.count_if(feature & (F.col("semantic_type") == t)).cast("long").alias(f"n_{t}")
          for t in ["numeric", "categorical", "datetime", "boolean"]],
        F.count_if(many_categories()).cast("long").alias("high_cardinality_columns"),
        F.count_if(usable_categorical()).cast("long").alias("n_robust_categorical"),
        F.count_if(F.col("n_distinct") <= 1).cast("long").alias("constant_columns"),
        F.count_if((F.col("numeric_ok") > 0) & (F.col("numeric_ok") < F.col("non_null"))).cast("long").alias("mixed_type_columns"),
        F.count_if((F.col("n_distinct") == F.col("rows")) & (F.col("rows") > 0)).cast("long").alias("id_like_columns"))
    miss = df.agg(F.count(F.lit(1)).cast("long").alias("rows"),
                  sum([F.count_if(col(c).isNull()) for c in df.columns], F.lit(0)).cast("long").alias("missing_cells"),
                  sum([F.when(F.count_if(col(c).isNull()) > 0, 1).otherwise(0) for c in df.columns], F.lit(0))
                  .cast("long").alias("columns_with_missing"),
                  sum([F.when(F.count_if(col(c).isNull()) * 2 > F.count(F.lit(1)), 1).otherwise(0)
                       for c in df.columns], F.lit(0)).cast("long").alias("columns_over_half_missing"))
    dup = duplicate_rows(df).select("duplicate_rows")
    w = (warnings_report(df) if warnings is None else warnings).agg(F.count_if(F.col("severity") == "high").cast("long").alias("high_warnings"),
                                F.count_if(F.col("warning") == "many_outliers").cast("long").alias("outlier_warnings"))
    t = with_scalars(with_scalars(with_scalars(miss, tc), dup), w)
    cells = F.col("rows") * k
    return t.select(
        "rows", F.lit(k).cast("long").alias("columns"), "n_numeric", "n_categorical", "n_datetime", "n_boolean",
        "missing_cells", pct(cells - F.col("missing_cells"), cells).alias("density"),
        pct(F.col("missing_cells"), cells).alias("missing_pct"), "columns_with_missing", "columns_over_half_missing",
        "duplicate_rows", pct(F.col("duplicate_rows"), F.col("rows")).alias("duplicate_pct"),
        "high_cardinality_columns", "n_robust_categorical", "many_valued_categorical", "high_warnings", "outlier_warnings",
        "constant_columns", "mixed_type_columns", "id_like_columns",
        F.lit(sum(name_contains(c, PII_NAME_PARTS) for c in df.columns)).cast("long").alias("pii_columns"))
