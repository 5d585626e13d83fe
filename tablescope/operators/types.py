"""Schema and semantic-type operators.

``schema_types`` decides, per column, numeric / categorical / datetime / boolean from
one wide aggregate (non-null counts and parse rates) plus the value histogram
(distinct counts and the two values of two-valued columns).  Parse rates are taken
over the whole column rather than "the first 100 values", which has no meaning on a
distributed table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablescope.functions.constants import ID_NAME_PARTS, PII_NAME_PARTS, TARGET_NAME_PARTS
from tablescope.functions.exprs import (
    as_string, bool_pair_match, col, is_atomic, is_boolean, is_datetime, is_integral,
    is_numeric, is_string, name_contains, nan_to_null, parse_timestamp, q, rnd, sig, strip, tall,
)
from tablescope.operators.histogram import HISTOGRAM_COLUMNS, TYPED, value_histogram

SEMANTIC_TYPES = ["numeric", "categorical", "datetime", "boolean"]


def _kind(dt: T.DataType) -> str:
    if is_boolean(dt):
        return "boolean"
    if is_numeric(dt):
        return "numeric"
    if is_datetime(dt):
        return "datetime"
    if is_string(dt):
        return "string"
    return "unsupported"


def column_stats(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """(column, position, data_type, kind, rows, non_null, numeric_ok, date_ok): one pass, and the distinct
    values of text columns."""
    df = nan_to_null(df)
    cols = [c for c in (cols or df.columns) if is_atomic(df.schema[c].dataType)]
    one = df.agg(F.count(F.lit(1)).alias("rows"),
                 *[F.count(col(c)).cast("long").alias(f"{i}__non_null") for i, c in enumerate(cols)])
    t = tall(one.select("*", *[F.lit(j).alias(f"{j}__position") for j in range(len(cols))]),
             cols, ["position", "non_null"], shared=["rows"])
    strs = [c for c in cols if is_string(df.schema[c].dataType)]
    if strs:
        # text is parsed once for each distinct value: a format that fails costs far more than a row
        hist = value_histogram(df, strs).where(F.col("value").isNotNull())
        parsed = hist.groupBy("column").agg(
            F.sum(F.when(F.expr("try_cast(value AS DOUBLE)").isNotNull(), F.col("n")).otherwise(0)).cast("long").alias("numeric_ok"),
            F.sum(F.when(parse_timestamp(F.col("value")).isNotNull(), F.col("n")).otherwise(0)).cast("long").alias("date_ok"))
        t = t.join(F.broadcast(parsed), "column", "left")  # one row per column
        is_text = F.col("column").isin(strs)
        t = t.withColumns({c: F.when(is_text, F.coalesce(c, F.lit(0).cast("long"))) for c in ("numeric_ok", "date_ok")})
    else:
        t = t.select("*", *[F.lit(None).cast("long").alias(c) for c in ("numeric_ok", "date_ok")])
    t = t.select("column", "position", "non_null", "numeric_ok", "date_ok", "rows")
    meta = df.sparkSession.createDataFrame(
        [(c, df.schema[c].dataType.simpleString(), _kind(df.schema[c].dataType)) for c in cols],
        "column string, data_type string, kind string")
    return t.join(F.broadcast(meta), "column")


def distinct_stats(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """(column, n_distinct, lo, hi) of columns with a value; lo/hi are the trimmed texts of the extremes in the
    column's order, the smaller text first.

    An aggregate for each column, without a key: the extremes of texts by a key would be sorted by it."""
    df = nan_to_null(df)
    cols = [c for c in (cols or df.columns) if is_atomic(df.schema[c].dataType)]
    if 0 < len(cols) <= HISTOGRAM_COLUMNS:
        out = None
        for c in cols:
            typed = isinstance(df.schema[c].dataType, TYPED)
            distinct = df.select((col(c) if typed else as_string(c)).alias("value")).where(F.col("value").isNotNull()).distinct()
            text = F.col("value") if typed else strip("value")
            part = distinct.agg(F.count(F.lit(1)).cast("long").alias("n_distinct"), F.min(text).cast("string").alias("a"),
                                F.max(text).cast("string").alias("b")).where("n_distinct > 0")
            part = part.select(F.lit(c).alias("column"), "n_distinct", F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"))
            out = part if out is None else out.unionAll(part)
        return out
    hist = value_histogram(df, cols).where(F.col("value").isNotNull())
    return hist.groupBy("column").agg(
        F.count(F.lit(1)).cast("long").alias("n_distinct"),
        F.min(strip("value")).alias("lo"), F.max(strip("value")).alias("hi"))


def usable_categorical() -> Column:
    """Of a row of column statistics: text or boolean, with two values or more but at most half as many as rows."""
    return F.col("kind").isin("string", "boolean") & (F.col("n_distinct") >= 2) & (
        F.col("n_distinct") <= 0.5 * F.col("non_null"))


def many_categories() -> Column:
    """Of a row of column statistics: a usable categorical column of high cardinality."""
    return usable_categorical() & (F.col("n_distinct") > F.least(F.lit(50.0), F.col("rows") * 0.05))


def typed_columns(df: DataFrame) -> DataFrame:
    """The column statistics with n_distinct and semantic_type, one row per column."""
    stats = column_stats(df)
    dist = distinct_stats(df)
    t = stats.join(F.broadcast(dist), "column", "left").fillna(0, ["n_distinct"])  # one row per column
    two = F.col("n_distinct") == 2
    num_pair = (F.col("kind") == "numeric") & two & (F.expr("try_cast(lo AS DOUBLE)") == 0.0) & (
        F.expr("try_cast(hi AS DOUBLE)") == 1.0)
    sem = (F.when(F.col("kind") == "unsupported", "unsupported")
           .when(F.col("non_null") == 0, "empty")
           .when(F.col("kind") == "datetime", "datetime")
           .when((F.col("kind") == "string") & (F.col("date_ok") > 0.8 * F.col("non_null")), "datetime")
           .when(F.col("kind") == "boolean", "boolean")
           .when(two & bool_pair_match(F.col("lo"), F.col("hi")), "boolean")
           .when(num_pair, "boolean")
           .when(F.col("kind") == "numeric", "numeric")
           .when((F.col("kind") == "string") & (F.col("numeric_ok") == F.col("non_null")), "numeric")
           .otherwise("categorical"))
    return t.withColumn("semantic_type", sem)


def schema_types(df: DataFrame, target: str | None = None) -> DataFrame:
    """(column, position, data_type, semantic_type, non_null, n_distinct) per column."""
    out = typed_columns(df).select("column", "position", "data_type", "semantic_type", "non_null", "n_distinct", "rows")
    if target is not None:
        out = out.where(F.col("column") != target)
    return out.orderBy("position")


def type_lists(df: DataFrame, target: str | None = None) -> dict[str, list[str]]:
    """Driver-side lists of column names per semantic type (one row per column collected)."""
    out: dict[str, list[str]] = {k: [] for k in SEMANTIC_TYPES + ["empty", "unsupported"]}
    for r in schema_types(df, target).collect():
        out[r["semantic_type"]].append(r["column"])
    return out


def basic_types(df: DataFrame) -> DataFrame:
    """numeric / datetime / categorical by data type only (booleans count as categorical)."""
    rows = []
    for i, f in enumerate(df.schema.fields):
        k = _kind(f.dataType)
        rows.append((f.name, i, f.dataType.simpleString(),
                     "numeric" if k == "numeric" else "datetime" if k == "datetime" else "categorical"))
    return df.sparkSession.createDataFrame(rows, "column string, position int, data_type string, basic_type string")


def select_types(df: DataFrame, kind: str) -> DataFrame:
    """Project the numeric / string / datetime / boolean columns."""
    return df.select(*[col(f.name) for f in df.schema.fields if _kind(f.dataType) == kind])


def dtype_summary(df: DataFrame) -> DataFrame:
    """Number of columns per data type."""
    counts: dict[str, int] = {}
    for f in df.schema.fields:
        counts[f.dataType.simpleString()] = counts.get(f.dataType.simpleString(), 0) + 1
    return df.sparkSession.createDataFrame(sorted(counts.items()), "data_type string, n_columns long")


def robust_numeric_columns(df: DataFrame, target: str | None = None,
                           min_non_null_ratio: float = 0.1) -> DataFrame:
    """Numeric or coercible columns with enough values and non-zero variance."""
    df = nan_to_null(df)
    cands = [c for c in df.columns if c != target and
             (is_numeric(df.schema[c].dataType) or is_string(df.schema[c].dataType))]
    aggs = [F.count(F.lit(1)).alias("rows")]
    for i, c in enumerate(cands):
        x = (col(c).cast("double") if is_numeric(df.schema[c].dataType)
             else F.expr(f"try_cast({q(c)} AS DOUBLE)"))
        aggs += [F.count(x).cast("long").alias(f"{i}__non_null"),
                 F.var_samp(x).alias(f"{i}__variance")]
    one = df.agg(*aggs)
    t = tall(one, cands, ["non_null", "variance"], shared=["rows"])
    keep = (F.col("non_null") >= F.greatest(F.lit(10.0), F.col("rows") * min_non_null_ratio)) & (
        F.col("variance") > 1e-10)
    return t.where(keep).select("column", "non_null", sig(F.col("variance")).alias("variance"))


def robust_categorical_columns(df: DataFrame, target: str | None = None,
                               max_unique_ratio: float = 0.5) -> DataFrame:
    """Non-numeric columns with 2+ distinct values and distinct/non-null <= ratio."""
    df = nan_to_null(df)
    cands = [c for c in df.columns if c != target and
             (is_string(df.schema[c].dataType) or is_boolean(df.schema[c].dataType))]
    if not cands:
        return df.sparkSession.createDataFrame([], "column string, non_null long, n_distinct long, unique_ratio double")
    hist = value_histogram(df, cands).where(F.col("value").isNotNull())
    g = hist.groupBy("column").agg(F.sum("n").cast("long").alias("non_null"),
                                   F.count(F.lit(1)).cast("long").alias("n_distinct"))
    g = g.withColumn("unique_ratio", rnd(F.col("n_distinct") / F.col("non_null"), 4))
    return g.where((F.col("n_distinct") >= 2) & (F.col("n_distinct") / F.col("non_null") <= max_unique_ratio))


def name_flags(df: DataFrame) -> DataFrame:
    """Per column: potential id name, potential PII name, potential target name."""
    rows = [(c, i, name_contains(c, ID_NAME_PARTS), name_contains(c, PII_NAME_PARTS),
             name_contains(c, TARGET_NAME_PARTS)) for i, c in enumerate(df.columns)]
    return df.sparkSession.createDataFrame(
        rows, "column string, position int, potential_id boolean, potential_pii boolean, target_like boolean")


def suggest_target(df: DataFrame) -> DataFrame:
    """Columns whose name suggests a target; else the last column if it has few values."""
    named = [c for c in df.columns if name_contains(c, TARGET_NAME_PARTS)]
    spark = df.sparkSession
    if named:
        return spark.createDataFrame([(c, "name") for c in named], "column string, reason string")
    last = df.columns[-1]
    st = df.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct(col(last)).alias("d"))
    return st.where(F.col("d") < 0.3 * F.col("rows")).select(
        F.lit(last).alias("column"), F.lit("low_cardinality_last_column").alias("reason"))


def task_type(df: DataFrame, target: str) -> DataFrame:
    """unknown / classification / regression for the target column."""
    df = nan_to_null(df)
    dt = df.schema[target].dataType
    hist = value_histogram(df, [target]).where(F.col("value").isNotNull())
    st = hist.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n"),
                  F.count(F.lit(1)).cast("long").alias("n_distinct"))
    ratio = F.col("n_distinct") / F.col("n")
    if isinstance(dt, (T.FloatType, T.DoubleType, T.DecimalType)):
        base = F.lit("regression")
    elif is_integral(dt):
        base = (F.when((F.col("n_distinct") <= 20) & (ratio < 0.1), "classification")
                .when((F.col("n_distinct") > 50) & (ratio > 0.3), "regression")
                .otherwise("classification"))
    else:
        base = F.lit("classification")
    numeric = is_numeric(dt)
    override = (F.lit(numeric) & (F.col("n_distinct") > 50) & (ratio > 0.3))
    kind = (F.when(F.col("n") < 10, "unknown").when(override, "regression").otherwise(base))
    return st.select(F.lit(target).alias("column"), "n", "n_distinct",
                     rnd(F.try_divide(F.col("n_distinct"), F.col("n")), 4).alias("unique_ratio"),
                     kind.alias("task_type"))


def mixed_type_columns(df: DataFrame) -> DataFrame:
    """String columns in which some but not all non-null values parse as numbers."""
    strs = [c for c in df.columns if is_string(df.schema[c].dataType)]
    if not strs:
        return df.sparkSession.createDataFrame([], "column string, non_null long, numeric_values long, numeric_pct double")
    st = column_stats(df, strs)
    return st.where((F.col("numeric_ok") > 0) & (F.col("numeric_ok") < F.col("non_null"))).select(
        "column", "non_null", F.col("numeric_ok").alias("numeric_values"),
        rnd(F.col("numeric_ok") * 100.0 / F.col("non_null"), 2).alias("numeric_pct"))


def datetime_like_strings(df: DataFrame, min_share: float = 0.7) -> DataFrame:
    """String columns where >= 70 % of values are longer than 8 chars and contain - / or :."""
    strs = [c for c in df.columns if is_string(df.schema[c].dataType)]
    if not strs:
        return df.sparkSession.createDataFrame([], "column string, non_null long, date_like long, date_like_pct double")
    aggs = []
    for i, c in enumerate(strs):
        x = col(c)
        aggs += [F.count(x).cast("long").alias(f"{i}__non_null"),
                 F.count_if((F.length(x) > 8) & x.rlike("[-/:]")).cast("long").alias(f"{i}__date_like")]
    t = tall(df.agg(*aggs), strs, ["non_null", "date_like"])
    return t.where((F.col("non_null") > 0) & (F.col("date_like") >= min_share * F.col("non_null"))).select(
        "column", "non_null", "date_like",
        rnd(F.col("date_like") * 100.0 / F.col("non_null"), 2).alias("date_like_pct"))


def structure_flags(df: DataFrame, target: str | None = None) -> DataFrame:
    """Per column: high cardinality (usable categorical columns only, those of at most half as many
    values as rows), low variance, completely / mostly missing."""
    df = nan_to_null(df)
    cols = [c for c in df.columns if c != target and is_atomic(df.schema[c].dataType)]
    st = column_stats(df, cols).join(F.broadcast(distinct_stats(df, cols)), "column", "left").fillna(0, ["n_distinct"])
    nums = [c for c in cols if is_numeric(df.schema[c].dataType)]
    if nums:
        var = tall(df.agg(*[F.var_samp(col(c).cast("double")).alias(f"{i}__variance")
                            for i, c in enumerate(nums)]), nums, ["variance"])
        st = st.join(F.broadcast(var), "column", "left")
    else:
        st = st.withColumn("variance", F.lit(None).cast("double"))
    missing_pct = (F.col("rows") - F.col("non_null")) * 100.0 / F.col("rows")
    return st.select(
        "column", "position", "n_distinct",
        usable_categorical().alias("categorical"),
        many_categories().alias("high_cardinality"),
        (F.col("variance").isNotNull() & (F.col("variance") < 1e-6)).alias("low_variance"),
        (F.col("non_null") == 0).alias("completely_missing"),
        (missing_pct > 80).alias("mostly_missing"),
    ).orderBy("position")
