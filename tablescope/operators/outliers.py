"""Outlier operators: IQR, z-score, modified z-score (MAD), per group, per row.

Bounds are a table of one row per column; it joins the rows as a broadcast row, and one
wide aggregate counts what lies outside.  Nothing is collected and no job runs before the
result is used.  Bounds per group come from the (group, value) histogram.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablescope.functions.constants import IQR_FACTOR, MODIFIED_Z_CONSTANT, MODIFIED_Z_LIMIT, ZSCORE_LIMIT
from tablescope.functions.exprs import (
    as_double, col, is_numeric, nan_to_null, pct, r4, scalar_structs, tall_agg, with_scalars,
)
from tablescope.operators.histogram import (
    exact_quantiles, grouped_quantiles, held_histogram, hot_groups, join_groups, wide_quantiles,
)


def _numeric_cols(df: DataFrame, cols: Sequence[str] | None) -> list[str]:
    return list(cols or [c for c in df.columns if is_numeric(df.schema[c].dataType)])


def _with_bounds(qs: DataFrame, keys: Sequence[str]) -> DataFrame:
    iqr = F.col("q3") - F.col("q1")
    return qs.select(*keys, "q1", "q3", (F.col("q1") - IQR_FACTOR * iqr).alias("lower"),
                     (F.col("q3") + IQR_FACTOR * iqr).alias("upper"))


def iqr_bounds(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column, q1, q3, lower, upper): one row per column that has a value."""
    return _with_bounds(wide_quantiles(exact_quantiles(df, cols, [0.25, 0.75]), ["column"], {0.25: "q1", 0.75: "q3"}),
                        ["column"])


def _group_bounds(hist: DataFrame, keys: Sequence[str], hot: DataFrame) -> DataFrame:
    return _with_bounds(wide_quantiles(grouped_quantiles(hist, keys, [0.25, 0.75], hot), keys, {0.25: "q1", 0.75: "q3"}), keys)


def _iqr_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column, q1, q3, lower, upper, n, min, max, n_outliers) of the columns that have a value."""
    b = with_scalars(df, scalar_structs(iqr_bounds(df, cols), cols, ["q1", "q3", "lower", "upper"]))
    at = {c: F.col(f"__s{i}") for i, c in enumerate(cols)}

    def make(c):
        x = as_double(df, c)
        return {"_b": F.max(at[c]), "n": F.count(x).cast("long"), "min": F.min(x), "max": F.max(x),
                "n_outliers": F.count_if((x < at[c]["lower"]) | (x > at[c]["upper"])).cast("long")}

    t = tall_agg(b, cols, make, ["_b", "n", "min", "max", "n_outliers"])
    return t.where(F.col("n") > 0).select("column", "_b.*", "n", "min", "max", "n_outliers")


def outliers_iqr(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """column, q1, q3, lower, upper (4 dp), n, n_outliers, pct (2 dp)."""
    df = nan_to_null(df)
    out = _iqr_counts(df, _numeric_cols(df, cols))
    return out.select("column", r4(F.col("q1")).alias("q1"), r4(F.col("q3")).alias("q3"),
                      r4(F.col("lower")).alias("lower"), r4(F.col("upper")).alias("upper"), "n", "n_outliers",
                      pct(F.col("n_outliers"), F.col("n")).alias("pct"))


def outliers_zscore(df: DataFrame, cols: Sequence[str] | None = None, limit: float = ZSCORE_LIMIT) -> DataFrame:
    """|x - mean| / population std > 3: column, mean, std_pop, n, n_outliers, pct."""
    df = nan_to_null(df)
    cols = _numeric_cols(df, cols)
    mom = tall_agg(df, cols, lambda c: {"mean": F.avg(as_double(df, c)), "std_pop": F.stddev_pop(as_double(df, c))},
                   ["mean", "std_pop"])
    b = with_scalars(df, scalar_structs(mom, cols, ["mean", "std_pop"]))
    at = {c: F.col(f"__s{i}") for i, c in enumerate(cols)}
    t = tall_agg(b, cols, lambda c: {
        "_m": F.max(at[c]), "n": F.count(as_double(df, c)).cast("long"),
        "n_outliers": F.count_if(F.try_divide(F.abs(as_double(df, c) - at[c]["mean"]), at[c]["std_pop"]) > limit)
        .cast("long")}, ["_m", "n", "n_outliers"])
    return t.where(F.col("n") > 0).select(
        "column", r4(F.col("_m.mean")).alias("mean"), r4(F.col("_m.std_pop")).alias("std_pop"), "n", "n_outliers",
        pct(F.col("n_outliers"), F.col("n")).alias("pct"))


def mad_table(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column, median, mad): exact median and median absolute deviation."""
    cols = list(cols)
    med = wide_quantiles(exact_quantiles(df, cols, [0.5]), ["column"], {0.5: "median"})
    b = with_scalars(df, scalar_structs(med, cols, ["median"]))
    dev = b.select(*[F.abs(as_double(df, c) - F.col(f"__s{i}.median")).alias(c) for i, c in enumerate(cols)])
    mad = wide_quantiles(exact_quantiles(dev, cols, [0.5]), ["column"], {0.5: "mad"})
    return med.join(F.broadcast(mad), "column")  # one row per column


def outliers_modified_z(df: DataFrame, cols: Sequence[str] | None = None,
                        limit: float = MODIFIED_Z_LIMIT) -> DataFrame:
    """|0.6745 (x - median) / MAD| > 3.5; with MAD = 0 every x != median is an outlier."""
    df = nan_to_null(df)
    cols = _numeric_cols(df, cols)
    b = with_scalars(df, scalar_structs(mad_table(df, cols), cols, ["median", "mad"]))
    at = {c: F.col(f"__s{i}") for i, c in enumerate(cols)}

    def make(c):
        dev = F.abs(as_double(df, c) - at[c]["median"])
        is_out = F.when(at[c]["mad"] == 0, dev > 0).otherwise(
            F.abs(F.try_divide(MODIFIED_Z_CONSTANT * dev, at[c]["mad"])) > limit)
        return {"_m": F.max(at[c]), "n": F.count(as_double(df, c)).cast("long"),
                "n_outliers": F.count_if(is_out).cast("long")}

    t = tall_agg(b, cols, make, ["_m", "n", "n_outliers"])
    return t.where(F.col("n") > 0).select(
        "column", r4(F.col("_m.median")).alias("median"), r4(F.col("_m.mad")).alias("mad"), "n", "n_outliers",
        pct(F.col("n_outliers"), F.col("n")).alias("pct"))


def outlier_report(df: DataFrame) -> DataFrame:
    """IQR outliers per numeric column with min / max and severity (High > 10 %, Medium > 5); desc."""
    df = nan_to_null(df)
    cols = _numeric_cols(df, None)
    if not cols:
        return df.sparkSession.createDataFrame([], "column string, n_outliers long, pct double, lower double, "
                                                   "upper double, min double, max double, severity string")
    out = _iqr_counts(df, cols)
    p = pct(F.col("n_outliers"), F.col("n"))
    return out.where(F.col("n_outliers") > 0).select(
        "column", "n_outliers", p.alias("pct"), r4(F.col("lower")).alias("lower"), r4(F.col("upper")).alias("upper"),
        r4(F.col("min")).alias("min"), r4(F.col("max")).alias("max"),
        F.when(p > 10, "High").when(p > 5, "Medium").otherwise("Low").alias("severity"),
    ).orderBy(F.desc("pct"), "column")


def _row_flag(df: DataFrame, cols: Sequence[str]) -> tuple[DataFrame, Column]:
    """The rows with their bounds attached, and whether any of the columns lies outside them."""
    b = with_scalars(df, scalar_structs(iqr_bounds(df, cols), cols, ["lower", "upper"]))
    flag = F.lit(False)
    for i, c in enumerate(cols):
        x = as_double(df, c)
        flag = flag | F.coalesce((x < F.col(f"__s{i}.lower")) | (x > F.col(f"__s{i}.upper")), F.lit(False))
    return b, flag


def outlier_rows(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Rows outlying (IQR) in any numeric column: count, %, flagged (> 5 %), severity."""
    df = nan_to_null(df)
    b, flag = _row_flag(df, _numeric_cols(df, cols))
    t = b.agg(F.count(F.lit(1)).cast("long").alias("rows"), F.count_if(flag).cast("long").alias("outlier_rows"))
    p = pct(F.col("outlier_rows"), F.col("rows"))
    return t.select("rows", "outlier_rows", p.alias("pct"), (p > 5).alias("flagged"),
                    F.when(p > 15, "high").when(p > 5, "medium").alias("severity"))


def outliers_pairwise(df: DataFrame, x: str, y: str) -> DataFrame:
    """Rows (with both x and y present) outlying in x or in y by the IQR rule."""
    b, flag = _row_flag(nan_to_null(df).where(col(x).isNotNull() & col(y).isNotNull()), [x, y])
    return b.agg(F.count(F.lit(1)).cast("long").alias("rows"),
                 F.count_if(flag).cast("long").alias("outlier_rows")).withColumn(
        "pct", pct(F.col("outlier_rows"), F.col("rows")))


def outliers_by_group(df: DataFrame, group: str, value: str) -> DataFrame:
    """IQR bounds per category and the number of outliers in each group."""
    df = nan_to_null(df)
    hist = held_histogram(df.where(col(group).isNotNull()), [value], keys=[group])
    keys = [group, "column"]
    hot = hot_groups(hist, keys)
    out = join_groups(hist, _group_bounds(hist, keys, hot), keys, hot).groupBy(group, "lower", "upper").agg(
        F.sum("n").cast("long").alias("n"),
        F.sum(F.when((F.col("value") < F.col("lower")) | (F.col("value") > F.col("upper")), F.col("n"))
              .otherwise(0)).cast("long").alias("n_outliers"))
    return out.select(col(group).cast("string").alias("group"), r4(F.col("lower")).alias("lower"),
                      r4(F.col("upper")).alias("upper"), "n", "n_outliers")


def flag_outliers(df: DataFrame, cols: Sequence[str] | None = None, name: str = "is_outlier") -> DataFrame:
    """The input rows with a boolean column: outlying (IQR) in any of the columns."""
    df = nan_to_null(df)
    b, flag = _row_flag(df, _numeric_cols(df, cols))
    return b.select(*[col(c) for c in df.columns], flag.alias(name))
