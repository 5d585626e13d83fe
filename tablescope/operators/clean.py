"""Projections, filters and cleaning steps.

Fill values (medians, means, modes) are computed as one-row aggregates and joined
back as a broadcast one-row table, so no value passes through the driver and the
row pass stays a map-side projection.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablescope.functions.exprs import as_double, col, is_numeric, nan_to_null, with_scalars
from tablescope.operators.histogram import exact_quantiles, value_histogram


def filter_eq(df: DataFrame, column: str, value) -> DataFrame:
    return df.where(col(column) == F.lit(value))


def filter_range(df: DataFrame, column: str, lo=None, hi=None) -> DataFrame:
    """Inclusive min / max range (either side optional)."""
    cond = F.lit(True)
    if lo is not None:
        cond = cond & (col(column) >= F.lit(lo))
    if hi is not None:
        cond = cond & (col(column) <= F.lit(hi))
    return df.where(cond)


def top_values(df: DataFrame, column: str, k: int = 15) -> DataFrame:
    """(value, n) of the k most frequent non-null values, ties by value ascending."""
    return (df.where(col(column).isNotNull()).groupBy(col(column).alias("value"))
            .agg(F.count(F.lit(1)).cast("long").alias("n")).orderBy(F.desc("n"), "value").limit(k))


def filter_top_categories(df: DataFrame, column: str, k: int = 15) -> DataFrame:
    """Rows whose category is among the k most frequent (broadcast semi join, k rows)."""
    top = top_values(df, column, k).select(F.col("value").alias("_tv"))
    return df.join(F.broadcast(top), col(column) == F.col("_tv"), "left_semi")


def drop_missing(df: DataFrame, subset: Sequence[str]) -> DataFrame:
    return nan_to_null(df).na.drop(how="any", subset=list(subset))


def drop_sparse_rows(df: DataFrame, cols: Sequence[str], min_filled: float = 0.5) -> DataFrame:
    """Keep rows with at least ``min_filled`` of the listed columns non-null."""
    thresh = math.ceil(len(cols) * min_filled)
    return nan_to_null(df).na.drop(thresh=max(thresh, 1), subset=list(cols)) if cols else df


def fill_constant(df: DataFrame, cols: Sequence[str], value: str = "Missing") -> DataFrame:
    cols = set(cols)
    return df.select(*[F.coalesce(col(c).cast("string"), F.lit(value)).alias(c) if c in cols else col(c)
                       for c in df.columns])


def coerce_numeric(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Unparseable values become NULL (``try_cast``), like ``to_numeric(errors='coerce')``."""
    cols = set(cols)
    return df.select(*[as_double(df, c).alias(c) if c in cols else col(c) for c in df.columns])


def _medians_row(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    q = exact_quantiles(df, cols, [0.5])
    return q.groupBy().pivot("column", list(cols)).agg(F.first("q"))


def impute_median(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Fill nulls with the exact column median (one-row broadcast join)."""
    df = nan_to_null(df)
    cols = list(cols)
    if not cols:
        return df
    med = _medians_row(df, cols).select(*[col(c).alias(f"_med_{i}") for i, c in enumerate(cols)])
    j = with_scalars(df, med)
    idx = {c: i for i, c in enumerate(cols)}
    return j.select(*[F.coalesce(as_double(df, c), F.col(f"_med_{idx[c]}")).alias(c) if c in idx else col(c)
                      for c in df.columns])


def impute_mean_mode(df: DataFrame, num_cols: Sequence[str], cat_cols: Sequence[str]) -> DataFrame:
    """Numeric nulls -> mean; string nulls -> mode (smallest of tied values)."""
    df = nan_to_null(df)
    num_cols, cat_cols = list(num_cols), list(cat_cols)
    means = df.agg(*[F.avg(as_double(df, c)).alias(f"_mean_{i}") for i, c in enumerate(num_cols)]) if num_cols else None
    modes = None
    if cat_cols:
        h = value_histogram(df, cat_cols).where(F.col("value").isNotNull())
        m = h.groupBy("column").agg(F.min(F.struct((-F.col("n")).alias("k"), F.col("value").alias("v"))).alias("m"))
        modes = m.groupBy().pivot("column", cat_cols).agg(F.first("m.v")).select(
            *[col(c).alias(f"_mode_{i}") for i, c in enumerate(cat_cols)])
    j = df
    if means is not None:
        j = with_scalars(j, means)
    if modes is not None:
        j = with_scalars(j, modes)
    ni = {c: i for i, c in enumerate(num_cols)}
    ci = {c: i for i, c in enumerate(cat_cols)}
    out = []
    for c in df.columns:
        if c in ni:
            out.append(F.coalesce(as_double(df, c), F.col(f"_mean_{ni[c]}")).alias(c))
        elif c in ci:
            out.append(F.coalesce(col(c).cast("string"), F.col(f"_mode_{ci[c]}")).alias(c))
        else:
            out.append(col(c))
    return j.select(*out)


def sample_n(df: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """n rows chosen by a seeded hash order (deterministic, top-n merge; all rows if fewer)."""
    key = F.xxhash64(*[col(c) for c in df.columns], F.lit(seed))
    return df.withColumn("_h", key).orderBy("_h").limit(n).drop("_h")


def quartile_bin(df: DataFrame, column: str, name: str | None = None) -> DataFrame:
    """Quartile index (right-closed bins, duplicate edges dropped, min in bin 0)."""
    name = name or f"{column}_bin"
    q = exact_quantiles(df, [column], [0.25, 0.5, 0.75])
    e = q.agg(F.sort_array(F.collect_list("q")).alias("_edges"))
    mm = df.agg(F.min(as_double(df, column)).alias("_min"), F.max(as_double(df, column)).alias("_max"))
    j = with_scalars(with_scalars(df, e), mm)
    x = as_double(df, column)
    inner = F.filter(F.array_distinct("_edges"), lambda v: (v > F.col("_min")) & (v < F.col("_max")))
    b = F.when(x.isNull(), None).otherwise(F.size(F.filter(inner, lambda v: v < x)))
    return j.withColumn(name, b.cast("int")).drop("_edges", "_min", "_max")


def zero_variance_guard(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """(column, variance, keep): columns whose sample variance is 0 or undefined are rejected."""
    from tablescope.functions.exprs import tall_agg
    df = nan_to_null(df)
    cols = list(cols or [c for c in df.columns if is_numeric(df.schema[c].dataType)])
    t = tall_agg(df, cols, lambda c: {"variance": F.var_samp(as_double(df, c))}, ["variance"])
    return t.select("column", "variance", F.coalesce(F.col("variance") > 0, F.lit(False)).alias("keep"))
