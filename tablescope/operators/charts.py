"""The numbers behind the exploratory charts (the reference draws them; we return them).

All are aggregates over the whole table: bins by arithmetic on a one-row min/max,
exact quantiles from the ranked histogram, top-k categories by a k-row broadcast semi
join.  The KDE grid expands a bounded fine histogram (bins x grid points), never rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablescope.functions.exprs import as_double, col, nan_to_null, pct, r4, with_scalars
from tablescope.operators.clean import filter_top_categories, sample_n
from tablescope.operators.histogram import (
    exact_quantiles, grouped_quantiles, held_histogram, hot_groups, join_groups, wide_quantiles,
)


def _bin_expr(x, lo, hi, bins: int):
    return F.when(hi == lo, F.lit(0)).otherwise(F.least(F.floor((x - lo) / (hi - lo) * bins), F.lit(bins - 1))
                                                ).cast("int")


def histogram(df: DataFrame, column: str, bins: int = 30, hue: str | None = None) -> DataFrame:
    """(hue?, bin, lower, upper, count, density, probability); the maximum falls in the last bin."""
    if bins < 1:
        raise ValueError("bins must be 1 or more")
    df = nan_to_null(df)
    x = as_double(df, column)
    mm = df.agg(F.min(x).alias("_lo"), F.max(x).alias("_hi"))
    j = with_scalars(df.where(x.isNotNull()), mm)
    keys = [col(hue).cast("string").alias("hue")] if hue else []
    b = _bin_expr(as_double(df, column), F.col("_lo"), F.col("_hi"), bins)
    g = j.groupBy(*keys, b.alias("bin"), "_lo", "_hi").agg(F.count(F.lit(1)).cast("long").alias("count"))
    width = (F.col("_hi") - F.col("_lo")) / bins
    tot = F.sum("count").over(__window(hue))
    return g.select(*(["hue"] if hue else []), "bin", r4(F.col("_lo") + F.col("bin") * width).alias("lower"),
                    r4(F.col("_lo") + (F.col("bin") + 1) * width).alias("upper"), "count",
                    r4(F.try_divide(F.col("count"), tot * width)).alias("density"),
                    r4(F.col("count") / tot).alias("probability"))


def __window(hue):
    from pyspark.sql import Window
    return Window.partitionBy("hue") if hue else Window.partitionBy()


def box_stats(df: DataFrame, value: str, group: str | None = None) -> DataFrame:
    """Quartiles, 1.5 IQR whiskers clipped to the data, flier count; overall or per group."""
    df = nan_to_null(df)
    keys = [group] if group else []
    d = df.where(col(group).isNotNull()) if group else df
    hist = held_histogram(d, [value], keys=keys)
    allk = keys + ["column"]
    hot = hot_groups(hist, allk)
    q = wide_quantiles(grouped_quantiles(hist, allk, [0.25, 0.5, 0.75], hot), allk, {0.25: "q1", 0.5: "median", 0.75: "q3"})
    lo = F.col("q1") - 1.5 * (F.col("q3") - F.col("q1"))
    hi = F.col("q3") + 1.5 * (F.col("q3") - F.col("q1"))
    inside = (F.col("value") >= lo) & (F.col("value") <= hi)
    j = join_groups(hist, q, allk, hot)
    out = j.groupBy(*allk, "q1", "median", "q3").agg(
        F.sum("n").cast("long").alias("n"),
        F.min(F.when(inside, F.col("value"))).alias("whisker_low"),
        F.max(F.when(inside, F.col("value"))).alias("whisker_high"),
        F.sum(F.when(~inside, F.col("n")).otherwise(0)).cast("long").alias("fliers"))
    sel = ([col(group).cast("string").alias("group")] if group else []) + [
        "n", r4(F.col("q1")).alias("q1"), r4(F.col("median")).alias("median"), r4(F.col("q3")).alias("q3"),
        r4(F.col("whisker_low")).alias("whisker_low"), r4(F.col("whisker_high")).alias("whisker_high"), "fliers"]
    return out.select(*sel)


def density_grid(df: DataFrame, column: str, points: int = 100, fine_bins: int = 1024) -> DataFrame:
    """1-D Gaussian KDE (Scott's bandwidth) on a grid, from a fine histogram of bin centres."""
    df = nan_to_null(df)
    x = as_double(df, column)
    st = df.agg(F.min(x).alias("_lo"), F.max(x).alias("_hi"), F.count(x).alias("_n"), F.stddev_samp(x).alias("_sd"))
    j = with_scalars(df.where(x.isNotNull()), st)
    fine = j.groupBy(_bin_expr(as_double(df, column), F.col("_lo"), F.col("_hi"), fine_bins).alias("b"),
                     "_lo", "_hi", "_n", "_sd").agg(F.count(F.lit(1)).alias("w"))
    centre = F.col("_lo") + (F.col("b") + 0.5) * (F.col("_hi") - F.col("_lo")) / fine_bins
    h = F.col("_sd") * F.pow(F.col("_n"), -0.2)
    grid = F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("g")
    e = fine.select("*", centre.alias("c"), h.alias("h"), grid)
    gx = F.col("_lo") + F.col("g") * (F.col("_hi") - F.col("_lo")) / (points - 1)
    k = F.exp(-0.5 * F.pow((gx - F.col("c")) / F.col("h"), 2)) / (F.col("h") * math.sqrt(2 * math.pi))
    return (e.groupBy("g").agg(F.first(gx).alias("x"), (F.sum(F.col("w") * k) / F.first("_n")).alias("density"))
            .select(F.col("g").alias("point"), r4(F.col("x")).alias("x"), F.col("density")))


def category_counts(df: DataFrame, column: str, k: int = 15) -> DataFrame:
    """Value counts for a pie (<= 10 categories) or the top-k bar; refused above 25 on a pie."""
    c = col(column)
    g = df.where(c.isNotNull()).groupBy(c.cast("string").alias("category")).agg(F.count(F.lit(1)).cast("long").alias("n"))
    tot = g.agg(F.count(F.lit(1)).alias("_k"), F.sum("n").alias("_t"))
    top = with_scalars(g.orderBy(F.desc("n"), "category").limit(k), tot)
    return top.select("category", "n", pct(F.col("n"), F.col("_t")).alias("pct"),
                      F.when(F.col("_k") <= 10, "pie").otherwise("bar").alias("chart"))


def count_by_target(df: DataFrame, column: str, target: str, k: int = 15) -> DataFrame:
    """Counts of the top-k categories split by target, whatever the number of target values."""
    t = filter_top_categories(df.where(col(column).isNotNull()), column, k)
    return t.groupBy(col(column).cast("string").alias("category"), col(target).cast("string").alias("target")).agg(
        F.count(F.lit(1)).cast("long").alias("n"))


def class_balance_chart(df: DataFrame, target: str, k: int = 15) -> DataFrame:
    return category_counts(df, target, k).select(F.col("category").alias("class"), "n", "pct")


def mean_target_by_category(df: DataFrame, column: str, target: str, k: int = 15) -> DataFrame:
    """Mean target over the k most frequent categories, descending."""
    t = filter_top_categories(nan_to_null(df).where(col(column).isNotNull()), column, k)
    return t.groupBy(col(column).cast("string").alias("category")).agg(
        F.count(F.lit(1)).cast("long").alias("n"), r4(F.avg(as_double(df, target))).alias("mean_target"))


_AGGS = {"mean": F.avg, "sum": F.sum, "count": F.count}


def _aggregate(df: DataFrame, keys: dict[str, str], value: str, agg: str) -> DataFrame:
    """mean / sum / count / exact median of ``value`` per group; null keys are a group of their own.

    Medians come from ranks over range buckets of the distinct values, so no task holds a group."""
    df = nan_to_null(df)
    if agg != "median":
        return df.groupBy(*[col(c).cast("string").alias(n) for n, c in keys.items()]).agg(
            r4(_AGGS[agg](as_double(df, value))).alias(agg))
    # the mark keeps a null key apart and joinable
    marked = df.select(*[F.coalesce(F.concat(F.lit("="), col(c).cast("string")), F.lit("")).alias(n) for n, c in keys.items()],
                       as_double(df, value).alias("__value"))
    medians = exact_quantiles(marked, ["__value"], [0.5], keys=list(keys)).select(*keys, "q")
    return marked.select(*keys).distinct().join(medians, list(keys), "left").select(
        *[F.when(F.col(n) != "", F.expr(f"substring({n}, 2)")).alias(n) for n in keys], r4(F.col("q")).alias(agg))


def bar_aggregate(df: DataFrame, column: str, value: str, agg: str = "mean") -> DataFrame:
    """mean / sum / count / median of value by category."""
    return _aggregate(df, {"category": column}, value, agg)


def pivot_heatmap(df: DataFrame, x: str, y: str, value: str, agg: str = "mean") -> DataFrame:
    """Tall (x, y, aggregated value) cells of a heatmap."""
    return _aggregate(df, {"x": x, "y": y}, value, agg)


def density_2d(df: DataFrame, x: str, y: str, bins: int = 20) -> DataFrame:
    """bins x bins counts over the joint range of two numeric columns."""
    df = nan_to_null(df)
    xx, yy = as_double(df, x), as_double(df, y)
    mm = df.agg(F.min(xx).alias("_xl"), F.max(xx).alias("_xh"), F.min(yy).alias("_yl"), F.max(yy).alias("_yh"))
    j = with_scalars(df.where(xx.isNotNull() & yy.isNotNull()), mm)
    return j.groupBy(_bin_expr(xx, F.col("_xl"), F.col("_xh"), bins).alias("xbin"),
                     _bin_expr(yy, F.col("_yl"), F.col("_yh"), bins).alias("ybin")).agg(
        F.count(F.lit(1)).cast("long").alias("n"))


def stacked_counts(df: DataFrame, a: str, b: str) -> DataFrame:
    """Mosaic / stacked-bar shares: every cell of the contingency table."""
    from tablescope.operators.stat_tests import contingency
    return contingency(df, a, b)


def line_mean(df: DataFrame, x: str, y: str, hue: str | None = None) -> DataFrame:
    """Mean y per x (and hue) with a normal 95 % interval."""
    keys = [col(x).alias("x")] + ([col(hue).cast("string").alias("hue")] if hue else [])
    d = nan_to_null(df)
    g = d.groupBy(*keys).agg(F.count(as_double(df, y)).cast("long").alias("n"), F.avg(as_double(df, y)).alias("m"),
                             F.stddev_samp(as_double(df, y)).alias("s"))
    half = 1.96 * F.col("s") / F.sqrt("n")
    return g.select(*[k for k in (["x"] + (["hue"] if hue else []))], "n", r4(F.col("m")).alias("mean"),
                    r4(F.col("m") - half).alias("ci_low"), r4(F.col("m") + half).alias("ci_high"))


def point_sample(df: DataFrame, x: str, y: str, n: int = 1000, seed: int = 42) -> DataFrame:
    """Sampled (x, y) points for scatter-type charts with the residual of the OLS fit."""
    d = nan_to_null(df)
    xx, yy = as_double(df, x), as_double(df, y)
    fit = d.agg(F.regr_slope(yy, xx).alias("_b"), F.regr_intercept(yy, xx).alias("_a"))
    s = sample_n(d.select(xx.alias("x"), yy.alias("y")).where(F.col("x").isNotNull() & F.col("y").isNotNull()), n, seed)
    return with_scalars(s, fit).select("x", "y", (F.col("y") - (F.col("_a") + F.col("_b") * F.col("x"))).alias("resid"))


def scree(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    from tablescope.operators.segment import pca
    return pca(df, cols)["variance"]
