"""Associations between columns: correlation pair tables and what is derived from them.

* Pearson: one wide aggregate for up to ``PAIR_BATCH`` pairs, pairwise-complete rows, computed
  as ``covar_samp / sqrt(var_a var_b)`` so a constant column gives NULL instead of the
  DIVIDE_BY_ZERO that ``corr`` raises under ANSI mode; more pairs than that come from Gram
  matrices of Arrow blocks, all of them in one scan.
* Spearman: rows are first collapsed to distinct value tuples with a weight (copies of
  a row never pile up in one task), exact average ranks are attached per column from
  the ranked histogram, and the weighted Pearson of the ranks is taken.  Pairs that
  touch a column with nulls get ranks of their own over the rows where both are present,
  which is what pandas' pairwise-complete ``corr(method='spearman')`` does.
* The pair table has at most p(p-1)/2 rows (p = number of columns), so grouping steps
  on it (components, clusters) are bounded by the schema, not by the data.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablescope.functions.constants import CORR_STRENGTH
from tablescope.functions.exprs import (
    as_double, col, head, is_numeric, nan_to_null, r4, rnd, strength_label, tall_agg, with_scalars,
)
from tablescope.functions.stats import corr_pvalue
from tablescope.operators.histogram import attach_rank_columns, exact_quantiles, wide_quantiles

# Pairs of one wide aggregate: code generated for more is too long to be compiled and runs interpreted.
PAIR_BATCH = 6


def _numeric(df: DataFrame, cols: Sequence[str] | None, exclude: Sequence[str] = ()) -> list[str]:
    return [c for c in (cols or [c for c in df.columns if is_numeric(df.schema[c].dataType)])
            if c not in exclude]


def _pairs(cols: Sequence[str]) -> list[tuple[str, str]]:
    return [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]]


def _empty_pairs(df: DataFrame, extra: str = "n long, r double") -> DataFrame:
    return df.sparkSession.createDataFrame([], f"feature1 string, feature2 string, {extra}")


def pearson_pairs(df: DataFrame, cols: Sequence[str] | None = None,
                  pairs: Sequence[tuple[str, str]] | None = None) -> DataFrame:
    """(feature1, feature2, n, r): pairwise-complete Pearson correlation, r unrounded.

    r is null where a column is constant on the rows of the pair or holds an infinite value there."""
    df = nan_to_null(df)
    cols = _numeric(df, cols)
    pairs = list(pairs if pairs is not None else _pairs(cols))
    if not pairs:
        return _empty_pairs(df)
    if len(pairs) > PAIR_BATCH:
        return _gram_pairs(df, pairs)
    x = {c: as_double(df, c) for c in {c for p in pairs for c in p}}
    aggs = []
    for i, (a, b) in enumerate(pairs):
        both = x[a].isNotNull() & x[b].isNotNull()
        xa, xb = F.when(both, x[a]), F.when(both, x[b])
        aggs += [F.count_if(both).alias(f"n{i}"), F.covar_samp(x[a], x[b]).alias(f"c{i}"),
                 _variance(xa).alias(f"va{i}"), _variance(xb).alias(f"vb{i}")]
    arr = F.array(*[F.struct(F.lit(a).alias("feature1"), F.lit(b).alias("feature2"),
                             F.col(f"n{i}").cast("long").alias("n"),
                             F.try_divide(F.col(f"c{i}"), F.sqrt(F.col(f"va{i}") * F.col(f"vb{i}"))).alias("r"))
                    for i, (a, b) in enumerate(pairs)])
    out = df.agg(*aggs).select(F.explode(arr).alias("p")).select("p.*")
    return out.withColumn("r", F.when(F.col("r").isNotNull() & ~F.isnan("r"), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), "r"))))


def _variance(x: Column) -> Column:
    """Sample variance; null where it is only what merging partial means of one value rounds to."""
    v = F.var_samp(x)
    return F.when(F.isnan(v) | (v > 1e-28 * F.pow(F.avg(x), 2)), v)


def _gram_pairs(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """The pairs of ``pearson_pairs`` from one scan for the centres and one for all products.

    A task adds up Gram matrices of its Arrow blocks (values with gaps as zeros, and masks of the gaps) and
    emits a row per pair; counts, sums, squares and products of centred values then only need sums."""
    used = sorted({c for p in pairs for c in p})
    at = {c: i for i, c in enumerate(used)}
    left = np.array([at[a] for a, _ in pairs])
    right = np.array([at[b] for _, b in pairs])
    x = df.select(*[as_double(df, c).alias(f"v{i}") for i, c in enumerate(used)])
    finite = [F.when(F.abs(f"v{i}") < float("inf"), F.col(f"v{i}")) for i in range(len(used))]
    # a constant column is centred on its value exactly
    centre = x.agg(*[F.when(F.min(v) == F.max(v), F.min(v)).otherwise(F.avg(v)).alias(f"m{i}") for i, v in enumerate(finite)])
    x = with_scalars(x, centre).select(*[(F.col(f"v{i}") - F.coalesce(f"m{i}", F.lit(0.0))).alias(f"v{i}") for i in range(len(used))])
    schema = "a int, b int, n long, sa double, sb double, qa double, qb double, p double, odd long"

    def sums(batches):
        k = len(used)
        n, s, q, p, odd = (np.zeros((k, k)) for _ in range(5))
        for batch in batches:
            block = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]).astype(np.float64)
            here = (~np.isnan(block)).astype(np.float64)
            wild = np.isinf(block)
            value = np.where(wild | np.isnan(block), 0.0, block)
            n += here.T @ here
            s += value.T @ here
            q += (value * value).T @ here
            p += value.T @ value
            if wild.any():
                odd += wild.T.astype(np.float64) @ here
        yield pa.RecordBatch.from_arrays([
            pa.array(left.astype(np.int32)), pa.array(right.astype(np.int32)), pa.array(n[left, right].astype(np.int64)),
            pa.array(s[left, right]), pa.array(s[right, left]), pa.array(q[left, right]), pa.array(q[right, left]),
            pa.array(p[left, right]), pa.array((odd[left, right] + odd[right, left]).astype(np.int64))],
            names=["a", "b", "n", "sa", "sb", "qa", "qb", "p", "odd"])

    total = x.mapInArrow(sums, schema).groupBy("a", "b").agg(
        *[F.sum(c).alias(c) for c in ("n", "sa", "sb", "qa", "qb", "p", "odd")])
    c = F.col

    def spread(q, s):
        """n times the sum of squares about the mean; null where it is rounding alone."""
        d = c("n") * c(q) - c(s) * c(s)
        return F.when(d > 1e-13 * c("n") * c(q), d)

    r = (c("n") * c("p") - c("sa") * c("sb")) / F.sqrt(spread("qa", "sa")) / F.sqrt(spread("qb", "sb"))
    names = df.sparkSession.createDataFrame([(a, b, at[a], at[b]) for a, b in pairs], "feature1 string, feature2 string, a int, b int")
    found = total.select("a", "b", "n", F.when(c("odd") == 0, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r))).alias("r"),
                         r.isNotNull().alias("known"))
    return names.join(found, ["a", "b"], "left").select(
        "feature1", "feature2", F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.when(c("known"), c("r")).alias("r"))


def _rank_corr(tuples: DataFrame, cols: Sequence[str], pairs: Sequence[tuple[str, str]],
               buckets: int | None) -> DataFrame:
    """Weighted Pearson of average ranks over a frame of distinct tuples with weight _w."""
    ranked = attach_rank_columns(tuples, cols, "_w", buckets=buckets)
    w = F.col("_w")
    aggs = [F.sum(w).alias("_n")]
    for i, (a, b) in enumerate(pairs):
        ra, rb = F.col(f"_rank_{a}"), F.col(f"_rank_{b}")
        aggs += [F.sum(w * ra * rb).alias(f"sab{i}"), F.sum(w * ra * ra).alias(f"saa{i}"),
                 F.sum(w * rb * rb).alias(f"sbb{i}")]
    one = ranked.agg(*aggs)
    n = F.col("_n")
    mean = (n + 1) / 2.0
    rows = []
    for i, (a, b) in enumerate(pairs):
        cov = F.col(f"sab{i}") - n * mean * mean
        va = F.col(f"saa{i}") - n * mean * mean
        vb = F.col(f"sbb{i}") - n * mean * mean
        rows.append(F.struct(F.lit(a).alias("feature1"), F.lit(b).alias("feature2"), n.cast("long").alias("n"),
                             F.try_divide(cov, F.sqrt(va * vb)).alias("rho")))
    return one.select(F.explode(F.array(*rows)).alias("p")).select("p.*")


def spearman_pairs(df: DataFrame, cols: Sequence[str] | None = None,
                   pairs: Sequence[tuple[str, str]] | None = None, buckets: int | None = None) -> DataFrame:
    """(feature1, feature2, n, rho): Spearman correlation with average ranks for ties."""
    df = nan_to_null(df)
    cols = _numeric(df, cols)
    pairs = list(pairs if pairs is not None else _pairs(cols))
    if not pairs:
        return _empty_pairs(df, "n long, rho double")
    in_pairs = {c for p in pairs for c in p}
    used = [c for c in cols if c in in_pairs] + sorted(in_pairs - set(cols))
    base = df.select(*[as_double(df, c).alias(c) for c in used])
    nulls = base.agg(*[F.count_if(col(c).isNull()).alias(c) for c in used]).first().asDict()
    complete = [c for c in used if nulls[c] == 0]
    full_pairs = [(a, b) for a, b in pairs if a in complete and b in complete]
    parts = []
    if full_pairs:
        need = [c for c in complete if any(c in p for p in full_pairs)]
        tuples = base.groupBy(*[col(c) for c in need]).agg(F.count(F.lit(1)).alias("_w"))
        parts.append(_rank_corr(tuples, need, full_pairs, buckets))
    for a, b in pairs:
        if (a, b) in full_pairs:
            continue
        sub = base.where(col(a).isNotNull() & col(b).isNotNull())
        tuples = sub.groupBy(col(a), col(b)).agg(F.count(F.lit(1)).alias("_w"))
        parts.append(_rank_corr(tuples, [a, b], [(a, b)], buckets))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("rho", F.when(F.col("rho").isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), "rho"))))


def corr_pairs(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """feature1, feature2, n, pearson, spearman (4 dp) and strength of |pearson|."""
    cols = _numeric(df, cols)
    p = pearson_pairs(df, cols)
    s = spearman_pairs(df, cols).drop("n")
    return p.join(s, ["feature1", "feature2"]).select(
        "feature1", "feature2", "n", r4(F.col("r")).alias("pearson"), r4(F.col("rho")).alias("spearman"),
        strength_label(F.coalesce(F.col("r"), F.lit(0.0)), CORR_STRENGTH, "very_weak").alias("strength"))


def corr_top_pairs(df: DataFrame, cols: Sequence[str] | None = None, k: int = 5) -> DataFrame:
    """The k strongest pairs by |pearson| (ties by names)."""
    p = pearson_pairs(df, cols).where(F.col("r").isNotNull())
    return p.orderBy(F.desc(F.abs("r")), "feature1", "feature2").limit(k).select(
        "feature1", "feature2", "n", r4(F.col("r")).alias("pearson"))


def corr_strong(df: DataFrame, cols: Sequence[str] | None = None, threshold: float = 0.7,
                k: int | None = None) -> DataFrame:
    """|r| > 0.7: pearson, very strong (> 0.9), sign; strongest first, the top k if asked for."""
    p = pearson_pairs(df, cols).where(F.abs("r") > threshold)
    return head(p.orderBy(F.desc(F.abs("r")), "feature1", "feature2"), k).select(
        "feature1", "feature2", "n", r4(F.col("r")).alias("pearson"),
        (F.abs("r") > 0.9).alias("very_strong"),
        F.when(F.col("r") > 0, "positive").otherwise("negative").alias("direction"))


def corr_detailed(df: DataFrame, cols: Sequence[str] | None = None, k: int | None = None) -> DataFrame:
    """|r| > 0.3 and n > 10: Pearson, Spearman, p-value, significance, strength; strongest first."""
    cols = _numeric(df, cols)
    p = pearson_pairs(df, cols).where((F.abs("r") > 0.3) & (F.col("n") > 10))
    s = spearman_pairs(df, cols).drop("n")
    t = p.join(s, ["feature1", "feature2"]).withColumn("p_value", corr_pvalue(F.col("r"), F.col("n")))
    return head(t.orderBy(F.desc(F.abs("r")), "feature1", "feature2"), k).select(
        "feature1", "feature2", "n", r4(F.col("r")).alias("pearson"), r4(F.col("rho")).alias("spearman"),
        rnd(F.col("p_value"), 6).alias("p_value"), (F.col("p_value") < 0.05).alias("significant"),
        strength_label(F.col("r"), CORR_STRENGTH, "very_weak").alias("strength"),
        F.when(F.col("r") > 0, "positive").otherwise("negative").alias("direction"))


def corr_network_edges(df: DataFrame, cols: Sequence[str] | None = None, threshold: float = 0.5) -> DataFrame:
    """Edges of the correlation network: pairs with |r| >= threshold."""
    p = pearson_pairs(df, cols).where(F.abs("r") >= threshold)
    return p.select("feature1", "feature2", r4(F.col("r")).alias("pearson"), r4(F.abs("r")).alias("weight"))


def corr_distribution(df: DataFrame, cols: Sequence[str] | None = None, bins: int = 20) -> DataFrame:
    """Histogram of the upper-triangle Pearson values over [-1, 1] with their quartiles."""
    p = pearson_pairs(df, cols).where(F.col("r").isNotNull())
    b = F.least(F.floor((F.col("r") + 1.0) / (2.0 / bins)), F.lit(bins - 1)).cast("int")
    h = p.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).cast("long").alias("pairs"))
    return h.select("bin", rnd(F.col("bin") * (2.0 / bins) - 1.0, 4).alias("lower"),
                    rnd((F.col("bin") + 1) * (2.0 / bins) - 1.0, 4).alias("upper"), "pairs")


def feature_matrix(df: DataFrame, cols: Sequence[str] | None = None, min_filled: float = 0.5) -> DataFrame:
    """Numeric columns, rows at least ``min_filled`` filled, nulls filled with the exact median."""
    from tablescope.operators.clean import drop_sparse_rows, impute_median
    df = nan_to_null(df)
    cols = _numeric(df, cols)
    x = df.select(*[as_double(df, c).alias(c) for c in cols])
    return impute_median(drop_sparse_rows(x, cols, min_filled), cols)


def corr_advanced_summary(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """>= 3 columns, sparse rows dropped, median fill: mean |r|, max, min, pairs > 0.8,
    features in them and the strongest such pair."""
    cols = _numeric(df, cols)
    fm = feature_matrix(df, cols)
    p = pearson_pairs(fm, cols).where(F.col("r").isNotNull())
    hi = F.abs("r") > 0.8
    return p.agg(
        F.lit(len(cols)).cast("long").alias("features"),
        r4(F.avg(F.abs("r"))).alias("mean_abs_corr"), r4(F.max(F.abs("r"))).alias("max_abs_corr"),
        r4(F.min(F.abs("r"))).alias("min_abs_corr"), F.count_if(hi).cast("long").alias("pairs_above_08"),
        F.size(F.array_distinct(F.flatten(F.collect_list(F.when(hi, F.array("feature1", "feature2")))))).cast("long")
        .alias("features_in_high_pairs"),
        F.max(F.when(hi, F.struct(F.abs("r").alias("a"), F.col("feature1"), F.col("feature2")))).alias("_top"),
    ).select("*", F.col("_top.feature1").alias("top_feature1"), F.col("_top.feature2").alias("top_feature2")
             ).drop("_top")


def _components(edges: DataFrame) -> DataFrame:
    """(node, component) by min-label propagation until nothing changes.

    The edge table (columns squared at most) is checkpointed first, so that the base table is not
    read again in every round, and so are the labels.
    """
    from tablescope.session import reliable_checkpoint
    edges = reliable_checkpoint(edges)
    und = edges.select(F.col("a").alias("src"), F.col("b").alias("dst")).unionByName(
        edges.select(F.col("b").alias("src"), F.col("a").alias("dst")))
    labels = und.select(F.col("src").alias("node")).distinct().withColumn("label", F.col("node"))
    while True:
        prop = (und.join(labels.withColumnRenamed("node", "src"), "src")
                .groupBy(F.col("dst").alias("node")).agg(F.min("label").alias("cand")))
        new = reliable_checkpoint(
            labels.join(prop, "node", "left")
            .select("node", F.least("label", F.coalesce("cand", "label")).alias("label"),
                    (F.col("cand") < F.col("label")).alias("moved")))
        labels = new.drop("moved")
        if new.where("moved").isEmpty():
            return labels.withColumnRenamed("label", "component")


def multicollinearity_groups(df: DataFrame, cols: Sequence[str] | None = None, threshold: float = 0.8) -> DataFrame:
    """>= 3 columns: groups of columns linked by |r| > 0.8; severity high above 2 members."""
    cols = _numeric(df, cols)
    spark = df.sparkSession
    if len(cols) < 3:
        return spark.createDataFrame([], "component string, features string, size long, severity string")
    e = pearson_pairs(df, cols).where(F.abs("r") > threshold).select(F.col("feature1").alias("a"),
                                                                      F.col("feature2").alias("b"))
    comp = _components(e)
    g = comp.groupBy("component").agg(F.array_join(F.array_sort(F.collect_list("node")), ",").alias("features"),
                                      F.count(F.lit(1)).cast("long").alias("size"))
    return g.select("component", "features", "size",
                    F.when(F.col("size") > 2, "high").otherwise("medium").alias("severity"))


def feature_clusters(df: DataFrame, cols: Sequence[str] | None = None, threshold: float = 0.7,
                     min_filled: float = 0.7) -> DataFrame:
    """Star clusters in column order: a seed takes every unassigned column with |r| > 0.7.

    Rows less than 70 % filled are dropped first.  The greedy pass walks the pair table
    (at most p(p-1)/2 rows, bounded by the schema) in column order.
    """
    from tablescope.operators.clean import drop_sparse_rows
    cols = _numeric(df, cols)
    x = drop_sparse_rows(nan_to_null(df).select(*[as_double(df, c).alias(c) for c in cols]), cols, min_filled)
    strong = pearson_pairs(x, cols).where(F.abs("r") > threshold).select("feature1", "feature2").collect()
    adj: dict[str, set[str]] = {c: set() for c in cols}
    for r in strong:
        adj[r[0]].add(r[1])
        adj[r[1]].add(r[0])
    done: set[str] = set()
    rows = []
    for c in cols:
        if c in done:
            continue
        members = {c} | {o for o in adj[c] if o not in done}
        done |= members
        if len(members) > 1:
            rows.append((c, ",".join(m for m in cols if m in members), len(members)))
    return df.sparkSession.createDataFrame(rows, "seed string, features string, size long")


def linear_fit(df: DataFrame, x: str, y: str) -> DataFrame:
    """OLS of y on x: slope, intercept, R^2, r, p-value, n (constant x gives NULL slope)."""
    df = nan_to_null(df)
    xx, yy = as_double(df, x), as_double(df, y)
    t = df.agg(F.regr_count(yy, xx).cast("long").alias("n"), F.regr_slope(yy, xx).alias("slope"),
               F.regr_intercept(yy, xx).alias("intercept"), F.regr_r2(yy, xx).alias("r2"),
               F.covar_samp(xx, yy).alias("_c"), F.var_samp(F.when(yy.isNotNull(), xx)).alias("_vx"),
               F.var_samp(F.when(xx.isNotNull(), yy)).alias("_vy"))
    r = F.try_divide(F.col("_c"), F.sqrt(F.col("_vx") * F.col("_vy")))
    t = t.withColumn("r", r).withColumn("p_value", corr_pvalue(F.col("r"), F.col("n")))
    return t.select(F.lit(x).alias("x"), F.lit(y).alias("y"), "n", r4(F.col("slope")).alias("slope"),
                    r4(F.col("intercept")).alias("intercept"),
                    r4(F.when(F.col("_vx") > 0, F.col("r2"))).alias("r2"), r4(F.col("r")).alias("r"),
                    rnd(F.col("p_value"), 6).alias("p_value"))


def quick_corr(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Pairs labelled strong (|r| > .7) or moderate (> .3)."""
    p = pearson_pairs(df, cols).where(F.abs("r") > 0.3)
    return p.select("feature1", "feature2", r4(F.col("r")).alias("pearson"),
                    F.when(F.abs("r") > 0.7, "strong").otherwise("moderate").alias("label"))


def quick_skew(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """|mean - median| / |median| > 0.1 marks a skewed column."""
    df = nan_to_null(df)
    cols = _numeric(df, cols)
    means = tall_agg(df, cols, lambda c: {"mean": F.avg(as_double(df, c))}, ["mean"])
    med = wide_quantiles(exact_quantiles(df, cols, [0.5]), ["column"], {0.5: "median"})
    t = means.join(med, "column")
    rel = F.try_divide(F.abs(F.col("mean") - F.col("median")), F.abs(F.col("median")))
    return t.select("column", r4(F.col("mean")).alias("mean"), r4(F.col("median")).alias("median"),
                    r4(rel).alias("relative_gap"), F.coalesce(rel > 0.1, F.lit(False)).alias("skewed"))
