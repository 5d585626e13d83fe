"""Target-centred analyses: associations, importance, mutual information, interactions.

Mutual information is the plug-in estimate (nats) on decile-binned numeric features
and raw categories: one stacked ``groupBy(feature, x, y).count()`` with margins from
two more group-bys of the same (histogram-sized) table.  Feature caps of the original
tool are optional parameters; by default every feature is scored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablescope.functions.exprs import (
    as_double, col, head, is_numeric, is_string, nan_to_null, r4, with_scalars,
)
from tablescope.operators.assoc import pearson_pairs, spearman_pairs
from tablescope.operators.histogram import exact_quantiles
from tablescope.operators.stat_tests import chi_square_pairs

DECILES = [i / 10 for i in range(1, 10)]


def _split(df: DataFrame, target: str, features: Sequence[str] | None):
    feats = [c for c in (features or df.columns) if c != target]
    nums = [c for c in feats if is_numeric(df.schema[c].dataType)]
    cats = [c for c in feats if is_string(df.schema[c].dataType)]
    return nums, cats


def target_associations(df: DataFrame, target: str, features: Sequence[str] | None = None,
                        k: int | None = None) -> DataFrame:
    """Best association of each feature with the target: Pearson / Spearman (numeric
    target, numeric feature, |r| > 0.1, n > 10) or Cramer's V > 0.1 (string feature)."""
    df = nan_to_null(df)
    nums, cats = _split(df, target, features)
    parts = []
    if is_numeric(df.schema[target].dataType) and nums:
        pairs = [(f, target) for f in nums]
        p = pearson_pairs(df, nums + [target], pairs)
        s = spearman_pairs(df, nums + [target], pairs).drop("n")
        t = p.join(s, ["feature1", "feature2"]).where(F.col("n") > 10)
        best = F.when(F.abs(F.coalesce("r", F.lit(0.0))) >= F.abs(F.coalesce("rho", F.lit(0.0))),
                      F.struct(F.lit("pearson").alias("method"), F.col("r").alias("score"))).otherwise(
            F.struct(F.lit("spearman").alias("method"), F.col("rho").alias("score")))
        parts.append(t.select(F.col("feature1").alias("feature"), "n", best.alias("b")).select(
            "feature", "n", "b.method", "b.score"))
    if cats:
        v = chi_square_pairs(df, [(c, target) for c in cats], fill="Missing")
        parts.append(v.select(F.col("feature1").alias("feature"), "n", F.lit("cramers_v").alias("method"),
                              F.col("cramers_v").alias("score")))
    if not parts:
        return df.sparkSession.createDataFrame([], "feature string, n long, method string, score double")
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    return (head(u.where(F.abs("score") > 0.1).orderBy(F.desc(F.abs("score")), "feature"), k)
            .select("feature", "n", "method", r4(F.col("score")).alias("score")))


def feature_importance(df: DataFrame, target: str, features: Sequence[str] | None = None,
                       k: int | None = None) -> DataFrame:
    """|Pearson| for numeric features (n > 10), Cramer's V for string features; strongest first."""
    df = nan_to_null(df)
    nums, cats = _split(df, target, features)
    parts = []
    if is_numeric(df.schema[target].dataType) and nums:
        p = pearson_pairs(df, nums + [target], [(f, target) for f in nums]).where(F.col("n") > 10)
        parts.append(p.select(F.col("feature1").alias("feature"), F.lit("abs_pearson").alias("method"),
                              F.abs("r").alias("importance")))
    if cats:
        parts.append(chi_square_pairs(df, [(c, target) for c in cats], fill="Missing").select(
            F.col("feature1").alias("feature"), F.lit("cramers_v").alias("method"), F.col("cramers_v").alias("importance")))
    if not parts:
        return df.sparkSession.createDataFrame([], "feature string, method string, importance double")
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    return (head(u.where(F.col("importance").isNotNull()).orderBy(F.desc("importance"), "feature"), k)
            .select("feature", "method", r4(F.col("importance")).alias("importance")))


def _decile_bins(df: DataFrame, cols: Sequence[str]) -> tuple[DataFrame, dict[str, str]]:
    """Add ``_bin_<i>`` = number of distinct decile edges below the value (0..9)."""
    cols = list(cols)
    if not cols:
        return df, {}
    q = exact_quantiles(df, cols, DECILES)
    row = q.groupBy().pivot("column", cols).agg(F.sort_array(F.collect_list("q")))
    row = row.select(*[col(c).alias(f"_edges_{i}") for i, c in enumerate(cols)])
    j = with_scalars(df, row)
    names = {}
    for i, c in enumerate(cols):
        e = F.col(f"_edges_{i}")
        x = as_double(df, c)
        steps = [F.when((F.lit(k) == 0) | (e[k] > e[k - 1]), F.when(e[k] < x, 1).otherwise(0)).otherwise(0)
                 if k > 0 else F.when(e[0] < x, 1).otherwise(0) for k in range(len(DECILES))]
        b = F.when(x.isNull(), None).otherwise(sum(steps[1:], steps[0]).cast("string"))
        j = j.withColumn(f"_bin_{i}", b)
        names[c] = f"_bin_{i}"
    return j.drop(*[f"_edges_{i}" for i in range(len(cols))]), names


def mutual_information(df: DataFrame, target: str, features: Sequence[str] | None = None,
                       max_features: int | None = None, target_bins: bool | None = None) -> DataFrame:
    """Plug-in mutual information (nats) of each feature with the target.

    Numeric features are decile-binned; strings are used as they are.  A numeric target is
    decile-binned too unless ``target_bins`` is False (its type decides, not its values).  ``max_features`` keeps the
    original tool's cap (half by variance, half by distinct count) when set.
    """
    df = nan_to_null(df)
    nums, cats = _split(df, target, features)
    if max_features:
        from tablescope.functions.exprs import tall_agg
        half = max_features // 2
        if len(nums) > half:
            v = tall_agg(df, nums, lambda c: {"v": F.var_samp(as_double(df, c))}, ["v"])
            nums = [r[0] for r in v.orderBy(F.desc_nulls_last("v"), "column").limit(half).collect()]
        if len(cats) > max_features - len(nums):
            d = tall_agg(df, cats, lambda c: {"d": F.approx_count_distinct(col(c))}, ["d"])
            cats = [r[0] for r in d.orderBy(F.desc("d"), "column").limit(max_features - len(nums)).collect()]
    tdt = df.schema[target].dataType
    if target_bins is None:
        target_bins = is_numeric(tdt)
    binned, names = _decile_bins(df, nums + ([target] if target_bins else []))
    y = F.col(names[target]) if target_bins else col(target).cast("string")
    items = [(c, "numeric", F.col(names[c])) for c in nums] + [(c, "categorical", col(c).cast("string")) for c in cats]
    if not items:
        return df.sparkSession.createDataFrame([], "feature string, type string, n long, mi double")
    stacked = binned.select(y.alias("_y"), F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.lit(t).alias("type"), x.alias("x")) for c, t, x in items])).alias("s")
    ).select("s.feature", "s.type", "s.x", "_y").where(F.col("x").isNotNull() & F.col("_y").isNotNull())
    joint = stacked.groupBy("feature", "type", "x", "_y").agg(F.count(F.lit(1)).alias("nxy"))
    px = joint.groupBy("feature", "x").agg(F.sum("nxy").alias("nx"))
    py = joint.groupBy("feature", "_y").agg(F.sum("nxy").alias("ny"))
    tot = joint.groupBy("feature").agg(F.sum("nxy").alias("N"))
    j = joint.join(px, ["feature", "x"]).join(py, ["feature", "_y"]).join(F.broadcast(tot), "feature")
    mi = j.groupBy("feature", "type").agg(
        F.max("N").cast("long").alias("n"),
        F.sum(F.col("nxy") / F.col("N") * F.log(F.col("nxy").cast("double") * F.col("N") / (F.col("nx").cast("double") * F.col("ny")))).alias("mi"))
    return mi.select("feature", "type", "n", r4(F.greatest(F.lit(0.0), F.col("mi"))).alias("mi"))


def mi_bands(mi: DataFrame) -> DataFrame:
    """Features above the 0.8 / below the 0.2 quantile of MI; numeric vs categorical ratio."""
    qs = mi.agg(F.percentile("mi", 0.8).alias("_hi"), F.percentile("mi", 0.2).alias("_lo"),
                F.avg(F.when(F.col("type") == "numeric", F.col("mi"))).alias("_mn"),
                F.avg(F.when(F.col("type") == "categorical", F.col("mi"))).alias("_mc"))
    t = with_scalars(mi, qs)
    ratio = F.try_divide(F.col("_mn"), F.col("_mc"))
    return t.select("feature", "type", "mi",
                    F.when(F.col("mi") > F.col("_hi"), "high").when(F.col("mi") < F.col("_lo"), "low")
                    .otherwise("middle").alias("band"),
                    r4(ratio).alias("numeric_to_categorical"),
                    F.when(ratio > 1.5, "numeric").when(F.try_divide(F.col("_mc"), F.col("_mn")) > 1.5, "categorical")
                    .alias("dominant_type"))


def interaction_strength(df: DataFrame, target: str, features: Sequence[str] | None = None,
                         max_features: int | None = None, k: int | None = None) -> DataFrame:
    """|corr(x*y, target)| per numeric pair, each feature's own |corr|, gain; strongest first."""
    df = nan_to_null(df)
    nums, _ = _split(df, target, features)
    if max_features and len(nums) > max_features:
        from tablescope.functions.exprs import tall_agg
        v = tall_agg(df, nums, lambda c: {"v": F.var_samp(as_double(df, c))}, ["v"])
        nums = [r[0] for r in v.orderBy(F.desc_nulls_last("v"), "column").limit(max_features).collect()]
    pairs = [(a, b) for i, a in enumerate(nums) for b in nums[i + 1:]]
    if not pairs:
        return df.sparkSession.createDataFrame([], "feature1 string, feature2 string, interaction_corr double, "
                                                   "best_single double, gain double, beneficial boolean")
    proj = df.select(as_double(df, target).alias("_t"), *[as_double(df, c).alias(c) for c in nums],
                     *[(as_double(df, a) * as_double(df, b)).alias(f"{a}__x__{b}") for a, b in pairs])
    singles = pearson_pairs(proj, nums + ["_t"], [(c, "_t") for c in nums]).select(
        F.col("feature1").alias("f"), F.abs("r").alias("rs"))
    inter = pearson_pairs(proj, [f"{a}__x__{b}" for a, b in pairs] + ["_t"],
                          [(f"{a}__x__{b}", "_t") for a, b in pairs]).select(
        F.col("feature1").alias("p"), F.abs("r").alias("ri"))
    meta = df.sparkSession.createDataFrame([(f"{a}__x__{b}", a, b) for a, b in pairs],
                                           "p string, feature1 string, feature2 string")
    t = (inter.join(F.broadcast(meta), "p")
         .join(F.broadcast(singles.withColumnRenamed("f", "feature1").withColumnRenamed("rs", "r1")), "feature1")
         .join(F.broadcast(singles.withColumnRenamed("f", "feature2").withColumnRenamed("rs", "r2")), "feature2"))
    best = F.greatest(F.coalesce("r1", F.lit(0.0)), F.coalesce("r2", F.lit(0.0)))
    gain = F.col("ri") - best
    return (head(t.where(F.col("ri").isNotNull()).orderBy(F.desc("ri"), "feature1", "feature2"), k)
            .select("feature1", "feature2", r4(F.col("ri")).alias("interaction_corr"), r4(best).alias("best_single"),
                    r4(gain).alias("gain"), (gain > 0).alias("beneficial")))


def interaction_bands(inter: DataFrame) -> DataFrame:
    """One row: 0.8 quantile of interaction strength, pairs above it, gains > 0.05,
    share of negative gains and whether it exceeds 70 %."""
    return inter.agg(
        r4(F.percentile("interaction_corr", 0.8)).alias("q80"),
        F.count(F.lit(1)).cast("long").alias("pairs"),
        F.count_if(F.col("gain") > 0.05).cast("long").alias("gain_above_005"),
        F.count_if(F.col("beneficial")).cast("long").alias("beneficial"),
        r4(F.avg("gain")).alias("mean_gain"),
        r4(F.count_if(F.col("gain") < 0) / F.count(F.lit(1))).alias("negative_share"),
    ).withColumn("mostly_negative", F.col("negative_share") > 0.7)
