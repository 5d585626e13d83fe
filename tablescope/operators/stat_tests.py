"""Categorical association and hypothesis tests.

Contingency tables are ``groupBy(a, b).count()`` (map-side combined).  The chi-square
statistic only needs observed cells and margins: unobserved cells contribute their
expected count, whose sum is ``n - sum(expected of observed cells)``.  ANOVA works from
per-group moments; Kruskal-Wallis from the joint (group, value) histogram and exact average
ranks.  All pairs of columns go through one pipeline, keyed by the pair.  Tail probabilities
run on the result, a row for each pair.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablescope.functions.constants import ASSOC_STRENGTH, EFFECT_SIZE
from tablescope.functions.exprs import (
    as_double, col, head, nan_to_null, pct, r4, rnd, strength_label, with_scalars,
)
from tablescope.functions.stats import chi2_pvalue, f_pvalue
from tablescope.operators.histogram import ranked_histogram

CHI_SQUARE_SCHEMA = ("feature1 string, feature2 string, n long, rows long, cols long, chi2 double, dof long, "
                     "p_value double, significant boolean, cramers_v double, low_expected boolean")
GROUP_EFFECT_SCHEMA = ("categorical_feature string, numeric_feature string, test string, statistic double, p_value double, "
                       "significant boolean, eta_squared double, effect string, groups long")


def _labels(df: DataFrame, a: str, b: str, fill: str) -> DataFrame:
    return nan_to_null(df).select(F.coalesce(col(a).cast("string"), F.lit(fill)).alias("a"),
                                  F.coalesce(col(b).cast("string"), F.lit(fill)).alias("b"))


def contingency(df: DataFrame, a: str, b: str, fill: str = "Unknown") -> DataFrame:
    """Tall contingency table: a, b, n, row %, column %, total % (nulls -> 'Unknown')."""
    ct = _labels(df, a, b, fill).groupBy("a", "b").agg(F.count(F.lit(1)).cast("long").alias("n"))
    rows = ct.groupBy("a").agg(F.sum("n").alias("_r"))
    cols = ct.groupBy("b").agg(F.sum("n").alias("_c"))
    tot = ct.agg(F.sum("n").alias("_t"))
    t = with_scalars(ct.join(rows, "a").join(cols, "b"), tot)
    return t.select(F.col("a").alias(a), F.col("b").alias(b), "n",
                    pct(F.col("n"), F.col("_r")).alias("row_pct"), pct(F.col("n"), F.col("_c")).alias("col_pct"),
                    pct(F.col("n"), F.col("_t")).alias("total_pct"))


def contingency_wide(df: DataFrame, a: str, b: str, fill: str = "Unknown") -> DataFrame:
    """Wide contingency table (one column per value of b); for small b only."""
    return _labels(df, a, b, fill).groupBy(F.col("a").alias(a)).pivot("b").count().fillna(0)


def _indexed_pairs(pairs: Sequence[tuple[int, int]]) -> Column:
    """The pairs of positions as one constant array, so that the plan does not grow with their number."""
    flat = [F.split(F.lit(",".join(str(p[side]) for p in pairs)), ",").cast("array<int>") for side in (0, 1)]
    return F.arrays_zip(flat[0].alias("i"), flat[1].alias("j"))


def _chi_square_pairs(df: DataFrame, pairs: Sequence[tuple[str, str]], fill: str, yates: bool) -> DataFrame:
    """feature1, feature2, n, rows, cols, chi2, dof, low_expected of every pair, in one pipeline.

    One scan and one shuffle count the cells (pair, a, b) after a map-side combine, so a hot value costs
    one row a task; the margins are sums of cells, joined by (pair, value).  No job runs before the frame
    is used.  In a two-by-two table all four cells lie equally far from what is expected, so Yates'
    correction needs only that distance and the sum of 1 / expected, a product of two margin sums.
    """
    names = list(dict.fromkeys(c for p in pairs for c in p))
    at = {c: i for i, c in enumerate(names)}
    values = F.array(*[F.coalesce(col(c).cast("string"), F.lit(fill)) for c in names])
    tall = (nan_to_null(df).select(values.alias("v"))
            .select("v", F.explode(_indexed_pairs([(at[a], at[b]) for a, b in pairs])).alias("p")))
    cells = (tall.select("p.i", "p.j", F.get("v", F.col("p.i")).alias("a"), F.get("v", F.col("p.j")).alias("b"))
             .groupBy("i", "j", "a", "b").agg(F.count(F.lit(1)).cast("double").alias("o")))
    rows = cells.groupBy("i", "j", "a").agg(F.sum("o").alias("R"))
    cols = cells.groupBy("i", "j", "b").agg(F.sum("o").alias("C"))
    shape = (rows.groupBy("i", "j").agg(F.count(F.lit(1)).alias("r"), F.sum("R").alias("N"), F.min("R").alias("minR"),
                                        F.sum(1.0 / F.col("R")).alias("invR"))
             .join(cols.groupBy("i", "j").agg(F.count(F.lit(1)).alias("c"), F.min("C").alias("minC"),
                                              F.sum(1.0 / F.col("C")).alias("invC")), ["i", "j"]))
    e = F.col("R") * F.col("C") / F.col("N")
    stat = (cells.join(rows, ["i", "j", "a"]).join(cols, ["i", "j", "b"])
            .join(F.broadcast(shape.select("i", "j", "N")), ["i", "j"])  # a row for each pair of columns
            .groupBy("i", "j").agg((F.sum(F.pow(F.col("o") - e, 2) / e) + F.max("N") - F.sum(e)).alias("plain"),
                                   F.max(F.abs(F.col("o") - e)).alias("off")))
    corrected = F.pow(F.greatest(F.col("off") - 0.5, F.lit(0.0)), 2) * F.col("N") * F.col("invR") * F.col("invC")
    chi2 = F.when(F.lit(yates) & (F.col("r") == 2) & (F.col("c") == 2), corrected).otherwise(F.col("plain"))
    label = F.array(*[F.lit(c) for c in names])
    return shape.join(stat, ["i", "j"]).select(
        F.get(label, F.col("i")).alias("feature1"), F.get(label, F.col("j")).alias("feature2"),
        F.col("N").cast("long").alias("n"), F.col("r").cast("long").alias("rows"), F.col("c").cast("long").alias("cols"),
        F.greatest(F.lit(0.0), chi2).alias("chi2"), ((F.col("r") - 1) * (F.col("c") - 1)).cast("long").alias("dof"),
        (F.col("minR") * F.col("minC") / F.col("N") < 5).alias("low_expected"))


def chi_square_pairs(df: DataFrame, pairs: Sequence[tuple[str, str]], fill: str = "Unknown",
                     yates: bool = True) -> DataFrame:
    """``chi_square`` of every given pair of columns, counted together; a table without rows gives none."""
    if not pairs:
        return df.sparkSession.createDataFrame([], CHI_SQUARE_SCHEMA)
    core = _chi_square_pairs(df, pairs, fill, yates)
    v = F.sqrt(F.try_divide(F.col("chi2"), F.col("n") * (F.least("rows", "cols") - 1)))
    p = chi2_pvalue(F.col("chi2"), F.col("dof"))
    return core.select("feature1", "feature2", "n", "rows", "cols",
                       r4(F.col("chi2")).alias("chi2"), "dof", rnd(p, 6).alias("p_value"),
                       (p < 0.05).alias("significant"), r4(v).alias("cramers_v"), "low_expected")


def chi_square(df: DataFrame, a: str, b: str, fill: str = "Unknown", yates: bool = True) -> DataFrame:
    """chi2, p, dof, n, Cramer's V, low expected counts, significance (Yates on 2x2)."""
    return chi_square_pairs(df, [(a, b)], fill, yates)


def cramers_v(df: DataFrame, a: str, b: str, fill: str = "Missing") -> DataFrame:
    return chi_square(df, a, b, fill).select("feature1", "feature2", "cramers_v")


def categorical_dependencies(df: DataFrame, cols: Sequence[str], k: int | None = None) -> DataFrame:
    """All string pairs (nulls -> 'Missing'), tables of 4+ cells, p < 0.05 and V > 0.1; strongest first."""
    cols = list(cols)
    u = chi_square_pairs(df, [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]], fill="Missing")
    u = u.where((F.col("rows") * F.col("cols") >= 4) & (F.col("p_value") < 0.05) & (F.col("cramers_v") > 0.1))
    return head(u.orderBy(F.desc("cramers_v"), "feature1", "feature2"), k).select(
        "feature1", "feature2", "cramers_v", "chi2", "p_value",
        strength_label(F.col("cramers_v"), ASSOC_STRENGTH, "negligible").alias("strength"))


def group_effects(df: DataFrame, pairs: Sequence[tuple[str, str]], method: str = "auto") -> DataFrame:
    """``group_effect`` of every (category, numeric) pair, in one pipeline.

    Group moments of all pairs come from one scan and one shuffle keyed by (pair, group), combined
    map-side; a pair's totals are sums over its groups.  Only pairs that take Kruskal-Wallis go on to
    the (pair, group, value) histogram, whose values are ranked once for all pairs.
    """
    if not pairs:
        return df.sparkSession.createDataFrame([], GROUP_EFFECT_SCHEMA)
    cats, nums = (list(dict.fromkeys(p[side] for p in pairs)) for side in (0, 1))
    position = _indexed_pairs([(cats.index(c), nums.index(x)) for c, x in pairs])
    clean = nan_to_null(df)
    tall = (clean.select(F.array(*[F.coalesce(col(c).cast("string"), F.lit("Missing")) for c in cats]).alias("c"),
                         F.array(*[as_double(clean, x) for x in nums]).alias("v"))
            .select("c", "v", F.explode(position).alias("p"))
            .select("p.i", "p.j", F.get("c", F.col("p.i")).alias("g"), F.get("v", F.col("p.j")).alias("x"))
            .where(F.col("x").isNotNull()))
    gs = tall.groupBy("i", "j", "g").agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("m"),
                                         F.var_samp("x").alias("v"), F.skewness("x").alias("sk"))
    w = F.col("n") * F.col("m")
    kept_n, kept = F.when(F.col("n") > 2, F.col("n")), F.col("n") > 2
    means = gs.groupBy("i", "j").agg(F.sum("n").alias("total"), (F.sum(w) / F.sum("n")).alias("mean"),
                                     F.count(kept_n).alias("k"), F.sum(kept_n).alias("kept_total"),
                                     (F.sum(F.when(kept, w)) / F.sum(kept_n)).alias("kept_mean"),
                                     F.bool_and(~kept | (F.col("n") < 30) | F.coalesce(F.abs("sk") < 2, F.lit(False))).alias("normal_ok"))
    inner = (F.col("n") - 1) * F.coalesce(F.col("v"), F.lit(0.0))
    apart = F.col("n") * F.pow(F.col("m") - F.col("mean"), 2)
    anova = {"auto": F.col("normal_ok"), "anova": F.lit(True), "kruskal": F.lit(False)}[method]
    # one row for each pair of columns: broadcast
    s = (gs.join(F.broadcast(means), ["i", "j"])
         .groupBy("i", "j", "total", "k", "kept_total", "normal_ok")
         .agg(F.sum(F.when(kept, F.col("n") * F.pow(F.col("m") - F.col("kept_mean"), 2))).alias("ssb_k"),
              F.sum(F.when(kept, inner)).alias("ssw"), F.sum(F.when(kept, apart)).alias("ssb_all"),
              F.sum(inner + apart).alias("sst"))
         .where((F.col("total") >= 10) & (F.col("k") >= 2)).withColumn("use_anova", anova))
    if method == "anova":
        s = s.withColumn("sr2", F.lit(None).cast("double")).withColumn("ties", F.lit(None).cast("double"))
    else:
        s = s.join(_rank_sums(tall, gs.where(kept), s.where(~F.col("use_anova")).select("i", "j")), ["i", "j"], "left")
    nk = F.col("kept_total").cast("double")
    h_raw = 12.0 / (nk * (nk + 1)) * F.col("sr2") - 3 * (nk + 1)
    h = F.try_divide(h_raw, 1 - F.col("ties") / (F.pow(nk, 3) - nk))
    fstat = F.try_divide(F.try_divide(F.col("ssb_k"), F.col("k") - 1), F.try_divide(F.col("ssw"), nk - F.col("k")))
    p = F.when(F.col("use_anova"), f_pvalue(fstat, F.col("k") - 1, nk - F.col("k"))).otherwise(chi2_pvalue(h, F.col("k") - 1))
    eta = F.coalesce(F.try_divide(F.col("ssb_all"), F.col("sst")), F.lit(0.0))
    cat_name, num_name = (F.array(*[F.lit(c) for c in names]) for names in (cats, nums))
    return s.select(
        F.get(cat_name, F.col("i")).alias("categorical_feature"), F.get(num_name, F.col("j")).alias("numeric_feature"),
        F.when(F.col("use_anova"), "anova").otherwise("kruskal_wallis").alias("test"),
        r4(F.when(F.col("use_anova"), fstat).otherwise(h)).alias("statistic"), rnd(p, 6).alias("p_value"),
        (p < 0.05).alias("significant"), r4(eta).alias("eta_squared"),
        strength_label(eta, EFFECT_SIZE, "negligible").alias("effect"), F.col("k").cast("long").alias("groups"))


def _rank_sums(tall: DataFrame, kept: DataFrame, wanted: DataFrame) -> DataFrame:
    """i, j, sr2 (sum of squared rank sums over group sizes) and ties of the ``wanted`` pairs, over rows of kept groups."""
    groups = kept.join(F.broadcast(wanted), ["i", "j"], "left_semi").select("i", "j", "g")
    hist = (tall.join(F.broadcast(wanted), ["i", "j"], "left_semi")
            .groupBy("i", "j", "g", F.col("x").alias("value")).agg(F.count(F.lit(1)).alias("n"))
            .join(groups, ["i", "j", "g"], "left_semi"))
    ranked = ranked_histogram(hist.groupBy("i", "j", "value").agg(F.sum("n").alias("n")), ["i", "j"])
    ties = ranked.groupBy("i", "j").agg(F.sum(F.pow(F.col("n"), 3) - F.col("n")).alias("ties"))
    rank = F.col("below") + (F.col("t") + 1) / 2.0
    sums = (hist.join(ranked.select("i", "j", "value", "below", F.col("n").alias("t")), ["i", "j", "value"])
            .groupBy("i", "j", "g").agg(F.sum(F.col("n") * rank).alias("R"), F.sum("n").alias("size")))
    return (sums.groupBy("i", "j").agg(F.sum(F.pow("R", 2) / F.col("size")).alias("sr2")).join(ties, ["i", "j"]))


def group_effect(df: DataFrame, cat: str, num: str, method: str = "auto") -> DataFrame:
    """Category x numeric: ANOVA or Kruskal-Wallis over groups with > 2 rows, and eta^2.

    ANOVA is used when every group has fewer than 30 rows or |skew| < 2 (``auto``).
    eta^2 = SS_between(kept groups) / SS_total(all rows), overall mean over all rows.
    """
    return group_effects(df, [(cat, num)], method)


def mixed_interactions(df: DataFrame, cat_cols: Sequence[str], num_cols: Sequence[str],
                       k: int | None = None) -> DataFrame:
    """group_effect for every category x numeric pair; significant ones, by eta^2."""
    u = group_effects(df, [(c, n) for c in cat_cols for n in num_cols])
    return head(u.where(F.col("significant")).orderBy(F.desc("eta_squared"), "categorical_feature",
                                                      "numeric_feature"), k)


def jarque_bera(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Jarque-Bera statistic n/6 (S^2 + K^2/4) and its chi-square(2) p-value exp(-JB/2)."""
    from tablescope.functions.exprs import tall_agg
    df = nan_to_null(df)
    t = tall_agg(df, list(cols), lambda c: {"n": F.count(as_double(df, c)).cast("long"),
                                            "skewness": F.skewness(as_double(df, c)),
                                            "kurtosis": F.kurtosis(as_double(df, c))}, ["n", "skewness", "kurtosis"])
    jb = F.col("n") / 6.0 * (F.pow("skewness", 2) + F.pow("kurtosis", 2) / 4.0)
    return t.select("column", "n", r4(F.col("skewness")).alias("skewness"), r4(F.col("kurtosis")).alias("kurtosis"),
                    r4(jb).alias("jb_stat"), rnd(F.exp(-jb / 2.0), 6).alias("jb_pvalue"),
                    (F.exp(-jb / 2.0) > 0.05).alias("jb_normal"))


def normality_test(df: DataFrame, column: str) -> DataFrame:
    """Kolmogorov-Smirnov against N(mean, sd) (distributed, pyspark.ml) plus Jarque-Bera."""
    from pyspark.ml.stat import KolmogorovSmirnovTest
    df = nan_to_null(df)
    x = df.select(as_double(df, column).alias("x")).where(F.col("x").isNotNull())
    st = x.agg(F.avg("x").alias("m"), F.stddev_samp("x").alias("s")).first()
    jb = jarque_bera(df, [column])
    if st["s"] is None or st["s"] == 0:
        return jb.select("*", F.lit(None).cast("double").alias("ks_stat"), F.lit(None).cast("double").alias("ks_pvalue"),
                         F.lit(False).alias("normal"))
    ks = KolmogorovSmirnovTest.test(x, "x", "norm", float(st["m"]), float(st["s"]))
    ks = ks.select(r4(F.col("statistic")).alias("ks_stat"), rnd(F.col("pValue"), 6).alias("ks_pvalue"))
    return with_scalars(jb, ks).withColumn("normal", F.col("ks_pvalue") > 0.05)


def distribution_shape(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Skew class (|s| < .5 approximately normal, > 1 right, < -1 left, else moderate)
    and whether a transformation is needed (|s| > 1 or Jarque-Bera rejects normality)."""
    jb = jarque_bera(df, cols)
    s = F.col("skewness")
    shape = (F.when(F.abs(s) < 0.5, "approximately_normal").when(s > 1, "right_skewed")
             .when(s < -1, "left_skewed").otherwise("moderately_skewed"))
    return jb.select("column", "n", "skewness", "kurtosis", shape.alias("shape"), "jb_normal",
                     ((F.abs(s) > 1) | ~F.col("jb_normal")).alias("transformation_needed"))
