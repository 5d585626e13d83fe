"""Shared primitives against numpy / pandas formula oracles, incl. edge frames."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tablescope.functions import stats
from tablescope.operators import assoc, histogram, outliers, profile, stat_tests

from .conftest import SF_SMALL


@pytest.mark.parametrize("buckets", [1, 3])
def test_exact_quantiles_match_pandas(spark, buckets):
    li = spark.read.parquet(f"{SF_SMALL}/lineitem.parquet")
    pdf = li.toPandas()
    cols = ["l_quantity", "l_extendedprice", "l_discount"]
    probs = [0.1, 0.25, 0.5, 0.75, 0.99]
    got = histogram.exact_quantiles(li, cols, probs, buckets=buckets).toPandas()
    for c in cols:
        for p in probs:
            v = got[(got.column == c) & (np.isclose(got.p, p))].q.iloc[0]
            assert v == pytest.approx(pdf[c].quantile(p), rel=1e-12, abs=1e-9)


@pytest.mark.parametrize("buckets", [1, 4])
def test_average_ranks_match_pandas(spark, buckets):
    pdf = pd.DataFrame({"x": [3.0, 1.0, 3.0, 2.0, 3.0, 5.0, 1.0], "y": [1.0, 2.0, 2.0, 2.0, 9.0, 0.0, 4.0]})
    df = spark.createDataFrame(pdf)
    tup = df.groupBy("x", "y").agg(F.count(F.lit(1)).alias("_w"))
    got = histogram.attach_rank_columns(tup, ["x"], "_w", buckets=buckets).toPandas()
    exp = pdf.x.rank()
    for _, r in got.iterrows():
        assert r["_rank_x"] == exp[pdf.x == r["x"]].iloc[0]


def test_spearman_pairwise_complete_matches_pandas(spark):
    pdf = pd.DataFrame({"a": [1, 2, 3, 4, 5, 6, None, 8.0], "b": [2, 1, 4, 3, 6, None, 7, 9.0],
                        "c": [1, 1, 2, 2, 3, 3, 4, 4.0]})
    df = spark.createDataFrame(pdf)
    got = {(r.feature1, r.feature2): r.rho for r in assoc.spearman_pairs(df, ["a", "b", "c"]).collect()}
    exp = pdf.corr(method="spearman")
    for (a, b), v in got.items():
        assert v == pytest.approx(exp.loc[a, b], abs=1e-12)


def test_pearson_constant_column_is_null_not_error(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (3.0, 5.0)], "x double, k double")
    r = assoc.pearson_pairs(df, ["x", "k"]).collect()[0]
    assert r.r is None


def test_nan_is_null(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (None,), (3.0,)], "x double")
    mp = profile.missing_counts(df).collect()[0]
    assert mp.missing_count == 2
    npf = profile.numeric_profile(df).collect()[0]
    assert npf.n == 2 and npf.mean == 2.0


def test_modified_z_with_zero_mad(spark):
    df = spark.createDataFrame([(1.0,), (1.0,), (1.0,), (1.0,), (9.0,)], "x double")
    r = outliers.outliers_modified_z(df, ["x"]).collect()[0]
    assert r.mad == 0 and r.n_outliers == 1


def test_empty_and_all_null_frames(spark):
    df = spark.createDataFrame([], "id long, x double, c string")
    assert profile.missing_counts(df).where("missing_count > 0").count() == 0
    nul = spark.createDataFrame([(None, None)] * 3, "x double, y double")
    mp = {r.column: r.missing_count for r in profile.missing_counts(nul).collect()}
    assert mp == {"x": 3, "y": 3}
    const = {r.column for r in profile.constant_columns(nul).collect()}
    assert const == {"x", "y"}


def test_skewness_kurtosis_population(spark):
    x = np.array([1.0, 2.0, 2.0, 3.0, 10.0, 11.0, 4.0])
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    r = profile.numeric_profile(df).collect()[0]
    m = x.mean()
    m2, m3, m4 = ((x - m) ** 2).mean(), ((x - m) ** 3).mean(), ((x - m) ** 4).mean()
    assert r.skewness == pytest.approx(round(m3 / m2 ** 1.5, 4), abs=1e-4)
    assert r.kurtosis == pytest.approx(round(m4 / m2 ** 2 - 3, 4), abs=1e-4)


def test_yates_two_by_two(spark):
    rows = [("a", "x")] * 10 + [("a", "y")] * 20 + [("b", "x")] * 30 + [("b", "y")] * 40
    df = spark.createDataFrame(rows, "a string, b string")
    r = stat_tests.chi_square(df, "a", "b").collect()[0]
    obs = np.array([[10, 20], [30, 40]], dtype=float)
    exp = obs.sum(1, keepdims=True) * obs.sum(0, keepdims=True) / obs.sum()
    diff = exp - obs
    corr = obs + np.sign(diff) * np.minimum(0.5, np.abs(diff))
    chi2 = ((corr - exp) ** 2 / exp).sum()
    assert r.chi2 == pytest.approx(round(chi2, 4), abs=1e-4)
    assert r.dof == 1
    assert r.p_value == pytest.approx(round(math.erfc(math.sqrt(chi2 / 2)), 6), abs=2e-6)


def test_tail_probabilities():
    assert stats.chi2_sf(3.841458820694124, 1) == pytest.approx(0.05, abs=1e-9)
    assert stats.chi2_sf(5.991464547107979, 2) == pytest.approx(0.05, abs=1e-9)
    assert stats.t_two_sided(2.2281388519649385, 10) == pytest.approx(0.05, abs=1e-9)
    assert stats.f_sf(4.964602743730711, 1, 10) == pytest.approx(0.05, abs=1e-8)
    assert stats.norm_cdf(1.959963984540054) == pytest.approx(0.975, abs=1e-12)


def test_kruskal_matches_formula(spark):
    g = ["a"] * 5 + ["b"] * 5 + ["c"] * 5
    x = [float(v) for v in [1, 2, 2, 3, 4, 5, 5, 6, 7, 8, 2, 9, 9, 10, 11]]
    df = spark.createDataFrame(list(zip(g, x)), "g string, x double")
    r = stat_tests.group_effect(df, "g", "x", method="kruskal").collect()[0]
    pdf = pd.DataFrame({"g": g, "x": x})
    rk = pdf.x.rank()
    n = len(x)
    h = 12 / (n * (n + 1)) * sum(rk[pdf.g == k].sum() ** 2 / (pdf.g == k).sum() for k in "abc") - 3 * (n + 1)
    t = pdf.x.value_counts()
    h /= 1 - ((t ** 3 - t).sum()) / (n ** 3 - n)
    assert r.statistic == pytest.approx(round(h, 4), abs=1e-4)


def test_rounding_is_binary_half_away(spark):
    s = spark
    from tablescope.functions.exprs import rnd
    v = s.createDataFrame([(0.00015,), (2.675,), (0.125,)], "x double").select(rnd(F.col("x"), 4).alias("a"),
                                                                             rnd(F.col("x"), 2).alias("b")).collect()
    assert [r.a for r in v] == [0.0001, 2.675, 0.125]
    # same as the oracle engine's round(x, 2): round(x * 100) / 100 on the binary value
    assert [r.b for r in v] == [0.0, round(2.675 * 100) / 100, 0.13]


def test_selected_quantiles_beyond_the_sketch(spark):
    """More values than the sketch keeps exactly, ties, nulls, a constant, an empty and an all-null column."""
    df = spark.range(60_000).select(
        (F.hash("id") % 100_003).cast("double").alias("a"), (F.col("id") % 7).cast("double").alias("b"),
        F.when(F.col("id") % 3 == 0, F.exp(F.col("id") / 4000.0)).alias("c"), F.lit(4.0).alias("d"),
        F.lit(None).cast("double").alias("e"))
    pdf = df.toPandas()
    probs = [0.0, 0.001, 0.25, 0.5, 0.9, 1.0]
    got = {(r.column, r.p): r.q for r in histogram.exact_quantiles(df, df.columns, probs).collect()}
    assert not [k for k in got if k[0] == "e"] and len(got) == 4 * len(probs)
    for c in "abcd":
        for p in probs:
            assert got[c, p] == pytest.approx(pdf[c].quantile(p), rel=1e-12)
    assert histogram.exact_quantiles(df.limit(0), ["a"], probs).count() == 0


def test_all_null_regression_target_has_a_row(spark):
    df = spark.createDataFrame([(None,)] * 3, "x double")
    r = profile.regression_target_profile(df, "x").collect()
    assert len(r) == 1 and r[0].n == 0 and r[0].median is None
