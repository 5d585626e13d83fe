"""Quantiles of groups, one of which holds nine tenths of the rows, against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablescope.operators import charts, histogram, outliers


def _rows(seed=3):
    rng = np.random.default_rng(seed)
    rows = [("hot", float(x)) for x in rng.normal(size=9000).round(3)]
    rows += [("hot", 7.25)] * 500
    for g in range(30):
        rows += [(f"g{g}", float(x)) for x in rng.integers(0, 40, size=int(rng.integers(1, 40)))]
    rows += [(None, 5.0), (None, 6.0), ("empty", None)]
    return rows


@pytest.fixture
def frame(spark):
    return spark.createDataFrame(_rows(), "g string, x double").repartition(8)


@pytest.mark.parametrize("hot_values", [10 ** 9, 100, 10])
def test_quantiles_of_groups_equal_numpy(frame, hot_values):
    probs = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    hist = histogram.numeric_histogram(frame, ["x"], keys=["g"]).where(F.col("g").isNotNull())
    hot = histogram.hot_groups(hist, ["g", "column"], hot_values)
    # at 10 the bound is a two-hundredth of all distinct values, which small groups pass too
    n_hot = hot.count()
    assert n_hot == {10 ** 9: 0, 100: 1}.get(hot_values, n_hot) and (hot_values > 10 or 1 < n_hot < histogram.HOT_GROUPS)
    got = {(r.g, r.p): r.q for r in histogram.grouped_quantiles(hist, ["g", "column"], probs, hot).collect()}
    values = {}
    for g, x in _rows():
        if g is not None and x is not None:
            values.setdefault(g, []).append(x)
    assert len(got) == len(values) * len(probs)
    for g, xs in values.items():
        for p in probs:
            assert got[g, p] == pytest.approx(np.quantile(xs, p), abs=1e-12)


def test_hot_group_is_ranked_in_cells_only(frame):
    hist = histogram.numeric_histogram(frame, ["x"], keys=["g"])
    hot = histogram.hot_groups(hist, ["g", "column"], 100)
    ranked = histogram.grouped_ranks(hist, ["g", "column"], [0.25, 0.75], hot)
    whole = hist.where("g = 'hot'").count()
    assert 0 < ranked.where("g = 'hot'").count() < whole / 50


def test_joined_groups_keep_every_row(frame):
    hist = histogram.numeric_histogram(frame.where("g is not null"), ["x"], keys=["g"])
    groups = hist.groupBy("g", "column").agg(F.max("value").alias("top"))
    hot = histogram.hot_groups(hist, ["g", "column"], 100)
    joined = histogram.join_groups(hist, groups, ["g", "column"], hot)
    assert joined.count() == hist.count() and joined.where("value > top").count() == 0


def test_outliers_and_boxes_do_not_depend_on_what_is_hot(frame, monkeypatch):
    def both():
        return (sorted(map(str, outliers.outliers_by_group(frame, "g", "x").collect())),
                sorted(map(str, charts.box_stats(frame, "x", "g").collect())), charts.box_stats(frame, "x").collect())
    plain = both()
    monkeypatch.setattr(histogram, "HOT_VALUES", 50)
    assert both() == plain
    persisted = frame.sparkSession.sparkContext._jsc.getPersistentRDDs().size()
    charts.box_stats(frame, "x", "g").count()
    assert frame.sparkSession.sparkContext._jsc.getPersistentRDDs().size() == persisted
