"""No caps, pruned scans, and arithmetic at the counts of very large tables."""

import pytest
from pyspark.sql import functions as F

from tablescope.operators import assoc, charts, profile
from tablescope.plans.inputs import table

from .conftest import SF_SMALL


def test_count_by_target_has_every_target(spark):
    df = spark.range(210).select((F.col("id") % 3).cast("string").alias("c"), (F.col("id") % 21).cast("string").alias("t"))
    assert charts.count_by_target(df, "c", "t").agg(F.sum("n")).first()[0] == 210


def test_stacked_counts_has_every_cell(spark):
    df = spark.range(256).select((F.col("id") % 16).cast("string").alias("a"), F.floor(F.col("id") / 16).cast("string").alias("b"))
    assert charts.stacked_counts(df, "a", "b").count() == 256


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(f"c{i:03d}", f"c{i + 1:03d}") for i in range(70)], "a string, b string")
    got = assoc._components(edges).collect()
    assert len(got) == 71 and {r.component for r in got} == {"c000"}


@pytest.mark.parametrize("make", [lambda d: charts.histogram(d, "l_quantity"),
                                  lambda d: charts.density_2d(d, "l_quantity", "l_tax")])
def test_scans_are_pruned(spark, make):
    plan = make(table(spark, SF_SMALL, "lineitem"))._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema" in plan and "l_orderkey" not in plan.split("ReadSchema", 1)[1]


def test_map_columns_do_not_break_charts(spark):
    df = spark.range(10).select(F.col("id").cast("double").alias("x"), F.create_map(F.lit("k"), F.col("id")).alias("m"))
    assert charts.histogram(df, "x", bins=5).agg(F.sum("count")).first()[0] == 10


def test_bins_are_honoured(spark):
    df = spark.range(1000).select(F.col("id").cast("double").alias("x"))
    assert charts.histogram(df, "x", bins=150).count() == 150
    with pytest.raises(ValueError):
        charts.histogram(df, "x", bins=0)


def test_class_distribution_of_one_class(spark):
    r = profile.class_distribution(spark.range(9).select(F.lit("a").alias("t")), "t").first()
    assert (r.n_classes, r.n, r.gini) == (1, 9, 0.0)
