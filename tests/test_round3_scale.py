"""Work and traffic of the operators that grew faster than their tables."""

from pyspark.sql import functions as F

from tablescope.operators import assoc, histogram, segment, types


def test_features_of_a_fit_carry_none_of_the_steps_that_made_them(spark):
    df = spark.range(400).select(F.rand(1).alias("x"), F.rand(2).alias("y"), (F.col("id") % 3).cast("string").alias("g"))
    wide = df.repartition(40).join(df.groupBy("g").agg(F.avg("x").alias("m")), "g")
    vec = segment._features(wide, ["x", "y", "m"], ["g"])[0]
    held = segment._held(vec)
    plan = held._jdf.queryExecution().optimizedPlan().toString() + held._jdf.queryExecution().analyzed().toString()
    assert "Join" not in plan and "Aggregate" not in plan
    assert held.count() == 400 and held.rdd.getNumPartitions() < 40
    held.unpersist()


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_text_is_parsed_once_for_each_distinct_value(spark):
    df = spark.createDataFrame([("1",), ("1",), ("2024-01-02",), ("x",), (None,)], "s string")
    stats = types.column_stats(df)
    assert "gettimestamp(value" in _plan(stats) and "gettimestamp(s" not in _plan(stats)
    row = stats.first()
    assert (row.non_null, row.numeric_ok, row.date_ok, row["rows"]) == (4, 2, 1, 5)
    empty = types.column_stats(spark.createDataFrame([(None, 1)], "s string, n int")).orderBy("position").collect()
    assert [(r.numeric_ok, r.date_ok) for r in empty] == [(0, 0), (None, None)]


def test_many_pairs_are_products_of_blocks(spark):
    df = spark.range(50).select(*[(F.col("id") * (i + 1) % 7).cast("double").alias(f"c{i}") for i in range(8)])
    assert "MapInArrow" in _plan(assoc.pearson_pairs(df))


def test_columns_are_counted_in_their_type(spark, monkeypatch):
    df = spark.createDataFrame([(0.0, 1, "a"), (-0.0, 1, "b"), (2.5, 2, "a"), (None, None, None)], "x double, n int, s string")
    want = {("x", "0.0", 2), ("x", "2.5", 1), ("x", None, 1), ("n", "1", 2), ("n", "2", 1), ("n", None, 1),
            ("s", "a", 2), ("s", "b", 1), ("s", None, 1)}
    hist = histogram.value_histogram(df)
    assert {tuple(r) for r in hist.collect()} == want and "Generate" not in _plan(hist)
    monkeypatch.setattr(histogram, "HISTOGRAM_COLUMNS", 1)
    assert {tuple(r) for r in histogram.value_histogram(df).collect()} == want


def test_quantiles_of_groups_read_the_table_once(spark, tmp_path):
    from tablescope.operators import charts, outliers
    path = str(tmp_path / "t")
    spark.range(300).select((F.col("id") % 3).cast("string").alias("g"), F.col("id").cast("double").alias("x")).write.parquet(path)
    df = spark.read.parquet(path)
    for out in (outliers.outliers_by_group(df, "g", "x"), charts.box_stats(df, "x", "g")):
        assert not [f for f in out.inputFiles() if "/t/" in f] and out.count() == 3
    med = {r.category: r["median"] for r in charts.bar_aggregate(df, "g", "x", "median").collect()}
    assert med == {"0": 148.5, "1": 149.5, "2": 150.5}


def test_report_sections_are_written_one_after_another(spark):
    from tablescope.plans.reports import Report
    base = spark.range(4).persist()
    report = Report(base)
    report["a"] = base.selectExpr("id", "nullif(id, 2) AS x")
    report["b"] = base.selectExpr("id + 1 AS y").where("id > 1")
    out = report.written()
    assert {f.split("/")[-2] for f in out.inputFiles()} == {"0", "1"} and not base.is_cached
    rows = sorted(tuple(r) for r in out.collect())
    assert len(rows) == 6 and rows[2] == (0, "a", '{"id":2,"x":null}') and rows[4] == (1, "b", '{"y":3}')


def test_patterns_are_matched_once_for_each_distinct_value(spark):
    from tablescope.operators import quality
    rows = [(" a", None), ("A", None), ("a", None), ("a", None), ("x,y;z", None), ("null", None), (None, None)]
    df = spark.createDataFrame(rows, "s string, t string")
    out = quality.format_checks(df)
    assert "RLIKE(value" in _plan(out).replace(" ", "") and "RLIKE(s" not in _plan(out).replace(" ", "")
    got = {r.column: tuple(r)[1:] for r in out.collect()}
    assert got == {"s": (6, 1, 1, 1, True, 0, 1, False), "t": (0, 0, 0, 0, False, 0, 0, False)}
    none = quality.format_checks(df.where("false")).collect()
    assert sorted(tuple(r)[:3] for r in none) == [("s", 0, 0), ("t", 0, 0)]


def test_extremes_of_distinct_values_are_not_sorted(spark):
    df = spark.createDataFrame([(0.0, 10, " b", None), (-0.0, 9, "a", None), (1.0, 9, "a ", None), (None, 10, None, None)],
                               "x double, n int, s string, e string")
    out = types.distinct_stats(df)
    assert {tuple(r) for r in out.collect()} == {("x", 2, "0.0", "1.0"), ("n", 2, "10", "9"), ("s", 3, "a", "b")}
    assert "Sort " not in out._jdf.queryExecution().executedPlan().toString()
    kinds = {r.column: r.semantic_type for r in types.typed_columns(df).collect()}
    assert kinds == {"x": "boolean", "n": "numeric", "s": "categorical", "e": "empty"}


def test_constant_columns_shuffle_no_values(spark):
    from tablescope.operators import profile
    df = spark.sql("""SELECT * FROM VALUES (0.0D, -0.0D, 1, ' a', CAST(NULL AS STRING), TIMESTAMP'2024-01-02 03:04:05', DOUBLE('NaN')),
                      (-0.0D, -0.0D, 2, ' a', NULL, TIMESTAMP'2024-01-02 03:04:05', 3.5D), (NULL, 0.0D, 2, ' a', NULL, NULL, DOUBLE('NaN'))
                      t(x, y, n, s, e, t, f)""")
    out = profile.constant_columns(df)
    assert [tuple(r) for r in out.collect()] == [("e", "string", None), ("f", "double", "3.5"), ("s", "string", " a"),
                                                 ("t", "timestamp", "2024-01-02 03:04:05"), ("x", "double", "0.0"), ("y", "double", "0.0")]
    assert "hashpartitioning" not in out._jdf.queryExecution().executedPlan().toString()
    assert profile.constant_columns(df.where("false")).count() == 7
