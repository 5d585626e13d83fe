"""CSV records across splits, the JSON document, and the written reports read back."""

import csv
import io as pyio
import json
import random

import pytest
from pyspark.sql import functions as F

from tablescope.sources import csv_records, io


def _spark_reader(spark, path, sep=","):
    return (spark.read.option("header", True).option("sep", sep).option("quote", '"').option("escape", '"')
            .option("multiLine", True).option("inferSchema", True).csv(path))


def _rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture
def small_splits(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def _table(n, seed):
    rng = random.Random(seed)
    texts = ["plain", 'says ""', 'a "quoted" word', "two\nlines", 'tail quote"', "\n\nblank lines\n", "a,b", '"\n"', "é"]
    out = pyio.StringIO()
    w = csv.writer(out, lineterminator="\n")
    w.writerow(["id", "text", "amount"])
    for i in range(n):
        text = "long\n" * 1500 + 'end "here"' if i == n // 2 else "".join(rng.choice(texts) for _ in range(rng.randint(1, 6)))
        w.writerow([i, text, rng.choice(["1.5", "2", ""])])
    return out.getvalue()


def test_records_across_splits_equal_sparks_reader(spark, tmp_path, small_splits):
    (tmp_path / "a").mkdir()
    for i in range(2):
        (tmp_path / "a" / f"{i}.csv").write_text(_table(400, i), encoding="utf-8")
    path = str(tmp_path / "a")
    records = csv_records.csv_records(spark, path)
    assert spark.read.text(path).rdd.getNumPartitions() > 5
    assert records.where("header").count() == 2
    got, want = io.read_csv(spark, path), _spark_reader(spark, path)
    assert [(f.name, f.dataType) for f in got.schema] == [(f.name, f.dataType) for f in want.schema]
    assert got.count() == 800 and _rows(got) == _rows(want)


def test_bare_quotes_do_not_open_a_field(spark, tmp_path):
    p = tmp_path / "bare.csv"
    p.write_text('a,b,c\n1,5" pipe,x\n2,y"z,"q\nr"\n3,"s",t\n')
    assert _rows(io.read_csv(spark, str(p))) == [(1, '5" pipe', "x"), (2, 'y"z', "q\nr"), (3, "s", "t")]


def test_carriage_returns_blank_lines_and_ragged_rows(spark, tmp_path):
    p = tmp_path / "r.csv"
    p.write_bytes(b'\r\na,b\r\n1,"x\r\ny"\r\n\r\n2\r\n3,z,extra\r\n')
    assert _rows(io.read_csv(spark, str(p))) == [(1, "x\r\ny"), (2, None), (3, "z")]


def test_header_alone_and_a_quote_never_closed(spark, tmp_path):
    p = tmp_path / "h.csv"
    p.write_text("a,b\n")
    got = io.read_csv(spark, str(p))
    assert got.columns == ["a", "b"] and got.count() == 0
    p2 = tmp_path / "open.csv"
    p2.write_text('a,b\n1,"x\ny\n')
    assert io.read_csv(spark, str(p2)).count() == 1


def test_windows_follow_the_rule(spark):
    rng = random.Random(5)
    rows = [(k, i, rng.choice([0, 1, 1, 2, 3])) for k in range(6) for i in range(30)]
    df = csv_records._states_before(spark.createDataFrame(rows, "k int, i int, f int"), ["k"], "i")
    seen = {(r.k, r.i): (r.from_outside, r.from_inside) for r in df.collect()}
    for k in range(6):
        a, b = 0, 1
        for kk, i, f in rows:
            if kk == k:
                assert seen[k, i] == (a, b)
                a, b = (f % 2 if a == 0 else f // 2), (f % 2 if b == 0 else f // 2)


def test_findings_json_is_one_document(spark, tmp_path):
    one = spark.createDataFrame([("x", 1.5, None), ("x", 1.5, None), ('q"\n', None, 2)], "a string, b double, c int")
    path = str(tmp_path / "doc")
    io.write_findings_json({"one": one, "none": one.where(F.lit(False)), "two": one.limit(1)}, path, "orders")
    files = list((tmp_path / "doc").glob("part-*"))
    assert len(files) == 1
    doc = json.loads(files[0].read_text())
    assert list(doc) == ["metadata", "results"] and doc["metadata"]["dataset"] == "orders"
    assert doc["metadata"]["results"] == ["one", "none", "two"]
    rows = sorted(((r["a"], r["b"], r["c"]) for r in doc["results"]["one"]), key=repr)
    assert rows == sorted([("x", 1.5, None), ("x", 1.5, None), ('q"\n', None, 2)], key=repr)
    assert doc["results"]["none"] == [] and len(doc["results"]["two"]) == 1
