"""CSV records of large files with line breaks inside quotes, found in parallel.

A file is read as lines, in as many splits as Spark makes of it.  What a line does to the state "inside
quotes" is a function of two states (it depends on the state it starts in); functions compose, so a prefix
over the lines of a split and one over the splits of a file (a row each) give the state at every line, and
with it the borders of records.  Only records of several lines are grouped.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablescope.session import staged

# Encodings in which a line feed, a quote and a separator are single bytes of their own.
LINE_ENCODINGS = {"utf-8": None, "utf8": None, "us-ascii": None, "iso-8859-1": "ISO-8859-1", "latin1": "ISO-8859-1"}
OUTSIDE, INSIDE = 0, 1
# A function of the two states is (image of outside) + 2 * (image of inside).
ALL_OUTSIDE, SWAP, IDENTITY, ALL_INSIDE = 0, 1, 2, 3


def _line_function(line: Column, sep: str) -> Column:
    """What a line does to the state.  A quote opens a field only as its first character; within quotes an
    odd number of quotes up to the next separator closes it (doubled quotes stand for themselves)."""
    def step(f, field):
        odd = (F.length(field) - F.length(F.replace(field, F.lit('"'), F.lit("")))) % 2
        opened = F.when(field.startswith('"'), odd).otherwise(OUTSIDE)
        kept = 1 - odd
        return (F.when(f % 2 == OUTSIDE, opened).otherwise(kept)
                + 2 * F.when(f < 2, opened).otherwise(kept)).cast("int")

    fields = F.split(line, re.escape(sep), -1)
    return F.when(F.instr(line, '"') == 0, F.lit(IDENTITY)).otherwise(F.aggregate(fields, F.lit(IDENTITY), step))


def _apply(f: Column, state: Column) -> Column:
    return F.when(state == OUTSIDE, f % 2).otherwise(F.floor(f / 2)).cast("int")


def _states_before(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Add ``from_outside`` / ``from_inside``: the state before each row of a key, by the state at its first row."""
    earlier = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    f = F.col("f")
    swaps = F.coalesce(F.sum((f == SWAP).cast("long")).over(earlier), F.lit(0))
    fixed = F.when(f.isin(ALL_OUTSIDE, ALL_INSIDE), F.struct((f == ALL_INSIDE).cast("long").alias("state"),
                                                             F.col("__swaps").alias("swaps")))
    df = df.withColumn("__swaps", swaps).withColumn("__fixed", F.last(fixed, ignorenulls=True).over(earlier))
    settled = F.pmod(F.col("__fixed.state") + F.col("__swaps") - F.col("__fixed.swaps"), F.lit(2))
    for name, state in (("from_outside", OUTSIDE), ("from_inside", INSIDE)):
        df = df.withColumn(name, F.coalesce(settled, (state + F.col("__swaps")) % 2).cast("int"))
    return df.drop("__swaps", "__fixed")


def _staged_lines(spark: SparkSession, path: str, sep: str, encoding: str) -> DataFrame:
    """(file, block, id, line, f): written once, so that the order of lines cannot change between two reads."""
    charset = LINE_ENCODINGS[encoding.lower()]
    line = F.col("value") if charset is None else F.decode(F.col("value").cast("binary"), charset)
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("id"), line.alias("line"))
    return staged(lines.withColumn("f", _line_function(F.col("line"), sep)), "csv-lines")


def csv_records(spark: SparkSession, path: str, sep: str = ",", encoding: str = "utf-8") -> DataFrame:
    """(file, header, record): the records of CSV files as text, line breaks included; empty ones are left out.

    ``header`` marks the first record of a file that is not empty.  Lines end in LF or CR LF."""
    lines = _states_before(_staged_lines(spark, path, sep, encoding), ["file", "block"], "id")
    f, out, ins = F.col("f"), F.col("from_outside"), F.col("from_inside")
    blocks = lines.groupBy("file", "block").agg(
        (F.max_by(_apply(f, out), "id") + 2 * F.max_by(_apply(f, ins), "id")).cast("int").alias("f"),
        F.max(F.when(out == OUTSIDE, F.col("id"))).alias("start_out"),
        F.max(F.when(ins == OUTSIDE, F.col("id"))).alias("start_in"),
        F.min(F.when(~F.col("line").isin("", "\r"), F.col("id"))).alias("text_id"))
    in_file = Window.partitionBy("file").orderBy("block")
    before = in_file.rowsBetween(Window.unboundedPreceding, -1)
    blocks = _states_before(blocks, ["file"], "block").withColumn("at_start", out)
    blocks = blocks.select(
        "file", "block", "at_start",
        F.last(F.when(F.col("at_start") == OUTSIDE, F.col("start_out")).otherwise(F.col("start_in")),
               ignorenulls=True).over(before).alias("open_record"),
        F.when(F.count("text_id").over(before) == 0, F.col("text_id")).alias("header_id"))

    lines = lines.join(blocks, ["file", "block"]).withColumn(
        "state", F.when(F.col("at_start") == OUTSIDE, out).otherwise(ins))
    so_far = Window.partitionBy("file", "block").orderBy("id").rowsBetween(Window.unboundedPreceding, 0)
    starts = F.last(F.when(F.col("state") == OUTSIDE, F.col("id")), ignorenulls=True).over(so_far)
    lines = lines.withColumn("record_id", F.coalesce(starts, F.col("open_record")))
    whole = (F.col("state") == OUTSIDE) & (_apply(f, F.col("state")) == OUTSIDE)
    header = F.coalesce(F.col("id") == F.col("header_id"), F.lit(False))
    single = lines.where(whole).select("file", header.alias("header"), F.col("line").alias("record"))
    parts = F.array_sort(F.collect_list(F.struct("block", "id", "line")))
    several = lines.where(~whole).groupBy("file", "record_id").agg(F.max(header).alias("header"), parts.alias("parts")).select(
        "file", "header", F.array_join(F.transform("parts", lambda p: p["line"]), "\n").alias("record"))
    record = F.regexp_replace("record", "\r\\z", "")
    return single.unionByName(several).withColumn("record", record).where(F.col("record") != "")


def _inferred(records: DataFrame, n: int, options: dict) -> list[T.DataType]:
    """Types of the fields as Spark's CSV reader infers them from all records."""
    spark = records.sparkSession
    # a header of names that no record holds: the reader drops lines equal to its header
    mark = uuid.uuid4().hex
    head = spark.range(1).select(F.lit(options["sep"].join(f"{mark}{i}" for i in range(n))).alias("record"))
    texts = getattr(head.unionAll(records.select("record"))._jdf, "as")(spark._jvm.org.apache.spark.sql.Encoders.STRING())
    reader = spark.read.options(**options).option("header", True).option("inferSchema", True)
    return [f.dataType for f in reader._df(reader._jreader.csv(texts)).schema.fields]


def read_csv_records(spark: SparkSession, path: str, sep: str, encoding: str, infer_schema: bool = True) -> DataFrame:
    """Header CSV whose quoted fields may hold line breaks, read by as many tasks as the files have splits.

    Column names are those of the first file's header, types Spark's own inference over all records."""
    options = {"sep": sep, "quote": '"', "escape": '"', "multiLine": "true", "mode": "PERMISSIVE"}
    names = spark.read.options(**options).option("header", True).option("encoding", encoding).csv(path).columns
    records = csv_records(spark, path, sep, encoding).where(~F.col("header"))
    records = staged(records.select("record"), "csv-records")
    types = _inferred(records, len(names), options) if infer_schema else [T.StringType()] * len(names)
    inner = T.StructType([T.StructField(f"c{i}", t) for i, t in enumerate(types)])
    row = F.from_csv("record", inner.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " "), options)
    return records.select(row.alias("r")).select(*[F.col(f"r.c{i}").alias(name) for i, name in enumerate(names)])
