"""Sources and sinks: CSV (auto-detected encoding / delimiter), parquet, and the report
writers.  Writers use Spark's distributed writers (one file per task); nothing is
collected to the driver."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablescope.functions.constants import CSV_DELIMITERS, CSV_ENCODINGS
from tablescope.functions.exprs import with_scalars
from tablescope.sources.csv_records import LINE_ENCODINGS, read_csv_records


def read_csv(spark: SparkSession, path: str, sep: str = ",", encoding: str = "utf-8",
             infer_schema: bool = True, multi_line: bool = True) -> DataFrame:
    """Header CSV with inferred types; a doubled quote stands for a quote.

    With ``multi_line`` quoted fields may hold line breaks: the borders of records are found in parallel
    (``csv_records``) for the encodings of ``LINE_ENCODINGS``, at the price of writing the records once;
    other encodings take Spark's reader, one task per file.  Without it lines are records.
    """
    if multi_line and encoding.lower() in LINE_ENCODINGS:
        return read_csv_records(spark, path, sep, encoding, infer_schema)
    return (spark.read.option("header", True).option("sep", sep).option("encoding", encoding)
            .option("quote", '"').option("escape", '"').option("multiLine", multi_line)
            .option("inferSchema", infer_schema).option("mode", "PERMISSIVE").csv(path))


def _lines(spark: SparkSession, path: str, encoding: str) -> DataFrame:
    """One row per line (``line``), decoded with ``encoding``, quotes and separators untouched."""
    # the CSV reader honours ``encoding`` (the text reader is UTF-8 only); a separator and
    # quote that never occur turn each line into one column
    return (spark.read.option("encoding", encoding).option("sep", "\u0001").option("quote", "\u0000")
            .option("header", False).schema("line string").csv(path))


def _delimiter(lines: DataFrame) -> str:
    """The delimiter most frequent outside quotes, over all lines; ',' when none occurs."""
    bare = F.regexp_replace("line", '"[^"]*"', "")
    counts = lines.agg(*[F.coalesce(F.sum(F.length(bare) - F.length(F.replace(bare, F.lit(d), F.lit("")))), F.lit(0))
                         .alias(f"d{i}") for i, d in enumerate(CSV_DELIMITERS)]).first()
    best = max(range(len(CSV_DELIMITERS)), key=lambda i: (counts[i], -i))
    return CSV_DELIMITERS[best] if counts[best] else CSV_DELIMITERS[0]


def read_csv_auto(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Try encodings utf-8, latin1, iso-8859-1 and delimiters ',', ';', TAB.

    Both are decided over the whole file: the first encoding under which no line holds a replacement
    character, and the delimiter found most often outside quotes.  Raises ValueError if nothing parses.
    """
    # latin1 and iso-8859-1 are two names of one encoding; Spark knows the second
    for enc in dict.fromkeys("iso-8859-1" if e == "latin1" else e for e in CSV_ENCODINGS):
        lines = _lines(spark, path, enc)
        n, broken = lines.agg(F.count(F.lit(1)), F.count_if(F.col("line").contains("\ufffd"))).first()
        if n and not broken:
            return read_csv(spark, path, _delimiter(lines), enc, multi_line=multi_line)
    raise ValueError(f"could not parse {path} with encodings {CSV_ENCODINGS} and delimiters {CSV_DELIMITERS}")


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """Parquet input (columnar, filter and projection pushdown)."""
    return spark.read.parquet(path)


def preview(df: DataFrame, n: int = 5) -> tuple[DataFrame, DataFrame]:
    """(first n rows, one-row shape) — the head is a limit, the shape one count."""
    shape = df.agg(F.count(F.lit(1)).cast("long").alias("rows")).withColumn("columns", F.lit(len(df.columns)))
    return df.limit(n), shape


def _write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    df.write.mode(mode).option("header", True).option("escape", '"').csv(path)
    return path


def write_quality_csv(df: DataFrame, path: str) -> DataFrame:
    """Tall quality export: Assessment_Type, Column, Issue_Count, Issue_Percentage,
    Severity, Data_Type, Details — from the missing, zero, outlier and cardinality profiles."""
    from tablescope.operators.missing import missing_profile
    from tablescope.operators.outliers import outlier_report
    from tablescope.operators.profile import cardinality_profile, zero_values
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    tmap = F.create_map(*[x for k, v in types.items() for x in (F.lit(k), F.lit(v))])
    parts = [
        missing_profile(df).where(F.col("missing_count") > 0).select(
            F.lit("Missing Values").alias("Assessment_Type"), F.col("column").alias("Column"),
            F.col("missing_count").alias("Issue_Count"), F.col("missing_pct").alias("Issue_Percentage"),
            F.col("severity").alias("Severity"), F.lit("missing cells").alias("Details")),
        zero_values(df).select(
            F.lit("Zero Values").alias("Assessment_Type"), F.col("column").alias("Column"),
            F.col("zero_count").alias("Issue_Count"), F.col("zero_pct").alias("Issue_Percentage"),
            F.col("severity").alias("Severity"), F.lit("zero values").alias("Details")),
        outlier_report(df).select(
            F.lit("Outliers").alias("Assessment_Type"), F.col("column").alias("Column"),
            F.col("n_outliers").alias("Issue_Count"), F.col("pct").alias("Issue_Percentage"),
            F.col("severity").alias("Severity"),
            F.concat(F.lit("IQR bounds "), F.col("lower").cast("string"), F.lit(" .. "), F.col("upper").cast("string"))
            .alias("Details")),
        cardinality_profile(df).select(
            F.lit("Cardinality").alias("Assessment_Type"), F.col("column").alias("Column"),
            F.col("unique_count").alias("Issue_Count"), F.col("unique_pct").alias("Issue_Percentage"),
            F.col("cardinality").alias("Severity"), F.lit("distinct values").alias("Details")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    out = out.withColumn("Data_Type", tmap[F.col("Column")])
    _write_csv(out, path)
    return out


def write_contingency_csv(df: DataFrame, a: str, b: str, path: str) -> DataFrame:
    from tablescope.operators.stat_tests import contingency
    out = contingency(df, a, b)
    _write_csv(out, path)
    return out


def write_clustered_csv(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str], k: int,
                        path: str) -> DataFrame:
    """Input rows (after imputation) with their ``Cluster`` label, as CSV."""
    from tablescope.operators.segment import kmeans
    out = kmeans(df, numeric, categorical, k).withColumnRenamed("cluster", "Cluster")
    _write_csv(out, path)
    return out


def findings_document(results: dict[str, DataFrame], dataset_name: str = "dataset") -> DataFrame:
    """(place, item, text): the pieces of one JSON document, in the order of (place, item).

    Metadata first (data set, time, names of the results), then each result as an array of its rows, fields
    that are null included, ordered by their text."""
    spark = next(iter(results.values())).sparkSession
    meta = F.to_json(F.struct(F.lit(dataset_name).alias("dataset"), F.current_timestamp().alias("generated_at"),
                              F.array(*[F.lit(n) for n in results]).alias("results")))
    pieces = spark.range(1).select(F.lit(-1).alias("place"), F.lit("").alias("item"),
                                   F.concat(F.lit('{"metadata": '), meta, F.lit(',\n"results": {')).alias("text"))
    marks = []
    for i, (name, frame) in enumerate(results.items()):
        marks += [(3 * i, "", (",\n" if i else "") + json.dumps(name) + ": ["), (3 * i + 2, "", "]")]
        rows = frame.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("item"))
        rows = rows.groupBy("item").agg(F.count(F.lit(1)).cast("int").alias("n"))
        comma = F.when(F.col("item") == F.col("first"), "").otherwise(",\n")
        pieces = pieces.unionAll(with_scalars(rows, rows.agg(F.min("item").alias("first"))).select(
            F.lit(3 * i + 1).alias("place"), "item",
            F.concat(comma, F.array_join(F.array_repeat("item", F.col("n")), ",\n")).alias("text")))
    marks.append((3 * len(results), "", "}}"))
    return pieces.unionAll(spark.createDataFrame(marks, "place int, item string, text string"))


def write_findings_json(results: dict[str, DataFrame], path: str, dataset_name: str = "dataset") -> None:
    """One JSON document of all results, the only file below ``path``; the sort that orders it spills."""
    document = findings_document(results, dataset_name).orderBy("place", "item").select("text")
    document.coalesce(1).write.mode("overwrite").text(path)


def write_key_findings_csv(findings: DataFrame, path: str) -> DataFrame:
    """Priority, Category, Insight, Action Needed."""
    out = findings.select(F.col("priority").alias("Priority"), F.col("category").alias("Category"),
                          F.col("rule").alias("Insight"),
                          F.when(F.col("action_needed"), "Yes").otherwise("No").alias("Action Needed"))
    _write_csv(out, path)
    return out
