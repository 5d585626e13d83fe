"""Corpus pipeline: language, exact and near duplicates, mixture, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read
again as the next stage's documents.  All but the last keep the columns of ``documents``.
"""

from __future__ import annotations

import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tablescope.llm.common import fold_ascii, table, work_path  # noqa: E402
from tablescope.llm.exact_dedup import exact_dedup  # noqa: E402
from tablescope.llm.language_crf import UNDETERMINED, fit_model, predict  # noqa: E402
from tablescope.llm.packing import pack  # noqa: E402
from tablescope.llm.queries import mix_documents  # noqa: E402
from tablescope.llm.simhash import simhash_dedup  # noqa: E402


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a recognisable language go; the others keep their columns as they are, whatever
    their names."""
    plain = docs.toDF(*(f"__c{i}" for i in range(len(docs.columns))))
    kept = predict(plain, fit_model(docs), f"__c{docs.columns.index('text')}").where(F.col("lang_pred") != UNDETERMINED)
    return kept.select(*(F.col(c).alias(name) for c, name in zip(plain.columns, docs.columns, strict=True)))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts that of the largest identifier stays, once."""
    stays = exact_dedup(docs, keep="largest").where("kept").select(F.col("doc_id").alias("__id"), F.unhex("text_sha256").alias("__sha"))
    keyed = docs.withColumn("__sha2", F.unhex(F.sha2(fold_ascii(F.col("text")).cast("binary"), 256)))
    return (keyed.join(stays, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__sha") == F.col("__sha2")), "left_semi")
            .dropDuplicates(["doc_id", "__sha2"]).drop("__sha2"))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of a group of near duplicates the document of the smallest identifier stays (null last; of one
    identifier's texts that of the smallest hash), once."""
    marks = {"__near_null": F.col("doc_id").isNull(), "__near_id": F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), "__near_hash": F.xxhash64("text")}
    keyed = docs.withColumns(marks)
    # a group by its fingerprint: identifiers may repeat in several groups
    first = (simhash_dedup(keyed, shingle=3, radius=2, carry=tuple(marks)).groupBy("root")
             .agg(F.min(F.struct(*marks)).alias("k")).select("k.*"))
    return keyed.join(first, list(marks), "left_semi").dropDuplicates(list(marks)).drop(*marks)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the target weights take it."""
    return mix_documents(docs, rows=True)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training windows of 1024 tokens: one row per piece."""
    return pack(docs, window=1024)


STAGES = [
    ("language_id", language_stage),
    ("exact_dedup", exact_stage),
    ("simhash_near_dedup", near_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: Learned labels, fingerprints and token ids cannot be said in SQL: see tests/llm/test_pipeline.py.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared checkpoint folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = work_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
