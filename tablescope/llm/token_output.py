"""Write the token ids of all documents in ascending identifier order, and read them back."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablescope.llm.common import byte_chunks, shuffle_partitions, staged, work_path
from tablescope.llm.simple8b import images, read_image
from tablescope.llm.tokens import Encoder, default_path

#: Ids of one image.
IMAGE_IDS = 1 << 18
END_ID = 0


def _encode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, serial = TaskContext.get().partitionId(), 0
        encoder = Encoder.of(path)
        end = np.array([END_ID], dtype="<u4")

        def rows():
            for b in byte_chunks(batches, "text", 4 << 20):
                ids, sizes = encoder.batch(b.column("text"))
                for doc, z, size in zip(b.column("doc_id").to_pylist(), np.cumsum(sizes).tolist(), sizes.tolist(), strict=True):
                    yield doc, np.concatenate([ids[z - size:z], end])

        for image, docs, n in images(rows(), IMAGE_IDS):
            yield pa.RecordBatch.from_pydict({"part": [part], "serial": [serial], "docs": [docs], "ids": [n], "image": [image]},
                                             schema=pa.schema([("part", pa.int32()), ("serial", pa.int64()), ("docs", pa.int64()),
                                                               ("ids", pa.int64()), ("image", pa.binary())]))
            serial += 1
    return run


def write_token_ids(df: DataFrame, path: str, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write shard images below ``path``: a table (part, serial, docs, ids, image) whose rows in order
    of part and serial hold the documents in ascending identifier order (null first; equal
    identifiers by text).  Null text is the empty text."""
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    keyed = docs.withColumn("h", F.xxhash64("text"))
    dealt = keyed.repartitionByRange(shuffle_partitions(df.sparkSession), "doc_id", "h").sortWithinPartitions("doc_id", "h", "text")
    (dealt.drop("h").mapInArrow(_encode(tokenizer or default_path()), "part int, serial long, docs long, ids long, image binary")
     .write.option("compression", "none").parquet(path))


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for base, image in zip(b.column("base").to_pylist(), b.column("image").to_pylist(), strict=True):
            ids, lengths, values = read_image(image)
            ends = np.cumsum(lengths)
            raw = values.astype("<u4").tobytes()
            crc = [zlib.crc32(raw[4 * (e - n):4 * e]) for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(base + ends - lengths, pa.int64()),
                                              pa.array(lengths, pa.int64()), pa.array(crc, pa.int64())],
                                             names=["doc_id", "start", "n_tokens", "ids_crc32"])


def read_token_ids(spark: SparkSession, path: str) -> DataFrame:
    """One row per document of the images below ``path``: doc_id, start, n_tokens, ids_crc32."""
    files = spark.read.schema("part int, serial long, docs long, ids long, image binary").parquet(path)
    sizes = files.select("part", "serial", "ids")
    # one row for each written partition, then the images inside a partition
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = sizes.groupBy("part").agg(F.sum("ids").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_base"))
    inside = Window.partitionBy("part").orderBy("serial").rowsBetween(Window.unboundedPreceding, -1)
    # written first: the join then knows its size, and broadcasts it instead of moving the images if it is small
    bases = staged(sizes.withColumn("inner_base", F.coalesce(F.sum("ids").over(inside), F.lit(0))).join(parts, "part")
                   .select("part", "serial", (F.col("part_base") + F.col("inner_base")).alias("base")), "token-bases")
    return (files.select("part", "serial", "image").join(bases, ["part", "serial"]).select("base", "image")
            .mapInArrow(_read, "doc_id long, start long, n_tokens long, ids_crc32 long"))


def token_round_trip(df: DataFrame, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write below the shared checkpoint folder, then read.  An empty table gives no rows; other
    columns are not read; rows that repeat an identifier are separate documents."""
    path = work_path(df.sparkSession, "token-ids")
    write_token_ids(df, path, tokenizer, id_col, text_col)
    return read_token_ids(df.sparkSession, path)
