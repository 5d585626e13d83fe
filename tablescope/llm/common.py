"""Helpers shared by the operators of this folder."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablescope.session import ensure_checkpoint_dir

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    """Partitions that the operator of the cluster has chosen for the size of the data."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def work_path(spark: SparkSession, name: str) -> str:
    """A new folder below the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back: cuts the lineage in
    storage that survives the loss of any executor."""
    path = work_path(df.sparkSession, name)
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fold_ascii(col: Column) -> Column:
    """Lower-case A-Z and nothing else; null counts as empty."""
    return F.coalesce(F.translate(col, UPPER, UPPER.lower()), F.lit(""))


def crc_mod(id_col: str, folds: int) -> Column:
    """crc32 of the identifier as text, modulo ``folds``; null counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds


def labelled_sample(texts: DataFrame, hashed: DataFrame, max_texts: int) -> list[tuple[str, object]]:
    """At most ``max_texts`` distinct texts of each label (those of the smallest hashes, however rare the
    label is), with the label, ordered by hash.  ``texts``: __id, __text, __h (a hash of the text);
    ``hashed``: __id, __h, __label.  Only hashes are shuffled before the sample is known."""
    # hashes lie evenly: below this share of their range a label has max_texts of them and some to
    # spare, or all that it has; nothing else is shuffled
    share = (F.lit(1.25) * max_texts + 200) / F.approx_count_distinct("__h", 0.02)
    below = hashed.groupBy(F.col("__label").alias("l")).agg((share * F.lit(2.0 ** 64) - F.lit(2.0 ** 63)).alias("below"))
    few = hashed.join(F.broadcast(below), F.col("__label") == F.col("l")).where(F.col("__h") <= F.col("below"))  # one row a label
    picked = (few.groupBy("l", F.col("__h").alias("h")).agg(F.min("__id").alias("i"))
              .withColumn("r", F.row_number().over(Window.partitionBy("l").orderBy("h"))).where(F.col("r") <= max_texts).drop("r"))
    # at most max_texts rows a label: a documented bound
    rows = (texts.join(F.broadcast(picked), (F.col("__h") == F.col("h")) & F.col("__id").eqNullSafe(F.col("i")))
            .select("h", "__text", "l").dropDuplicates(["h", "l"]).orderBy("h", "l").collect())
    return [(r["__text"], r["l"]) for r in rows]


def as_bytes(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a string or binary column, null as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def slices(sizes: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive rows whose sizes sum to ``limit`` at most (one row at least)."""
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if i > start and total + n > limit:
            yield start, i
            start, total = i, 0
        total += int(n)
    if start < len(sizes):
        yield start, len(sizes)


def byte_chunks(batches: Iterator[pa.RecordBatch], text: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Cut incoming batches so that each holds ``limit`` bytes of ``text`` at most, or one row."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        size = np.asarray(pc.fill_null(pc.binary_length(batch.column(text)), 0), dtype=np.int64)
        for a, b in slices(size, limit):
            yield batch.slice(a, b - a)


def release_memory() -> None:
    """Hand what Arrow and the C library have freed, but keep, back to the system (the latter where it is glibc)."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError, TypeError):
        pass


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """``run`` for ``mapInArrow``, after which the worker gives its free memory back.

    Workers live on between tasks and stages, and what they keep for later counts beside the executor's heap, in
    stages without Python too."""
    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release_memory()
    return tidied


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of unsigned 64-bit integers (the splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
