"""Exact deduplication by content sort.

Rows are dealt to range partitions by (first bytes, hash, id) of the normalised text: Spark
samples the splitters, whose size is bounded although texts are not, and the id as last part
lets splitters fall inside a run of equal texts, so that a text that holds a third of all
rows is spread over many partitions.  Each partition is sorted externally by the whole text,
which puts equal texts side by side; neighbours are compared in full.  A run that reaches the
edge of its partition is completed from a table of edge runs with two keys a partition at most.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablescope.llm.common import fold_ascii, shuffle_partitions, staged

PREFIX_BYTES = 32
_RUNS = "id long, digest binary, run_size long, run_keep long, stays boolean, edge boolean, part int"


def _neighbours(keep_last: bool):
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        ids, valid, new_run, new_key, digests = [], [], [], [], []
        last = None
        for b in batches:
            if b.num_rows == 0:
                continue
            fresh = {}
            for name in ("prefix", "h", "body"):
                col = b.column(name)
                differs = np.asarray(pc.not_equal(col[1:], col[:-1]).to_numpy(zero_copy_only=False), dtype=bool)
                first = last is None or last[name] != col[0].as_py()
                fresh[name] = np.concatenate([[first], differs])
            key = fresh["prefix"] | fresh["h"]
            run = key | fresh["body"]
            body = b.column("body")
            digests += [hashlib.sha256(body[int(i)].as_py()).digest() for i in np.flatnonzero(run)]
            col = b.column("id")
            ids.append(np.asarray(pc.fill_null(col, 0)))
            valid.append(np.asarray(col.is_valid()))
            new_run.append(run)
            new_key.append(key)
            last = {name: b.column(name)[b.num_rows - 1].as_py() for name in ("prefix", "h", "body")}
        if last is None:
            return
        ids, valid, new_run, new_key = map(np.concatenate, (ids, valid, new_run, new_key))
        starts = np.flatnonzero(new_run)
        sizes = np.diff(np.append(starts, len(ids)))
        run = np.cumsum(new_run) - 1
        key = np.cumsum(new_key) - 1
        rep = starts + sizes - 1 if keep_last else starts
        stays = np.zeros(len(ids), dtype=bool)
        stays[rep] = True
        edge = (key == 0) | (key == key[-1])
        digest = pa.array(digests, pa.binary())
        for a in range(0, len(ids), 20_000):
            s = slice(a, a + 20_000)
            r = run[s]
            yield pa.RecordBatch.from_arrays([
                pa.array(ids[s], pa.int64(), mask=~valid[s]), digest.take(pa.array(r)), pa.array(sizes[r], pa.int64()),
                pa.array(ids[rep][r], pa.int64(), mask=~valid[rep][r]), pa.array(stays[s]), pa.array(edge[s]),
                pa.array(np.full(len(r), part), pa.int32())],
                names=["id", "digest", "run_size", "run_keep", "stays", "edge", "part"])
    return compare


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """One row per row of ``df``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z.  ``keep`` is ``smallest`` or
    ``largest``: the identifier that stays.  Defined cases: null text is the empty text; a null
    identifier never wins over another one; of rows that repeat text and identifier exactly one
    is kept; an empty table gives no rows; other columns are not read.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError("keep is 'smallest' or 'largest'")
    spark = df.sparkSession
    last = keep == "largest"
    body = fold_ascii(F.col(text_col)).cast("binary")
    keyed = (df.select(F.col(id_col).cast("long").alias("id"), body.alias("body"))
             .select("id", "body", F.substring("body", 1, PREFIX_BYTES).alias("prefix"), F.xxhash64("body").alias("h")))
    by_id = F.asc_nulls_first("id") if last else F.asc_nulls_last("id")
    dealt = (keyed.repartitionByRange(shuffle_partitions(spark), "prefix", "h", by_id)
             .sortWithinPartitions("prefix", "h", "body", by_id))
    runs = staged(dealt.mapInArrow(_neighbours(last), _RUNS), "exact-dedup")
    extreme = F.max if last else F.min
    edges = (runs.where("edge and stays").groupBy("digest")
             .agg(F.sum("run_size").alias("all_size"), extreme(F.struct("part", "run_keep")).alias("best")))
    # two keys for each partition: a size that does not depend on the number of rows
    out = runs.join(F.broadcast(edges), "digest", "left")
    inner = F.col("best").isNull()
    return out.select(
        F.col("id").alias("doc_id"),
        F.when(inner, F.col("run_keep")).otherwise(F.col("best.run_keep")).alias("keep_id"),
        F.when(inner, F.col("run_size")).otherwise(F.col("all_size")).alias("group_size"),
        (F.col("stays") & (inner | (F.col("part") == F.col("best.part")))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"))
