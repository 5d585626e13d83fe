"""Packing documents into fixed windows by non-negative least squares over length combinations.

Whole windows of a document are sequences of their own; what is left of it (its *rest*) has a
length below the window.  Shallow combinations of two or three rest lengths that fill a window
exactly are enumerated, and non-negative least squares finds how often to use each so that the
histogram of rests is met; the counts are rounded down and trimmed to the rests there are.  The
residual rests are packed greedily: laid end to end and cut at window borders, so that only the
last sequence of all is padded.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablescope.llm.common import byte_chunks, shuffle_partitions, staged, tidy
from tablescope.llm.tokens import Encoder, default_path

WINDOW = 1024
END_ID = 0
#: Triples have a first length that is a multiple of this.
TRIPLE_STEP = 64
SWEEPS = 60
#: Bytes of the texts that are encoded at once.
CHUNK = 2 << 20
#: Sequences of whole windows are numbered apart, by task and place.
_WHOLE = 1 << 40


def _measure(tokenizer: str, window: int):
    """One row a document: its ids' number, the crc32 of each whole window, and the rest's ids."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, serial, whole = TaskContext.get().partitionId(), 0, 0
        encoder = Encoder.of(tokenizer)
        end = np.array([END_ID], dtype="<u4").tobytes()
        for b in byte_chunks(batches, "text", CHUNK):
            docs = b.column("doc_id").to_pylist()
            out: dict[str, list] = {k: [] for k in ("row", "doc_id", "n", "rest", "crcs", "first_whole", "rest_crc", "rest_ids")}
            ids, sizes = encoder.batch(b.column("text"))
            ends = np.cumsum(sizes)
            for doc, z, size in zip(docs, ends.tolist(), sizes.tolist(), strict=True):
                raw = ids[z - size:z].tobytes() + end
                n = len(raw) // 4
                cut = n // window * window
                crcs = [zlib.crc32(raw[4 * a:4 * (a + window)]) for a in range(0, cut, window)]
                out["row"].append((part << 40) + serial)
                out["doc_id"].append(doc)
                out["n"].append(n)
                out["rest"].append(n - cut)
                out["crcs"].append(crcs)
                out["first_whole"].append(((part + 1) * _WHOLE) + whole)
                out["rest_crc"].append(zlib.crc32(raw[4 * cut:]))
                out["rest_ids"].append(raw[4 * cut:])
                serial += 1
                whole += len(crcs)
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([
                ("row", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int64()), ("rest", pa.int32()), ("crcs", pa.list_(pa.int64())),
                ("first_whole", pa.int64()), ("rest_crc", pa.int64()), ("rest_ids", pa.binary())]))
    return run


def combinations(window: int, step: int = TRIPLE_STEP) -> np.ndarray:
    """Pairs (third length 0) and triples of lengths that sum to ``window``, each in rising order."""
    pairs = [(0, a, window - a) for a in range(1, window // 2 + 1)]
    triples = [(a, b, window - a - b) for a in range(step, window // 3 + 1, step)
               for b in range(a, (window - a) // 2 + 1)]
    return np.array(pairs + triples, dtype=np.int64).reshape(-1, 3)


def nnls(combos: np.ndarray, histogram: np.ndarray, sweeps: int = SWEEPS) -> np.ndarray:
    """Minimise |A x - histogram| over x >= 0, where column j of A counts combination j's lengths, by
    cyclic coordinate descent (each step is the exact minimum along one coordinate)."""
    columns = []
    for combo in combos.tolist():
        lengths = [c for c in combo if c]
        columns.append([(c, lengths.count(c)) for c in sorted(set(lengths))])
    norms = [float(sum(k * k for _, k in col)) for col in columns]
    residual = histogram.astype(float).tolist()
    x = [0.0] * len(columns)
    scale = max(1.0, float(histogram.max(initial=0)))
    for _ in range(sweeps):
        moved = 0.0
        for j, col in enumerate(columns):
            slope = 0.0
            for c, k in col:
                slope += k * residual[c]
            new = x[j] + slope / norms[j]
            if new < 0.0:
                new = 0.0
            d = new - x[j]
            if d:
                x[j] = new
                for c, k in col:
                    residual[c] -= k * d
                moved = max(moved, abs(d))
        if moved < 1e-3 * scale ** 0.5:
            break
    return np.array(x)


def plan_sequences(histogram: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Combinations and whole repeat counts that use no more rests of any length than there are."""
    combos = combinations(window)
    repeat = np.floor(nnls(combos, histogram) + 1e-9).astype(np.int64)
    left = histogram.astype(np.int64).copy()
    for j in np.argsort(-repeat, kind="stable"):
        lengths, need = np.unique(combos[j][combos[j] > 0], return_counts=True)
        repeat[j] = min(repeat[j], int((left[lengths] // need).min()))
        if repeat[j] <= 0:
            repeat[j] = 0
            continue
        left[lengths] -= need * repeat[j]
    used = np.flatnonzero(repeat)
    return combos[used], repeat[used]


def _slots(combos: np.ndarray, repeat: np.ndarray, window: int) -> dict[int, tuple[np.ndarray, ...]]:
    """By rest length: from which rank on each slot begins, its first sequence and its offset.  The
    rest of rank r in slot s goes to sequence first[s] + r - begin[s]; ranks past the last slot are
    residual."""
    first = np.cumsum(repeat) - repeat
    by: dict[int, list[tuple[int, int, int]]] = {}
    for combo, n, s in zip(combos.tolist(), repeat.tolist(), first.tolist(), strict=True):
        offset = 0
        for c in combo:
            if c:
                by.setdefault(c, []).append((n, s, offset))
                offset += c
    out = {}
    for c, slots in by.items():
        n = np.array([x[0] for x in slots])
        out[c] = (np.cumsum(n) - n, np.array([x[1] for x in slots]), np.array([x[2] for x in slots]), int(n.sum()))
    return out


def _place(slots: dict[int, tuple[np.ndarray, ...]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rest, rank = np.asarray(b.column("rest")).astype(np.int64), np.asarray(b.column("rank"))
            sequence, offset = np.full(len(rest), -1, dtype=np.int64), np.zeros(len(rest), dtype=np.int64)
            for c in np.unique(rest):
                if int(c) not in slots:
                    continue
                begin, first, at, total = slots[int(c)]
                here = np.flatnonzero((rest == c) & (rank < total))
                s = np.searchsorted(begin, rank[here], side="right") - 1
                sequence[here] = first[s] + rank[here] - begin[s]
                offset[here] = at[s]
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("rest"), pa.array(sequence), pa.array(offset)],
                                             names=["row", "rest", "sequence_id", "offset"])
    return run


def _cut(window: int, base: int):
    """Pieces of the residual rests: laid end to end from ``at``, cut at window borders."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: dict[str, list] = {k: [] for k in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")}
            for doc, n, at, raw in zip(*(b.column(c).to_pylist() for c in ("doc_id", "n", "at", "rest_ids")), strict=True):
                ids = np.frombuffer(raw, "<u4")
                done = 0
                while done < len(ids):
                    offset = (at + done) % window
                    k = min(len(ids) - done, window - offset)
                    for name, v in zip(out, (doc, n - len(ids) + done, k, zlib.crc32(raw[4 * done:4 * (done + k)]), n,
                                             base + (at + done) // window, offset), strict=True):
                        out[name].append(v)
                    done += k
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([(k, pa.int64()) for k in out]))
    return run


def pack(df: DataFrame, window: int = WINDOW, tokenizer: str | None = None, id_col: str = "doc_id",
         text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is its text's token ids and one end id.  Every id lies in exactly one piece; the
    pieces of a sequence lie without gaps from offset 0 and hold ``window`` ids together, but for one
    last sequence.  Defined cases: null text is the empty text (one id); null and repeated
    identifiers are documents like others; an empty table gives no rows; other columns are not read.
    """
    spark = df.sparkSession
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    measured = staged(docs.mapInArrow(tidy(_measure(tokenizer or default_path(), window)),
                      "row long, doc_id long, n long, rest int, crcs array<long>, first_whole long, rest_crc long, rest_ids binary"), "packing")
    sizes = measured.where("rest > 0").select("row", "rest")
    salts = max(16, shuffle_partitions(spark))
    salted = sizes.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(salts)))
    cells = salted.groupBy("rest", "salt").agg(F.count(F.lit(1)).alias("n"))
    histogram = np.zeros(window, dtype=np.int64)
    for r in cells.groupBy("rest").agg(F.sum("n").alias("n")).collect():  # fewer rows than the window is long
        histogram[r["rest"]] = r["n"]
    combos, repeat = plan_sequences(histogram, window)
    # ranks of rests of one length: inside (length, salt), after the cells before
    before = Window.partitionBy("rest").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    slots = _slots(combos, repeat, window)
    starts = cells.select("rest", "salt", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = (salted.withColumn("inner", F.row_number().over(Window.partitionBy("rest", "salt").orderBy("row")))
              .join(starts.drop("n"), ["rest", "salt"]).select("row", "rest", (F.col("base") + F.col("inner") - 1).alias("rank")))
    placed = staged(ranked.mapInArrow(tidy(_place(slots)), "row long, rest int, sequence_id long, offset long"), "packing-plan")
    # residual rests end to end: inside a group, after the groups before
    loose = placed.where("sequence_id < 0").withColumn("g", F.pmod(F.xxhash64("row"), F.lit(salts)))
    group_before = Window.orderBy("g").rowsBetween(Window.unboundedPreceding, -1)  # one row for each group
    groups = loose.groupBy("g").agg(F.sum("rest").alias("t")).select("g", F.coalesce(F.sum("t").over(group_before), F.lit(0)).alias("base"))
    inner = Window.partitionBy("g").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    laid = (loose.withColumn("inner", F.coalesce(F.sum("rest").over(inner), F.lit(0))).join(groups, "g")
            .select("row", (F.col("base") + F.col("inner")).alias("at")))
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    whole = (measured.where("size(crcs) > 0").select("doc_id", "n", "first_whole", F.posexplode("crcs").alias("k", "crc"))
             .select("doc_id", (F.col("k") * F.lit(window).cast("long")).alias("start"), F.lit(window).cast("long").alias("length"), F.col("crc").alias("ids_crc32"),
                     F.col("n").alias("doc_tokens"), (F.col("first_whole") + F.col("k")).alias("sequence_id"), F.lit(0).cast("long").alias("offset")))
    planned = (measured.select("row", "doc_id", "n", "rest_crc").join(placed.where("sequence_id >= 0"), "row")
               .select("doc_id", (F.col("n") - F.col("rest")).alias("start"), F.col("rest").cast("long").alias("length"), F.col("rest_crc").alias("ids_crc32"),
                       F.col("n").alias("doc_tokens"), "sequence_id", "offset"))
    # ranks rise with the salt, so residual rests have the salts from a length's first one with ranks
    # to spare: a table of one row for each length keeps all other ids out of the join's shuffle
    taken = spark.createDataFrame([(int(c), x[3]) for c, x in slots.items()], "rest int, taken long")
    spare = (starts.join(F.broadcast(taken), "rest", "left").where(F.col("base") + F.col("n") > F.coalesce("taken", F.lit(0)))
             .groupBy("rest").agg(F.min("salt").alias("first_salt")))
    some = (measured.where("rest > 0").select("row", "doc_id", "n", "rest", "rest_ids").join(F.broadcast(spare), "rest")
            .where(F.pmod(F.xxhash64("row"), F.lit(salts)) >= F.col("first_salt")))
    residual = (some.join(laid, "row").select("doc_id", "n", "at", "rest_ids")
                .mapInArrow(tidy(_cut(window, int(repeat.sum()))), schema))
    return whole.union(planned).union(residual)
