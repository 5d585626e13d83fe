"""Product-quantised codes of vectors, trained and assigned in integers only.

Components become integers, vectors are cut into parts, and each part position has a codebook of a few
entries.  Parts and entries are zero-padded to a power of two and go through the integer Walsh-Hadamard
transform, which multiplies squared distances by that power exactly.  Squared differences are added up
coefficient by coefficient in sequency order (slow ones first, which hold most of a smooth part), and an
entry leaves as soon as its sum exceeds the whole distance of one that is known; no floating point is used.

Spark sums parts by entry in every round; only the codebooks, a size fixed by parameters, reach the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablescope.llm.common import staged

PARTS = 8
ENTRIES = 16
ROUNDS = 6
SCALE = 4096
#: Part vectors that are compared at once.
BLOCK = 4_096


def sequency_order(n: int) -> np.ndarray:
    """Rows of the Hadamard matrix of order ``n`` (a power of two) by their number of sign changes."""
    k = np.arange(n)
    gray = k ^ (k >> 1)
    bits = n.bit_length() - 1
    out = np.zeros(n, dtype=np.int64)
    for b in range(bits):
        out |= ((gray >> b) & 1) << (bits - 1 - b)
    return out


def walsh_hadamard(x: np.ndarray) -> np.ndarray:
    """The integer transform of each row, zero-padded to a power of two, in sequency order."""
    n = 1 << max(0, (x.shape[1] - 1).bit_length())
    out = np.zeros((len(x), n), dtype=np.int64)
    out[:, :x.shape[1]] = x
    h = 1
    while h < n:
        y = out.reshape(len(x), n // (2 * h), 2, h)
        out = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(len(x), n)
        h *= 2
    return out[:, sequency_order(n)]


def nearest_entries(parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows of transformed ``parts``, the nearest row of transformed ``entries`` (ties to the lower)
    and the squared distance of the untransformed ones."""
    m, n = parts.shape
    k = len(entries)
    row, entry = np.repeat(np.arange(m), k), np.tile(np.arange(k), m)
    total = (parts[row, 0] - entries[entry, 0]) ** 2
    guess = total.reshape(m, k).argmin(axis=1)
    bound = ((parts - entries[guess]) ** 2).sum(axis=1)
    for j in range(1, n):
        keep = total <= bound[row]  # an equal one may still tie
        if not keep.all():
            row, entry, total = row[keep], entry[keep], total[keep]
        total = total + (parts[row, j] - entries[entry, j]) ** 2
    first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
    best = np.minimum.reduceat(total, first)
    hit = np.flatnonzero(total == np.repeat(best, np.diff(np.r_[first, len(row)])))
    hit = hit[np.r_[True, row[hit][1:] != row[hit][:-1]]]  # the lowest of equals
    return entry[hit], best // n


def _rows(column: pa.Array, width: int) -> np.ndarray:
    """Integer components, row by row, zero-padded to ``width``."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(np.asarray(lists.offsets, dtype=np.int64))
    out = np.zeros((len(lists), width), dtype=np.int64)
    at = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[np.repeat(np.arange(len(lists)), sizes), at] = np.asarray(lists.flatten(), dtype=np.int64)
    return out


def _assigned(x: np.ndarray, books: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Each part position with the entries and squared distances of all rows of ``x``."""
    width = x.shape[1] // len(books)
    for p, book in enumerate(books):
        entries = walsh_hadamard(book)
        found = [nearest_entries(walsh_hadamard(x[a:a + BLOCK, p * width:(p + 1) * width]), entries)
                 for a in range(0, len(x), BLOCK)]
        yield p, np.concatenate([e for e, _ in found]), np.concatenate([d for _, d in found])


def _sums(shared, width: int):
    """Number and component sums of the rows of each entry: a row for each part and entry of a batch."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x, each = _rows(b.column("v"), width), width // len(shared.value)
            for p, entry, _ in _assigned(x, shared.value):
                order = np.argsort(entry, kind="stable")
                used, first = np.unique(entry[order], return_index=True)
                sums = np.add.reduceat(x[order, p * each:(p + 1) * each], first, axis=0)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(used), p, dtype=np.int32)), pa.array(used.astype(np.int32)),
                     pa.array(np.diff(np.r_[first, len(entry)]).astype(np.int64)), pa.array(sums.tolist(), pa.list_(pa.int64()))],
                    names=["part", "entry", "n", "sums"])
    return run


def _codes(shared, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            codes, error = [], np.zeros(b.num_rows, dtype=np.int64)
            for _, entry, distance in _assigned(_rows(b.column("v"), width), shared.value):
                codes.append(entry)
                error += distance
            code = [bytes(c).hex() for c in np.stack(codes, axis=1).astype(np.uint8)]
            keep = [i for i, name in enumerate(b.schema.names) if name != "v"]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in keep), pa.array(code), pa.array(error)],
                                             names=[*(b.schema.names[i] for i in keep), "code", "error"])
    return run


def integer_components(vector: Column, limit: int, scale: int = SCALE) -> Column:
    """floor(scale * x) of each component, at most ``limit`` away from 0."""
    return F.transform(vector, lambda x: F.greatest(F.lit(-limit), F.least(F.lit(limit), F.floor(x.cast("double") * scale))).cast("long"))


def codebooks_text(books: list[np.ndarray]) -> str:
    return ",".join(str(x) for book in books for entry in book.tolist() for x in entry)


def vector_codes(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
                 parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """One row per usable vector: vec_id, code, error, label_error, codebooks_sha256.

    Each of ``rounds`` rounds assigns every part to the nearest entry of its codebook (squared Euclidean
    distance, ties to the lower index) and moves each entry to floor(sum / count) of its parts.

    Defined cases: rows whose vector is null or holds null or non-finite components are left out; vectors
    are as wide as the longest, rounded up to a multiple of ``parts`` (at least ``parts``), and shorter
    ones (empty ones, too) count as followed by zeros; integers stop at 2^30 / (a part's width rounded up
    to a power of two), 2^27 for eight, so that sums of squares are exact in 64 bits; null identifiers
    come last, equal ones in the order of their components, when first entries are chosen, and fewer rows
    than ``entries`` make as many entries; repeated rows stay; equal labels share label_error, null ones
    among them; an empty table gives no rows; other columns are not read.
    """
    v = F.col(vector_col)
    ok = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != float("inf")))
    rows = df.where(ok).select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), v.alias("v"))
    longest = rows.agg(F.max(F.size("v"))).first()[0]
    each = max(1, -(-(longest or 0) // parts))
    width = each * parts
    limit = (1 << 30) >> max(0, (each - 1).bit_length())
    whole = staged(rows.withColumn("v", integer_components(F.col("v"), limit, scale)), "vector-integers")
    # a top-n of the entries that start: `entries` rows, whatever the size of the table
    first = whole.select("vec_id", "v").orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).collect()
    if not first:
        return whole.select("vec_id", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"),
                            F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    start = np.array([list(r.v) + [0] * (width - len(r.v)) for r in first], dtype=np.int64)
    books = [start[:, p * each:(p + 1) * each].copy() for p in range(parts)]
    context = df.sparkSession.sparkContext
    for _ in range(rounds):
        shared = context.broadcast(books)
        found = whole.select("v").mapInArrow(_sums(shared, width), "part int, entry int, n long, sums array<long>")
        # parts x entries rows
        sums = (found.select("part", "entry", "n", F.posexplode("sums").alias("at", "x"))
                .groupBy("part", "entry", "at").agg(F.sum("n").alias("n"), F.sum("x").alias("x")).collect())
        books = [b.copy() for b in books]
        for r in sums:
            books[r["part"]][r["entry"], r["at"]] = r["x"] // r["n"]  # integers of any size, rounded down
    digest = hashlib.sha256(codebooks_text(books).encode()).hexdigest()
    coded = staged(whole.mapInArrow(_codes(context.broadcast(books), width),
                                    f"vec_id long, label {whole.schema['label'].dataType.simpleString()}, code string, error long"), "vector-codes")
    sums = coded.groupBy(F.col("label").alias("l")).agg(F.sum("error").alias("label_error"))
    return (coded.join(sums, F.col("label").eqNullSafe(F.col("l")))
            .select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256")))
