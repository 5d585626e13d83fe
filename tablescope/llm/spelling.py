"""Spelling variants: words one edit apart, by blocked products of letter counts.

A word is a vector of letter counts.  Two words that differ by one replaced letter have a squared
distance of 2 or 0, by one inserted or deleted letter of 1, so words of a block are compared with those of
blocks of equal or adjacent length by a matrix product (the squared distances of all pairs at once), and
only pairs at a squared distance of at most two are looked at letter by letter.

Blocks hold words of one length and one number of letters in each of ``GROUPS`` groups of letters.  One
edit moves one letter at most from a group to another, so a block meets only those blocks whose counts
are that close; all other pairs are farther apart than one edit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablescope.llm.common import UPPER, shuffle_partitions, staged

#: Code points of a word, at least; its occurrences, at least; how much more frequent its form is.
MIN_LENGTH, MIN_COUNT, RATIO = 7, 2, 10
#: Groups of letters: the place in this order (by how common letters are in European texts), counted up and
#: down, decides; other letters go by their code point.
GROUPS = 6
_ORDER = "etaoinsrhldcumfpgwybvkxjqz"
#: Words and letters of a block.
BLOCK_WORDS, BLOCK_LETTERS = 1_024, 1 << 20
#: Entries of a product, and letters of pairs, that are held at once.
PRODUCT, LETTERS = 1 << 21, 1 << 22


def letter_groups() -> np.ndarray:
    """The group of each Latin-1 code point."""
    out = np.arange(256) % GROUPS
    for i, x in enumerate(_ORDER):
        turn, place = divmod(i, GROUPS)
        out[ord(x)] = place if turn % 2 == 0 else GROUPS - 1 - place
    return out


def word_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH,
                min_count: int = MIN_COUNT) -> DataFrame:
    """Words (w) of at least ``min_length`` code points and their occurrences (n), at least ``min_count``.

    Of each run of letters, with A-Z lower-cased, let h be the crc32 of ``<id>:<run>``; if 31 divides h, its
    code point h % length goes.  Only runs of ``min_length`` letters and more can make such a word.
    """
    run = F.explode(F.regexp_extract_all(F.col(text_col), F.lit(rf"[A-Za-zÀ-ÿ]{{{min_length},}}"), F.lit(0)))
    key = F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id")
    runs = df.where(F.col(text_col).isNotNull()).select(key, run.alias("w"))
    runs = runs.select("id", F.when(F.col("w").rlike("[A-Z]"), F.translate("w", UPPER, UPPER.lower())).otherwise(F.col("w")).alias("w"))
    h = F.crc32(F.concat("id", F.lit(":"), F.col("w")).cast("binary"))
    at = (F.col("h") % F.length("w")).cast("int")
    cut = F.concat(F.substring(F.col("w"), F.lit(1), at), F.substring(F.col("w"), at + 2, F.length("w")))
    words = runs.withColumn("h", h).select(F.when(F.col("h") % 31 == 0, cut).otherwise(F.col("w")).alias("w"))
    return (words.where(F.length("w") >= min_length).groupBy("w").agg(F.count(F.lit(1)).alias("n"))
            .where(F.col("n") >= min_count))


class _Block:
    """Words of one length: their letters, letter counts and occurrences."""

    def __init__(self, length: int, words: bytes, n: bytes):
        self.letters = np.frombuffer(words, dtype=np.uint8).reshape(-1, length)
        self.n = np.frombuffer(n, dtype="<i8")
        rows = np.repeat(np.arange(len(self.letters)), length)
        # products of counts are exact in single precision as long as no square of a length passes 2^24
        kind = np.float32 if length <= 4_000 else np.float64
        self.counts = np.bincount(rows * 256 + self.letters.ravel(), minlength=256 * len(self.letters)).reshape(-1, 256).astype(kind)
        self.squares = (self.counts * self.counts).sum(axis=1)


def close_pairs(a: _Block, b: _Block) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of pairs (of a, of b) whose letter counts are at a squared distance of two at most."""
    used = np.flatnonzero(a.counts.any(axis=0))  # letters that a has none of add nothing to a product
    left, right = a.counts[:, used], np.ascontiguousarray(b.counts[:, used].T)
    step = max(1, PRODUCT // len(b.n))
    for x in range(0, len(a.n), step):
        # |a - b|^2 <= 2, that is 2 a.b >= |a|^2 + |b|^2 - 2
        gram = left[x:x + step] @ right
        gram *= 2
        gram -= a.squares[x:x + step, None]
        i, j = np.nonzero(gram >= b.squares[None, :] - 2)
        yield i + x, j


def one_edit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether rows of letters differ by exactly one edit; lengths differ by one at most."""
    if a.shape[1] == b.shape[1]:
        return (a != b).sum(axis=1) == 1
    short, long = (a, b) if a.shape[1] < b.shape[1] else (b, a)
    n = short.shape[1]
    front = np.concatenate([short != long[:, :n], np.ones((len(short), 1), dtype=bool)], axis=1).argmax(axis=1)
    back = np.concatenate([(short != long[:, 1:])[:, ::-1], np.ones((len(short), 1), dtype=bool)], axis=1).argmax(axis=1)
    return front + back >= n


def signatures(words: list[bytes]) -> np.ndarray:
    """The numbers of letters of each group, modulo 1024, packed into one integer a word."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    group = letter_groups()[np.frombuffer(b"".join(words), dtype=np.uint8)]
    counts = np.bincount(np.repeat(np.arange(len(words)), sizes) * GROUPS + group, minlength=GROUPS * len(words)).reshape(-1, GROUPS)
    return ((counts & 1023) << (10 * np.arange(GROUPS))).sum(axis=1)


def adjacent(tiles: np.ndarray) -> np.ndarray:
    """For each signature, those that one edit can lead to, itself included: a letter more or less in a
    group, or one moved from a group to another."""
    moves = [(i, j) for i in range(-1, GROUPS) for j in range(-1, GROUPS) if i != j]
    out = [tiles]
    for gone, come in moves:
        t = tiles
        for g, step in ((gone, -1), (come, 1)):
            if g >= 0:
                shift = 10 * g
                t = (t & ~(1023 << shift)) | ((((t >> shift) + step) & 1023) << shift)
        out.append(t)
    return np.stack(out, axis=1)


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if b.num_rows:
            words = [w.encode("latin-1") for w in b.column("w").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(signatures(words)), pa.array(words, pa.binary()), b.column("n")], names=["tile", "w", "n"])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by tile and length to one row for each block."""
    words, counts, now, letters = [], [], None, 0

    def row():
        return pa.RecordBatch.from_arrays(
            [pa.array([now[0]], pa.int64()), pa.array([now[1]], pa.int32()), pa.array([b"".join(words)], pa.binary()),
             pa.array([np.array(counts, dtype="<i8").tobytes()], pa.binary())], names=["tile", "length", "words", "n"])

    for b in batches:
        for tile, w, n in zip(b.column("tile").to_pylist(), b.column("w").to_pylist(), b.column("n").to_pylist(), strict=True):
            if words and ((tile, len(w)) != now or len(words) >= BLOCK_WORDS or letters >= BLOCK_LETTERS):
                yield row()
                words, counts, letters = [], [], 0
            now = (tile, len(w))
            words.append(w)
            counts.append(n)
            letters += len(w)
    if words:
        yield row()


def _meetings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        there = adjacent(np.asarray(b.column("tile"), dtype=np.int64))
        block = np.repeat(np.asarray(b.column("block"), dtype=np.int64), there.shape[1])
        yield pa.RecordBatch.from_arrays([pa.array(block), pa.array(there.ravel())], names=["center", "there"])


class _Found:
    """Of each word of a block: the number of near words, and the largest of them (ties: the first)."""

    def __init__(self, block: _Block):
        self.block = block
        self.near = np.zeros(len(block.n), dtype=np.int64)
        self.most = np.zeros(len(block.n), dtype=np.int64)
        self.form: list[bytes | None] = [None] * len(block.n)

    def meet(self, other: _Block) -> None:
        size = max(1, LETTERS // max(self.block.letters.shape[1], other.letters.shape[1]))
        for i, j in close_pairs(self.block, other):
            for a in range(0, len(i), size):
                x, y = i[a:a + size], j[a:a + size]
                ok = one_edit(self.block.letters[x], other.letters[y])
                x, y = x[ok], y[ok]
                if not len(x):
                    continue
                self.near += np.bincount(x, minlength=len(self.near))
                n = other.n[y]
                order = np.lexsort((-n, x))
                x, y, n = x[order], y[order], n[order]
                begin = np.r_[True, x[1:] != x[:-1]]
                top = n == np.repeat(n[begin], np.diff(np.r_[np.flatnonzero(begin), len(n)]))  # those of the largest n of each word
                for r, w, m in zip(x[top].tolist(), (bytes(v) for v in other.letters[y[top]]), n[top].tolist(), strict=True):
                    if m > self.most[r] or m == self.most[r] and w < self.form[r]:
                        self.most[r], self.form[r] = m, w

    def rows(self) -> pa.RecordBatch:
        text = lambda w: None if w is None else w.decode("latin-1")
        words = [bytes(w).decode("latin-1") for w in self.block.letters]
        return pa.RecordBatch.from_arrays(
            [pa.array(words), pa.array(self.block.n), pa.array(self.near), pa.array([text(w) for w in self.form], pa.string()),
             pa.array(self.most)], names=["word", "n", "n_near", "most", "most_n"])


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by block, the block itself first: each block against all that it meets."""
    found = None
    for b in batches:
        own, length, words, n = (b.column(c) for c in ("own", "length", "words", "n"))
        for i in range(b.num_rows):
            there = _Block(length[i].as_py(), words[i].as_py(), n[i].as_py())
            if own[i].as_py():
                if found is not None:
                    yield found.rows()
                found = _Found(there)
            if abs(there.letters.shape[1] - found.block.letters.shape[1]) <= 1:
                found.meet(there)
    if found is not None:
        yield found.rows()


def near_words(counts: DataFrame) -> DataFrame:
    """For each word of ``counts`` (w, n): n_near, and the near word of the largest n (most, most_n)."""
    parts = shuffle_partitions(counts.sparkSession)
    tiled = counts.mapInArrow(_tiles, "tile long, w binary, n long")
    # by tile and hash, so that a tile of very many words spreads over several partitions
    sorted_ = (tiled.withColumn("h", F.xxhash64("w")).repartitionByRange(parts, "tile", "h")
               .sortWithinPartitions("tile", F.length("w"), "h").drop("h"))
    blocks = staged(sorted_.mapInArrow(_blocks, "tile long, length int, words binary, n binary")
                    .withColumn("block", F.monotonically_increasing_id()), "spelling-blocks")
    meetings = blocks.select("block", "tile").mapInArrow(_meetings, "center long, there long")
    met = (meetings.join(blocks, F.col("there") == F.col("tile"))
           .select("center", (F.col("center") == F.col("block")).alias("own"), "length", "words", "n"))
    return (met.repartition(parts, "center").sortWithinPartitions("center", F.desc("own"))
            .mapInArrow(_compare, "word string, n long, n_near long, most string, most_n long"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, form) without nulls to (word, root): forms are followed to the last.  A form occurs far more
    often than its word, so chains are short and have no loops; each round doubles the steps taken."""
    state = forms.select("word", F.col("form").alias("root"))
    while True:
        further = state.select(F.col("word").alias("w"), F.col("root").alias("next"))
        joined = state.join(further, F.col("root") == F.col("w"), "left")
        state = staged(joined.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
        if not state.where("moved").limit(1).count():
            return state.select("word", "root")
        state = state.select("word", "root")


def spelling_variants(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH,
                      min_count: int = MIN_COUNT, ratio: int = RATIO) -> DataFrame:
    """One row per word: word, form, root, n, n_near, form_n.

    Words are near if they differ by exactly one inserted, deleted or replaced code point.  A word's form is
    its near word of the largest n (ties: the smallest in code-point order) if that is at least ``ratio``
    times its own n, else null; its root is where forms lead to in the end, or the word itself.

    Defined cases: null, empty and letterless texts have no words; a null identifier counts as the empty
    text; repeated rows count each time; a run of any length is one word; an empty table gives no rows;
    other columns are not read.
    """
    near = staged(near_words(staged(word_counts(df, id_col, text_col, min_length, min_count), "spelling-words")), "spelling-near")
    has = F.col("most_n") >= ratio * F.col("n")
    words = near.select("word", "n", "n_near", F.when(has, F.col("most")).alias("form"), F.when(has, F.col("most_n")).alias("form_n"))
    last = roots(words.where("form IS NOT NULL")).withColumnRenamed("word", "w")
    return (words.join(last, F.col("word") == F.col("w"), "left")
            .select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"))
