"""Language-model scoring: a Katz backoff bigram model over words.

Documents are read in chunks of bounded size; a chunk's words become codes of the chunk's own
vocabulary.  All lookups go the same way: a chunk sends its *distinct* keys to the partitions that
own them, and a partition answers every chunk's keys in the order sent.

1. words: the owners add up training counts, number the words, and answer with number and count;
2. pairs (history, word): the owners add up training counts of pairs and answer with them and, for
   each history, with its count, its counts of counts and the word-model mass of what was seen;
3. with the Good-Turing discounts, which come from the counts of counts of all owners, each token
   takes its discounted pair probability or, recursively, the backoff weight times the word's own.
   The weights make every history's distribution sum to exactly one.

Histories are owned by hash.  The pairs of a *hot* history (one that holds more than 1 / HOT_SHARE
of all tokens, so fewer than HOT_SHARE of them) are owned by hash of the whole pair, and their
figures are added up afterwards.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablescope.llm.common import as_bytes, byte_chunks, mix64, shuffle_partitions, staged

#: Text bytes of a chunk.
CHUNK = 10 << 20
#: Counts up to this one are discounted.
GT_MAX = 5
HOT_SHARE = 200
#: Numbers of all words that are not in training, and of the start mark (a history only).
UNKNOWN, START, FIRST_WORD = 0, 1, 2
_U64 = np.uint64
#: The end mark: no word is empty.
_END = b""


def pack(a: np.ndarray) -> bytes:
    """Non-negative integers (or doubles) in the least width that holds them, by byte planes, compressed."""
    if a.dtype.kind == "f":
        code, a = b"f", a.astype("<f8")
    else:
        code = next(c for c, w in ((b"1", 8), (b"2", 16), (b"4", 32), (b"8", 64)) if w == 64 or a.max(initial=0) < 1 << w)
        a = a.astype(f"<u{code.decode()}")
    planes = a.view(np.uint8).reshape(-1, a.itemsize).T.tobytes()
    return code + zstandard.ZstdCompressor(level=1).compress(planes)


def unpack(b: bytes) -> np.ndarray:
    kind = "<f8" if b[:1] == b"f" else f"<u{b[:1].decode()}"
    width = np.dtype(kind).itemsize
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(b[1:]), np.uint8).reshape(width, -1)
    out = raw.T.copy().view(kind).ravel()  # a copy: callers write to it
    return out if kind in ("<f8", "<u8") else out.astype(np.int64)


def _blobs(arrays) -> pa.Array:
    return pa.array([pack(a) for a in arrays], pa.binary())


def _tokens(folds: int, held: int, parts: int):
    """One row a chunk: its documents, their words as codes, and the vocabulary's hashes.  Codes are
    in order of the word's owner, so that the owners' answers, put in a row, are in order of codes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, serial = TaskContext.get().partitionId(), 0
        for b in byte_chunks(batches, "text", CHUNK):
            words: list[bytes] = []
            lengths = []
            for t in as_bytes(b.column("text")):
                w = t.lower().split()
                words += w
                words.append(_END)
                lengths.append(len(w) + 1)
            codes, vocab = pd.factorize(np.array(words, dtype=object))
            del words
            hashes = np.fromiter((xxhash.xxh64_intdigest(w) for w in vocab), _U64, len(vocab))
            owner = (mix64(hashes) % _U64(parts)).astype(np.int64)
            order = np.lexsort((hashes, owner))
            rank = np.empty(len(order), dtype=np.int64)
            rank[order] = np.arange(len(order))
            ids = b.column("doc_id").to_pylist()
            out = [zlib.crc32(b"" if d is None else str(d).encode()) % folds == held for d in ids]
            yield pa.RecordBatch.from_arrays([
                pa.array([(part << 32) + serial], pa.int64()), pa.array([ids], pa.list_(pa.int64())),
                pa.array([out], pa.list_(pa.bool_())), _blobs([np.array(lengths)]), _blobs([rank[codes]]),
                _blobs([hashes[order]]), _blobs([np.bincount(owner, minlength=parts)])],
                names=["chunk", "ids", "held", "lengths", "codes", "vocab", "cuts"])
            serial += 1
    return run


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for b in batches:
        for i in range(b.num_rows):
            row = {n: b.column(n)[i].as_py() for n in b.schema.names}
            for n in {"lengths", "codes", "vocab", "cuts"} & row.keys():
                row[n] = unpack(row[n])
            row["train"] = np.repeat(~np.array(row["held"], dtype=bool), row["lengths"])
            yield row


def _word_requests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for row in _rows(batches):
        train = np.bincount(row["codes"][row["train"]], minlength=len(row["vocab"]))
        ends = np.cumsum(row["cuts"])
        spans = [(p, slice(e - n, e)) for p, (n, e) in enumerate(zip(row["cuts"], ends, strict=True)) if n]
        yield pa.RecordBatch.from_arrays([
            pa.array([p for p, _ in spans], pa.int32()), pa.array([row["chunk"]] * len(spans), pa.int64()),
            _blobs(row["vocab"][s] for _, s in spans), _blobs(train[s] for _, s in spans)],
            names=["owner", "chunk", "keys", "counts"])


def _count_of_counts(values: np.ndarray) -> np.ndarray:
    return np.bincount(values[(values > 0) & (values <= GT_MAX + 1)], minlength=GT_MAX + 2)


_WORD_ANSWERS = "owner int, chunk long, numbers binary, counts binary, known long, tokens long, coc array<long>"


def _word_answers(parts: int):
    """Number and count of every chunk's words, and one row of totals (without a chunk)."""
    def run(group: pa.Table) -> pa.Table:
        owner = group.column("owner")[0].as_py()
        keys = [unpack(x) for x in group.column("keys").to_pylist()]
        counts = np.concatenate([unpack(x) for x in group.column("counts").to_pylist()])
        ends = np.cumsum([len(k) for k in keys])
        distinct, at = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(at, weights=counts, minlength=len(distinct)).astype(np.int64)
        spans = [slice(e - len(k), e) for k, e in zip(keys, ends, strict=True)]
        n = len(spans)
        return pa.table({
            "owner": pa.array([owner] * (n + 1), pa.int32()), "chunk": pa.array([*group.column("chunk").to_pylist(), None], pa.int64()),
            "numbers": pa.array([*(pack(FIRST_WORD + at[s] * parts + owner) for s in spans), None], pa.binary()),
            "counts": pa.array([*(pack(total[at[s]]) for s in spans), None], pa.binary()),
            "known": pa.array([None] * n + [int((total > 0).sum())], pa.int64()),
            "tokens": pa.array([None] * n + [int(total.sum())], pa.int64()),
            "coc": pa.array([None] * n + [_count_of_counts(total).tolist()], pa.list_(pa.int64()))})
    return run


@dataclass
class Discounts:
    """Good-Turing discount of each count (1 above ``GT_MAX``)."""

    by_count: np.ndarray

    @staticmethod
    def fit(coc: np.ndarray) -> Discounts:
        """From counts of counts.  A count whose estimate is not between 0 and 1 (too little data)
        takes that of an absolute discount, so that some mass is left for the unseen."""
        d = np.ones(GT_MAX + 2)
        n = np.asarray(coc, dtype=float)
        if n[1] > 0:
            absolute = n[1] / (n[1] + 2 * n[2])
            tail = (GT_MAX + 1) * n[GT_MAX + 1] / n[1]
            for r in range(1, GT_MAX + 1):
                good = (r + 1) * n[r + 1] / (r * n[r]) if n[r] else 0.0
                turing = (good - tail) / (1 - tail) if tail < 1 else 0.0
                d[r] = turing if 0 < turing < 1 else max(1e-3, 1 - absolute / r)
        return Discounts(d)

    def __call__(self, counts: np.ndarray) -> np.ndarray:
        return self.by_count[np.minimum(counts, GT_MAX + 1)]


@dataclass
class WordModel:
    """Good-Turing word probabilities; ``unknown`` is that of all words not in training together."""

    tokens: int
    words: int
    discounts: Discounts
    unknown: float
    scale: float

    @staticmethod
    def fit(tokens: int, words: int, coc: np.ndarray) -> WordModel:
        d = Discounts.fit(coc)
        left = float(sum(r * coc[r] * (1 - d.by_count[r]) for r in range(1, GT_MAX + 1))) / max(tokens, 1)
        if left > 0:
            return WordModel(tokens, words, d, left, 1.0)
        # no count is small (or there is none): one pseudo-count is kept for the unknown
        return WordModel(tokens, words, d, 1 / (tokens + 1), tokens / (tokens + 1))

    def probability(self, counts: np.ndarray) -> np.ndarray:
        return np.where(counts > 0, self.discounts(counts) * counts / max(self.tokens, 1) * self.scale, self.unknown)


def _resolved(row: dict) -> tuple[np.ndarray, np.ndarray]:
    """Number and training count of a chunk's vocabulary; a word not in training is ``UNKNOWN``."""
    answers = sorted(row["answers"], key=lambda a: a["owner"])
    number = np.concatenate([unpack(a["numbers"]).astype(np.int64) for a in answers])
    count = np.concatenate([unpack(a["counts"]).astype(np.int64) for a in answers])
    return np.where(count > 0, number, UNKNOWN), count


def _pairs(row: dict, hot: np.ndarray, parts: int) -> dict[str, np.ndarray]:
    """The chunk's distinct pairs in order of owner and history; ``at`` gives each token's pair."""
    number, count = _resolved(row)
    codes = row["codes"]
    first = np.cumsum(row["lengths"]) - row["lengths"]
    v = len(number)
    history = np.concatenate([[v], codes[:-1]])
    history[first] = v
    pair, at = np.unique(history * (v + 1) + codes, return_inverse=True)
    h, w = pair // (v + 1), pair % (v + 1)
    c = count[w]
    h, w = np.append(number, START)[h], number[w]
    key = mix64(h.astype(_U64))
    spread = mix64(key ^ (w.astype(_U64) * _U64(0x9E3779B97F4A7C15)))
    owner = (np.where(np.isin(h, hot), spread, key) % _U64(parts)).astype(np.int64)
    order = np.lexsort((h, owner))
    rank = np.empty(len(order), dtype=np.int64)
    rank[order] = np.arange(len(order))
    return {"h": h[order], "w": w[order], "c": c[order], "n": np.bincount(at[row["train"]], minlength=len(pair))[order],
            "owner": owner[order], "at": rank[at], "first": first}


def _spans(p: dict, parts: int) -> list[tuple[int, slice]]:
    cut = np.searchsorted(p["owner"], np.arange(parts + 1))
    return [(k, slice(a, b)) for k, (a, b) in enumerate(zip(cut, cut[1:], strict=False)) if b > a]


def _pair_requests(parts: int, hot: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            p = _pairs(row, hot, parts)
            spans = _spans(p, parts)
            yield pa.RecordBatch.from_arrays([
                pa.array([k for k, _ in spans], pa.int32()), pa.array([row["chunk"]] * len(spans), pa.int64()),
                *[_blobs(p[x][s] for _, s in spans) for x in ("h", "w", "c", "n")]],
                names=["owner", "chunk", "h", "w", "c", "n"])
    return run


def _runs(h: np.ndarray) -> np.ndarray:
    """Begins of the runs of equal histories."""
    return np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, dtype=np.int64)


_PAIR_ANSWERS = ("owner int, chunk long, totals binary, n binary, few array<binary>, lower binary, "
                 "hot array<struct<h:long,figures:array<double>>>, coc array<long>")


def _pair_answers(words: WordModel, hot: np.ndarray):
    """Every chunk's pair counts and, for each run of a history in its request, the history's
    figures; one row (without a chunk) of counts of counts and of this owner's share of the
    hot histories."""
    def run(group: pa.Table) -> pa.Table:
        col = {k: [unpack(x).astype(np.int64) for x in group.column(k).to_pylist()] for k in ("h", "w", "c", "n")}
        ends = np.cumsum([len(x) for x in col["h"]])
        spans = [slice(e - len(x), e) for x, e in zip(col["h"], ends, strict=True)]
        h, w, c, n = (np.concatenate(col[k]) for k in ("h", "w", "c", "n"))
        order = np.lexsort((w, h))
        hs, ws = h[order], w[order]
        fresh = np.concatenate([[True], (hs[1:] != hs[:-1]) | (ws[1:] != ws[:-1])])
        at = np.empty(len(h), dtype=np.int64)
        at[order] = np.cumsum(fresh) - 1
        total = np.bincount(at, weights=n).astype(np.int64)
        hd, cd = hs[fresh], c[order][fresh]
        hist, by = np.unique(hd, return_inverse=True)
        seen = total > 0
        add = lambda x: np.bincount(by, weights=x, minlength=len(hist))
        count = add(total).astype(np.int64)
        few = [add(total == r).astype(np.int64) for r in range(1, GT_MAX + 1)]
        lower = add(np.where(seen, words.probability(cd), 0.0))
        of = by[at]  # of each request entry
        begins = [of[s][_runs(h[s])] for s in spans]
        own = np.flatnonzero(np.isin(hist, hot))
        figures = np.stack([count, lower, *few], axis=1).astype(float)
        shares = [{"h": int(hist[i]), "figures": figures[i].tolist()} for i in own]
        k = len(spans)
        return pa.table({
            "owner": pa.array([group.column("owner")[0].as_py()] * (k + 1), pa.int32()),
            "chunk": pa.array([*group.column("chunk").to_pylist(), None], pa.int64()),
            "totals": pa.array([*(pack(total[at[s]]) for s in spans), None], pa.binary()),
            "n": pa.array([*(pack(count[x]) for x in begins), None], pa.binary()),
            "few": pa.array([*([pack(f[x]) for f in few] for x in begins), None], pa.list_(pa.binary())),
            "lower": pa.array([*(pack(lower[x]) for x in begins), None], pa.binary()),
            "hot": pa.array([None] * k + [shares], pa.list_(pa.struct([("h", pa.int64()), ("figures", pa.list_(pa.float64()))]))),
            "coc": pa.array([None] * k + [_count_of_counts(total).tolist()], pa.list_(pa.int64()))})
    return run


def backoff(n: np.ndarray, few: np.ndarray, lower: np.ndarray, discounts: Discounts) -> tuple[np.ndarray, np.ndarray]:
    """(scale, weight) of histories with count ``n``, ``few[r - 1]`` pairs of count r, and word-model
    mass ``lower`` of the words seen: a seen pair has probability scale * discount * count / n, any
    other word the weight times its own.  A history without discounted pairs keeps one pseudo-count
    for the unseen; a history not in training gives the word model."""
    r = np.arange(1, GT_MAX + 1)
    left = ((r * (1 - discounts.by_count[1:GT_MAX + 1]))[:, None] * few).sum(axis=0) / np.maximum(n, 1)
    none = left <= 0
    scale = np.where(none, n / (n + 1), 1.0)
    left = np.where(none, 1 / (n + 1), left)
    return scale, np.where(n > 0, left / (1 - lower), 1.0)


def _scores(words: WordModel, discounts: Discounts, parts: int, hot: dict[int, tuple]):
    hot_h = np.array(sorted(hot), dtype=np.int64)
    hot_v = np.array([hot[h] for h in sorted(hot)], dtype=float).reshape(-1, GT_MAX + 2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            p = _pairs(row, hot_h, parts)
            answers = {a["owner"]: a for a in row["scores"]}
            score = np.empty(len(p["h"]))
            for k, s in _spans(p, parts):
                a = answers[k]
                h = p["h"][s]
                begin = _runs(h)
                n, lower = unpack(a["n"]).astype(float), unpack(a["lower"])
                few = np.stack([unpack(x) for x in a["few"]]).astype(float)
                at = np.searchsorted(hot_h, h[begin]).clip(0, len(hot_h) - 1)
                is_hot = hot_h[at] == h[begin]
                n[is_hot], lower[is_hot], few[:, is_hot] = hot_v[at[is_hot], 0], hot_v[at[is_hot], 1], hot_v[at[is_hot], 2:].T
                scale, weight = backoff(n, few, lower, discounts)
                of = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(h))))
                total = unpack(a["totals"]).astype(np.int64)
                score[s] = np.log10(np.where(total > 0, scale[of] * discounts(total) * total / np.maximum(n[of], 1),
                                             weight[of] * words.probability(p["c"][s])))
            count = p["c"][p["at"]]
            base = np.log10((count + 1) / (words.tokens + 1 * (words.words + 1)))
            add = lambda x: np.add.reduceat(x, p["first"])
            yield pa.RecordBatch.from_arrays([
                pa.array(row["ids"], pa.int64()), pa.array(row["held"], pa.bool_()), pa.array(row["lengths"], pa.int64()),
                pa.array(add((count > 0).astype(np.int64)), pa.int64()), pa.array([words.tokens] * len(row["ids"]), pa.int64()),
                pa.array(add(base)), pa.array(add(score[p["at"]]))],
                names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])
    return run


def _hot_words(tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for number, count in zip(b.column("numbers").to_pylist(), b.column("counts").to_pylist(), strict=True):
                n = unpack(number).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(n[unpack(count).astype(np.int64) * HOT_SHARE > tokens], pa.int64())], names=["h"])
    return run


def _sum_coc(rows: DataFrame) -> np.ndarray:
    out = np.zeros(GT_MAX + 2, dtype=np.int64)
    for r in rows.select(F.posexplode("coc").alias("at", "x")).groupBy("at").agg(F.sum("x").alias("x")).collect():
        out[r["at"]] = r.x
    return out


def katz_scores(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 7, held: int = 2) -> DataFrame:
    """One row per row of ``df``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    The model learns from rows whose crc32(identifier as text) modulo ``folds`` is not ``held`` and
    scores all.  Tokens are words with A-Z folded, then one end mark.  ``score`` is the log10
    probability of the text; all words not in training are one word to the model.  Defined cases:
    null text is the empty text (one token); a null identifier counts as the empty text in the
    crc32; with no training rows every token is unknown and has probability 1; rows that repeat
    each score; an empty table gives no rows; other columns are not read.
    """
    spark = df.sparkSession
    parts = shuffle_partitions(spark)
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    chunks = staged(docs.mapInArrow(_tokens(folds, held, parts), "chunk long, ids array<long>, held array<boolean>, "
                                    "lengths binary, codes binary, vocab binary, cuts binary"), "katz-chunks")

    def ask(requests: DataFrame, answer, schema: str, name: str) -> DataFrame:
        return staged(requests.repartition(parts, "owner").groupBy("owner").applyInArrow(answer, schema), name)

    word_rows = ask(chunks.mapInArrow(_word_requests, "owner int, chunk long, keys binary, counts binary"),
                    _word_answers(parts), _WORD_ANSWERS, "katz-words")
    totals = word_rows.agg(F.sum("known"), F.sum("tokens")).first()
    tokens, known = totals[1] or 0, totals[0] or 0
    words = WordModel.fit(tokens, known, _sum_coc(word_rows))
    found = (word_rows.where("chunk IS NOT NULL").select("numbers", "counts").mapInArrow(_hot_words(words.tokens), "h long")
             .distinct().collect()) if words.tokens else []  # fewer than HOT_SHARE words
    hot = np.array(sorted({r.h for r in found} | {START, UNKNOWN}), dtype=np.int64)
    numbered = chunks.drop("vocab", "cuts").join(
        word_rows.where("chunk IS NOT NULL").groupBy("chunk")
        .agg(F.collect_list(F.struct("owner", "numbers", "counts")).alias("answers")), "chunk")
    pair_rows = ask(numbered.mapInArrow(_pair_requests(parts, hot), "owner int, chunk long, h binary, w binary, c binary, n binary"),
                    _pair_answers(words, hot), _PAIR_ANSWERS, "katz-pairs")
    discounts = Discounts.fit(_sum_coc(pair_rows))
    masses = {int(h): np.zeros(GT_MAX + 2) for h in hot}
    shares = (pair_rows.select(F.explode("hot").alias("s")).select("s.h", F.posexplode("s.figures").alias("at", "x"))
              .groupBy("h", "at").agg(F.sum("x").alias("x")))
    for r in shares.collect():  # a few figures of each hot history
        masses[r.h][r["at"]] = r.x
    scored = (pair_rows.where("chunk IS NOT NULL").groupBy("chunk")
              .agg(F.collect_list(F.struct("owner", "totals", "n", "few", "lower")).alias("scores")))
    return numbered.join(scored, "chunk").mapInArrow(
        _scores(words, discounts, parts, {h: tuple(v) for h, v in masses.items()}),
        "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
