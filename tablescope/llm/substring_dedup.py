"""Substring deduplication with FM-indexes over shards.

Two equal windows have equal *anchors* (the smallest hash of the windows' short word sequences), so
windows are dealt to shards by anchor and never have to be compared across shards.  Anchors that
occur once in the whole corpus are dropped before any text is moved: their windows cannot repeat.
Neighbouring windows of one anchor travel together as a segment.  Each shard builds a compressed
FM-index of its segments and streams the segments of all documents through it by backward search,
which counts every window.  The windows of a hot anchor are dealt one by one, by their whole
content, so that no shard grows with a popular passage.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablescope.llm.common import as_bytes, byte_chunks, mix64, shuffle_partitions, staged
from tablescope.llm.wavelet import FMIndex, repeated_windows

#: Words of the short sequences whose hashes are anchors.
GRAM = 8
#: Segments that one shard is planned for.
SHARD_SEGMENTS = 4_000
#: Occurrences from which the windows of an anchor are dealt by their content.
HOT = 1_000
_CHUNK = 2 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BLANKS = np.isin(np.arange(256), [0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D])


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(1, dtype=np.uint64)
    while len(out) < n:
        top = np.uint64(pow(int(base), len(out), 1 << 64))
        out = np.concatenate([out, out * top])
    return out[:n]


def word_hashes(buffer: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and polynomial hashes of all words of a byte buffer (a filter, never a proof of equality)."""
    blank = _BLANKS[buffer]
    edges = np.flatnonzero(np.diff(np.concatenate([[True], blank, [True]]).astype(np.int8)))
    starts, ends = edges[0::2], edges[1::2]
    n = len(buffer)
    up, down = _powers(int(_BASE), n + 1), _powers(pow(int(_BASE), -1, 1 << 64), n + 1)
    total = np.concatenate([[np.uint64(0)], np.cumsum((buffer.astype(np.uint64) + np.uint64(1)) * up[:n], dtype=np.uint64)])
    return starts, mix64((total[ends] - total[starts]) * down[starts])


def anchors(texts: list[bytes], window: int, gram: int) -> tuple[np.ndarray, ...]:
    """(document, first window, windows, anchor) of every maximal run of windows with one anchor."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    buffer = np.frombuffer(b" ".join(texts), dtype=np.uint8)
    starts, wh = word_hashes(buffer)
    doc_at = np.concatenate([[0], np.cumsum(sizes + 1)])
    first_word = np.searchsorted(starts, doc_at)  # of each document, and the end
    n = len(starts)
    if n < window:
        return tuple(np.zeros(0, dtype=t) for t in (np.int64, np.int64, np.int64, np.uint64))
    grams = n - gram + 1
    g = np.zeros(grams, dtype=np.uint64)
    factor = 1
    for j in range(gram):
        g += wh[j:j + grams] * np.uint64(factor)
        factor = factor * 0xD6E8FEB86659FD93 % (1 << 64)
    g = mix64(g)
    # high 40 bits of the hash, then the position: the leftmost smallest of each window
    low = np.uint64((1 << 24) - 1)
    value = (g & ~low) | (np.arange(grams, dtype=np.uint64) & low)
    width, span = window - gram + 1, 1
    while span * 2 <= width:
        value = np.minimum(value[:-span], value[span:])
        span *= 2
    if span < width:
        value = np.minimum(value[:len(value) - (width - span)], value[width - span:])
    at = (value & low).astype(np.int64)
    doc = np.searchsorted(first_word, np.arange(len(at)), side="right") - 1
    ok = np.arange(len(at)) + window <= first_word[doc + 1]
    fresh = np.concatenate([[True], (at[1:] != at[:-1]) | (doc[1:] != doc[:-1])]) & ok
    run = np.flatnonzero(fresh)
    group = np.cumsum(fresh)[ok] - 1
    counts = np.bincount(group, minlength=len(run))
    return doc[run], run - first_word[doc[run]], counts, g[at[run]]


def _pieces(texts: list[bytes], window: int) -> Iterator[tuple[list[bytes], int]]:
    """(texts, word offset): a very long text comes in pieces that share
    ``window`` - 1 words, so that every window is in exactly one piece."""
    if len(texts) > 1 or len(texts[0]) <= 4 * _CHUNK:
        yield texts, 0
        return
    words = texts[0].split()
    step = _CHUNK // 8
    for a in range(0, max(1, len(words) - window + 1), step):
        yield [b" ".join(words[a:a + step + window - 1])], a


def _anchor_rows(window: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, (texts, offset) in ((b, p) for b in byte_chunks(batches, "text", _CHUNK)
                                      for p in _pieces(as_bytes(b.column("text")), window)):
            d, s, n, a = anchors(texts, window, gram)
            s = s + offset
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").take(pa.array(d)), b.column("row_key").take(pa.array(d)), pa.array(s, pa.int32()),
                 pa.array(n, pa.int32()), pa.array(a.view(np.int64))], names=["doc_id", "row_key", "start", "n", "anchor"])
    return run


def _segments(window: int, shards: int, with_words: bool):
    """The segments of each document.  With words: at most two of each content from one task (it
    only matters whether a window occurs twice), for the index.  Without: all, with their place."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, int] = {}
        for b in byte_chunks(batches, "text", _CHUNK):
            out: dict[str, list] = {k: [] for k in ("shard", "key", "n", "words", "doc_id", "row_key", "start")}
            doc_ids, row_keys = b.column("doc_id").to_pylist(), b.column("row_key").to_pylist()
            lists = b.column("segments").to_pylist()
            for text, doc, row, segments in zip(as_bytes(b.column("text")), doc_ids, row_keys, lists, strict=True):
                words = text.split()
                for seg in segments:
                    s, n, hot = seg["start"], seg["n"], seg["hot"]
                    for a, m in ([(s + i, 1) for i in range(n)] if hot else [(s, n)]):
                        content = b" ".join(words[a:a + m + window - 1])
                        key = xxhash.xxh3_128_digest(content) + bytes([m & 255])
                        if with_words:
                            times = seen.get(key, 0)
                            if times >= 2:
                                continue
                            seen[key] = times + 1
                            out["words"].append(content)
                            place = int.from_bytes(key[:8], "little") if hot else seg["anchor"]
                            out["shard"].append(place % shards)
                        else:
                            out["doc_id"].append(doc)
                            out["row_key"].append(row)
                            out["start"].append(a)
                        out["key"].append(key)
                        out["n"].append(m)
            if with_words:
                yield pa.RecordBatch.from_pydict({k: out[k] for k in ("shard", "key", "n", "words")}, schema=pa.schema(
                    [("shard", pa.int64()), ("key", pa.binary()), ("n", pa.int32()), ("words", pa.binary())]))
            else:
                yield pa.RecordBatch.from_pydict({k: out[k] for k in ("key", "doc_id", "row_key", "start")}, schema=pa.schema(
                    [("key", pa.binary()), ("doc_id", pa.int64()), ("row_key", pa.int64()), ("start", pa.int32())]))
    return run


def _search(window: int):
    def run(shard: pa.Table) -> pa.Table:
        keys, counts = np.unique(np.array(shard.column("key").to_pylist(), dtype=object), return_counts=True)
        first = {k: i for i, k in enumerate(shard.column("key").to_pylist())}
        at = [first[k] for k in keys]
        segments = [w.split(b" ") for w in shard.column("words").take(pa.array(at)).to_pylist()]
        n = shard.column("n").take(pa.array(at)).to_numpy().astype(np.int64)
        flat: list[bytes] = []
        for s in segments:
            flat += s
            flat.append(b"")
        codes, symbols = pd.factorize(np.array(flat, dtype=object))
        end = codes == codes[-1]
        seq = np.where(end, 0, np.where(codes < codes[-1], codes + 1, codes))  # the terminator sorts first
        lengths = n + window
        start = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        fm = FMIndex(seq, len(symbols), np.repeat(counts, lengths), window)
        masks = repeated_windows(fm, seq, start, n)
        hit = [i for i, m in enumerate(masks) if m.any()]
        return pa.table({"key": pa.array([keys[i] for i in hit], pa.binary()),
                         "mask": pa.array([np.packbits(masks[i]).tobytes() for i in hit], pa.binary())})
    return run


def _remove(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in byte_chunks(batches, "text", _CHUNK):
            total, removed, digests, spans = [], [], [], []
            for text, hits in zip(as_bytes(b.column("text")), b.column("hits").to_pylist(), strict=True):
                words = text.split()
                gone = np.zeros(len(words) + 1, dtype=np.int64)
                for h in hits or ():
                    at = np.flatnonzero(np.unpackbits(np.frombuffer(h["mask"], dtype=np.uint8))) + h["start"]
                    np.add.at(gone, at, 1)
                    np.add.at(gone, at + window, -1)
                cover = np.cumsum(gone[:-1]) > 0
                if cover.any():
                    edges = np.flatnonzero(np.diff(np.concatenate([[False], cover, [False]]).astype(np.int8)))
                    spans.append([{"start": int(x), "end": int(y)} for x, y in zip(edges[0::2], edges[1::2], strict=True)])
                    kept = [w for w, c in zip(words, cover.tolist(), strict=True) if not c]
                else:
                    spans.append([])
                    kept = words
                total.append(len(words))
                removed.append(int(cover.sum()))
                digests.append(hashlib.sha256(b" ".join(kept)).hexdigest())
            span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests),
                 pa.array(spans, span)], names=["doc_id", "n_words", "n_removed", "kept_sha256", "spans"])
    return run


def substring_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 35,
                    gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """One row per row of ``df``: doc_id, n_words, n_removed, kept_sha256, spans (removed word ranges).

    A word is removed if a window of ``window`` words covers it whose words also start anywhere else
    in the table, in the same text included.  Defined cases: null text has no words; texts shorter
    than the window lose none; repeated rows are separate documents and so remove each other;
    identifiers may be null or repeat; an empty table gives no rows; other columns are not read.
    """
    spark = df.sparkSession
    gram = min(gram, window)
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    docs = docs.withColumn("row_key", F.xxhash64("doc_id", "text"))
    rows = staged(docs.mapInArrow(_anchor_rows(window, gram),
                                  "doc_id long, row_key long, start int, n int, anchor long"), "substring-anchors")
    often = staged(rows.groupBy("anchor").agg(F.count(F.lit(1)).alias("times")).where("times >= 2"), "substring-often")
    shards = max(1, int(often.agg(F.coalesce(F.sum("times"), F.lit(0))).first()[0]) // SHARD_SEGMENTS)
    lists = (rows.join(often, "anchor")
             .groupBy("doc_id", "row_key")
             # a set: rows repeated as a whole share their segments and hits, and need them once
             .agg(F.collect_set(F.struct("start", "n", "anchor", (F.col("times") > hot).alias("hot"))).alias("segments")))
    lists = lists.select(F.col("doc_id").alias("d"), F.col("row_key").alias("r"), "segments")
    same = F.expr("row_key = r AND doc_id <=> d")
    found = docs.join(lists, same).select("doc_id", "row_key", "text", "segments")
    index = found.mapInArrow(_segments(window, shards, True), "shard long, key binary, n int, words binary")
    masks = (index.repartition(shuffle_partitions(spark), "shard").groupBy("shard")
             .applyInArrow(_search(window), "key binary, mask binary"))
    places = found.mapInArrow(_segments(window, shards, False), "key binary, doc_id long, row_key long, start int")
    hits = (places.join(masks, "key").groupBy("doc_id", "row_key")
            .agg(F.collect_set(F.struct("start", "mask")).alias("hits"))
            .select(F.col("doc_id").alias("d"), F.col("row_key").alias("r"), "hits"))
    return (docs.join(hits, same, "left").select("doc_id", "text", "hits")
            .mapInArrow(_remove(window), "doc_id long, n_words long, n_removed long, kept_sha256 string, "
                                         "spans array<struct<start:long,end:long>>"))
