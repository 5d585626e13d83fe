"""SimHash near-duplicates by tiled exact comparison.

A fingerprint's *signature* is the population count of each of its four 16-bit parts.  Two
fingerprints differ in at least as many bits as their signatures differ in sum, so only tiles
(groups of fingerprints of one signature) within the radius of each other are compared, by
numpy exclusive-or and bit counts; every other pair of tiles is skipped without loss.  Large
tiles are cut into blocks, and each pair of blocks is work of its own.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablescope.llm.common import as_bytes, byte_chunks, shuffle_partitions, staged, tidy
from tablescope.llm.components import components

SEED = 42
PARTS = 4
#: Fingerprints of a block: bounds the rows that one comparison holds.
BLOCK = 16_384


def fingerprint(text: bytes, shingle: int) -> int:
    """The 64-bit SimHash of the word shingles of ``text`` (A-Z folded; no words: 0)."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - shingle + 1)
    lo, hi = starts[:n].tolist(), ends[len(words) - n:].tolist()
    if len(words) < shingle:
        hi = [len(joined)]
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(lo, hi, strict=True)), np.uint64, n)
    ones = np.zeros(64, dtype=np.int64)
    for a in range(0, n, 100_000):
        bits = np.unpackbits(h[a:a + 100_000].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def _fingerprints(text_col: str, shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in byte_chunks(batches, text_col, 8 << 20):
            fp = np.array([fingerprint(t, shingle) for t in as_bytes(b.column(text_col))], dtype=np.uint64)
            keep = [i for i, n in enumerate(b.schema.names) if n != text_col]
            yield pa.RecordBatch.from_arrays([b.column(i) for i in keep] + [pa.array(fp.view(np.int64))],
                                             names=[b.schema.names[i] for i in keep] + ["fp"])
    return run


def signature(fp: np.ndarray) -> np.ndarray:
    """The population counts of the four parts, packed into one integer (5 bits each)."""
    out = np.zeros(len(fp), dtype=np.int64)
    for p in range(PARTS):
        part = (fp >> np.uint64(16 * p)) & np.uint64(0xFFFF)
        out = out * 32 + np.bitwise_count(part).astype(np.int64)
    return out


def _steps(radius: int) -> list[tuple[int, ...]]:
    """Differences of signatures within the radius, one of each pair of opposites, own tile first."""
    span = range(-radius, radius + 1)
    near = [d for d in itertools.product(span, repeat=PARTS) if sum(map(abs, d)) <= radius]
    return sorted((d for d in near if d >= (0,) * PARTS), key=lambda d: (any(d), d))


def _deal(tiles: dict[int, int], radius: int):
    """Send each fingerprint to every pair of blocks it has to be compared in."""
    steps = _steps(radius)

    def to_pairs(fp: np.ndarray):
        sig = signature(fp)
        counts = np.stack([(sig >> (5 * (PARTS - 1 - p))) & 31 for p in range(PARTS)], axis=1)
        with np.errstate(over="ignore"):
            salt = (fp * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
        own = np.array([tiles.get(int(s), 1) for s in sig], dtype=np.int64)
        block = (salt.astype(np.int64)) % own
        for d in steps:
            for sign in ((1,) if not any(d) else (1, -1)):
                other = counts + np.array(d) * sign
                ok = ((other >= 0) & (other <= 16)).all(axis=1)
                there = np.zeros(len(fp), dtype=np.int64)
                for p in range(PARTS):
                    there = there * 32 + other[:, p]
                n = np.array([tiles.get(int(s), 0) if o else 0 for s, o in zip(there, ok, strict=True)], dtype=np.int64)
                for k in range(int(n.max(initial=0))):
                    at = np.flatnonzero(n > k)
                    if not any(d):  # a tile with itself: unordered pairs of blocks
                        lo, hi = np.minimum(block[at], k), np.maximum(block[at], k)
                        yield at, sig[at], lo, sig[at], hi, block[at] == lo, block[at] == hi
                    elif sign > 0:
                        yield at, sig[at], block[at], there[at], np.full(len(at), k), np.ones(len(at), bool), np.zeros(len(at), bool)
                    else:
                        yield at, there[at], np.full(len(at), k), sig[at], block[at], np.zeros(len(at), bool), np.ones(len(at), bool)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.asarray(b.column(0)).view(np.uint64)
            for at, sa, ba, sb, bb, left, right in to_pairs(fp):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(sa * (1 << 20) + sb), pa.array(ba * (1 << 31) + bb), pa.array(fp[at].view(np.int64)),
                     pa.array(left), pa.array(right)], names=["tiles", "blocks", "fp", "is_left", "is_right"])
    return run


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> list[int]:
    """Positions of pairs that join two trees: the same components with n - 1 links at most."""
    root = list(range(n))
    out = []
    for i, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        while root[y] != y:
            root[y] = root[root[y]]
            y = root[y]
        if x != y:
            root[max(x, y)] = min(x, y)
            out.append(i)
    return out


def _links(left: np.ndarray, right: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    nodes = np.unique(np.concatenate([left, right]))
    found_a, found_b = [], []
    step = max(1, (1 << 20) // max(1, len(right)))
    for a in range(0, len(left), step):
        x, y = np.nonzero(np.bitwise_count(left[a:a + step, None] ^ right[None, :]) <= radius)
        u, v = left[a + x], right[y]
        diff = u != v
        u, v = u[diff], v[diff]
        at = _forest(len(nodes), np.searchsorted(nodes, u), np.searchsorted(nodes, v))
        found_a.append(u[at])
        found_b.append(v[at])
    u, v = np.concatenate(found_a), np.concatenate(found_b)
    at = _forest(len(nodes), np.searchsorted(nodes, u), np.searchsorted(nodes, v))
    return u[at], v[at]


def _compare(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush():
            t = pa.Table.from_batches(held)
            fp = t.column("fp").to_numpy().view(np.uint64)
            left = fp[t.column("is_left").to_numpy().astype(bool)]
            right = fp[t.column("is_right").to_numpy().astype(bool)]
            held.clear()
            if len(left) and len(right):
                u, v = _links(left, right, radius)
                if len(u):
                    return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], names=["u", "v"])
            return None

        key = None
        for b in batches:
            if b.num_rows == 0:
                continue
            k = np.stack([np.asarray(b.column("tiles")), np.asarray(b.column("blocks"))], axis=1)
            cuts = [0, *(np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1).tolist(), b.num_rows]
            for x, y in zip(cuts, cuts[1:], strict=False):
                now = tuple(k[x])
                if held and now != key:
                    out = flush()
                    if out is not None:
                        yield out
                key = now
                held.append(b.slice(x, y - x))
        if held:
            out = flush()
            if out is not None:
                yield out
    return run


def links(fps: DataFrame, radius: int) -> DataFrame:
    """Distinct fingerprints (``fp`` long) to links ``(u, v)`` that have the same components as
    all pairs within ``radius`` bits."""
    spark = fps.sparkSession
    tiles = _tile_blocks(fps)
    dealt = fps.select("fp").mapInArrow(tidy(_deal(tiles, radius)), "tiles long, blocks long, fp long, is_left boolean, is_right boolean")
    return (dealt.repartition(shuffle_partitions(spark), "tiles", "blocks").sortWithinPartitions("tiles", "blocks")
            .mapInArrow(tidy(_compare(radius)), "u long, v long"))


def _tile_blocks(fps: DataFrame) -> dict[int, int]:
    """Blocks of every tile that occurs: at most 17 ** 4 entries, whatever the number of rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sig, n = np.unique(signature(np.asarray(b.column(0)).view(np.uint64)), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(sig), pa.array(n.astype(np.int64))], names=["sig", "n"])
    rows = fps.select("fp").mapInArrow(run, "sig long, n long").groupBy("sig").agg(F.sum("n").alias("n")).collect()
    return {r.sig: -(-r.n // BLOCK) for r in rows}


def simhash_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3,
                  radius: int = 2, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of ``df``: doc_id, fingerprint (16 hex digits), component_id; with ``carry``, these
    columns of ``df`` too, and ``root``, a fingerprint that stands for the component.

    Fingerprints link at ``radius`` or fewer differing bits; ``component_id`` is the smallest
    identifier in the component of a row's fingerprint.  Defined cases: null or wordless text has
    fingerprint 0 and links like any other; a text of fewer words than ``shingle`` has one shingle;
    null identifiers are never the smallest unless a component has no other; repeated rows stay; an
    empty table gives no rows.
    """
    kept = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("__text"), *carry)
    schema = T.StructType([f for f in kept.schema if f.name != "__text"]).add("fp", "long")
    rows = staged(kept.mapInArrow(tidy(_fingerprints("__text", shingle)), schema), "simhash")
    fps = staged(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    roots = components(links(fps, radius))
    named = (fps.join(roots, fps.fp == roots.node, "left")
             .select("fp", "least", F.coalesce("root", "fp").alias("root")))
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = named.join(ids, "root").select("fp", "component_id", "root")
    return (rows.join(by_fp, "fp")
            .select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id",
                    *([*carry, "root"] if carry else ())))
