"""Token ids in a Simple-8b binary format, written and read back.

A shard image (one row of the written table; Spark's writer commits it) holds, little-endian:

    magic "TS8B", version u32, documents u64, ids u64, blocks u64, escapes u64
    document identifiers i64[], identifier-is-null u8[], ids of each document u64[]
    word offset of each block u64[blocks + 1]
    words u64[]
    escapes: position u64[], value u64[]

Ids are cut into blocks of BLOCK ids; a block starts at its own word, so blocks decode on their
own.  A word's highest 4 bits select how many values of how many bits it holds.  Values of 2**60
and more are escapes: 0 in the words, kept aside with their position.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np

BLOCK = 1024
MAGIC, VERSION = b"TS8B", 1
# Selector -> (values, bits of each).
SELECTORS = [(240, 0), (120, 0), (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6),
             (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60)]
_COUNT = np.array([n for n, _ in SELECTORS])
_LARGEST = 1 << 60


def _bit_lengths(values: np.ndarray) -> np.ndarray:
    out = np.zeros(len(values), dtype=np.uint8)
    for width in range(60):
        more = values >= np.uint64(1 << width)
        if not more.any():
            break
        out += more
    return out


def _best_selectors(bits: np.ndarray, block: int) -> np.ndarray:
    """For a word that starts at each position: the selector that takes most values; the rest of a
    block behind its end counts as zeros."""
    n = len(bits)
    rows = -(-n // block)
    pad = max(c for c, _ in SELECTORS)
    wide = np.zeros((rows, block + pad), dtype=np.uint8)
    flat = np.zeros(rows * block, dtype=np.uint8)
    flat[:n] = bits
    wide[:, :block] = flat.reshape(rows, block)
    best = np.full((rows, block), len(SELECTORS) - 1, dtype=np.uint8)
    most, span = wide, 1  # most[:, i]: the largest of ``span`` values from i
    for s in range(len(SELECTORS) - 1, -1, -1):
        count, width = SELECTORS[s]
        while span < count:
            step = min(span, count - span)
            most = np.maximum(most[:, :most.shape[1] - step], most[:, step:])
            span += step
        best[most[:, :block] <= width] = s
    return best


def encode(values: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(words, word offset of each block, escape positions, escape values)."""
    values = np.ascontiguousarray(values, dtype=np.uint64)
    escapes = np.flatnonzero(values >= np.uint64(_LARGEST))
    kept = values[escapes]
    if len(escapes):
        values = values.copy()
        values[escapes] = 0
    n = len(values)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(1, np.uint64), escapes.astype(np.uint64), kept
    best = _best_selectors(_bit_lengths(values), block)
    rows = len(best)
    ends = np.full(rows, block)
    ends[-1] = n - (rows - 1) * block
    # all blocks advance together, one word a step
    at, live = np.zeros(rows, dtype=np.int64), np.arange(rows)
    row_of, start_of = [], []
    while len(live):
        row_of.append(live)
        start_of.append(at[live])
        at[live] += _COUNT[best[live, at[live]]]
        live = live[at[live] < ends[live]]
    row, start = np.concatenate(row_of), np.concatenate(start_of)
    order = np.lexsort((start, row))
    row, start = row[order], start[order]
    offsets = np.searchsorted(row, np.arange(rows + 1)).astype(np.uint64)
    selector = best[row, start]
    padded = np.zeros((rows, block + _COUNT.max()), dtype=np.uint64)
    flat = np.zeros(rows * block, dtype=np.uint64)
    flat[:n] = values
    padded[:, :block] = flat.reshape(rows, block)
    words = selector.astype(np.uint64) << np.uint64(60)
    for s, (count, width) in enumerate(SELECTORS):
        here = np.flatnonzero(selector == s)
        if width and len(here):
            for j in range(count):
                words[here] |= padded[row[here], start[here] + j] << np.uint64(j * width)
    return words, offsets, escapes.astype(np.uint64), kept


def decode(words: np.ndarray, offsets: np.ndarray, n: int, block: int = BLOCK,
           escapes: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """The ``n`` values of all blocks, every selector's words at once."""
    if n == 0:
        return np.zeros(0, dtype=np.uint64)
    offsets = offsets.astype(np.int64)
    selector = (words >> np.uint64(60)).astype(np.int64)
    counts = _COUNT[selector]
    before = np.cumsum(counts) - counts
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    start = before - before[offsets[:-1]][row]
    out = np.zeros((len(offsets) - 1, block + int(_COUNT.max())), dtype=np.uint64)
    for s, (count, width) in enumerate(SELECTORS):
        here = np.flatnonzero(selector == s)
        if width and len(here):
            mask = np.uint64((1 << width) - 1)
            for j in range(count):
                out[row[here], start[here] + j] = (words[here] >> np.uint64(j * width)) & mask
    out = out[:, :block].reshape(-1)[:n].copy()
    if escapes is not None and len(escapes[0]):
        out[escapes[0].astype(np.int64)] = escapes[1]
    return out


def write_image(ids: list[int | None], lengths: np.ndarray, values: np.ndarray) -> bytes:
    words, offsets, where, what = encode(values)
    null = np.array([d is None for d in ids], dtype=np.uint8)
    return b"".join([
        MAGIC, struct.pack("<IQQQQ", VERSION, len(ids), len(values), len(offsets) - 1, len(where)),
        np.array([d or 0 for d in ids], dtype="<i8").tobytes(), null.tobytes(), np.asarray(lengths).astype("<u8").tobytes(),
        offsets.astype("<u8").tobytes(), words.astype("<u8").tobytes(), where.astype("<u8").tobytes(), what.astype("<u8").tobytes()])


def read_image(image: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """(identifiers, ids of each document, all ids)."""
    if image[:4] != MAGIC:
        raise ValueError("not a TS8B image")
    version, docs, n, blocks, escapes = struct.unpack_from("<IQQQQ", image, 4)
    if version != VERSION:
        raise ValueError(f"TS8B version {version}")
    at = 4 + struct.calcsize("<IQQQQ")

    def take(kind: str, count: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(image, kind, count, at)
        at += out.nbytes
        return out

    numbers, null, lengths, offsets = take("<i8", docs), take("u1", docs), take("<u8", docs), take("<u8", blocks + 1)
    words = take("<u8", int(offsets[-1]) if blocks else 0)
    where, what = take("<u8", escapes), take("<u8", escapes)
    ids = [None if z else d for d, z in zip(numbers.tolist(), null.tolist(), strict=True)]
    return ids, lengths.astype(np.int64), decode(words, offsets, n, BLOCK, (where, what))


def images(rows: Iterator[tuple[int | None, np.ndarray]], limit: int) -> Iterator[tuple[bytes, int, int]]:
    """(image, documents, ids) of consecutive documents, ``limit`` ids at most or one document."""
    ids, parts, total = [], [], 0
    for doc, values in rows:
        if ids and total + len(values) > limit:
            yield write_image(ids, np.array(list(map(len, parts))), np.concatenate(parts)), len(ids), total
            ids, parts, total = [], [], 0
        ids.append(doc)
        parts.append(values)
        total += len(values)
    if ids:
        yield write_image(ids, np.array(list(map(len, parts))), np.concatenate(parts)), len(ids), total
