"""A compressed FM-index over integer sequences: wavelet matrix, backward search, block truncation."""

from __future__ import annotations

import numpy as np


class WaveletMatrix:
    """Bit vectors with rank, one for each binary digit of the symbols, most significant first."""

    def __init__(self, symbols: np.ndarray, size: int):
        self.levels = max(1, int(size - 1).bit_length())
        self.bits, self.ranks, self.zeros = [], [], []
        n = len(symbols)
        seq = symbols.astype(np.uint32)
        words = (n >> 6) + 1
        for level in range(self.levels - 1, -1, -1):
            bit = ((seq >> np.uint32(level)) & np.uint32(1)).astype(bool)
            packed = np.zeros(words * 64, dtype=np.uint8)
            packed[:n] = bit
            packed = np.packbits(packed, bitorder="little").view("<u8")
            counts = np.bitwise_count(packed).astype(np.int64)
            self.bits.append(packed)
            self.ranks.append(np.concatenate([[0], np.cumsum(counts)[:-1]]))
            self.zeros.append(n - int(bit.sum()))
            seq = np.concatenate([seq[~bit], seq[bit]])

    def descend(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where position ``at`` maps to, following each symbol's digits through all levels."""
        at = at.astype(np.int64)
        for k in range(self.levels):
            one = ((symbols >> (self.levels - 1 - k)) & 1).astype(bool)
            word = at >> 6
            low = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
            rank = self.ranks[k][word] + np.bitwise_count(self.bits[k][word] & low)
            at = np.where(one, self.zeros[k] + rank, at - rank)
        return at


def suffix_order(seq: np.ndarray, depth: int) -> tuple[np.ndarray, dict[int, np.ndarray]]:
    """Suffixes sorted by their first ``depth`` symbols (0 behind the end), and the ranks of the
    shorter prefixes used on the way, by length.  Ranks of several prefixes are joined in one
    64-bit key as long as they fit, so that few sorts are needed."""
    n = len(seq)
    rank, length = seq.astype(np.int64), 1
    ranks = {1: rank}

    def shifted(a: np.ndarray, by: int) -> np.ndarray:
        out = np.zeros(n, dtype=np.int64)
        if by < n:
            out[:n - by] = a[by:]
        return out

    while True:
        bits = max(1, int(rank.max(initial=0) + 1).bit_length())
        arity = max(2, min(62 // bits, -(-depth // length)))
        step = min(length, -(-(depth - length) // (arity - 1)))
        key = rank.copy()
        for j in range(1, arity):
            key = (key << bits) | (shifted(rank, j * step) + 1 if j * step < n else 0)
        order = np.argsort(key, kind="stable")
        in_order = key[order]
        fresh = np.concatenate([[0], (in_order[1:] != in_order[:-1]).astype(np.int64)])
        rank = np.empty(n, dtype=np.int64)
        rank[order] = np.cumsum(fresh)
        length += (arity - 1) * step
        ranks[length] = rank
        if length >= depth:
            return order, ranks


class FMIndex:
    """Backward search over sequences that end in symbol 0, for patterns of ``window`` + 1 symbols at most."""

    def __init__(self, seq: np.ndarray, size: int, weight: np.ndarray, window: int):
        n = len(seq)
        order, ranks = suffix_order(seq, window + 1)
        self.n, self.window = n, window
        self.first = np.concatenate([[0], np.cumsum(np.bincount(seq, minlength=size))])[:size]
        self.wavelet = WaveletMatrix(seq[order - 1], size)
        self.offset = self.first - self.wavelet.descend(np.arange(size), np.zeros(size, dtype=np.int64))
        self.weight = np.concatenate([[0], np.cumsum(weight[order])])
        # suffixes that agree in their first ``window`` symbols make a block
        short = max(k for k in ranks if k <= window)
        same = np.ones(max(0, n - 1), dtype=bool)
        for shift in sorted({*range(0, window - short + 1, short), window - short}):
            at = order + shift
            r = np.where(at < n, ranks[short][np.minimum(at, n - 1)], -1)
            same &= r[1:] == r[:-1]
        starts = np.flatnonzero(np.concatenate([[True], ~same]))
        self.block = np.cumsum(np.concatenate([[True], ~same])) - 1
        self.block_start, self.block_end = starts, np.append(starts[1:], n)

    def extend(self, symbols: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the patterns with one symbol more in front."""
        both = self.wavelet.descend(np.concatenate([symbols, symbols]), np.concatenate([lo, hi]))
        both += np.concatenate([self.offset[symbols]] * 2)
        return both[:len(lo)], both[len(lo):]

    def truncate(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the first ``window`` symbols of the (longer) patterns."""
        return self.block_start[self.block[lo]], self.block_end[self.block[np.maximum(hi - 1, lo)]]

    def occurrences(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        return self.weight[hi] - self.weight[lo]


def repeated_windows(fm: FMIndex, seq: np.ndarray, start: np.ndarray, windows: np.ndarray) -> list[np.ndarray]:
    """For each query (``windows`` windows of the sequence at ``start``): which occur twice or more.

    All queries go backwards in step: the last window is searched in full, then each step adds one
    symbol in front and cuts one at the end.
    """
    T = fm.window
    out = [np.zeros(int(w), dtype=bool) for w in windows]
    turn = np.argsort(-windows, kind="stable")
    start, windows = start[turn], windows[turn]
    end = start + windows + T - 1
    lo, hi = np.zeros(len(turn), dtype=np.int64), np.full(len(turn), fm.n, dtype=np.int64)
    for j in range(1, T + 1):
        lo, hi = fm.extend(seq[end - j], lo, hi)
    flags = np.zeros((len(turn), int(windows.max(initial=0))), dtype=bool)
    live = len(turn)
    step = 1
    while live:
        flags[np.arange(live), windows[:live] - step] = fm.occurrences(lo[:live], hi[:live]) >= 2
        step += 1
        live = int(np.searchsorted(-windows, -step, side="right"))
        lo, hi = fm.extend(seq[end[:live] - T - step + 1], lo[:live], hi[:live])
        lo, hi = fm.truncate(lo, hi)
    for i, q in enumerate(turn.tolist()):
        out[q] = flags[i, :windows[i]]
    return out
