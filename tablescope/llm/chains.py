"""Linear-chain conditional random fields over the words of texts: features, marginals, fitting.

Features are computed for all distinct words of a batch at once, as integer arrays over their letters,
and need no cache: a worker holds a batch, its distinct words and one matrix of their scores.

A chain runs in blocks that advance together.  Blocks are sorted by length and laid out time-major, so
that the words at one place of all blocks are one slice; for chains of several blocks, products over
each block come first, then one pass over the blocks of each chain.  This is exact for any length.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BUCKETS = 1 << 17
#: Words of a chain that one block holds.
BLOCK = 128
#: A longer run without white space is read as consecutive words of so many letters, each a word of the chain.
PIECE = 64
#: Letters of the words whose features are held at once.
LETTERS = 1 << 18
#: Scores further than this below a word's best are as good as impossible.
FLOOR = -40.0
_LONG = re.compile(r"(\S{%d})(?=\S)" % PIECE)
_K = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


@dataclass
class Words:
    """The words of several texts laid end to end: ``vocab[codes]``, ``lengths`` of them in each text."""

    vocab: pa.Array
    codes: np.ndarray
    lengths: np.ndarray


def split_words(texts: pa.Array) -> Words:
    """What stands between white space; runs of over ``PIECE`` letters are cut into pieces."""
    texts = pc.fill_null(texts.cast(pa.string()), "")
    lists = pc.utf8_split_whitespace(texts)
    flat = lists.flatten().dictionary_encode()
    if len(flat.dictionary) and (pc.max(pc.utf8_length(flat.dictionary)).as_py() or 0) > PIECE:
        cut = pa.array([_LONG.sub(r"\1 ", t) for t in texts.to_pylist()], pa.string())
        lists = pc.utf8_split_whitespace(cut)
        flat = lists.flatten().dictionary_encode()
    vocab = flat.dictionary
    codes = np.asarray(flat.indices, dtype=np.int64)
    lengths = np.diff(np.asarray(lists.offsets, dtype=np.int64))
    empty = pc.index(vocab, "").as_py()  # beside white space at either end of a text
    if empty >= 0:
        use = codes != empty
        lengths = np.bincount(np.repeat(np.arange(len(lengths)), lengths)[use], minlength=len(lengths))
        codes = codes[use]
        codes -= codes > empty
        vocab = pa.concat_arrays([vocab[:empty], vocab[empty + 1:]])
    return Words(vocab, codes, lengths)


def _cuts(words: pa.Array | list[str]):
    """Ranges of consecutive words of ``LETTERS`` letters together at most, or of one word."""
    sizes = np.asarray(pc.utf8_length(words)) if isinstance(words, pa.Array) else np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes, dtype=np.int64)
    a = 0
    while a < len(ends):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + LETTERS, side="right")))
        yield a, b
        a = b


def _joined(words: pa.Array | list[str]) -> str:
    if isinstance(words, pa.Array):
        return pc.binary_join(pa.ListArray.from_arrays([0, len(words)], words), "\n")[0].as_py()
    return "\n".join(words)


def has_letter(texts: pa.Array) -> np.ndarray:
    """Whether a text holds a letter (``\\p{L}``); null does not."""
    return np.asarray(pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False), dtype=bool)


@dataclass
class Grams:
    """Hashed features of words: two-grams of letters (those of word w from ``starts[w]`` on), three-grams
    (from ``starts[w] - w`` on), and one of the whole word, its first three and its last three letters.
    A word's borders count as letters, so that shorter affixes are among the grams."""

    two: np.ndarray
    three: np.ndarray
    single: np.ndarray   # words x 3
    starts: np.ndarray
    sizes: np.ndarray    # features of each word
    whole: np.ndarray    # 64-bit hash of the lower-cased word

    def flat(self) -> tuple[np.ndarray, np.ndarray]:
        """All features, word by word, and where each word's begin."""
        w = np.arange(len(self.starts))
        n = (self.sizes - 4) // 2
        owner = np.concatenate([np.repeat(w, n + 1), np.repeat(w, n), np.repeat(w, 3)])
        order = np.argsort(owner, kind="stable")
        return np.concatenate([self.two, self.three, self.single.ravel()])[order], np.cumsum(self.sizes) - self.sizes


def _bucket(*letters: np.ndarray, kind: int) -> np.ndarray:
    h = np.full(len(letters[0]), (kind * 0x2545F4914F6CDD1D) & (2**64 - 1), dtype=np.uint64)
    for x, k in zip(letters, _K, strict=False):
        h += x * k
    h ^= h >> np.uint64(32)
    h *= _K[1]
    return (h >> np.uint64(47)).astype(np.int32)


def grams(words: pa.Array | list[str]) -> Grams:
    text = "\n" + _joined(words).lower() + "\n"
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    edge = np.flatnonzero(c == 10)
    starts, ends = edge[:-1], edge[1:]
    n = ends - starts - 1
    two = _bucket(c[:-1], c[1:], kind=2)
    three = _bucket(c[:-2], c[1:-1], c[2:], kind=3)[c[1:-1] != 10]
    place = np.arange(len(c) - 1) - np.repeat(starts, n + 1)
    powers = np.full(int(n.max()) + 1, _K[3], dtype=np.uint64)
    powers[0] = 1
    whole = np.add.reduceat(c[:-1] * np.cumprod(powers)[place], starts)
    front = _bucket(*(c[np.minimum(starts + k, ends)] for k in range(4)), kind=4)
    back = _bucket(*(c[np.maximum(ends - k, starts)] for k in range(4)), kind=5)
    return Grams(two, three, np.stack([_bucket(whole, kind=1), front, back], axis=1), starts, 2 * n + 4, whole)


def scores(words: pa.Array | list[str], weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scores by label of each word, divided by the root of its number of features, and the words' hashes."""
    out = np.empty((len(words), weights.shape[1]), dtype=weights.dtype)
    whole = np.empty(len(words), dtype=np.uint64)
    for a, b in _cuts(words):
        g = grams(words[a:b])
        total = np.add.reduceat(weights[g.two], g.starts, axis=0, dtype=float)
        total += np.add.reduceat(weights[g.three], g.starts - np.arange(b - a), axis=0, dtype=float)
        for k in range(3):
            total += weights[g.single[:, k]]
        out[a:b] = total / np.sqrt(g.sizes)[:, None]
        whole[a:b] = g.whole
    return out, whole


def marginals(emissions: np.ndarray, lengths: np.ndarray, transitions: np.ndarray, block: int = BLOCK,
              expect: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Label probabilities (labels x words) of chains of ``lengths`` laid end to end, whose words score
    ``emissions`` (words x labels); with ``expect``, the expected number of each transition, else zeros."""
    n, L = emissions.shape
    lengths = np.asarray(lengths)[np.asarray(lengths) > 0]
    joint = np.zeros((L, L))
    if n == 0:
        return np.empty((L, 0), dtype=emissions.dtype), joint
    blocks = -(-lengths // block)
    lanes = int(blocks.sum())
    first = np.cumsum(blocks) - blocks  # each chain's first lane
    nth = np.arange(lanes) - np.repeat(first, blocks)
    size = np.minimum(block, np.repeat(lengths, blocks) - nth * block)
    order = np.argsort(-size, kind="stable")
    rank = np.empty(lanes, dtype=np.int64)
    rank[order] = np.arange(lanes)
    live = lanes - np.cumsum(np.bincount(size, minlength=block + 1))[:-1]  # lanes with a word at each place
    live = live[live > 0]
    at = np.concatenate([[0], np.cumsum(live)])
    begin = np.cumsum(size) - size
    place = at[np.arange(n) - np.repeat(begin, size)] + np.repeat(rank, size)
    X = np.empty((L, n), dtype=emissions.dtype)
    X[:, place] = np.exp(np.maximum(emissions - emissions.max(axis=1, keepdims=True), FLOOR)).T
    T = np.exp(np.maximum(transitions - transitions.max(), FLOOR)).astype(emissions.dtype)
    opens = nth[order] == 0
    before = np.full((L, lanes), 1.0 / L, dtype=X.dtype)
    after = np.full((L, lanes), 1.0, dtype=X.dtype)
    if lanes > len(lengths):
        _between(X, T, at, live, opens, first, blocks, rank, before, after)
    alpha, beta = np.empty_like(X), np.empty_like(X)
    a = T.T @ before
    a[:, opens] = 1.0  # nothing comes before the first word of a chain
    for t, m in enumerate(live):
        step = slice(at[t], at[t + 1])
        if t:
            a = T.T @ a[:, :m]
        a = a[:, :m] * X[:, step]
        a /= a.sum(axis=0)
        alpha[:, step] = a
    b = after
    for t in range(len(live) - 1, -1, -1):
        step, m = slice(at[t], at[t + 1]), live[t]
        beta[:, step] = b[:, :m]
        if t or expect:
            here = X[:, step] * b[:, :m]
            if expect:  # transitions into this word, but for the first of a chain
                prev = alpha[:, at[t - 1]:at[t - 1] + m] if t else before
                into = T.T @ prev
                total = (into * here).sum(axis=0)
                weight = here / np.maximum(total, 1e-300)
                if t == 0:
                    weight[:, opens] = 0.0
                joint += T * (prev @ weight.T)
            new = T @ here
            b[:, :m] = new / new.sum(axis=0)
    alpha *= beta
    alpha /= alpha.sum(axis=0)
    return alpha[:, place], joint


def _between(X, T, at, live, opens, first, blocks, rank, before, after) -> None:
    """Messages into and out of the blocks of chains that have several: fills ``before`` (ahead of each
    block's first word) and ``after`` (behind its last), both by lane rank."""
    L, lanes = before.shape
    Q = np.broadcast_to(np.eye(L, dtype=X.dtype)[:, :, None], (L, L, lanes)).copy()  # from, to, lane
    for t, m in enumerate(live):
        step = np.matmul(T.T, Q[:, :, :m])
        if t == 0:
            step[:, :, opens[:m]] = 1.0
        step *= X[:, at[t]:at[t + 1]]
        Q[:, :, :m] = step / step.sum(axis=(0, 1))
    many = np.argsort(-blocks, kind="stable")
    for k in range(1, int(blocks.max())):
        c = many[:int(np.searchsorted(-blocks[many], -k, side="left"))]
        lane, prev = rank[first[c] + k], rank[first[c] + k - 1]
        x = np.einsum("il,ijl->jl", before[:, prev], Q[:, :, prev])
        before[:, lane] = x / x.sum(axis=0)
        end = first[c] + blocks[c] - 1 - k
        lane, later = rank[end], rank[end + 1]
        x = np.einsum("ijl,jl->il", Q[:, :, later], after[:, later])
        after[:, lane] = x / x.sum(axis=0)


def fit(vocab: pa.Array, codes: np.ndarray, lengths: np.ndarray, tags: np.ndarray, labels: int,
        members: np.ndarray | None = None, epochs: int = 6, batch: int = 60, seed: int = 11):
    """Adaptive stochastic gradient ascent of the chains' conditional likelihood.  ``members`` (words x
    any) are further features.  Returns weights of hashed features, of members, and transitions."""
    members = np.zeros((len(vocab), 0)) if members is None else members
    weights, extra, transitions = np.zeros((BUCKETS, labels)), np.zeros((members.shape[1], labels)), np.zeros((labels, labels))
    squares = [np.full_like(m, 1e-6) for m in (weights, extra, transitions)]
    lengths = np.asarray(lengths, dtype=np.int64)
    if not len(codes):
        return weights.astype(np.float32), extra, transitions
    parts, at = [], 0
    for a, b in _cuts(vocab):
        g = grams(vocab[a:b])
        f, s = g.flat()
        parts.append((f, s + at, g.sizes))
        at += len(f)
    flat, starts, sizes = (np.concatenate(x) for x in zip(*parts, strict=True))
    bounds = np.concatenate([[0], np.cumsum(lengths)])
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        turn = rng.permutation(np.flatnonzero(lengths))
        for s in range(0, len(turn), batch):
            pick = turn[s:s + batch]
            words = np.concatenate([np.arange(bounds[c], bounds[c + 1]) for c in pick])
            used, local = np.unique(codes[words], return_inverse=True)
            span = np.repeat(starts[used] - np.cumsum(sizes[used]) + sizes[used], sizes[used]) + np.arange(int(sizes[used].sum()))
            f, root = flat[span], np.sqrt(sizes[used])[:, None]
            em = np.add.reduceat(weights[f], np.cumsum(sizes[used]) - sizes[used], axis=0) / root + members[used] @ extra
            gamma, joint = marginals(em[local], lengths[pick], transitions, expect=True)
            truth = tags[words]
            delta = -gamma
            delta[truth, np.arange(len(words))] += 1.0
            grad_word = np.stack([np.bincount(local, weights=d, minlength=len(used)) for d in delta], axis=1) / len(words)
            per_feature = np.repeat(grad_word / root, sizes[used], axis=0)
            grad = np.stack([np.bincount(f, weights=per_feature[:, k], minlength=BUCKETS) for k in range(labels)], axis=1)
            inside = np.ones(len(words), dtype=bool)
            inside[np.cumsum(lengths[pick]) - lengths[pick]] = False
            seen = np.bincount(truth[np.flatnonzero(inside) - 1] * labels + truth[inside], minlength=labels**2).reshape(labels, labels)
            grads = (grad - 1e-7 * weights, members[used].T @ grad_word, (seen - joint) / len(words))
            for m, g, q in zip((weights, extra, transitions), grads, squares, strict=True):
                q += g * g
                m += 0.3 * g / np.sqrt(q)
    return weights.astype(np.float32), extra, transitions
