"""Plain single-process versions of the operators, for small tables."""

import base64
import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import xxhash

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall((text or "").encode())


def fold(text):
    return (text or "").encode().lower()


def substring(docs, window):
    toks = [words(t) for _, t in docs]
    seen = Counter(tuple(w[i:i + window]) for w in toks for i in range(len(w) - window + 1))
    out = []
    for (doc, _), w in zip(docs, toks):
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i:i + window])] > 1:
                gone[i:i + window] = [True] * window
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out.append((doc, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return out


def simhash(docs, shingle, radius):
    fps = []
    for _, t in docs:
        w = WORD.findall(fold(t))
        grams = [b" ".join(w[i:i + shingle]) for i in range(max(1, len(w) - shingle + 1))] if w else []
        h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
        fps.append(sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h)))
    f = np.array(fps, dtype=np.uint64)
    root = list(range(len(f)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(f)):
        for j in np.flatnonzero(np.bitwise_count(f[i] ^ f[i + 1:]) <= radius):
            a, b = find(i), find(i + 1 + int(j))
            root[max(a, b)] = min(a, b)
    least = {}
    for i, (d, _) in enumerate(docs):
        r = find(i)
        if d is not None and (least.get(r) is None or d < least[r]):
            least[r] = d
        least.setdefault(r, None)
    return [(d, f"{x:016x}", least[find(i)]) for i, ((d, _), x) in enumerate(zip(docs, fps))]


def unigrams(docs, folds, held):
    """(doc, held out, tokens, known, training tokens, base score)"""
    toks = [WORD.findall(fold(t)) + [None] for _, t in docs]
    out = [zlib.crc32(str("" if d is None else d).encode()) % folds == held for d, _ in docs]
    c = Counter(w for t, o in zip(toks, out) if not o for w in t)
    n, v = sum(c.values()), len(c)
    return [(d, o, len(t), sum(c[w] > 0 for w in t), n, float(sum(np.log10((c[w] + 1) / (n + v + 1)) for w in t)))
            for (d, _), t, o in zip(docs, toks, out)]


def _discounts(counts):
    k = 5
    n = Counter(counts)
    d = {r: 1.0 for r in range(1, k + 2)}
    if n[1]:
        absolute = n[1] / (n[1] + 2 * n[2])
        tail = (k + 1) * n[k + 1] / n[1]
        for r in range(1, k + 1):
            good = (r + 1) * n[r + 1] / (r * n[r]) if n[r] else 0.0
            gt = (good - tail) / (1 - tail) if tail < 1 else 0.0
            d[r] = gt if 0 < gt < 1 else max(1e-3, 1 - absolute / r)
    return lambda c: d[min(c, k + 1)]


class Katz:
    """The bigram model with dictionaries; ``p(h, w)``, with None as the end and "<s>" as the start."""

    def __init__(self, chains):
        self.c1 = Counter(w for t in chains for w in t)
        self.n = sum(self.c1.values())
        self.d1 = _discounts(self.c1.values())
        self.unknown = sum(c * (1 - self.d1(c)) for c in self.c1.values()) / self.n if self.n else 0
        self.scale = 1.0
        if self.unknown <= 0:
            self.unknown, self.scale = 1 / (self.n + 1), self.n / (self.n + 1)
        self.c2 = Counter(p for t in chains for p in zip(["<s>", *t], t))
        self.d2 = _discounts(self.c2.values())
        self.after = defaultdict(dict)
        for (h, w), c in self.c2.items():
            self.after[h][w] = c

    def p1(self, w):
        c = self.c1.get(w, 0)
        return self.d1(c) * c / self.n * self.scale if c else self.unknown

    def p(self, h, w):
        seen = self.after.get(h)
        if not seen:
            return self.p1(w)
        n = sum(seen.values())
        left = sum((1 - self.d2(c)) * c for c in seen.values()) / n
        scale = 1.0
        if left <= 0:
            left, scale = 1 / (n + 1), n / (n + 1)
        if w in seen:
            return scale * self.d2(seen[w]) * seen[w] / n
        return left / (1 - sum(map(self.p1, seen))) * self.p1(w)


def katz(docs, folds, held):
    toks = [WORD.findall(fold(t)) + [None] for _, t in docs]
    out = [zlib.crc32(str("" if d is None else d).encode()) % folds == held for d, _ in docs]
    m = Katz([t for t, o in zip(toks, out) if not o])
    return m, [float(sum(np.log10(m.p(h, w)) for h, w in zip(["<s>", *t], t))) for t in toks]


def sha1_32(payload):
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def cosine_top(rows, k, every):
    """{query: [(score, candidate)]} over all rows, exactly."""
    ok = [(i, np.array(v, dtype=float)) for i, v in rows
          if i is not None and v is not None and len(v) and all(x is not None for x in v)]
    ok = [(i, v) for i, v in ok if np.isfinite(v).all() and v.any()]
    out = {}
    for q, v in ok:
        if q % every:
            continue
        s = sorted((-float(v @ w / np.sqrt((v @ v) * (w @ w))), i) for i, w in ok if i != q and len(w) == len(v))[:k]
        out[q] = [(i, -x) for x, i in s]
    return out
