"""Vector codes, toxicity and spelling variants against plain versions."""

import hashlib
import itertools
import json
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablescope.llm import chains, queries, spelling, toxicity_crf, vector_codes
from tests.conftest import SF_CHECK, SF_SMALL

# ---- vector codes


def plain_codes(data, parts=8, entries=16, rounds=6, scale=4096):
    """(vec_id, embedding, label) rows to (vec_id, code, error, label_error, sha)."""
    import math

    kept = [(i, [math.floor(float(x) * scale) for x in v], lab) for i, v, lab in data
            if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return []
    each = max(1, -(-max(len(v) for _, v, _ in kept) // parts))
    limit = 2**30 // 2 ** max(0, (each - 1).bit_length())
    kept = [(i, [min(limit, max(-limit, x)) for x in v] + [0] * (each * parts - len(v)), lab) for i, v, lab in kept]
    order = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    cut = lambda v, p: v[p * each:(p + 1) * each]
    books = [[cut(v, p) for _, v, _ in order] for p in range(parts)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            groups = defaultdict(list)
            for _, v, _ in kept:
                groups[near(cut(v, p), books[p])[1]].append(cut(v, p))
            books[p] = [[sum(c) // len(groups[k]) for c in zip(*groups[k])] if k in groups else e for k, e in enumerate(books[p])]
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    out, sums = [], Counter()
    for i, v, lab in kept:
        found = [near(cut(v, p), books[p]) for p in range(parts)]
        error = sum(d for d, _ in found)
        sums[lab] += error
        out.append((i, "".join(f"{k:02x}" for _, k in found), error, lab))
    return [(i, c, e, sums[lab], sha) for i, c, e, lab in out]


SCHEMA = "vec_id long, embedding array<float>, label int"


def codes(df, **kw):
    return Counter((r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in vector_codes.vector_codes(df, **kw).collect())


def test_transform_scales_squared_distances_and_is_in_sequency_order():
    for n in (1, 2, 4, 8, 16):
        h = vector_codes.walsh_hadamard(np.eye(n, dtype=np.int64)).T
        assert [int((r[1:] != r[:-1]).sum()) for r in h] == list(range(n))
    rng = np.random.default_rng(0)
    x, e = rng.integers(-50, 50, (300, 5)), rng.integers(-50, 50, (7, 5))
    e[3] = e[1]  # ties go to the lower
    at, d = vector_codes.nearest_entries(vector_codes.walsh_hadamard(x), vector_codes.walsh_hadamard(e))
    full = ((x[:, None] - e[None]) ** 2).sum(axis=2)
    assert (at == full.argmin(axis=1)).all() and (d == full.min(axis=1)).all()


@pytest.mark.parametrize("width", [64, 24, 5])
def test_vector_codes(spark, width):
    rng = np.random.default_rng(width)
    v = rng.normal(size=(120, width)).astype("float32")
    data = [(i * 3, v[i].tolist(), None if i % 7 == 0 else i % 4) for i in range(120)]
    data += [(i, v[5].tolist(), 1) for i in (1, 1, 4)]  # repeated rows
    data += [(2000, None, 1), (2001, [float("nan")] * width, 1), (2002, [None] * width, 1), (2003, [float("inf")] * width, 1),
             (None, v[3].tolist(), 2), (2004, [], 3), (2005, [1.0, -2.0], 3), (2006, [1e30] * width, 3)]
    assert codes(spark.createDataFrame(data, SCHEMA)) == Counter(plain_codes(data))


def test_vector_codes_of_few_equal_or_no_rows(spark):
    few = [(2, [0.5, -0.25, 1.0], None), (1, [0.5, -0.25, 1.0], None)]
    assert codes(spark.createDataFrame(few, SCHEMA)) == Counter(plain_codes(few))
    assert not codes(spark.createDataFrame([], SCHEMA))
    assert not codes(spark.createDataFrame([(1, None, 1)], SCHEMA))
    clash = spark.createDataFrame(few, SCHEMA).selectExpr("*", "'x' AS v", "'y' AS code", "1 AS l", "2 AS part")
    assert codes(clash) == Counter(plain_codes(few))


def test_vector_codes_of_the_whole_table(spark):
    df = spark.read.parquet(f"{SF_SMALL}/embeddings.parquet")
    got = Counter(map(tuple, queries.op11_vector_codes(spark, SF_SMALL).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()))
    assert got == Counter(plain_codes([(r.vec_id, r.embedding, r.label) for r in df.collect()]))


# ---- toxicity


def _texts(n, seed, share=0.3):
    rng = random.Random(seed)
    mild = ["kato", "kina", "kemu", "wurt", "wesp", "grod", "plim", "strunk", "olm", "farn"]
    out = []
    for i in range(n):
        bad = rng.random() < share
        words = [rng.choice(mild) + rng.choice(["", ",", "a", "e"]) for _ in range(rng.randint(5, 60))]
        for _ in range(3 * bad):
            words.insert(rng.randrange(len(words) + 1), "xyqu" + rng.choice(["al", "ed", "in", "or", "um"]) + rng.choice(["", "!", "."]))
        out.append((i, " ".join(words), int(bad)))
    return out


def _frames(spark, data):
    docs = spark.createDataFrame([(i, t) for i, t, _ in data], "doc_id long, text string")
    return docs, spark.createDataFrame([(i, 1, y) for i, _, y in data if y is not None], "doc_id long, quality int, toxic int")


def test_toxicity_of_texts_not_learnt_from(spark):
    data = _texts(600, 1)
    extra = [(1000, None, 0), (1001, "", 0), (1002, " \n", None), (None, "kato xyqual xyquin kina xyqued", None), (1003, "kato " * 30_000 + "xyquor xyqued!", None)]
    docs, labels = _frames(spark, data + extra)
    got = {r.doc_id: r for r in toxicity_crf.toxicity(docs, labels).collect()}
    assert len(got) == 605
    held = [d for d, _, _ in data if zlib.crc32(str(d).encode()) % 3 == 1]
    assert {d for d, r in got.items() if d is not None and d < 1000 and r.held_out} == set(held)
    assert all(got[d].predicted == y for d, _, y in data)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got.values())
    for d, t, y in data[:80]:
        found = [t[s.start:s.end] for s in got[d].spans]
        assert " ".join(found).split() == [w for w in t.split() if w.startswith("xyqu")]
    assert got[1000].score == got[1001].score == got[1002].score < 0.5
    assert got[None].predicted == 1 and got[None].held_out == (zlib.crc32(b"") % 3 == 1)
    assert got[1003].predicted == 1 and got[1003].spans[0].start == 150_000


def test_toxicity_does_not_read_held_out_labels(spark):
    data = _texts(300, 2)
    flipped = [(d, t, 1 - y if zlib.crc32(str(d).encode()) % 3 == 1 else y) for d, t, y in data]
    docs, labels = _frames(spark, data)
    key = lambda r: r.doc_id
    a = sorted(toxicity_crf.toxicity(docs, labels).collect(), key=key)
    b = sorted(toxicity_crf.toxicity(docs.withColumn("lang", F.lit("x")), _frames(spark, flipped)[1]).collect(), key=key)
    assert a == b


def test_toxicity_without_labels_of_both_kinds(spark):
    docs, labels = _frames(spark, [(1, "some words", 1), (2, "more words", 1), (3, "", None)])
    assert {r.score for r in toxicity_crf.toxicity(docs, labels.limit(0)).collect()} == {0.0}
    assert {r.score for r in toxicity_crf.toxicity(docs, labels).collect()} == {1.0}
    assert toxicity_crf.toxicity(docs.limit(0), labels).collect() == []
    nulls = spark.createDataFrame([(None, 1), (1, None), (1, 0), (1, 3)], "doc_id long, toxic int")
    assert {r.score for r in toxicity_crf.toxicity(docs, nulls).collect()} == {1.0}  # the largest label counts
    clash = docs.selectExpr("*", "'s' AS score", "1 AS predicted", "2 AS spans", "3 AS toxic", "4 AS held_out")
    assert toxicity_crf.toxicity(clash, labels).count() == 3


def test_toxicity_on_the_whole_table(spark):
    got = queries.op12_toxicity(spark, SF_CHECK).join(spark.read.parquet(f"{SF_CHECK}/labels.parquet"), "doc_id").toPandas()
    assert len(got) > 300
    held = got[got.held_out]
    assert held[held.toxic == 1].score.median() > 5 * held[held.toxic == 0].score.median()
    assert (held[held.toxic == 0].predicted == 0).mean() > 0.97
    rank = held.score.rank()
    n1, n0 = (held.toxic == 1).sum(), (held.toxic == 0).sum()
    assert (rank[held.toxic == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * n0) > 0.85  # area under the curve


def test_marginals_of_one_label_and_of_extreme_scores():
    one, _ = chains.marginals(np.zeros((5, 1)), np.array([3, 2]), np.zeros((1, 1)))
    assert (one == 1).all()
    em = np.array([[0, 1e6], [1e6, 0], [0, -1e6], [5, 5]], dtype=np.float32)
    for t in (np.zeros((2, 2)), np.array([[900.0, -900], [-900, 0]])):
        got, _ = chains.marginals(em, np.array([4]), t, 2)
        assert np.isfinite(got).all() and np.allclose(got.sum(axis=0), 1)


# ---- spelling variants


def plain_spelling(docs, min_length=7, min_count=2, ratio=10):
    n = Counter()
    for d, t in docs:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = "".join(c.lower() if "A" <= c <= "Z" else c for c in w)
            h = zlib.crc32(f"{'' if d is None else d}:{w}".encode())
            if h % 31 == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            n[w] += 1
    n = {w: c for w, c in n.items() if len(w) >= min_length and c >= min_count}
    by = defaultdict(list)
    for w in n:  # near words share a word with one letter left out, or one is the other's
        for i in range(len(w)):
            by[(w[:i], w[i + 1:])].append(w)
    near = defaultdict(set)
    for group in by.values():
        for a, b in itertools.combinations(group, 2):
            near[a].add(b), near[b].add(a)
    for w in n:
        for i in range(len(w)):
            if (x := w[:i] + w[i + 1:]) in n:
                near[w].add(x), near[x].add(w)
    form = {}
    for w in n:
        if near[w]:
            top = min(near[w], key=lambda x: (-n[x], x))
            if n[top] >= ratio * n[w]:
                form[w] = top

    def root(w):
        while w in form:
            w = form[w]
        return w
    return sorted((w, form.get(w), root(w), c, len(near[w]), n[form[w]] if w in form else None) for w, c in n.items())


def _order(rows):
    return sorted(rows, key=lambda r: json.dumps(r))


def test_edits_and_close_counts():
    rng = random.Random(3)
    words = {"".join(rng.choices("abé", k=rng.randint(3, 6))) for _ in range(300)}
    block = lambda ws: spelling._Block(len(ws[0]), "".join(ws).encode("latin-1"), np.ones(len(ws), dtype="<i8").tobytes())

    def edits(w):
        out = {w[:i] + w[i + 1:] for i in range(len(w))}
        out |= {w[:i] + c + w[i:] for i in range(len(w) + 1) for c in "abé"}
        return out | {w[:i] + c + w[i + 1:] for i in range(len(w)) for c in "abé"} - {w}

    by = defaultdict(list)
    for w in sorted(words):
        by[len(w)].append(w)
    for a in by:
        for b in (a - 1, a, a + 1):
            if b not in by:
                continue
            x, y = block(by[a]), block(by[b])
            got = set()
            for i, j in spelling.close_pairs(x, y):
                ok = spelling.one_edit(x.letters[i], y.letters[j])
                got |= {(by[a][p], by[b][q]) for p, q in zip(i[ok], j[ok])}
            assert got == {(p, q) for p in by[a] for q in by[b] if q in edits(p)}
            for p, q in got:  # no near pair lies outside the blocks that meet
                s, t = spelling.signatures([p.encode("latin-1")]), spelling.signatures([q.encode("latin-1")])
                assert t[0] in spelling.adjacent(s)[0]


def test_spelling_variants(spark, monkeypatch):
    monkeypatch.setattr(spelling, "BLOCK_WORDS", 7)
    rng = random.Random(4)
    base = ["".join(rng.choices("abcdeéüz", k=rng.randint(7, 10))) for _ in range(30)]
    docs = []
    for i in range(300):
        words = []
        for _ in range(rng.randint(0, 40)):
            w = base[min(int(rng.expovariate(0.2)), 29)]
            if rng.random() < 0.2:
                k = rng.randrange(len(w))
                w = rng.choice([w[:k] + w[k + 1:], w[:k] + rng.choice("abcÉ") + w[k:], w[:k] + rng.choice("abcX") + w[k + 1:], w.upper()])
            words.append(w)
        docs.append((i, " ".join(words)))
    docs += [(400, None), (401, ""), (402, "12 -- ½"), (None, f"{base[0]}-{base[1]}_{base[2]}"), (5, docs[5][1]), (5, docs[5][1])]
    docs += [(500 + i, "a" * 5000 + " " + "a" * 4999 + " " + "ab" * 3000) for i in range(3)]
    docs += [(700 + i, "zzzzyyyy " * 40 + "zzzzyyyx " * (3 if i < 8 else 0) + "zzzzyyxx " * (i < 2)) for i in range(10)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = _order(_variants_rows(df))
    exp = _order(plain_spelling(docs))
    assert got == exp and any(r[1] for r in got) and any(r[1] and r[1] != r[2] for r in got)
    clash = df.selectExpr("*", "'x' AS w", "1 AS n", "2 AS h", "'y' AS id", "3 AS word")
    assert _order(_variants_rows(clash)) == exp


def _variants_rows(df):
    return [tuple(r) for r in spelling.spelling_variants(df).select("word", "form", "root", "n", "n_near", "form_n").collect()]


def test_spelling_of_an_empty_table(spark):
    assert _variants_rows(spark.createDataFrame([], "doc_id long, text string")) == []
    assert _variants_rows(spark.createDataFrame([(1, "once only here"), (2, None)], "doc_id long, text string")) == []


def test_spelling_on_the_whole_table(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_CHECK}/documents.parquet").select("doc_id", "text").collect()]
    got = [tuple(r) for r in queries.op13_spelling(spark, SF_CHECK).select("word", "form", "root", "n", "n_near", "form_n").collect()]
    assert _order(got) == _order(plain_spelling(docs))
