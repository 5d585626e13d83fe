"""The operators of tablescope.llm against plain single-process versions, and their edge cases."""

import gzip
import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tablescope.llm import (chains, katz, language_crf, mixing, packing, simhash, simple8b, substring_dedup, tokens, vamana,
                            warc, wavelet)
from tablescope.llm.components import components
from tablescope.llm.exact_dedup import exact_dedup
from tablescope.llm.token_output import token_round_trip

from . import brute

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(n=160, seed=1):
    """Documents with copies, near copies, a shared passage, nulls, empty, odd and long texts."""
    rng = random.Random(seed)
    vocab = ["the", "of", "and"] * 6 + ["".join(rng.choices("aeioulmnrst", k=rng.randint(2, 7))) for _ in range(400)]
    passage = " ".join(rng.choices(vocab, k=50))
    docs = []
    for i in range(n):
        words = rng.choices(vocab, k=rng.randint(1, 160))
        if i % 9 == 0:
            words[len(words) // 2:len(words) // 2] = passage.split(" ")
        text = rng.choice([" ", "  ", "\n"]).join(words)
        if i % 7 == 3 and docs:
            text = rng.choice(docs)[1] or ""
            text = text.upper() if i % 2 else text
        if i % 11 == 5 and docs:
            parts = (rng.choice(docs)[1] or "").split(" ")
            parts[rng.randrange(len(parts))] = "changed"
            text = " ".join(parts)
        docs.append((i, text))
    docs += [(n, None), (n + 1, ""), (n + 2, " \t\n "), (n + 3, "É É é ı"), (n + 4, "one two"), (n + 5, "x " * 9000),
             (n + 6, passage), (n + 6, passage), (None, "no identifier " * 3), (None, "no identifier " * 3), (None, None)]
    return docs


def frame(spark, docs, parts=5):
    rows = [(d, t, ["en", "fr", "de", None][k % 4], f"src{k % 6}" if k % 13 else None, len(t or "")) for k, (d, t) in enumerate(docs)]
    return spark.createDataFrame(rows, SCHEMA).repartition(parts)


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=lambda r: tuple((x is None, x) for x in r))


def ordered(it):
    return sorted(it, key=lambda r: tuple((x is None, x) for x in r))


@pytest.fixture(scope="module")
def docs():
    return corpus()


@pytest.mark.parametrize("keep", ["smallest", "largest"])
@pytest.mark.parametrize("parts", [3, 40])
def test_exact_dedup(spark, docs, keep, parts):
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    copies = docs + [(1000 + i, "a hot text") for i in range(300)]
    try:
        got = exact_dedup(frame(spark, copies), keep=keep).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 8)
    groups = {}
    for d, t in copies:
        groups.setdefault(brute.fold(t), []).append(d)
    best = {t: (min if keep == "smallest" else max)((d for d in ds if d is not None), default=None) for t, ds in groups.items()}
    exp = ordered((d, best[brute.fold(t)], len(groups[brute.fold(t)]), hashlib.sha256(brute.fold(t)).hexdigest()) for d, t in copies)
    assert ordered((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == exp
    kept = [(r.text_sha256, r.doc_id, r.keep_id) for r in got if r.kept]
    assert len(kept) == len(groups) == len({k for k, _, _ in kept})
    assert all(d == k for _, d, k in kept)


@pytest.mark.parametrize("hot", [1, 1000])
def test_substring_dedup(spark, docs, hot):
    got = rows(substring_dedup.substring_dedup(frame(spark, docs), window=12, gram=5, hot=hot), "doc_id", "n_words", "n_removed", "kept_sha256")
    exp = ordered(brute.substring(docs, 12))
    assert got == exp and sum(r[2] for r in exp) > 0


def test_substring_long_text_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "_CHUNK", 64)
    rng = random.Random(3)
    texts = [b" ".join(rng.choices([b"a", b"bb", b"c"], k=300)), b"x y"]
    window, gram = 6, 3
    seen = set()
    for piece, offset in substring_dedup._pieces(texts[:1], window):
        _, s, n, _ = substring_dedup.anchors(piece, window, gram)
        for a, m in zip(s + offset, n):
            new = set(range(a, a + m))
            assert not seen & new
            seen |= new
    assert seen == set(range(300 - window + 1))


@settings(max_examples=25, deadline=None)
@given(st.lists(st.lists(st.integers(1, 3), min_size=4, max_size=25), min_size=1, max_size=6), st.integers(2, 4))
def test_fm_index_counts_windows(seqs, window):
    seqs = [s for s in seqs if len(s) >= window] or [[1] * window]
    seq = np.array([x for s in seqs for x in [*s, 0]])
    start = np.cumsum([0, *(len(s) + 1 for s in seqs)])[:-1]
    fm = wavelet.FMIndex(seq, 4, np.ones(len(seq), dtype=np.int64), window)
    got = wavelet.repeated_windows(fm, seq, start, np.array([len(s) - window + 1 for s in seqs]))
    grams = [[tuple(s[i:i + window]) for i in range(len(s) - window + 1)] for s in seqs]
    flat = [g for x in grams for g in x]
    assert [m.tolist() for m in got] == [[flat.count(g) >= 2 for g in x] for x in grams]


def test_katz(spark, docs):
    got = katz.katz_scores(frame(spark, docs)).collect()
    exp = brute.unigrams(docs, 7, 2)
    assert ordered(tuple(r)[:5] for r in got) == ordered(e[:5] for e in exp)
    model, scores = brute.katz(docs, 7, 2)
    key = lambda d, n, k: (d is None, d or 0, n, k)
    a = sorted((key(r.doc_id, r.n_tokens, r.n_known), r.base_score, r.score) for r in got)
    b = sorted((key(e[0], e[2], e[3]), e[5], s) for e, s in zip(exp, scores))
    assert [x[0] for x in a] == [x[0] for x in b]
    np.testing.assert_allclose([x[1:] for x in a], [x[1:] for x in b], rtol=1e-9)
    for h in ["<s>", b"the", b"unseen-history", max(model.after, key=lambda w: len(model.after[w]))]:
        assert abs(sum(model.p(h, w) for w in model.c1) + model.p(h, "unknown word") - 1) < 1e-9


def test_katz_without_training_rows(spark):
    got = katz.katz_scores(frame(spark, [(d, "a b") for d in range(40) if zlib.crc32(str(d).encode()) % 7 == 2])).collect()
    assert got and all(r.score == 0 and r.base_score == 0 and r.train_tokens == 0 and r.held_out for r in got)


def test_katz_pack_round_trip():
    for a in (np.array([], dtype=np.int64), np.array([0, 255]), np.array([70000, 3]), np.array([1 << 40]), np.array([1.5, -2.0])):
        np.testing.assert_array_equal(katz.unpack(katz.pack(a)), a)


@pytest.mark.parametrize("block", [3, 16_384])
def test_simhash(spark, docs, block, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", block)
    got = rows(simhash.simhash_dedup(frame(spark, docs), radius=6), "doc_id", "fingerprint", "component_id")
    exp = ordered(brute.simhash(docs, 3, 6))
    assert got == exp and any(c is not None and c != d for d, _, c in exp)


def test_components_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(90)] + [(200, 201), (5, 5)], "u long, v long")
    got = dict(rows(components(edges), "node", "root"))
    assert got == {**{i: 0 for i in range(91)}, 200: 200, 201: 200}


def _mixed(spark, docs, **kw):
    return mixing.mix(frame(spark, docs), F.col("lang"), F.col("lang"), F.col("source"), domain_weights={"en": 5, "de": 0}, **kw)


def test_mixing_budget(spark, docs):
    got = _mixed(spark, docs, budget_share=0.5, max_epochs=3).collect()
    assert len(got) == len(docs)
    total = sum(r.n_tokens for r in got)
    assert total == sum(len(brute.words(t)) for _, t in docs)
    assert all(r.copies == 0 for r in got if r.domain == "de" and r.n_tokens)
    taken = sum(r.n_tokens * r.copies for r in got)
    longest = max(r.n_tokens for r in got)
    leaves = len({(r.domain, r.language, r.source) for r in got})
    assert int(total * 0.5) - leaves <= taken <= int(total * 0.5) + leaves * longest
    assert max(r.copies for r in got) <= 3
    again = _mixed(spark, docs, budget_share=0.5, max_epochs=3, rows=True)
    assert again.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert again.count() == sum(r.copies for r in got)


def test_mixing_shortage_goes_to_siblings_first(spark):
    leaf = [("a", "x", "s1", 10), ("a", "x", "s2", 1000), ("a", "y", "s3", 1000), ("b", "x", "s4", 5000)]
    leaves = spark.createDataFrame(leaf, "domain string, language string, source string, tokens long")
    got = {r.source: r.given for r in mixing.leaf_budgets(leaves, F.lit(800), 1, None, None, None).collect()}
    # a and b take 400 each; in a, x and y take 200 each; s1 can give 10, its sibling s2 the other 190
    assert got == {"s1": 10, "s2": 190, "s3": 200, "s4": 400}


def test_mixing_is_native():
    source = open(mixing.__file__).read()
    assert not any(x in source for x in ("mapIn", "applyIn", "udf", "pandas", "pyarrow", ".rdd"))


@pytest.mark.parametrize("text", ["a  b", " lead", "tail  ", "a \n\n b", "x\n  y", "it's 12% é漢字 <|endoftext|>", "", "   x",
                                  "a \n", "\t \tq", "we'll  go\r\n now "])
def test_token_ids_equal_the_library(text):
    enc = tokens.Encoder(tokens.default_path())
    exp = enc._tokenizer.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(enc.ids(text), "<u4").tolist() == exp


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab ,.'\n\t 1é ", max_size=30))
def test_token_ids_equal_the_library_for_any_blanks(text):
    enc = tokens.Encoder.of(tokens.default_path())
    assert np.frombuffer(enc.ids(text), "<u4").tolist() == enc._tokenizer.encode(text, add_special_tokens=False).ids


@settings(max_examples=40, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 60000), st.integers(0, (1 << 64) - 1)), max_size=400), st.sampled_from([16, 1024]))
def test_simple8b_round_trip(values, block):
    a = np.array(values, dtype=np.uint64)
    w, o, where, what = simple8b.encode(a, block)
    np.testing.assert_array_equal(simple8b.decode(w, o, len(a), block, (where, what)), a)


def test_simple8b_packs_zeros_tightly():
    words, *_ = simple8b.encode(np.zeros(1024, dtype=np.uint64))
    assert len(words) <= 6


def _ids(docs):
    enc = tokens.Encoder.of(tokens.default_path())._tokenizer
    return [(d, np.array(enc.encode(t or "", add_special_tokens=False).ids + [0], dtype="<u4")) for d, t in docs]


def test_token_round_trip(spark, docs):
    got = rows(token_round_trip(frame(spark, docs)), "start", "doc_id", "n_tokens", "ids_crc32")
    ids = _ids(docs)
    assert sorted((d is not None, d or 0, n, c) for _, d, n, c in got) == sorted((d is not None, d or 0, len(x), zlib.crc32(x.tobytes())) for d, x in ids)
    at = 0
    for start, _, n, _ in got:
        assert start == at
        at += n
    named = [d for _, d, _, _ in got if d is not None]
    assert named == sorted(named)


def test_packing(spark, docs):
    got = packing.pack(frame(spark, docs), window=64).collect()
    exp = {}
    for d, x in _ids(docs):
        exp.setdefault((d, len(x)), []).append(x)
    by_seq, by_doc = {}, {}
    for r in got:
        by_seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
        by_doc.setdefault((r.doc_id, r.doc_tokens), []).append((r.start, r.length, r.ids_crc32))
    short = 0
    for s in by_seq.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at <= 64
        short += at < 64
    assert short <= 1
    assert by_doc.keys() == exp.keys()
    for k, pieces in by_doc.items():
        assert sum(n for _, n, _ in pieces) == sum(map(len, exp[k]))
        if len(exp[k]) == 1:
            x, at = exp[k][0], 0
            for start, n, crc in sorted(pieces):
                assert start == at and crc == zlib.crc32(x[start:start + n].tobytes())
                at += n


def test_nnls_meets_a_solvable_histogram():
    h = np.zeros(64, dtype=np.int64)
    h[[20, 44]] = 1000
    h[32] = 500
    combos, repeat = packing.plan_sequences(h, 64)
    used = np.zeros(64, dtype=np.int64)
    for c, n in zip(combos, repeat):
        assert c.sum() == 64
        for x in c[c > 0]:
            used[x] += n
    assert (used <= h).all() and used.sum() >= 0.95 * h.sum()


def _chain_marginals(E, T):
    """Marginals by enumeration of all label sequences."""
    import itertools

    n, L = E.shape
    out = np.zeros((n, L))
    for tags in itertools.product(range(L), repeat=n):
        p = np.exp(sum(E[i, t] for i, t in enumerate(tags)) + sum(T[a, b] for a, b in zip(tags, tags[1:])))
        for i, t in enumerate(tags):
            out[i, t] += p
    return out / out.sum(axis=1, keepdims=True)


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(0)
    lengths = np.array([1, 5, 2, 7, 4])
    E, T = rng.normal(size=(lengths.sum(), 3)), rng.normal(size=(3, 3))
    for block in (1, 2, 3, 64):
        got, joint = language_crf.forward_backward(E, lengths, T, block)
        exp = np.concatenate([_chain_marginals(E[a:a + n], T) for a, n in zip(np.cumsum(lengths) - lengths, lengths)])
        np.testing.assert_allclose(got, exp, atol=1e-9)
        assert abs(joint.sum() - (lengths - 1).sum()) < 1e-9


LANGS = {"aa": ["kato", "kina", "kemu", "kola", "suke"], "bb": ["wurt", "wesp", "grod", "plim", "strunk"]}


def _tongue(rng, lang, n):
    return " ".join(rng.choice(LANGS[lang]) for _ in range(n))


def test_language_id(spark):
    rng = random.Random(5)
    data = [(i, _tongue(rng, lang, rng.randint(3, 60)), lang) for i in range(200) for lang in [rng.choice(["aa", "bb"])]]
    data += [(900, None, "aa"), (901, "", "aa"), (902, "123 456 --", "bb"), (None, "kato kina", None)]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in language_crf.identify(df).collect()}
    for d, t, lang in data[:200]:
        r = got[d]
        assert r.held_out == (zlib.crc32(str(d).encode()) % 4 == 2)
        assert r.lang_pred == lang and 0 < r.score <= 1
    assert all(got[d].lang_pred == "und" and got[d].score == 0 for d in (900, 901, 902))
    assert got[None].lang_pred == "aa"


def test_language_of_each_word_in_switched_text(spark):
    rng = random.Random(6)
    model = language_crf.train([_tongue(rng, x, 40) for x in ("aa", "bb") * 30], ["aa", "bb"] * 30)
    text = _tongue(rng, "aa", 12) + " 77 " + _tongue(rng, "bb", 12)
    df = spark.createDataFrame([(text, "kept")], "text string, score string")
    out = language_crf.predict(df, model, with_words=True)
    assert out.columns == ["text", "lang_pred", "score", "word_langs"]
    tags = out.first().word_langs
    assert tags[:12] == ["aa"] * 12 and tags[13:] == ["bb"] * 12


def test_language_without_labels(spark):
    df = spark.createDataFrame([(1, "some words", None)], "doc_id long, text string, lang string")
    assert [(r.lang_pred, r.score) for r in language_crf.identify(df).collect()] == [("und", 0.0)]


def test_nearest(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(700, 16)).astype("float32")
    data = [(i, base[i].tolist()) for i in range(700)] + [(2000 + i, base[7].tolist()) for i in range(40)]
    data += [(3000, None), (3050, []), (3100, [0.0] * 16), (3150, [float("nan")] * 16), (3200, [None] * 16), (None, base[1].tolist()),
             (3250, [1.0, 2.0]), (3300, [2.0, 1.0]), (7, base[7].tolist())]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>")
    got = {}
    for r in vamana.nearest(df, k=5, every=50, shard_points=250).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    exp = brute.cosine_top(data, 5, 50)
    assert got.keys() == exp.keys()
    hits = total = 0
    for q, near in exp.items():
        total += len(near)
        hits += len({i for i, _ in near} & {i for i, _ in got[q]})
        true = dict(near)
        assert all(abs(s - true[i]) < 1e-12 for i, s in got[q] if i in true)
        assert got[q] == sorted(got[q], key=lambda x: (-x[1], x[0]))
    assert hits / total >= 0.9
    assert got[3250] == [(3300, pytest.approx(0.8))]


def test_nearest_of_scaled_copies(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(600, 12))
    data = [(i, base[i].tolist()) for i in range(600)]
    # 500 vectors of one direction, of every size; and two identifiers that repeat with other sizes
    data += [(10_000 + i, (base[9] * (0.37 + 1.13 * i) * 10.0 ** (i % 80 - 40)).tolist()) for i in range(500)]
    data += [(10_003, (base[9] * 3).tolist()), (50, (base[50] * 7).tolist())]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    got = {}
    for r in vamana.nearest(df, k=5, every=50, shard_points=200, block_queries=4).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert got.keys() == {v for v, _ in data if v % 50 == 0}
    for q in got:
        if q >= 10_000:
            assert [v for v, _ in got[q]] == [v for v in [9, *range(10_000, 10_006)] if v != q][:5]
            assert all(s == pytest.approx(1.0, abs=1e-12) for _, s in got[q])
    unit = base / np.linalg.norm(base, axis=1, keepdims=True)
    hits = 0
    few = [q for q in got if q < 600]
    for q in few:
        near = unit @ unit[q]
        every = [(-near[i], i) for i in range(600) if i != q] + [(-near[9], 10_000 + i) for i in range(5)]
        exp = [i for s, i in sorted((round(s, 12), i) for s, i in every)][:5]
        hits += len(set(exp) & {v for v, _ in got[q]})
    assert hits >= 0.9 * 5 * len(few)


def _pages(spark, data):
    return spark.createDataFrame(data, "page_id long, url string, html string")


def test_warc_round_trip(spark):
    tricky = "<p>\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n</p> é漢"
    data = [(1, "http://a.example/x", "<p>same</p>"), (2, None, "<p>same</p>"), (3, "no url", tricky), (4, "http://b/\r\nX: y", ""),
            (5, "http://b/", None), (None, "http://c/", "<p>same</p>"), (9, "http://d/", "only"), (9, "http://d/", "only"), (None, "http://e/", "alone")]
    got = ordered(tuple(r) for r in warc.warc_round_trip(_pages(spark, data)).collect())
    body = lambda h: (h or "").encode()
    full = {}
    for p, _, h in data:
        if p is not None:
            full[body(h)] = max(p, full.get(body(h), p))
    exp = []
    for p, _, h in data:
        b = body(h)
        revisit = b in full and p != full[b]
        exp.append((p, len(b), brute.sha1_32(b), "revisit" if revisit else "response", full[b] if revisit else None))
    assert got == ordered(exp)


def test_warc_small_payloads_are_never_revisits(spark):
    data = [(1, "http://a/", "abc"), (2, "http://a/", "abc"), (3, "http://a/", "abcdefgh"), (4, "http://a/", "abcdefgh")]
    got = {r.page_id: r.record_type for r in warc.warc_round_trip(_pages(spark, data), least_revisit_bytes=5).collect()}
    assert got == {1: "response", 2: "response", 3: "revisit", 4: "response"}


def test_warc_files_and_nested_rows(spark, tmp_path):
    path = str(tmp_path / "w")
    warc.write_archives(_pages(spark, [(i, f"http://h/{i}", f"page {i}") for i in range(20)]), path)
    files = list((tmp_path / "w").glob("*.gz"))
    kinds = [f["warc-type"] for x in files for f, _ in warc.parse(gzip.decompress(x.read_bytes()))]
    assert sorted(set(kinds)) == ["metadata", "request", "response"] and len(kinds) == 60
    nested = warc.assemble(warc.read_records(spark, path)).collect()
    assert len(nested) == 20
    assert all(r.main.warc_type == "response" and r.request.warc_type == "request" and r.metadata.warc_type == "metadata" for r in nested)


OPERATORS = {
    "exact": exact_dedup, "substring": substring_dedup.substring_dedup, "katz": katz.katz_scores, "simhash": simhash.simhash_dedup,
    "mixing": lambda df: mixing.mix(df, F.col("source"), F.col("lang"), F.col("source")), "packing": packing.pack,
    "language": language_crf.identify, "token_ids": token_round_trip,
}


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_and_clashing_columns(spark, docs, name):
    op = OPERATORS[name]
    assert op(frame(spark, docs).limit(0)).collect() == []
    few = frame(spark, docs[:12] + docs[-8:], 2)
    clash = few
    for c in ("id", "h", "fp", "chunk", "part", "anchor", "row", "key", "kept", "score", "tokens", "copies", "start", "body", "prefix", "domain"):
        clash = clash.withColumn(c, F.lit("x"))
    key = lambda r: str(tuple(r))
    drop = [c for c in ("sequence_id", "offset", "start") if c in op(few).columns]
    assert sorted(op(few).drop(*drop).collect(), key=key) == sorted(op(clash).drop(*drop).collect(), key=key)


def test_empty_vectors_and_pages(spark):
    assert vamana.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []
    assert warc.warc_round_trip(_pages(spark, [])).collect() == []


def test_language_of_unspaced_text_is_read_to_its_end(spark):
    rng = random.Random(8)
    signs = {"aa": "日月火水木金土山川", "bb": "ก ข ค ง จ ฉ ช ซ".replace(" ", "")}
    run = lambda lang, n: "".join(rng.choices(signs[lang], k=n))
    labels = ["aa", "bb"] * 30
    model = language_crf.train(["==" + run(x, 60) + "==" for x in labels], labels)
    # the same 40 signs of neither language before and after: only the middle tells
    texts = ["漢" * 40 + run(x, 300) + "漢" * 40 for x in labels]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.lang_pred for r in language_crf.predict(df, model).collect()}
    assert [got[i] for i in range(len(labels))] == labels


def _plain_bucket(kind, *letters):
    h = kind * 0x2545F4914F6CDD1D
    for x, k in zip(letters, (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)):
        h += x * k
    h %= 2**64
    return (((h ^ (h >> 32)) * 0xC2B2AE3D27D4EB4F) % 2**64) >> 47


def _plain_features(word):
    b = [10, *map(ord, word.lower()), 10]
    n = len(b) - 2
    whole = sum(x * pow(0xD6E8FEB86659FD93, i, 2**64) for i, x in enumerate(b[:-1])) % 2**64
    front, back = ([b[min(k, n + 1)] for k in range(4)], [b[max(n + 1 - k, 0)] for k in range(4)])
    return sorted([_plain_bucket(2, *b[i:i + 2]) for i in range(n + 1)] + [_plain_bucket(3, *b[i:i + 3]) for i in range(n)]
                  + [_plain_bucket(1, whole), _plain_bucket(4, *front), _plain_bucket(5, *back)])


def test_features_of_a_word_of_any_length_come_from_all_of_it():
    long = "".join(chr(0x4e00 + i) for i in range(300))
    words = ["a", "Öl", "the", "Straße", "İx", long, "ΣΑΣ"]
    g = chains.grams(words)
    flat, starts = g.flat()
    for w, s, n in zip(words, starts, g.sizes):
        assert sorted(flat[s:s + n].tolist()) == _plain_features(w) == sorted(language_crf.word_features(w))
    weights = np.random.default_rng(0).normal(size=(language_crf.BUCKETS, 2)).astype("float32")
    model = language_crf.Model(["aa", "bb"], weights, {}, np.zeros((2, 2)), np.zeros((2, 2)))
    very_long = long * 2000
    exp = weights[language_crf.word_features(very_long)].sum(axis=0, dtype=float) / np.sqrt(len(language_crf.word_features(very_long)))
    np.testing.assert_allclose(model.emissions(["ab", very_long, "c"])[1], exp, rtol=1e-6)


def test_words_are_cut_at_white_space_and_long_runs_into_pieces():
    import pyarrow as pa

    texts = [" a\tb  c\u3000d\n", None, "", "x" * 150 + " y", "\u00a0"]
    got = chains.split_words(pa.array(texts))
    words, out = [got.vocab[c].as_py() for c in got.codes.tolist()], []
    for n in got.lengths:
        out.append([words.pop(0) for _ in range(n)])
    assert out == [["a", "b", "c", "d"], [], [], ["x" * 64, "x" * 64, "x" * 22, "y"], []]


def test_letterless_signs_have_no_language(spark):
    model = language_crf.train(["kato kina", "wurt wesp"] * 10, ["aa", "bb"] * 10)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(["½ ②", "² Ⅷ 7", "٣", "½ kato"])], "doc_id long, text string")
    assert [r.lang_pred for r in language_crf.predict(df, model).orderBy("doc_id").collect()] == ["und", "und", "und", "aa"]


def test_rare_languages_are_learnt(spark, monkeypatch):
    monkeypatch.setitem(LANGS, "cc", ["öde", "ähre", "über", "öhr", "süß"])
    rng = random.Random(9)
    data = [(i, _tongue(rng, lang, rng.randint(20, 60)), lang) for i in range(900) for lang in ["cc" if i % 150 == 0 else "aa" if i % 3 else "bb"]]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string")
    model = language_crf.fit_model(df, max_texts=20)
    assert model.languages == ["aa", "bb", "cc"]
    got = {r.doc_id: r.lang_pred for r in language_crf.predict(df, model).collect()}
    assert [got[i] for i, _, _ in data] == [lang for _, _, lang in data]


def test_sample_is_bounded_for_each_language_and_a_text_counts_for_each_of_its_labels(spark, monkeypatch):
    texts = [(i, f"word{i % 400} kato", "aa" if i < 800 else "bb") for i in range(900)] + [(2000, "word3 kato", "cc")]
    seen = {}
    monkeypatch.setattr(language_crf, "train", lambda t, labels: seen.update(pairs=sorted(zip(labels, t))))
    language_crf.fit_model(spark.createDataFrame(texts, "doc_id long, text string, lang string"), folds=1, held=9, max_texts=30)
    for lang, n in (("aa", 30), ("bb", 30), ("cc", 1)):
        mine = [t for x, t in seen["pairs"] if x == lang]
        exp = spark.createDataFrame([(t,) for _, t, x in texts if x == lang], "t string").select("t", F.xxhash64("t").alias("h")).distinct()
        assert mine == sorted(r.t for r in exp.orderBy("h").limit(n).collect())


def test_many_languages_and_an_odd_number_of_texts():
    labels = [f"l{i:03d}" for i in range(71)]
    model = language_crf.train([f"{x}a {x}b {x}a {x}b" for x in labels], labels, epochs=1)
    for i, x in enumerate(labels):
        assert model.member([x + "a"])[0].tolist() == [float(k == i) for k in range(71)]


@pytest.fixture(scope="module")
def library():
    """The tokenizer as the library loads it."""
    from tokenizers import Tokenizer

    path = tokens.default_path()
    return lambda t: Tokenizer.from_file(path).encode(t, add_special_tokens=False).ids


ADDED = ["a <|endoftext|> b", "<|endoftext|>", "<|endoftext|><|endoftext|>", "x  <|endoftext|>  y\n", "<|endoftext|", "a\n<|endoftext|>'s <|endoftext|>",
         "<|<|endoftext|>|>", "no token"]


def test_added_tokens_have_the_ids_of_the_untouched_library(library):
    assert library(ADDED[0]) == [64, 220, 50256, 275]
    enc = tokens.Encoder(tokens.default_path())
    for text in ADDED:
        assert np.frombuffer(enc.ids(text), "<u4").tolist() == library(text)


def test_batches_of_texts_have_the_ids_of_the_untouched_library(library, monkeypatch):
    import pyarrow as pa

    rng = random.Random(12)
    bits = ["the", "Don't", "über", " ", "  ", "\n", " \n", "\t", "\u00a0", "\u3000", "\x1c", "\x85", "123", "x1", "--", "...", "日本", "é", "\x00",
            "<|endoftext|>", "a" * 300, "ab" * 50, "'s", "_", "²"]
    texts = ["".join(rng.choice(bits) + rng.choice(["", " "]) for _ in range(rng.randint(0, 30))) for _ in range(1500)]
    texts += ["", " ", "  ", "a", " a", "a ", "a b ", "\n", *ADDED]
    from tokenizers import Tokenizer
    untouched = Tokenizer.from_file(tokens.default_path())
    exp = [untouched.encode(t, add_special_tokens=False).ids for t in texts]
    for kept in (tokens.CACHE_BYTES, 1000):
        monkeypatch.setattr(tokens, "CACHE_BYTES", kept)
        enc = tokens.Encoder(tokens.default_path())
        for part in (slice(0, 700), slice(700, None)):
            ids, sizes = enc.batch(pa.array([*texts[part], None], pa.string())[:-1] if kept == 1000 else pa.array(texts[part], pa.string()))
            assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == exp[part]
    ids, sizes = enc.batch(pa.array([None, "a", None], pa.string()))
    assert sizes.tolist() == [0, 1, 0] and enc.batch(pa.array([], pa.string()))[0].tolist() == []


def test_added_tokens_in_token_files_and_windows(spark, library):
    data = [(i, t) for i, t in enumerate(ADDED)]
    ids = {i: np.array(library(t) + [0], dtype="<u4") for i, t in data}
    got = rows(token_round_trip(frame(spark, data)), "start", "doc_id", "n_tokens", "ids_crc32")
    at = 0
    for (start, d, n, crc), (i, x) in zip(got, sorted(ids.items()), strict=True):
        assert (start, d, n, crc) == (at, i, len(x), zlib.crc32(x.tobytes()))
        at += n
    for r in packing.pack(frame(spark, data), window=8).collect():
        assert r.doc_tokens == len(ids[r.doc_id]) and r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start:r.start + r.length].tobytes())


def test_mixing_counts_no_capacity_under_a_weight_of_zero(spark):
    leaf = [("a", "x", "s1", 1000), ("a", "x", "s2", 100), ("b", "x", "s3", 5000)]
    leaves = spark.createDataFrame(leaf, "domain string, language string, source string, tokens long")
    got = {r.source: r.given for r in mixing.leaf_budgets(leaves, F.lit(800), 1, None, None, {"s1": 0}).collect()}
    assert got == {"s1": 0, "s2": 100, "s3": 700}


def test_many_wholly_repeated_rows_are_no_slower_than_others(spark):
    rng = random.Random(13)
    text = " ".join(f"w{rng.randint(0, 9)}{i}" for i in range(60))
    data = [(1, text)] * 3000 + [(None, text)] * 1000 + [(2, "x " + text + " y"), (3, "alone " * 34), (4, "again " * 36)]
    got = Counter((r.doc_id, r.n_words, r.n_removed) for r in substring_dedup.substring_dedup(frame(spark, data, 8), window=35).collect())
    assert got == {(1, 60, 60): 3000, (None, 60, 60): 1000, (2, 62, 60): 1, (3, 34, 0): 1, (4, 36, 36): 1}


def test_urls_that_cannot_be_parsed(spark):
    pages = [(1, "http://[bad/x", "a"), (2, "http://exa\u2100mple.com/", "b"), (3, "no url", "c"), (4, None, "d"), (5, "http://h/p", "a"), (6, "http://]", None)]
    got = {r.page_id: (r.payload_bytes, r.record_type, r.refers_to) for r in warc.warc_round_trip(_pages(spark, pages)).collect()}
    assert got == {1: (1, "revisit", 5), 2: (1, "response", None), 3: (1, "response", None), 4: (1, "response", None),
                   5: (1, "response", None), 6: (0, "response", None)}
