"""The corpus pipeline, stage by stage, and the registered queries."""

import hashlib

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
import corpus_pipeline

from . import brute
from .test_operators import corpus, frame

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = [(d, t) for d, t in corpus(120, 4)] + [(500, "?? 12"), (501, "the same text of a copy"), (502, "The Same text of a copy")]
    df = frame(spark, docs).cache()
    out = [df]
    for _, f in corpus_pipeline.STAGES:
        out.append(f(spark, out[-1], SMALL).cache())
    return out


def pairs(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def test_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "simhash_near_dedup", "mixing", "packing"]


def test_columns(stages):
    assert all(s.columns == stages[0].columns for s in stages[1:-1])


def test_language_keeps_all_texts_with_letters(stages):
    kept = [t for _, t in pairs(stages[1])]
    assert sorted(kept) == sorted(t for _, t in pairs(stages[0]) if t and any(c.isalpha() for c in t))


def test_language_stage_keeps_columns_of_any_name(spark):
    rows = [(i, "kato kina kemu " * 5 if i % 2 else "wurt wesp grod " * 5, "aa" if i % 2 else "bb") for i in range(40)] + [(90, "12", "aa")]
    docs = (frame(spark, [(d, t) for d, t, _ in rows]).drop("lang")
            .selectExpr("*", "if(doc_id % 2 = 1, 'aa', 'bb') AS lang", "7 AS score", "'mine' AS lang_pred", "array('w') AS word_langs", "doc_id AS c0"))
    got = corpus_pipeline.language_stage(spark, docs, SMALL)
    assert got.columns == docs.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, docs.where("doc_id <> 90").collect()))


def test_near_stage_of_repeated_and_null_identifiers(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(300)) for x in "abc")
    docs = [(1, a), (1, a), (1, b), (2, a + " "), (3, b.upper()), (None, c), (None, c), (None, c + " "), (4, "x y"), (None, "p q")]
    got = pairs(corpus_pipeline.near_stage(spark, frame(spark, docs), SMALL))
    least = {x: min((h, t) for h, t in [(r.h, r.t) for r in spark.createDataFrame([(t,) for t in ts], "t string").selectExpr("t", "xxhash64(t) AS h").collect()])[1]
             for x, ts in (("c", (c, c + " ")),)}
    assert sorted(map(str, got)) == sorted(map(str, [(1, a), (1, b), (None, least["c"]), (4, "x y"), (None, "p q")]))


def test_exact_stage(stages):
    groups = {}
    for d, t in pairs(stages[1]):
        k = hashlib.sha256(brute.fold(t)).digest()
        groups[k] = max(groups.get(k, -1), -1 if d is None else d)
    got = pairs(stages[2])
    assert {hashlib.sha256(brute.fold(t)).digest(): -1 if d is None else d for d, t in got} == groups and len(got) == len(groups)


def test_near_stage(stages):
    docs = pairs(stages[2])
    keep = {c for _, _, c in brute.simhash(docs, 3, 2)}
    assert sorted(d for d, _ in pairs(stages[3]) if d is not None) == sorted(c for c in keep if c is not None)


def test_mixing_stage_takes_known_rows_only(stages):
    before = set(pairs(stages[3]))
    after = pairs(stages[4])
    assert after and set(after) <= before and max(map(after.count, set(after))) <= 2


def test_packing_stage_holds_every_id_once(stages):
    import zlib

    from tablescope.llm import tokens

    enc = tokens.Encoder.of(tokens.default_path())._tokenizer
    pieces = {}
    for r in stages[5].collect():
        pieces[r.doc_id] = pieces.get(r.doc_id, 0) + r.length
    exp = {}
    for d, t in pairs(stages[4]):
        n = len(enc.encode(t or "", add_special_tokens=False).ids) + 1
        exp[d] = exp.get(d, 0) + n
    assert pieces == exp
    assert zlib.crc32(np.array([0], dtype="<u4").tobytes()) >= 0


def test_registered():
    names = entry.queries()
    assert {n for n in names if n.startswith("op")} >= {
        "op1_exact_dedup", "op2_substring_dedup", "op3_lm_scoring", "op4_simhash", "op5_mixing", "op6_packing", "op7_language_id",
        "op8_ann", "op9_token_ids", "op10_warc", "op11_vector_codes", "op12_toxicity", "op13_spelling"} and "pipeline" in names


@pytest.mark.parametrize("name", ["op1_exact_dedup", "op5_mixing"])
def test_oracle(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SMALL}/documents.parquet')")
    exp = con.execute(entry.oracle_sql()[name]).df()
    got = entry.queries()[name](spark, SMALL).toPandas()
    cols = sorted(exp.columns)
    assert cols == sorted(got.columns) and len(exp) > 0
    assert sorted(map(tuple, exp[cols].values.tolist())) == sorted(map(tuple, got[cols].values.tolist()))
