"""All pairs of a wide table in one pass, against pandas."""

import numpy as np
import pandas as pd
import pytest

from tablescope.operators import assoc


def _wide(p=22, n=700):
    rng = np.random.default_rng(11)
    base = rng.normal(size=(n, p)) + rng.normal(size=(n, 1))
    base[:, 1] = base[:, 0] * 1e6 + 5e8
    base[rng.random(size=base.shape) < 0.2] = np.nan
    base[:, 2] = 0.1
    base[:, 3] = np.nan
    frame = pd.DataFrame(base, columns=[f"c {i}" for i in range(p)])
    frame["c 4"] = np.where(np.arange(n) % 2, 3.0, np.nan)
    frame.iloc[5, 6] = np.inf
    return frame


def test_gram_pairs_equal_pandas(spark):
    pdf = _wide()
    df = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None).values.tolist(),
                               ", ".join(f"`{c}` double" for c in pdf.columns)).repartition(5)
    got = {(r.feature1, r.feature2): r for r in assoc.pearson_pairs(df).collect()}
    cols = list(pdf.columns)
    assert len(got) == len(cols) * (len(cols) - 1) // 2 > assoc.PAIR_BATCH
    for i, a in enumerate(cols):
        for b in cols[i + 1:]:
            pair = pdf[[a, b]].dropna()
            row = got[a, b]
            assert row.n == len(pair)
            known = len(pair) > 1 and np.isfinite(pair.values).all() and (pair.max() > pair.min()).all()
            if known:
                assert row.r == pytest.approx(pair[a].corr(pair[b]), abs=1e-9)
            else:
                assert row.r is None


def test_both_ways_agree(spark, monkeypatch):
    pdf = _wide(p=8, n=200)
    df = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None).values.tolist(),
                               ", ".join(f"`{c}` double" for c in pdf.columns))
    one = {(r.feature1, r.feature2): (r.n, r.r) for r in assoc.pearson_pairs(df).collect()}
    monkeypatch.setattr(assoc, "PAIR_BATCH", 0)
    two = {(r.feature1, r.feature2): (r.n, r.r) for r in assoc.pearson_pairs(df).collect()}
    assert one.keys() == two.keys()
    for k, (n, r) in one.items():
        assert two[k][0] == n and (two[k][1] is None) == (r is None) and (r is None or two[k][1] == pytest.approx(r, abs=1e-9))


def test_gram_pairs_of_an_empty_table(spark, monkeypatch):
    monkeypatch.setattr(assoc, "PAIR_BATCH", 0)
    df = spark.createDataFrame([], "x double, y double, z int")
    assert sorted((r.n, r.r) for r in assoc.pearson_pairs(df).collect()) == [(0, None)] * 3
