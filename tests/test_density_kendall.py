"""Density clusters against plain DBSCAN, Kendall's tau against all pairs."""

import math
import random

import numpy as np
import pytest

from tablescope.operators import density, kendall


def plain_tau(x, y):
    keep = [(a, b) for a, b in zip(x, y) if a is not None and b is not None and a == a and b == b]
    if not keep:
        return None
    a, b = np.array(keep, dtype=float).T
    sx, sy = np.sign(a[:, None] - a[None]), np.sign(b[:, None] - b[None])
    spread = math.sqrt(abs(sx).sum()) * math.sqrt(abs(sy).sum())
    return (sx * sy).sum() / spread if spread else None


def test_inversions_of_weighted_rows():
    rng = np.random.default_rng(1)
    for n in (1, 2, 50, 333):
        x, y, w = rng.integers(0, 12, n).astype(float), rng.integers(-9, 9, n).astype(float), rng.integers(1, 5, n)
        exp = int(sum(w[i] * w[j] for i in range(n) for j in range(n) if x[i] < x[j] and y[i] > y[j]))
        assert kendall.inversions(x, y, w) == exp


@pytest.mark.parametrize("stripe_rows", [40, 10**6])
def test_kendall(spark, stripe_rows):
    rng = random.Random(2)
    rows = []
    for i in range(900):
        a = 7.0 if i % 3 == 0 else rng.gauss(0, 1)  # one value of x holds a third of the rows
        rows.append((a, a + rng.gauss(0, 2), rng.randint(0, 5), None if i % 10 == 0 else rng.random(), 1.0, None if i % 4 else float("nan")))
    df = spark.createDataFrame(rows, "a double, b double, c int, d double, e double, f double")
    cols = list(zip(*rows))
    got = {(r.feature1, r.feature2): r for r in kendall.kendall_pairs(df, stripe_rows=stripe_rows).collect()}
    assert set(got) == {(p, q) for i, p in enumerate("abcde") for q in "abcde"[i + 1:]}  # f has no value
    for (p, q), r in got.items():
        exp = plain_tau(cols["abcdef".index(p)], cols["abcdef".index(q)])
        assert (r.tau is None) == (exp is None) and (exp is None or abs(r.tau - exp) < 1e-12)
    assert got["a", "d"].n == 810
    assert kendall.kendall_pairs(df.limit(0)).collect() == [] and kendall.kendall_pairs(df.select("a")).collect() == []


def plain_clusters(points, eps, least):
    """(core, name or None) of each point, by all pairs."""
    ok = [i for i, p in enumerate(points) if all(v is not None and math.isfinite(v) for v in p)]
    near = {i: [j for j in ok if (points[i][0] - points[j][0]) ** 2 + (points[i][1] - points[j][1]) ** 2 <= eps * eps] for i in ok}
    core = {i for i in ok if len(near[i]) >= least}
    name = {}
    for i in sorted(core, key=lambda k: points[k]):
        if i in name:
            continue
        todo, name[i] = [i], points[i]
        while todo:
            for j in near[todo.pop()]:
                if j in core and j not in name:
                    name[j] = points[i]
                    todo.append(j)
    out = []
    for i in range(len(points)):
        mine = name.get(i) or min((name[j] for j in near.get(i, ()) if j in core), default=None)
        out.append((i in core, mine))
    return out


def _check(spark, points, eps, least):
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(points)], "i int, u double, v double")
    got = {r.i: (r.core, (r.cluster_x, r.cluster_y) if r.cluster_x is not None else None)
           for r in density.density_clusters(df, "u", "v", eps, least).collect()}
    exp = plain_clusters(points, eps, least)
    assert [got[i] for i in range(len(points))] == exp
    return exp


def test_density_clusters(spark):
    rng = random.Random(3)
    points = [(rng.gauss(cx, 0.4), rng.gauss(cy, 0.4)) for cx, cy in ((0, 0), (4, 1), (1.9, 0.4)) for _ in range(60)]
    points += [(rng.uniform(-3, 7), rng.uniform(-3, 4)) for _ in range(80)]
    points += [(0.1, 0.1 + i * 1e-6) for i in range(300)]  # one cell with half of all rows
    points += [(9.0, 9.0)] * 5 + [(9.4, 9.0), (12.0, 9.0)] + [(None, 1.0), (float("nan"), 2.0), (float("inf"), 0.0)]
    exp = _check(spark, points, 0.5, 5)
    assert len({n for _, n in exp if n}) > 2 and any(n is None for _, n in exp) and any(n and not c for c, n in exp)


def test_dense_cells_whose_boxes_straddle_the_distance(spark):
    # crowds whose nearest points are just within, or just beyond, 0.5
    def crowd(x, y, n=12):
        return [(x + math.cos(i) * 0.1, y + math.sin(i) * 0.1) for i in range(n)]
    points = crowd(0, 0) + crowd(0.66, 0.1) + crowd(0, 3) + crowd(0.72, 3.0) + crowd(5, 5) + [(5.0 + 0.05 * k, 5.5) for k in range(14)]
    _check(spark, points, 0.5, 4)
    line = [(0.0, 0.0)] * 4 + [(0.5, 0.0)] * 4 + [(1.0 + 1e-9, 0.0)] * 4  # exactly eps apart, and just more
    exp = _check(spark, line, 0.5, 4)
    assert len({n for _, n in exp}) == 2


def test_density_clusters_of_nothing(spark):
    df = spark.createDataFrame([], "u double, v double")
    assert density.density_clusters(df, "u", "v").collect() == []
    one = spark.createDataFrame([(1.0, 2.0)], "u double, v double")
    assert [tuple(r) for r in density.density_clusters(one, "u", "v").collect()] == [(1.0, 2.0, False, None, None)]
    assert tuple(density.density_summary(density.density_clusters(one, "u", "v")).first()) == (1, 0, 1)
