"""All pairs of columns at once, against plain formulas on small frames."""

import itertools
import math
from collections import Counter

from tablescope.operators import stat_tests


def _plain_chi_square(a, b, yates=True):
    cells, rows, cols, n = Counter(zip(a, b)), Counter(a), Counter(b), len(a)
    total = 0.0
    for x, y in itertools.product(rows, cols):
        e = rows[x] * cols[y] / n
        off = abs(cells[x, y] - e)
        if yates and len(rows) == len(cols) == 2:
            off -= min(0.5, off)
        total += off * off / e
    return len(rows), len(cols), total, (len(rows) - 1) * (len(cols) - 1), min(rows.values()) * min(cols.values()) / n < 5


def test_chi_square_of_all_pairs(spark):
    # h: one value holds over a third of the rows; k: constant; t and u: two by two, one cell empty
    data = [(("x" if i % 3 else f"v{i}"), ("p", "q", None, "p")[i % 4], ("a" if i < 150 else "b"),
             ("c" if i < 100 else "d"), "k", f"z{i % 5}") for i in range(200)]
    names = ["h", "s", "t", "u", "k", "z"]
    df = spark.createDataFrame(data, ", ".join(f"{c} string" for c in names))
    pairs = list(itertools.combinations(names, 2)) + [("t", "t"), ("z", "h")]
    got = {(r.feature1, r.feature2): r for r in stat_tests.chi_square_pairs(df, pairs, fill="Missing").collect()}
    assert len(got) == len(pairs)
    columns = {c: [v if v is not None else "Missing" for v in col] for c, col in zip(names, zip(*data))}
    for a, b in pairs:
        rows, cols, chi2, dof, low = _plain_chi_square(columns[a], columns[b])
        r = got[a, b]
        assert (r.n, r.rows, r.cols, r.dof, r.low_expected) == (200, rows, cols, dof, low), (a, b)
        assert math.isclose(r.chi2, chi2, abs_tol=1e-4), (a, b)
        if min(rows, cols) > 1:
            assert math.isclose(r.cramers_v, math.sqrt(chi2 / (200 * (min(rows, cols) - 1))), abs_tol=1e-4)
        else:
            assert r.cramers_v is None


def test_chi_square_without_rows_or_pairs(spark):
    df = spark.createDataFrame([], "a string, b string, `c.d` string")
    assert stat_tests.chi_square_pairs(df, [("a", "b"), ("a", "c.d")]).count() == 0
    assert stat_tests.categorical_dependencies(df, ["a"]).count() == 0


def _plain_kruskal(groups):
    kept = {g: v for g, v in groups.items() if len(v) > 2}
    flat = sorted(x for v in kept.values() for x in v)
    n, count = len(flat), Counter(flat)
    first = {x: flat.index(x) for x in count}
    rank = {x: first[x] + (count[x] + 1) / 2 for x in count}
    h = 12 / (n * (n + 1)) * sum(sum(rank[x] for x in v) ** 2 / len(v) for v in kept.values()) - 3 * (n + 1)
    return h / (1 - sum(t ** 3 - t for t in count.values()) / (n ** 3 - n))


def _plain_f(groups):
    kept = [v for v in groups.values() if len(v) > 2]
    n, k = sum(map(len, kept)), len(kept)
    mean = sum(map(sum, kept)) / n
    between = sum(len(v) * (sum(v) / len(v) - mean) ** 2 for v in kept)
    within = sum((x - sum(v) / len(v)) ** 2 for v in kept for x in v)
    return (between / (k - 1)) / (within / (n - k))


def test_group_effects_of_all_pairs(spark):
    # g: half of the rows in one group, one group too small; skewed: 1 in 40 rows far away
    data = [("hot" if i % 2 else ("rare" if i < 3 else f"g{i % 3}"), None if i % 7 == 0 else f"w{i % 2}",
             float(i % 11) + (i % 2), 1000.0 if i % 41 == 5 else float(i % 5), None if i % 4 == 0 else float(i % 13), 1.0)
            for i in range(240)]
    df = spark.createDataFrame(data, "g string, w string, even double, skewed double, holes double, flat double")
    at = {"g": 0, "w": 1, "even": 2, "skewed": 3, "holes": 4, "flat": 5}
    pairs = [(c, x) for c in ("g", "w") for x in ("even", "skewed", "holes", "flat")]

    def groups(c, x):
        out = {}
        for row in data:
            if row[at[x]] is not None:
                out.setdefault(row[at[c]] or "Missing", []).append(row[at[x]])
        return out

    auto = {(r.categorical_feature, r.numeric_feature): r for r in stat_tests.group_effects(df, pairs).collect()}
    ranks = {(r.categorical_feature, r.numeric_feature): r for r in stat_tests.group_effects(df, pairs, "kruskal").collect()}
    assert set(auto) == set(ranks) == set(pairs)
    assert {r.test for r in auto.values()} == {"anova", "kruskal_wallis"}
    for c, x in pairs:
        one = stat_tests.group_effect(df, c, x).collect()
        assert one == [auto[c, x]]
        if x == "flat":  # no variance: no statistic
            assert ranks[c, x].statistic is None and auto[c, x].eta_squared == 0.0
            continue
        assert math.isclose(ranks[c, x].statistic, _plain_kruskal(groups(c, x)), abs_tol=1e-3), (c, x)
        if auto[c, x].test == "anova":
            assert math.isclose(auto[c, x].statistic, _plain_f(groups(c, x)), abs_tol=1e-3), (c, x)
        else:
            assert auto[c, x].statistic == ranks[c, x].statistic
    assert stat_tests.group_effects(df.limit(0), pairs).count() == 0
    assert stat_tests.mixed_interactions(df, [], ["even"]).count() == 0
