"""Approximate nearest neighbours by cosine: robust-pruned directed graphs, one a shard.

Vectors are dealt to shards by hash.  In a shard, points are inserted in rounds: beam searches from
the medoid propose neighbours, and of the visited points robust pruning keeps an edge only if no
kept one is nearer to the candidate by the factor ``alpha`` (relaxed in a second pass); edges are
mirrored and pruned again.  The graphs are written once; every query runs a beam search in every
shard, in blocks of a bounded number of queries.  The shards' candidates are scored exactly in double
precision and merged.

Vectors of one direction (equal up to positive scale, to twelve decimals of the unit vector) have one
cosine to any query and are one point: it carries its smallest identifiers, as many as a query can
return, so ties among them go to the smaller ones.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablescope.llm.common import shuffle_partitions, staged

#: Points that a shard is planned for.
SHARD_POINTS = 3_000
#: Queries that a block is planned for: one task holds a shard's graph and a block.
BLOCK_QUERIES = 8_192
DEGREE = 24
BEAM_BUILD = 48
BEAM_QUERY = 96
ALPHA = 1.2
ROUND = 200


def beam_search(points: np.ndarray, graph: np.ndarray, entry: int, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """(point, squared distance) of the ``beam`` nearest found, for all queries in step; -1 where
    fewer were reached.  A point is expanded once, nearest first."""
    q, n = len(queries), len(points)
    ids = np.full((q, beam), -1, dtype=np.int64)
    dist = np.full((q, beam), np.inf)
    done = np.ones((q, beam), dtype=bool)
    ids[:, 0], done[:, 0] = entry, False
    dist[:, 0] = ((queries - points[entry]) ** 2).sum(axis=1)
    seen = np.zeros((q, n + 1), dtype=bool)
    seen[:, entry] = True
    seen[:, n] = True  # stands for no neighbour
    live = np.arange(q)
    while len(live):
        first = np.argmin(np.where(done[live], np.inf, dist[live]), axis=1)
        here = ids[live, first]
        done[live, first] = True
        near = graph[here]
        near = np.where(near < 0, n, near)
        fresh = ~seen[live[:, None], near]
        seen[live[:, None], near] = True
        d = ((points[np.minimum(near, n - 1)] - queries[live][:, None, :]) ** 2).sum(axis=2)
        d = np.where(fresh, d, np.inf)
        all_d = np.concatenate([dist[live], d], axis=1)
        all_i = np.concatenate([ids[live], np.where(fresh, near, -1)], axis=1)
        all_done = np.concatenate([done[live], ~fresh], axis=1)
        pick = np.argsort(all_d, axis=1, kind="stable")[:, :beam]
        dist[live] = np.take_along_axis(all_d, pick, axis=1)
        ids[live] = np.take_along_axis(all_i, pick, axis=1)
        done[live] = np.take_along_axis(all_done, pick, axis=1)
        live = live[~done[live].all(axis=1)]
    ids[~np.isfinite(dist)] = -1
    return ids, dist


def robust_prune(points: np.ndarray, at: np.ndarray, candidates: np.ndarray, alpha: float, degree: int) -> np.ndarray:
    """For each of the points ``at``: of its row of ``candidates`` (-1: none) at most ``degree``
    diverse ones, nearest first: a kept one removes those that are nearer to it, by ``alpha``."""
    rows, width = candidates.shape
    safe = np.maximum(candidates, 0)
    d = ((points[safe] - points[at][:, None, :]) ** 2).sum(axis=2)
    d[(candidates < 0) | (candidates == at[:, None])] = np.inf
    order = np.argsort(d, axis=1, kind="stable")
    d, cand = np.take_along_axis(d, order, axis=1), np.take_along_axis(candidates, order, axis=1)
    vec = points[np.maximum(cand, 0)]
    out = np.full((rows, degree), -1, dtype=np.int64)
    count = np.zeros(rows, dtype=np.int64)
    alive = np.isfinite(d)
    live = np.flatnonzero(alive.any(axis=1))
    while len(live):
        first = np.argmax(alive[live], axis=1)
        chosen = cand[live, first]
        out[live, count[live]] = chosen
        count[live] += 1
        between = ((vec[live] - points[chosen][:, None, :]) ** 2).sum(axis=2)
        alive[live] &= alpha ** 2 * between > d[live]
        alive[live] &= cand[live] != chosen[:, None]
        live = live[alive[live].any(axis=1) & (count[live] < degree)]
    return out


def build_graph(points: np.ndarray, degree: int = DEGREE, beam: int = BEAM_BUILD, alpha: float = ALPHA,
                seed: int = 3) -> tuple[np.ndarray, int]:
    """(out-neighbours by point, -1 where fewer; entry point)."""
    n = len(points)
    rng = np.random.default_rng(seed)
    entry = int(((points - points.mean(axis=0)) ** 2).sum(axis=1).argmin())
    degree = min(degree, max(1, n - 1))
    if n == 1:
        return np.full((1, 1), -1, dtype=np.int64), 0
    graph = np.stack([rng.integers(0, n, degree) for _ in range(n)])
    graph[graph == np.arange(n)[:, None]] = -1
    for relaxed in (1.0, alpha):
        order = rng.permutation(n)
        for s in range(0, n, ROUND):
            at = order[s:s + ROUND]
            found, _ = beam_search(points, graph, entry, points[at], beam)
            graph[at] = robust_prune(points, at, np.concatenate([found, graph[at]], axis=1), relaxed, degree)
            _mirror(points, graph, at, relaxed, degree)
    return graph, entry


def _mirror(points: np.ndarray, graph: np.ndarray, at: np.ndarray, alpha: float, degree: int) -> None:
    """Edges back to the points ``at``; a point that would have too many is pruned again."""
    targets = graph[at].ravel()
    sources = np.repeat(at, graph.shape[1])[targets >= 0]
    targets = targets[targets >= 0]
    order = np.argsort(targets, kind="stable")
    targets, sources = targets[order], sources[order]
    node, begin, n = np.unique(targets, return_index=True, return_counts=True)
    if not len(node):
        return
    extra = np.full((len(node), int(n.max())), -1, dtype=np.int64)
    extra[np.repeat(np.arange(len(node)), n), np.arange(len(targets)) - np.repeat(begin, n)] = sources
    extra[(extra[:, :, None] == graph[node][:, None, :]).any(axis=2)] = -1  # already there
    both = np.concatenate([graph[node], extra], axis=1)
    few = (both >= 0).sum(axis=1) <= degree
    packed = np.take_along_axis(both, np.argsort(both < 0, axis=1, kind="stable"), axis=1)[:, :degree]
    graph[node[few]] = packed[few]
    if not few.all():
        graph[node[~few]] = robust_prune(points, node[~few], both[~few], alpha, degree)


def _unit(vectors: np.ndarray) -> np.ndarray:
    # scaled first, so that very large and very small components do not overflow
    big = np.abs(vectors).max(axis=1, keepdims=True)
    v = vectors / big
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def _build_shard(table: pa.Table) -> pa.Table:
    """The graph of a shard, a row for each point: its place, its vector, its neighbours' places."""
    unit = _unit(np.array(table.column("v").to_pylist(), dtype=float))
    graph, entry = build_graph(unit)
    n = len(unit)
    return pa.table({"dims": table.column("dims"), "shard": table.column("shard"), "place": np.arange(n, dtype=np.int32),
                     "entry": np.arange(n) == entry, "unit": pa.array(list(unit), pa.list_(pa.float64())),
                     "near": pa.array(list(graph.astype(np.int32)), pa.list_(pa.int32())),
                     "ids": table.column("ids").cast(pa.list_(pa.int64()))})


def _search_shard(k: int, beam: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
        if left.num_rows == 0 or right.num_rows == 0:
            return schema.empty_table()
        left = left.sort_by("place")
        unit = np.array(left.column("unit").to_pylist(), dtype=float)
        graph = np.array(left.column("near").to_pylist(), dtype=np.int64)
        entry = int(np.argmax(left.column("entry").to_numpy(zero_copy_only=False)))
        holders = left.column("ids").to_pylist()
        out: list[list] = [[], [], []]
        query_ids = right.column("query_id").to_pylist()
        for a in range(0, len(query_ids), 256):
            q = _unit(np.array(right.column("v").slice(a, 256).to_pylist(), dtype=float))
            found, _ = beam_search(unit, graph, entry, q, max(beam, 2 * k))
            exact = np.where(found >= 0, np.einsum("qbd,qd->qb", unit[np.maximum(found, 0)], q), -np.inf)
            for i, (row, score) in enumerate(zip(found.tolist(), exact.tolist(), strict=True)):
                me = query_ids[a + i]
                best = sorted((-s, v) for p, s in zip(row, score, strict=True) if p >= 0 for v in holders[p] if v != me)[:k]
                for s, v in best:
                    out[0].append(me)
                    out[1].append(v)
                    out[2].append(-s)
        return pa.table(out, schema=schema)
    return run


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with ``value`` computed once, however often a lambda inside reads it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _direction(v: Column) -> Column:
    """The unit vector as integers, twelve decimals each; scaled first, so that nothing overflows."""
    def units(scaled: Column) -> Column:
        norm = F.sqrt(F.aggregate(scaled, F.lit(0.0), lambda total, x: total + x * x))
        return _let(norm, lambda n: F.transform(scaled, lambda x: F.floor(x / n * 1e12 + 0.5)))
    return _let(F.array_max(F.transform(v, F.abs)), lambda big: _let(F.transform(v, lambda x: x / big), units))


def nearest(df: DataFrame, k: int = 5, every: int = 50, id_col: str = "vec_id", vector_col: str = "embedding",
            beam: int = BEAM_QUERY, shard_points: int = SHARD_POINTS, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found of every query.

    Queries are the rows whose identifier is divisible by ``every``; candidates are all rows but the
    query's own identifier; nearness is the cosine in double precision, ties to the smaller
    identifier.  Defined cases: null identifiers, and vectors that are null, empty, zero or hold null
    or non-finite components, take no part; only vectors of one length are compared; rows that repeat
    an identifier count once each as candidates if their directions differ, and a query identifier with
    several vectors gets the nearest to any of them; with fewer candidates than ``k`` all are returned;
    an empty table gives no rows.
    """
    spark = df.sparkSession
    v = F.col(vector_col).cast("array<double>")
    ok = (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull()).where(ok)
    # distinct directions with their k + 1 smallest identifiers, found in salted groups first
    slim = (rows.withColumn("way", _direction(F.col("v"))).groupBy("vec_id", "way").agg(F.min("v").alias("v"))
            .withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(64))))
    small = Window.partitionBy("way", "salt").orderBy("vec_id")
    ids = Window.partitionBy("way").orderBy("vec_id")
    points = (slim.withColumn("r", F.row_number().over(small)).where(F.col("r") <= k + 1)
              .withColumn("r", F.row_number().over(ids)).where(F.col("r") <= k + 1)
              .groupBy("way").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"), F.min_by("v", "vec_id").alias("v"))
              .select("v", "ids", F.size("v").alias("dims"), F.xxhash64("way").alias("hash")))
    points = staged(points, "vamana-points")
    shards = max(1, -(-points.count() // shard_points))
    n = shuffle_partitions(spark)
    dealt = points.select("v", "ids", "dims", F.pmod("hash", F.lit(shards)).alias("shard"))
    graphs = staged(dealt.repartition(n, "dims", "shard").groupBy("dims", "shard").applyInArrow(
        _build_shard, "dims int, shard long, place int, entry boolean, unit array<double>, near array<int>, ids array<long>"),
        "vamana-graphs")
    asked = rows.where(F.col("vec_id") % every == 0).distinct()
    blocks = max(1, -(-asked.count() // block_queries))
    queries = (asked.select(F.col("vec_id").alias("query_id"), "v", F.size("v").alias("dims"),
                            F.pmod(F.xxhash64("vec_id", "v"), F.lit(blocks)).alias("block"))
               .withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)).cast("array<bigint>"))))
    spread = graphs.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<bigint>")))
    at = ("dims", "shard", "block")
    found = (spread.repartition(n, *at).groupBy(*at).cogroup(queries.repartition(n, *at).groupBy(*at))
             .applyInArrow(_search_shard(k, beam), "query_id long, vec_id long, score double"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    one = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return (one.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))
