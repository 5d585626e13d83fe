"""Density clusters (DBSCAN) of points in the plane, exactly and without pairs inside a crowd.

The plane is cut into cells whose diagonal is just under ``eps``.  All points of a cell with ``min_points``
rows are core points of one cluster, so such a *dense* cell becomes one node, however many rows it holds.
Only points of other cells, fewer than ``min_points`` in each, are compared with the points around them.

Whether two dense cells hold points within ``eps`` is decided on bounding boxes: boxes surely within ``eps``
link the cells, boxes surely farther apart do not, and boxes that straddle it are cut four by four, over and
over, until none is left.
"""

from __future__ import annotations

import math
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablescope.functions.exprs import as_double, nan_to_null
from tablescope.operators.graph import connected
from tablescope.session import reliable_checkpoint

_AROUND = list(product(range(-2, 3), repeat=2))
_BOX = ("x0", "x1", "y0", "y1")


def _box() -> list[Column]:
    return [F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1")]


def _apart(least: bool) -> Column:
    """Squared distance of boxes a and b: the least, or the largest, of any two places in them."""
    def one(v: str) -> Column:
        a0, a1, b0, b1 = (F.col(f"{s}{v}{k}") for s in "ab" for k in "01")
        if least:
            return F.greatest(F.lit(0.0), a0 - b1, b0 - a1)
        return F.greatest(a1 - b0, b1 - a0)
    return one("x") * one("x") + one("y") * one("y")


def _named(df: DataFrame, side: str, *cols: str) -> DataFrame:
    return df.select(*[F.col(c).alias(side + c) for c in cols])


def _around(df: DataFrame, cells: list[tuple[int, int]]) -> DataFrame:
    """Each row once for each cell around its own: tx, ty."""
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in cells])
    return df.withColumn("s", F.explode(steps)).withColumns({"tx": F.col("cx") + F.col("s.i"), "ty": F.col("cy") + F.col("s.j")}).drop("s")


def _dense_links(places: DataFrame, dense: DataFrame, eps: float, side: float) -> DataFrame:
    """Pairs of dense cells (acx, acy, bcx, bcy) that hold points within ``eps`` of each other."""
    within = F.lit(eps * eps)
    key = ["acx", "acy", "bcx", "bcy"]
    half = [s for s in _AROUND if s > (0, 0)]
    pairs = (_named(_around(dense, half), "a", "cx", "cy", "tx", "ty", *_BOX)
             .join(_named(dense, "b", "cx", "cy", *_BOX), (F.col("atx") == F.col("bcx")) & (F.col("aty") == F.col("bcy"))))
    none = F.lit(0).cast("long")
    pairs = reliable_checkpoint(pairs.where(_apart(True) <= within).withColumns({c: none for c in ("asx", "asy", "bsx", "bsy")}))
    links, cut = [], 1
    while True:
        near = pairs.where(_apart(False) <= within).select(*key).distinct()
        links.append(near)
        left = reliable_checkpoint(pairs.select(*key, "asx", "asy", "bsx", "bsy").join(near, key, "left_anti"))
        if left.isEmpty():
            break
        cut *= 4
        cells = left.select(F.col("acx").alias("cx"), F.col("acy").alias("cy")).union(left.select("bcx", "bcy")).distinct()
        at = {s: F.floor((F.col(v) - F.col("c" + v) * side) / side * cut) for s, v in (("sx", "x"), ("sy", "y"))}  # exact powers of two
        boxes = reliable_checkpoint(places.join(cells, ["cx", "cy"], "left_semi").withColumns(at).groupBy("cx", "cy", "sx", "sy").agg(*_box())
                                    .withColumns({"px": F.floor(F.col("sx") / 4), "py": F.floor(F.col("sy") / 4)}))
        for s in "ab":
            mine = _named(boxes, "n" + s, "cx", "cy", "px", "py", "sx", "sy", *_BOX)
            same = [F.col(f"{s}{c}") == F.col(f"n{s}{c}") for c in ("cx", "cy")] + [F.col(f"{s}s{v}") == F.col(f"n{s}p{v}") for v in "xy"]
            left = left.join(mine, same[0] & same[1] & same[2] & same[3]).drop(f"{s}sx", f"{s}sy", *[f"n{s}{c}" for c in ("cx", "cy", "px", "py")])
        left = left.select(*key, *[F.col(f"n{s}{c}").alias(s + c) for s in "ab" for c in ("sx", "sy", *_BOX)])
        pairs = reliable_checkpoint(left.where(_apart(True) <= within))
    out = links[0]
    for more in links[1:]:
        out = out.union(more)
    return out


def density_clusters(df: DataFrame, x: str, y: str, eps: float = 0.5, min_points: int = 5) -> DataFrame:
    """``df`` with core, cluster_x and cluster_y: a cluster is named by the smallest place (x, then y) of its
    core points, and noise has none.

    A point is a core point if ``min_points`` rows, itself included, lie within ``eps``; a point within
    ``eps`` of core points of several clusters goes to that of the smallest name.  Rows without x or y
    (null, NaN, infinite) are noise.  Equal points are one place of that many rows.
    """
    side = eps / math.sqrt(2.0) * (1 - 1e-9)
    marks = {"__x": as_double(nan_to_null(df), x), "__y": as_double(nan_to_null(df), y)}
    rows = nan_to_null(df).withColumns(marks)
    finite = (F.abs("__x") < float("inf")) & (F.abs("__y") < float("inf"))
    places = rows.where(finite).groupBy(F.col("__x").alias("x"), F.col("__y").alias("y")).agg(F.count(F.lit(1)).alias("w"))
    places = places.withColumns({"cx": F.floor(F.col("x") / side), "cy": F.floor(F.col("y") / side)})
    places = reliable_checkpoint(places)
    cells = reliable_checkpoint(places.groupBy("cx", "cy").agg(F.sum("w").alias("n"), *_box(), F.min(F.struct("x", "y")).alias("first")))
    dense = cells.where(F.col("n") >= min_points)
    marked = places.join(cells.select("cx", "cy", (F.col("n") >= min_points).alias("crowd")), ["cx", "cy"])
    # each place outside the crowd with all that lies around it: fewer than 25 x min_points partners for a place of a
    # crowd, and results of as many cells and places at most
    alone = _around(marked.where("NOT crowd").select("x", "y", "cx", "cy"), _AROUND).drop("cx", "cy")
    other = marked.select(F.col("x").alias("qx"), F.col("y").alias("qy"), F.col("w").alias("qw"), F.col("cx").alias("tx"), F.col("cy").alias("ty"), "crowd")
    dx, dy = F.col("x") - F.col("qx"), F.col("y") - F.col("qy")
    near = reliable_checkpoint(alone.join(other, ["tx", "ty"]).where(dx * dx + dy * dy <= eps * eps).groupBy("x", "y").agg(
        (F.sum("qw") >= min_points).alias("core"), F.collect_set(F.when(F.col("crowd"), F.struct("tx", "ty"))).alias("crowds"),
        F.collect_set(F.when(~F.col("crowd"), F.struct("qx", "qy"))).alias("others")))

    def cell_node(cx: str, cy: str) -> Column:
        return F.concat_ws(":", F.lit("c"), F.col(cx).cast("string"), F.col(cy).cast("string"))

    def place_node(px: str, py: str) -> Column:
        return F.concat_ws(":", F.lit("p"), F.col(px).cast("string"), F.col(py).cast("string"))

    core = near.where("core")
    to_cells = near.select("x", "y", "core", F.explode("crowds").alias("c")).select("x", "y", "core", cell_node("c.tx", "c.ty").alias("node"))
    to_places = (near.select("x", "y", "core", F.explode("others").alias("o")).select("x", "y", "core", "o.*")
                 .join(core.select(F.col("x").alias("qx"), F.col("y").alias("qy")), ["qx", "qy"])
                 .select("x", "y", "core", place_node("qx", "qy").alias("node")))
    reached = reliable_checkpoint(to_cells.union(to_places))  # core nodes within eps of each place outside the crowd
    links = (_dense_links(places, dense, eps, side).select(cell_node("acx", "acy").alias("a"), cell_node("bcx", "bcy").alias("b"))
             .union(reached.where("core").select(place_node("x", "y").alias("a"), F.col("node").alias("b"))))
    groups = connected(links)
    nodes = (dense.select(cell_node("cx", "cy").alias("node"), "first")
             .union(core.select(place_node("x", "y").alias("node"), F.struct("x", "y").alias("first"))))
    rooted = reliable_checkpoint(nodes.join(groups, "node", "left").select("node", "first", F.coalesce("root", "node").alias("root")))
    named = rooted.join(rooted.groupBy("root").agg(F.min("first").alias("cluster")), "root").select("node", "cluster")
    of_alone = (reached.join(named, "node").groupBy("x", "y").agg(F.min("cluster").alias("border"))
                .join(near.select("x", "y", "core"), ["x", "y"], "right")
                .join(core.select("x", "y", place_node("x", "y").alias("node")).join(named, "node").drop("node"), ["x", "y"], "left")
                .select("x", "y", "core", F.when(F.col("core"), F.col("cluster")).otherwise(F.col("border")).alias("cluster")))
    of_crowd = (marked.where("crowd").withColumn("node", cell_node("cx", "cy")).join(named, "node")
                .select("x", "y", F.lit(True).alias("core"), "cluster"))
    labels = of_alone.union(of_crowd).select(F.col("x").alias("__lx"), F.col("y").alias("__ly"), F.col("core").alias("__core"), F.col("cluster").alias("__cluster"))
    return (rows.join(labels, (F.col("__x") == F.col("__lx")) & (F.col("__y") == F.col("__ly")), "left")
            .select(*[F.col(f"`{c}`") for c in df.columns], F.coalesce("__core", F.lit(False)).alias("core"),
                    F.col("__cluster.x").alias("cluster_x"), F.col("__cluster.y").alias("cluster_y")))


def density_summary(clustered: DataFrame) -> DataFrame:
    """rows, clusters and noise rows of a result of ``density_clusters``."""
    named = clustered.where("cluster_x IS NOT NULL").groupBy("cluster_x", "cluster_y").agg(F.count(F.lit(1)).alias("n"))
    all_rows = clustered.agg(F.count(F.lit(1)).alias("rows"))
    return (all_rows.crossJoin(named.agg(F.count(F.lit(1)).alias("clusters"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")))  # one row each
            .select("rows", "clusters", (F.col("rows") - F.col("n")).alias("noise_points")))
