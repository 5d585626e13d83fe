"""Connected components of an edge table of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablescope.session import reliable_checkpoint


def connected(edges: DataFrame) -> DataFrame:
    """(node, root): every node of ``edges`` (a, b; any ordered type) with the smallest it is linked to.

    In every round each node hands all its neighbours to the smallest of them, first those larger than
    itself, then the others, so that paths shorten by a factor and rounds grow with the logarithm of the
    longest.  A round ends in a checkpoint.
    """
    state = reliable_checkpoint(edges.where("a <> b").select(F.greatest("a", "b").alias("high"), F.least("a", "b").alias("low")).distinct())
    seen = None
    while True:
        ends = state.select(F.col("high").alias("node"), F.col("low").alias("other")).union(state.select("low", "high"))
        least = ends.groupBy("node").agg(F.min("other").alias("m")).select("node", F.least("node", "m").alias("m"))
        larger = state.select(F.col("low").alias("node"), "high").join(least, "node").select("high", F.col("m").alias("low")).distinct()
        least = larger.groupBy("high").agg(F.min("low").alias("m"))
        rest = larger.join(least, "high").where("low <> m").select(F.col("low").alias("high"), F.col("m").alias("low"))
        state = reliable_checkpoint(rest.union(least.select("high", F.col("m").alias("low"))).distinct())
        now = tuple(state.agg(F.count(F.lit(1)), F.sum(F.xxhash64("high", "low").cast("decimal(38,0)"))).first())
        if now == seen:
            break
        seen = now
    roots = state.select(F.col("low").alias("node"), F.col("low").alias("root")).distinct()
    return state.select(F.col("high").alias("node"), F.col("low").alias("root")).union(roots)
