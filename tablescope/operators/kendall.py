"""Kendall's tau-b of all column pairs, exactly, by distributed counting of inversions.

Rows are first collapsed to distinct (x, y) with a weight.  Quantiles of x and of y cut the plane into
cells; every quantile value is a stripe of its own, so however many rows share it, they need no comparison.
A discordant pair of rows then lies

* in cells that differ in both directions: counted from the cells' weights alone, a table whose size is a
  parameter;
* in one open stripe of x: counted inside the stripe;
* in one open stripe of y and different stripes of x: counted inside the stripe of y.

An open stripe holds about 1 / ``stripes`` of the distinct rows at most.  Inversions inside it are counted by
the binary digits of the ranks of y: two ranks part at their highest different digit.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablescope.functions.exprs import as_double, is_numeric, nan_to_null, r4
from tablescope.session import reliable_checkpoint

#: Distinct rows of an open stripe (about), and stripes of either direction at most.
STRIPE_ROWS, MAX_STRIPES = 200_000, 512


def _dot(a: np.ndarray, b: np.ndarray) -> int:
    """The exact sum of products of 64-bit integers whose products fit."""
    x = a * b
    return (int((x >> 32).sum()) << 32) + int((x & 0xFFFFFFFF).sum())


def inversions(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> int:
    """Weight of the pairs of rows with a smaller x and a larger y."""
    order = np.lexsort((y, x))  # rows of one x stand in rising order of y: no inversion among them
    rank = np.unique(y[order], return_inverse=True)[1]
    w = w[order].astype(np.int64)
    total = 0
    for digit in range(int(rank.max(initial=0)).bit_length() - 1, -1, -1):
        # rows are in groups of equal higher digits, in order of x within each
        one = (rank >> digit) & 1
        group = rank >> (digit + 1)
        before = np.cumsum(w * one) - w * one
        first = np.r_[True, group[1:] != group[:-1]]
        start = before[first][np.cumsum(first) - 1]
        total += _dot(w * (1 - one), before - start)
        order = np.argsort(rank >> digit, kind="stable")
        rank, w = rank[order], w[order]
    return total


def _discordant_cells(cells: pd.DataFrame) -> int:
    """Weight of the pairs of cells of which one lies left of and above the other."""
    size = int(max(cells["sx"].max(), cells["sy"].max())) + 1
    grid = np.zeros((size, size), dtype=np.int64)
    grid[cells["sx"], cells["sy"]] = cells["w"]
    left = np.cumsum(grid, axis=0) - grid                               # all further left, same stripe of y
    above = left[:, ::-1].cumsum(axis=1)[:, ::-1] - left                # further left and above
    used = (grid > 0) & (above > 0)
    return int(grid[used].astype(object).dot(above[used].astype(object))) if used.any() else 0


def _striped(bounds: dict[int, tuple[np.ndarray, np.ndarray]]):
    """Add the stripes sx and sy: odd ones are bounds, even ones lie between them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pair = np.asarray(b.column("pair"))
            stripes = []
            for k, name in enumerate(("x", "y")):
                value = np.asarray(b.column(name))
                out = np.zeros(len(value), dtype=np.int32)
                for p in np.unique(pair):
                    here = pair == p
                    cut = bounds[int(p)][k]
                    below = np.searchsorted(cut, value[here], side="left")
                    out[here] = 2 * below + (np.searchsorted(cut, value[here], side="right") > below)
                stripes.append(out)
            yield pa.RecordBatch.from_arrays([*b.columns, *map(pa.array, stripes)], names=[*b.schema.names, "sx", "sy"])
    return run


def kendall_pairs(df: DataFrame, cols: Sequence[str] | None = None, pairs: Sequence[tuple[str, str]] | None = None,
                  stripe_rows: int = STRIPE_ROWS) -> DataFrame:
    """(feature1, feature2, n, tau): tau-b over the rows where both are present, unrounded; null if either
    is constant there.  Pairs without a row are left out; NaN counts as missing."""
    df = nan_to_null(df)
    cols = list(cols or [c for c in df.columns if is_numeric(df.schema[c].dataType)])
    pairs = list(pairs if pairs is not None else [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]])
    spark = df.sparkSession
    if not pairs:
        return spark.createDataFrame([], "feature1 string, feature2 string, n long, tau double")
    both = F.array(*[F.struct(F.lit(i).alias("pair"), as_double(df, a).alias("x"), as_double(df, b).alias("y")) for i, (a, b) in enumerate(pairs)])
    rows = (df.select(F.explode(both).alias("r")).select("r.*").where("x IS NOT NULL AND y IS NOT NULL")
            .groupBy("pair", "x", "y").agg(F.count(F.lit(1)).alias("w")))
    rows = reliable_checkpoint(rows)
    most = rows.groupBy("pair").count().agg(F.max("count")).first()[0] or 0
    stripes = int(min(MAX_STRIPES, -(-most // stripe_rows)))
    # one row for each pair of columns, of `stripes` bounds
    probs = [i / stripes for i in range(1, stripes)]
    bounds = {i: (np.zeros(0), np.zeros(0)) for i in range(len(pairs))}
    if probs:
        for r in rows.groupBy("pair").agg(*[F.percentile_approx(c, probs, 10_000).alias(c) for c in ("x", "y")]).collect():
            bounds[r["pair"]] = (np.unique(r["x"]), np.unique(r["y"]))
    placed = rows.mapInArrow(_striped(bounds), "pair int, x double, y double, w long, sx int, sy int")

    def inside(key: tuple, t: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"pair": [key[0]], "d": [Decimal(inversions(t["a"].to_numpy(), t["b"].to_numpy(), t["w"].to_numpy()))]})

    def across(key: tuple, t: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"pair": [key[0]], "d": [Decimal(_discordant_cells(t))]})

    in_x = placed.where("sx % 2 = 0").select("pair", F.lit(0).alias("way"), F.col("sx").alias("s"), F.col("x").alias("a"), F.col("y").alias("b"), "w")
    in_y = placed.where("sy % 2 = 0").select("pair", F.lit(1).alias("way"), F.col("sy").alias("s"), F.col("sx").cast("double").alias("a"), F.col("y").alias("b"), "w")
    local = in_x.union(in_y).groupBy("pair", "way", "s").applyInPandas(inside, "pair int, d decimal(38,0)")
    cells = placed.groupBy("pair", "sx", "sy").agg(F.sum("w").alias("w"))  # at most (2 x stripes + 1)^2 for each pair of columns
    discordant = (local.union(cells.groupBy("pair").applyInPandas(across, "pair int, d decimal(38,0)"))
                  .groupBy("pair").agg(F.sum("d").cast("decimal(38,0)").alias("d")))

    def tied(*by: str) -> DataFrame:
        """Pairs of rows that agree in ``by``."""
        t = F.col("t").cast("decimal(19,0)")
        return (rows.groupBy("pair", *by).agg(F.sum("w").alias("t")).groupBy("pair")
                .agg((F.sum((t * (t - 1)).cast("decimal(38,0)")).cast("decimal(38,0)") / 2).cast("decimal(38,0)").alias("t" + "".join(by)), F.sum("t").alias("n" + "".join(by))))

    out = tied().join(tied("x").drop("nx"), "pair").join(tied("y").drop("ny"), "pair").join(tied("x", "y").drop("nxy"), "pair").join(discordant, "pair", "left")
    d = F.coalesce(F.col("d"), F.lit(0)).cast("decimal(38,0)")
    score = (F.col("t") - F.col("tx") - F.col("ty") + F.col("txy") - 2 * d).cast("double")
    spread = F.sqrt((F.col("t") - F.col("tx")).cast("double")) * F.sqrt((F.col("t") - F.col("ty")).cast("double"))
    names = F.array(*[F.struct(F.lit(a).alias("feature1"), F.lit(b).alias("feature2")) for a, b in pairs])
    tau = F.try_divide(score, spread)
    return out.select(names[F.col("pair")].alias("f"), F.col("n").cast("long").alias("n"),
                      F.when(tau.isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), tau))).alias("tau")).select("f.*", "n", "tau")


def corr_kendall(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """feature1, feature2, n, kendall (tau-b, 4 dp) of every pair of numeric columns."""
    return kendall_pairs(df, cols).select("feature1", "feature2", "n", r4(F.col("tau")).alias("kendall"))
