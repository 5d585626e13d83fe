"""Missing-value operators: per-column counts, patterns, co-occurrence and correlation.

Everything is one pass over the rows: null counts are ``count_if`` in one wide
aggregate; null patterns are grouped as a boolean array (map-side combined, at most
2^k groups, in practice a handful); co-missingness is pairwise ``count_if`` in one
aggregate over the columns that have nulls at all.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablescope.functions.exprs import col, head, nan_to_null, pct, r4, rnd, with_scalars
from tablescope.operators.profile import missing_counts


def missing_profile(df: DataFrame) -> DataFrame:
    """column, missing_count, missing_pct (2 dp), severity, completely / high missing; desc."""
    t = missing_counts(df)
    p = pct(F.col("missing_count"), F.col("rows"))
    return t.select(
        "column", "missing_count", p.alias("missing_pct"),
        F.when(p > 50, "High").when(p > 20, "Medium").otherwise("Low").alias("severity"),
        (p == 100).alias("completely_missing"), (p > 50).alias("high_missing"),
    ).orderBy(F.desc("missing_pct"), "column")


def missing_summary(df: DataFrame) -> DataFrame:
    """One row: columns with missing, their average %, cells, missing cells, overall rate,
    empty columns, worst column and its %."""
    t = missing_counts(df).withColumn("_p", F.col("missing_count") * 100.0 / F.col("rows"))
    k = len(df.columns)
    return t.agg(
        F.count_if(F.col("missing_count") > 0).cast("long").alias("columns_with_missing"),
        rnd(F.avg(F.when(F.col("missing_count") > 0, F.col("_p"))), 2).alias("avg_missing_pct"),
        (F.max("rows") * k).cast("long").alias("total_cells"),
        F.sum("missing_count").cast("long").alias("missing_cells"),
        rnd(F.coalesce(F.try_divide(F.sum("missing_count") * 100.0, F.max("rows") * k), F.lit(0.0)), 2)
        .alias("overall_missing_pct"),
        F.count_if(F.col("_p") == 100).cast("long").alias("empty_columns"),
        F.min(F.when(F.col("missing_count") > 0, F.struct(-F.col("_p"), F.col("column")))).alias("_w"),
    ).select("*", F.col("_w.column").alias("worst_column"), rnd(-F.col("_w.col1"), 2).alias("worst_pct")).drop("_w")


def missing_bar(df: DataFrame, k: int | None = None) -> DataFrame:
    """Columns with missing values, the highest missing % first."""
    return head(missing_profile(df).where(F.col("missing_count") > 0).orderBy(
        F.desc("missing_pct"), "column"), k).select("column", "missing_count", "missing_pct")


def missing_combinations(df: DataFrame, k: int | None = None) -> DataFrame:
    """Null patterns (all-present excluded), most frequent first: columns, n, % of rows."""
    df = nan_to_null(df)
    cols = list(df.columns)
    names = F.array(*[F.when(col(c).isNull(), F.lit(c)) for c in cols])
    pat = df.select(F.array_join(F.filter(names, lambda x: x.isNotNull()), ",").alias("columns"))
    g = pat.groupBy("columns").agg(F.count(F.lit(1)).cast("long").alias("n"))
    tot = g.agg(F.sum("n").alias("_rows"))
    top = head(g.where(F.col("columns") != "").orderBy(F.desc("n"), "columns"), k)
    return with_scalars(top, tot).select("columns", "n", pct(F.col("n"), F.col("_rows")).alias("pct"))


def _missing_cols(df: DataFrame) -> list[str]:
    t = missing_counts(df).where(F.col("missing_count") > 0).select("column").collect()
    present = {r[0] for r in t}
    return [c for c in df.columns if c in present]


def missing_together(df: DataFrame, threshold: float = 0.8, k: int | None = None) -> DataFrame:
    """Ordered pairs (a, b): share of a's nulls where b is null too, above threshold; strongest first."""
    df = nan_to_null(df)
    cols = _missing_cols(df)
    if len(cols) < 2:
        return df.sparkSession.createDataFrame([], "column_a string, column_b string, a_missing long, "
                                                   "both_missing long, share double")
    pairs = [(a, b) for a in cols for b in cols if a != b]
    aggs = [F.count_if(col(c).isNull()).alias(f"m{i}") for i, c in enumerate(cols)]
    idx = {c: i for i, c in enumerate(cols)}
    aggs += [F.count_if(col(a).isNull() & col(b).isNull()).alias(f"b{j}") for j, (a, b) in enumerate(pairs)]
    one = df.agg(*aggs)
    arr = F.array(*[F.struct(F.lit(j).alias("ord"), F.lit(a).alias("column_a"), F.lit(b).alias("column_b"),
                             F.col(f"m{idx[a]}").cast("long").alias("a_missing"),
                             F.col(f"b{j}").cast("long").alias("both_missing")) for j, (a, b) in enumerate(pairs)])
    t = one.select(F.explode(arr).alias("r")).select("r.*")
    share = F.col("both_missing") / F.col("a_missing")
    return (head(t.where(share > threshold).orderBy(F.desc(share), "ord"), k)
            .select("column_a", "column_b", "a_missing", "both_missing", r4(share).alias("share")))


def missing_correlation(df: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Pearson correlation of the null indicators of columns with nulls; |r| > threshold kept."""
    from tablescope.operators.assoc import pearson_pairs
    df = nan_to_null(df)
    cols = _missing_cols(df)
    if len(cols) < 2:
        return df.sparkSession.createDataFrame([], "feature1 string, feature2 string, n long, pearson double")
    ind = df.select(*[col(c).isNull().cast("double").alias(c) for c in cols])
    pr = pearson_pairs(ind, cols)
    return pr.where(F.abs("r") > threshold).select("feature1", "feature2", "n", r4(F.col("r")).alias("pearson"))


def drop_rows_report(df: DataFrame, subset: Sequence[str]) -> DataFrame:
    """Rows before / after dropping rows with a null in ``subset`` (one row)."""
    df = nan_to_null(df)
    cond = F.lit(False)
    for c in subset:
        cond = cond | col(c).isNull()
    return df.agg(F.count(F.lit(1)).cast("long").alias("rows_before"),
                  F.count_if(~cond).cast("long").alias("rows_after")).withColumn(
        "rows_removed", F.col("rows_before") - F.col("rows_after"))
