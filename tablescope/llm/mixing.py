"""Mixing sources to target weights by hierarchical budgeting (DataFrame functions only).

The tree is domain - language - source; its leaves hold documents.  A token budget goes from the
root to the leaves: the children of a node share the node's tokens in proportion to their weights,
a child never gets more than its subtree can give (its tokens times ``max_epochs``), and what it
cannot take goes to its siblings first, and past them only when all of them are full too.  A leaf
with budget B and T tokens gives B div T whole epochs and, from the next epoch's seeded order, the
prefix whose tokens start below B mod T.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablescope.llm.common import staged

WORD = r"[^\x20\x09-\x0D]+"
#: Leading hex digits of the order key that make a leaf's buckets: 4096 of them.
BUCKET_DIGITS = 3


def _weight(level: Column, weights: dict[str, int] | None, default: int) -> Column:
    out = F.lit(default)
    for k, w in (weights or {}).items():
        out = F.when(level == F.lit(k), F.lit(int(w))).otherwise(out)
    return F.greatest(out, F.lit(0)).cast("double")


def _fill(nodes: DataFrame, parent: list[str]) -> DataFrame:
    """Share ``budget`` (of the parent) among the rows of one parent; adds ``given``.

    Rows are taken by rising capacity per weight.  A row is full while the level, which is the
    parent's rest divided by the weights not yet full, reaches its capacity per weight.
    """
    order = [F.asc("ratio"), *[F.asc_nulls_first(c) for c in ("domain", "language", "source") if c in nodes.columns]]
    by = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    before = by.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rest = by.orderBy(*order).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    ready = nodes.withColumn("ratio", F.when(F.col("w") > 0, F.col("cap") / F.col("w")).otherwise(F.lit(float("inf"))))
    level = (F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.nullif(F.sum("w").over(rest), F.lit(0.0))
    ready = ready.withColumn("level", level).withColumn("full", (F.col("w") > 0) & (F.col("level") >= F.col("ratio")))
    # the level falls from row to row once one is not full: the first of those has the largest
    common = F.max(F.when((F.col("w") > 0) & ~F.col("full"), F.col("level"))).over(by)
    ready = ready.withColumn("common", common)
    given = (F.when(F.col("w") <= 0, F.lit(0)).when(F.col("full"), F.col("cap"))
             .otherwise(F.least(F.col("cap"), F.floor(F.col("w") * F.col("common")))))
    return ready.withColumn("given", given.cast("long")).drop("ratio", "level", "full", "common")


def leaf_budgets(leaves: DataFrame, budget: Column, max_epochs: int, domain_weights: dict[str, int] | None,
                 language_weights: dict[str, int] | None, source_weights: dict[str, int] | None,
                 default: int = 1) -> DataFrame:
    """``leaves(domain, language, source, tokens)`` with ``given``: the tokens of each leaf."""
    # what lies under a weight of 0 can take nothing, so its parents count no capacity for it
    least = F.least(*[_weight(F.col(c), w, default) for c, w in
                      (("domain", domain_weights), ("language", language_weights), ("source", source_weights))])
    leaves = leaves.withColumn("cap", F.when(least > 0, F.col("tokens") * max_epochs).otherwise(F.lit(0)).cast("long"))
    langs = leaves.groupBy("domain", "language").agg(F.sum("cap").alias("cap"))
    domains = langs.groupBy("domain").agg(F.sum("cap").alias("cap"))
    total = leaves.agg(budget.alias("budget"))
    top = _fill(domains.crossJoin(F.broadcast(total)).withColumn("w", _weight(F.col("domain"), domain_weights, default)), [])
    mid = _fill(langs.alias("l").join(top.select(F.col("domain").alias("d"), F.col("given").alias("budget")),
                                      F.expr("domain <=> d")).drop("d")
                .withColumn("w", _weight(F.col("language"), language_weights, default)), ["domain"])
    low = _fill(leaves.join(mid.select(F.col("domain").alias("d"), F.col("language").alias("g"), F.col("given").alias("budget")),
                            F.expr("domain <=> d AND language <=> g")).drop("d", "g")
                .withColumn("w", _weight(F.col("source"), source_weights, default)), ["domain", "language"])
    return low.select("domain", "language", "source", "tokens", "given")


def mix(df: DataFrame, domain: Column, language: Column, source: Column, budget_share: float = 0.9,
        max_epochs: int = 2, domain_weights: dict[str, int] | None = None,
        language_weights: dict[str, int] | None = None, source_weights: dict[str, int] | None = None,
        seed: int = 7, id_col: str = "doc_id", text_col: str = "text", rows: bool = False) -> DataFrame:
    """One row per row of ``df``: doc_id, domain, language, source, n_tokens, copies (0: not taken).

    The budget is ``floor(budget_share * all tokens)``.  With ``rows`` the result is instead the
    rows of ``df`` that are taken, each ``copies`` times.  Defined cases: null text is the empty
    text and has no tokens; null levels are branches of their own; a weight of 0 takes nothing;
    rows that repeat identifier and text are taken together; an empty table gives no rows.
    """
    tie = F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))
    levels = {"domain": domain, "language": language, "source": source}
    n_tokens = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    # the narrow table of keys and sizes; texts are not carried through any shuffle
    base = staged(df.select(F.col(id_col).cast("long").alias("doc_id"), tie.alias("tie"),
                            *[c.alias(k) for k, c in levels.items()], n_tokens.alias("n_tokens")), "mixing")
    leaves = base.groupBy(*levels).agg(F.sum("n_tokens").alias("tokens"))
    plan = leaf_budgets(leaves, F.floor(F.coalesce(F.sum("tokens"), F.lit(0)) * F.lit(budget_share)), max_epochs,
                        domain_weights, language_weights, source_weights)
    some = F.col("tokens") > 0
    # written first: the join with documents then knows its size, and broadcasts it only if that is small
    plan = staged(plan.select(F.col("domain").alias("d"), F.col("language").alias("g"), F.col("source").alias("s"),
                              F.when(some, F.floor(F.col("given") / F.col("tokens"))).otherwise(0).cast("long").alias("epochs"),
                              F.when(some, F.col("given") % F.col("tokens")).otherwise(0).cast("long").alias("rest")), "mixing-plan")
    same_leaf = F.expr("domain <=> d AND language <=> g AND source <=> s")

    def order_key(epochs: Column) -> Column:
        return F.md5(F.concat_ws(":", F.lit(str(seed)), epochs.cast("string"), F.col("doc_id").cast("string"),
                                 F.col("tie")).cast("binary"))

    keyed = (base.join(plan, same_leaf).select("d", "g", "s", "rest", "n_tokens", order_key(F.col("epochs")).alias("key"))
             .withColumn("bucket", F.substring("key", 1, BUCKET_DIGITS)))
    sums = keyed.groupBy("d", "g", "s", "rest", "bucket").agg(F.sum("n_tokens").alias("bucket_tokens"))
    leaf = Window.partitionBy("d", "g", "s")
    before = F.coalesce(F.sum("bucket_tokens").over(leaf.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # the one bucket of each leaf in which the prefix ends: only its rows are put in order
    last = (sums.withColumn("bucket_start", before).where("bucket_start < rest AND bucket_start + bucket_tokens >= rest")
            .select(F.col("d").alias("d2"), F.col("g").alias("g2"), F.col("s").alias("s2"),
                    F.col("bucket").alias("last_bucket"), "bucket_start"))
    running = F.coalesce(F.sum("n_tokens").over(leaf.orderBy("key").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cut = (keyed.join(last, F.expr("d <=> d2 AND g <=> g2 AND s <=> s2 AND bucket = last_bucket"))
           .withColumn("at", F.col("bucket_start") + running).where("at < rest")
           .groupBy(F.col("d").alias("d2"), F.col("g").alias("g2"), F.col("s").alias("s2")).agg(F.max("key").alias("cut")))
    plan = staged(plan.join(cut, F.expr("d <=> d2 AND g <=> g2 AND s <=> s2"), "left").drop("d2", "g2", "s2"), "mixing-cut")
    copies = F.col("epochs") + F.coalesce(order_key(F.col("epochs")) <= F.col("cut"), F.lit(False)).cast("long")
    if not rows:
        return base.join(plan, same_leaf).select("doc_id", *levels, "n_tokens", copies.alias("copies"))
    wide = df.select(F.struct("*").alias("row"), F.col(id_col).cast("long").alias("doc_id"), tie.alias("tie"),
                     *[c.alias(k) for k, c in levels.items()])
    return (wide.join(plan, same_leaf).select("row", copies.cast("int").alias("copies")).where("copies > 0")
            .select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).select("row.*"))
