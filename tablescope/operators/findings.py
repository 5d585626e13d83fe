"""Scored findings: rule sets evaluated as filters over the one-row dataset profile.

A rule is (rule set, name, predicate, category, severity, priority, action needed).
``findings`` evaluates every rule against the profile row Spark computed and returns
one tall table; key findings, action items and the business / band flags are views
of it.  The prose of the original tool is not reproduced, only the triggers.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablescope.functions.constants import (
    PRIORITY_BAND_LOWEST, PRIORITY_BANDS, SIZE_FACTOR_LOWEST, SIZE_FACTORS, WIDTH_FACTOR_LOWEST, WIDTH_FACTORS,
)
from tablescope.functions.exprs import as_double, head, is_numeric, ladder, nan_to_null, r4, tall_agg, with_scalars
from tablescope.operators.quality import dataset_profile


def scores_row(profile: DataFrame) -> DataFrame:
    """Add complexity, processing complexity and investment priority to a profile row."""
    c = F.col
    k = c("columns").cast("double")
    complexity = (30 * F.least(k / 100, F.lit(1.0)) + 20 * F.least(c("high_cardinality_columns") / 10.0, F.lit(1.0))
                  + 25 * c("columns_with_missing") / k + 25 * c("n_robust_categorical") / k)
    proc = (F.least(c("missing_pct") / 50.0, F.lit(1.0)) + F.coalesce(F.try_divide(c("many_valued_categorical"), c("n_categorical")), F.lit(0.0))
            + F.least(F.coalesce(F.try_divide(c("outlier_warnings"), c("n_numeric")), F.lit(0.0)), F.lit(1.0))
            + F.least(c("high_warnings") / 10.0, F.lit(1.0))) / 4.0
    size = ladder(c("rows"), SIZE_FACTORS, SIZE_FACTOR_LOWEST)
    width = ladder(c("columns"), WIDTH_FACTORS, WIDTH_FACTOR_LOWEST)
    t = profile.withColumn("complexity_score", r4(complexity)).withColumn("processing_complexity", r4(proc))
    return t.withColumn("size_factor", size).withColumn("width_factor", width)


def _priority(has_target: bool) -> Column:
    """Mean of the five factors of a scores row, between 0 and 1."""
    return (F.col("density") / 100 + F.col("size_factor") + F.col("width_factor")
            + (1 - F.col("processing_complexity")) + F.lit(1.0 if has_target else 0.7)) / 5.0


def complexity_score(df: DataFrame, target: str | None = None) -> DataFrame:
    """30 min(k/100,1) + 20 min(high-card/10,1) + 25 share with missing + 25 share categorical."""
    s = scores_row(dataset_profile(df, target))
    return s.select("columns", "high_cardinality_columns", "columns_with_missing", "n_robust_categorical",
                    "complexity_score", F.when(F.col("complexity_score") > 70, "High")
                    .when(F.col("complexity_score") < 30, "Low").otherwise("Medium").alias("readiness_complexity"))


def investment_priority(df: DataFrame, target: str | None = None) -> DataFrame:
    """Mean of density/100, size factor, width factor, 1 - processing complexity, target factor."""
    s = scores_row(dataset_profile(df, target))
    tgt = 1.0 if target else 0.7
    score = _priority(target is not None)
    return s.select("density", "size_factor", "width_factor", "processing_complexity",
                    F.lit(tgt).alias("target_factor"), r4(score).alias("investment_priority"),
                    ladder(score, PRIORITY_BANDS, PRIORITY_BAND_LOWEST).alias("priority_band"))


def rule_facts(df: DataFrame, target: str | None = None, issues: DataFrame | None = None) -> DataFrame:
    """One row of what the rules read beside the profile.

    ``related_pairs`` numeric pairs with |r| > 0.3 over more than 10 rows, ``collinear`` whether three numeric
    columns or more hold a pair above 0.8, ``highly_skewed_columns`` (|skewness| > 2), ``quality_issues``,
    and of the target its task, the severity of its imbalance and whether Jarque-Bera takes it as normal
    (null where that does not apply).  The target is not a feature.  ``issues``: the frame's ``quality_issues``
    where they are known already."""
    from tablescope.operators.assoc import pearson_pairs
    from tablescope.operators.profile import class_balance
    from tablescope.operators.quality import quality_issues
    from tablescope.operators.types import task_type
    df = nan_to_null(df)
    nums = [c for c in df.columns if c != target and is_numeric(df.schema[c].dataType)]
    one = (quality_issues(df) if issues is None else issues).agg(F.count(F.lit(1)).cast("long").alias("quality_issues"))
    r = F.abs("r")
    one = with_scalars(one, pearson_pairs(df, nums).agg(
        F.count_if((r > 0.3) & (F.col("n") > 10)).cast("long").alias("related_pairs"),
        (F.lit(len(nums) >= 3) & (F.count_if(r > 0.8) > 0)).alias("collinear")))
    if nums:
        skew = tall_agg(df, nums, lambda c: {"skewness": F.skewness(as_double(df, c))}, ["skewness"])
        one = with_scalars(one, skew.agg(F.count_if(F.abs("skewness") > 2).cast("long").alias("highly_skewed_columns")))
    else:
        one = one.withColumn("highly_skewed_columns", F.lit(0).cast("long"))
    if target is None:
        return one.select("*", *[F.lit(None).cast(t).alias(c) for c, t in
                                 (("task_type", "string"), ("imbalance", "string"), ("target_normal", "boolean"))])
    one = with_scalars(with_scalars(one, task_type(df, target).select("task_type")),
                       class_balance(df, target).agg(F.max("severity").alias("imbalance")))
    if not is_numeric(df.schema[target].dataType):
        return one.withColumn("target_normal", F.lit(None).cast("boolean"))
    x = as_double(df, target)
    jb = F.count(x) / 6.0 * (F.pow(F.skewness(x), 2) + F.pow(F.kurtosis(x), 2) / 4.0)
    return with_scalars(one, df.agg((F.exp(-jb / 2.0) > 0.05).alias("target_normal")))


def _rules(has_target: bool) -> list[tuple[str, str, Column, str, str, int, bool]]:
    c = F.col
    n, k = c("rows"), c("columns")
    classes, regression = c("task_type") == "classification", c("task_type") == "regression"
    imbalanced = c("imbalance") == "high"
    normal = F.coalesce(c("target_normal"), F.lit(True))
    poor = [c("missing_pct") > 20, c("duplicate_pct") > 5, c("constant_columns") > 0, c("mixed_type_columns") > 0,
            c("id_like_columns") > 1]
    return [
        # structure
        ("structure", "high_missing_columns", c("columns_over_half_missing") > 0, "data_quality", "high", 8, True),
        ("structure", "high_cardinality", c("high_cardinality_columns") > 0, "feature_engineering", "medium", 6, True),
        ("structure", "wide_table", (k > 0.1 * n) & (k > 10), "dimensionality", "high", 8, True),
        ("structure", "complex_dataset", c("complexity_score") > 70, "analysis_strategy", "high", 7, True),
        # preprocessing
        ("preprocessing", "missing_values", c("columns_over_half_missing") > 0, "missing_values", "high", 8, True),
        ("preprocessing", "encoding", c("many_valued_categorical") > 0, "encoding", "medium", 5, True),
        ("preprocessing", "scaling", c("n_numeric") > 1, "scaling", "medium", 4, False),
        ("preprocessing", "outliers", c("outlier_warnings") > 0, "outliers", "medium", 6, True),
        # feature engineering
        ("feature_engineering", "transformations", c("highly_skewed_columns") > 0, "transformations", "medium", 5, False),
        ("feature_engineering", "interactions", c("related_pairs") > 0, "feature_interactions", "low", 4, False),
        ("feature_engineering", "dimensionality", c("n_numeric") > 10, "dimensionality", "medium", 5, False),
        ("feature_engineering", "datetime_features", c("n_datetime") > 0, "datetime_features", "medium", 5, False),
        # modelling
        ("modelling", "small_dataset", n < 1000, "small_dataset", "high", 8, True),
        ("modelling", "large_dataset", n > 100000, "large_dataset", "medium", 5, False),
        ("modelling", "more_features_than_rows", k > n, "dimensionality", "high", 9, True),
        ("modelling", "imbalanced_classes", classes & imbalanced, "classification_imbalanced", "high", 9, True),
        ("modelling", "balanced_classes", classes & ~imbalanced, "classification_balanced", "medium", 5, False),
        ("modelling", "non_normal_target", regression & ~normal, "regression_non_normal", "medium", 6, True),
        ("modelling", "normal_target", regression & normal, "regression_normal", "medium", 5, False),
        ("modelling", "multicollinearity", c("collinear"), "multicollinearity", "medium", 6, True),
        # data collection
        ("data_collection", "quality_issues", c("quality_issues") > 0, "data_quality", "medium", 6, True),
        ("data_collection", "incomplete", c("missing_pct") > 20, "completeness", "high", 8, True),
        ("data_collection", "too_few_rows", n < 100, "sample_size", "high", 8, True),
        ("data_collection", "few_rows", (n >= 100) & (n < 1000), "sample_size", "medium", 6, True),
        ("data_collection", "only_numeric", (c("n_categorical") == 0) & (c("n_numeric") > 0), "diversity", "low", 4, False),
        ("data_collection", "only_categorical", (c("n_numeric") == 0) & (c("n_categorical") > 0), "diversity", "low", 4, False),
        # business
        ("business", "density_high", c("density") > 90, "data_richness", "high", 5, False),
        ("business", "density_medium", (c("density") > 70) & (c("density") <= 90), "data_richness", "medium", 5, False),
        ("business", "density_low", c("density") <= 70, "data_richness", "low", 7, True),
        ("business", "volume_high", n > 10000, "volume", "high", 5, False),
        ("business", "volume_low", n < 100, "volume", "low", 7, True),
        ("business", "complexity_high", c("processing_complexity") > 0.7, "complexity", "high", 6, True),
        ("business", "complexity_low", c("processing_complexity") < 0.3, "complexity", "low", 4, False),
        ("business", "temporal", c("n_datetime") > 0, "opportunity", "medium", 4, False),
        ("business", "many_categories", c("n_categorical") > 5, "opportunity", "medium", 4, False),
        ("business", "quality_risk", c("high_warnings") > 3, "risk", "high", 8, True),
        ("business", "privacy_risk", c("pii_columns") > 0, "risk", "high", 8, True),
        ("business", "sample_risk", n < 1000, "risk", "medium", 6, True),
        ("business", "quick_win", (c("density") > 85) & (c("processing_complexity") < 0.4), "quick_wins", "low", 5, False),
        ("business", "strategic", (n > 10000) & (k > 10), "strategic_value", "high", 5, False),
        # key findings
        ("key", "low_density", c("density") < 70, "data_quality", "high", 10, True),
        ("key", "excellent_density", c("density") > 95, "data_quality", "low", 7, False),
        ("key", "tiny_dataset", n < 100, "dataset_size", "high", 8, True),
        ("key", "large_dataset", n > 10000, "dataset_size", "low", 5, False),
        ("key", "features_exceed_rows", k > n, "dimensionality", "high", 9, True),
        ("key", "many_features", (k > 20) & (k <= n), "dimensionality", "medium", 4, False),
        ("key", "half_missing_columns", c("columns_over_half_missing") > 0, "missing_data", "high", 8, True),
        ("key", "many_high_warnings", c("high_warnings") > 5, "warnings", "high", 10, True),
        ("key", "some_high_warnings", (c("high_warnings") > 0) & (c("high_warnings") <= 5), "warnings", "medium", 7, True),
        ("key", "high_value", _priority(has_target) > 0.8, "business_value", "low", 6, False),
        ("key", "low_value", _priority(has_target) < 0.4, "business_value", "high", 8, True),
        ("key", "class_imbalance", classes & imbalanced, "target", "high", 9, True),
        ("key", "target_suitable", (classes & ~imbalanced) | regression, "target", "medium", 6, False),
        ("key", "many_related_pairs", c("related_pairs") > 10, "relationships", "medium", 7, True),
        ("key", "related_pairs", c("related_pairs").between(1, 10), "relationships", "low", 5, False),
        # quality report
        ("quality", "missing_rate", poor[0], "missing", "high", 8, True),
        ("quality", "duplicates", poor[1], "duplicates", "medium", 6, True),
        ("quality", "constant_columns", poor[2], "constants", "medium", 6, True),
        ("quality", "type_issues", poor[3], "types", "medium", 6, True),
        ("quality", "id_like_columns", poor[4], "identifiers", "low", 4, True),
        ("quality", "good_condition", ~(poor[0] | poor[1] | poor[2] | poor[3] | poor[4]), "condition", "low", 3, False),
    ]


def findings(df: DataFrame, target: str | None = None, profile: DataFrame | None = None,
             issues: DataFrame | None = None) -> DataFrame:
    """Every triggered rule: rule_set, rule, category, severity, priority, action_needed.

    ``profile``, ``issues``: the frame's ``dataset_profile`` and ``quality_issues`` where they are known already."""
    prof = dataset_profile(df, target) if profile is None else profile
    prof = with_scalars(scores_row(prof), rule_facts(df, target, issues))
    rules = _rules(target is not None)
    arr = F.array(*[F.struct(F.lit(rs).alias("rule_set"), F.lit(name).alias("rule"), pred.alias("hit"),
                             F.lit(cat).alias("category"), F.lit(sev).alias("severity"),
                             F.lit(pri).cast("long").alias("priority"), F.lit(act).alias("action_needed"))
                    for rs, name, pred, cat, sev, pri, act in rules])
    return (prof.select(F.explode(arr).alias("f")).select("f.*").where(F.coalesce("hit", F.lit(False)))
            .drop("hit"))


def key_findings(df: DataFrame, target: str | None = None, k: int | None = None, found: DataFrame | None = None) -> DataFrame:
    """Key findings by priority (the top k if asked for), plus a summary row (priority 5) when any of them
    needs action; the summary itself needs action when more than half of them do.  ``found``: the frame's ``findings``
    where they are known already."""
    f = (findings(df, target) if found is None else found).where(F.col("rule_set") == "key")
    # at most one entry per rule: gathered in one row, so that the dataset is profiled once
    entry = F.struct((-F.col("priority")).alias("rank"), "rule", "rule_set", "category", "severity", "priority", "action_needed")
    one = f.agg(F.array_sort(F.collect_list(entry)).alias("top"))
    if k is not None:
        one = one.select(F.slice("top", 1, k).alias("top"))
    to_do = F.size(F.filter("top", lambda e: e["action_needed"]))
    summary = F.struct(F.lit(0).cast("long").alias("rank"), F.lit("summary").alias("rule"), F.lit("key").alias("rule_set"),
                       F.lit("summary").alias("category"), F.lit("medium").alias("severity"),
                       F.lit(5).cast("long").alias("priority"), (to_do > F.floor(F.size("top") / 2)).alias("action_needed"))
    last = F.when(to_do > 0, F.array(summary)).otherwise(F.slice("top", 1, 0))
    return one.select(F.inline(F.concat("top", last))).select("rule_set", "rule", "category", "severity", "priority", "action_needed")


def action_items(df: DataFrame, target: str | None = None, k: int | None = None, found: DataFrame | None = None) -> DataFrame:
    """High-priority structure rows first, then other actionable findings.  ``found``: as for ``key_findings``."""
    f = (findings(df, target) if found is None else found).where(F.col("action_needed"))
    order = F.when((F.col("rule_set") == "structure") & (F.col("severity") == "high"), 0).otherwise(1)
    return head(f.orderBy(order, F.desc("priority"), "rule_set", "rule"), k)


def dataset_bands(df: DataFrame, target: str | None = None) -> DataFrame:
    """Size, completeness, warning, relationship and dominant-type bands of the dataset.

    Related pairs are numeric pairs with |r| > 0.3 over more than 10 rows."""
    from tablescope.operators.assoc import pearson_pairs
    pairs = pearson_pairs(df).where((F.abs("r") > 0.3) & (F.col("n") > 10)).agg(
        F.count(F.lit(1)).cast("long").alias("related_pairs"))
    prof = with_scalars(dataset_profile(df, target), pairs)
    c = F.col
    size = (F.when(c("rows") < 100, "tiny").when(c("rows") < 1000, "small").when(c("rows") < 10000, "medium")
            .when(c("rows") < 100000, "large").otherwise("very_large"))
    comp = (F.when(c("density") >= 95, "excellent").when(c("density") >= 85, "good").when(c("density") >= 70, "fair")
            .otherwise("poor"))
    warn = (F.when(c("high_warnings") == 0, "clean").when(c("high_warnings") <= 3, "minor")
            .when(c("high_warnings") <= 6, "moderate").otherwise("severe"))
    rel = (F.when(c("related_pairs") == 0, "none").when(c("related_pairs") < 5, "few")
           .when(c("related_pairs") < 15, "many").otherwise("very_many"))
    dom = F.when(c("n_numeric") >= c("n_categorical"), "numeric").otherwise("categorical")
    return prof.select("rows", "density", "high_warnings", "related_pairs", rel.alias("relationship_band"), size.alias("size_band"), comp.alias("completeness_band"),
                       warn.alias("warning_band"), dom.alias("dominant_type"))


def _fired(one: DataFrame, rules: list[tuple[str, Column, Column]]) -> DataFrame:
    """(flag, value) of the rules that hold on a one-row table."""
    return one.select(F.inline(F.array(*[F.struct(F.lit(name).alias("flag"), r4(value.cast("double")).alias("value"),
                                                  hit.alias("hit")) for name, value, hit in rules]))
                      ).where("hit").drop("hit")


def correlation_flags(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """(flag, value): mean |r| above 0.5 or below 0.2, pairs above 0.8 present, more than 5 of them.

    Sparse rows are dropped and gaps filled with medians, as for ``corr_advanced_summary``."""
    from tablescope.operators.assoc import feature_matrix, pearson_pairs
    one = pearson_pairs(feature_matrix(df, cols)).where(F.col("r").isNotNull()).agg(
        F.avg(F.abs("r")).alias("m"), F.count_if(F.abs("r") > 0.8).alias("k"))
    m, k = F.col("m"), F.col("k")
    return _fired(one, [("high_average", m, m > 0.5), ("collinear_pairs", k, k > 0), ("severe_collinearity", k, k > 5),
                        ("mostly_independent", m, m < 0.2)])


def target_recommendation_flags(df: DataFrame, target: str) -> DataFrame:
    """(flag, value) for the target: the balance of its classes, or the shape of a numeric one.

    A regression target is not normal when Jarque-Bera rejects normality at 5 %."""
    from tablescope.operators.profile import class_balance
    from tablescope.operators.types import task_type
    df = nan_to_null(df)
    one = with_scalars(task_type(df, target).select("task_type"), class_balance(df, target).agg(
        F.max("severity").alias("severity"), F.max("imbalance_ratio").alias("ratio")))
    cls = F.col("task_type") == "classification"
    rules = [(name, F.col("ratio"), cls & (F.col("severity") == sev)) for name, sev in
             [("single_class", "critical"), ("severe_imbalance", "high"), ("moderate_imbalance", "medium"),
              ("balanced", "low")]]
    if is_numeric(df.schema[target].dataType):
        x = as_double(df, target)
        one = with_scalars(one, df.agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("sd"),
                                       F.skewness(x).alias("sk"), F.kurtosis(x).alias("ku")))
        reg = F.col("task_type") == "regression"
        skew = F.coalesce(F.abs("sk"), F.lit(0.0))
        spread = F.coalesce(F.col("sd") > 2 * F.col("mean"), F.lit(False))
        jb = F.col("n") / 6.0 * (F.pow("sk", 2) + F.pow("ku", 2) / 4.0)
        odd = F.coalesce(F.exp(-jb / 2.0) <= 0.05, F.lit(False))
        rules += [("highly_skewed", skew, reg & (skew > 2)), ("moderately_skewed", skew, reg & (skew > 1) & (skew <= 2)),
                  ("high_variance", F.col("sd"), reg & spread), ("not_normal", jb, reg & odd),
                  ("suitable", skew, reg & (skew <= 1) & ~spread & ~odd)]
    return _fired(one, rules)


def readiness(df: DataFrame, target: str | None = None) -> DataFrame:
    """One row: complexity level, issues found (missing values) and how ready the data is."""
    s = scores_row(dataset_profile(df, target))
    issues = F.when(F.col("columns_with_missing") > 0, 1).otherwise(0)
    return s.select("complexity_score", F.when(F.col("complexity_score") > 70, "High").when(F.col("complexity_score") < 30, "Low")
                    .otherwise("Medium").alias("complexity"), issues.cast("long").alias("issues"),
                    F.when(issues == 0, "ready").when(issues <= 2, "minor").otherwise("significant").alias("readiness"))
