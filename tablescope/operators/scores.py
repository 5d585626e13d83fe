"""Dataset scores: health, quality, complexity, processing complexity, investment priority.

Each score is one-row arithmetic (``least`` / ``greatest`` / ``when``) over one-row
aggregates that Spark computed from the table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablescope.functions.constants import HEALTH_GRADE_LOWEST, HEALTH_GRADES
from tablescope.functions.exprs import col, is_numeric, is_string, ladder, nan_to_null, rnd, with_scalars
from tablescope.operators import profile, types


def _one_row_counts(df: DataFrame) -> DataFrame:
    """rows, missing cells, duplicate rows, constant and mixed-type column counts."""
    df = nan_to_null(df)
    k = len(df.columns)
    miss = df.agg(F.count(F.lit(1)).cast("long").alias("rows"),
                  sum([F.count_if(col(c).isNull()) for c in df.columns], F.lit(0)).cast("long").alias("missing_cells"))
    dup = profile.duplicate_rows(df).select("duplicate_rows")
    const = profile.constant_columns(df).agg(F.count(F.lit(1)).cast("long").alias("constant_columns"))
    strs = [c for c in df.columns if is_string(df.schema[c].dataType)]
    if strs:
        mixed = types.mixed_type_columns(df.select(*[col(c) for c in strs])).agg(
            F.count(F.lit(1)).cast("long").alias("mixed_type_columns"))
    else:
        mixed = df.sparkSession.range(1).select(F.lit(0).cast("long").alias("mixed_type_columns"))
    out = with_scalars(with_scalars(with_scalars(miss, dup), const), mixed)
    return out.withColumn("columns", F.lit(k).cast("long"))


def health_score(df: DataFrame) -> DataFrame:
    """100 - min(2 x missing %, 30) - min(1.5 x duplicate %, 20) - 5 x constant columns
    - 10 x mixed-type columns, floored at 0, with a letter grade."""
    t = _one_row_counts(df)
    missing_pct = rnd(F.coalesce(F.try_divide(F.col("missing_cells") * 100.0, F.col("rows") * F.col("columns")),
                                     F.lit(0.0)), 2)
    dup_pct = rnd(F.coalesce(F.try_divide(F.col("duplicate_rows") * 100.0, F.col("rows")), F.lit(0.0)), 2)
    t = t.select("*", F.least(missing_pct * 2, F.lit(30.0)).alias("missing_penalty"),
                 F.least(dup_pct * 1.5, F.lit(20.0)).alias("duplicate_penalty"),
                 (F.col("constant_columns") * 5.0).alias("constant_penalty"),
                 (F.col("mixed_type_columns") * 10.0).alias("type_penalty"))
    score = F.greatest(F.lit(0.0), 100.0 - F.col("missing_penalty") - F.col("duplicate_penalty")
                       - F.col("constant_penalty") - F.col("type_penalty"))
    t = t.withColumn("score", rnd(score, 1))
    grade = ladder(F.col("score"), HEALTH_GRADES, HEALTH_GRADE_LOWEST)
    return t.select(rnd("missing_penalty", 2).alias("missing_penalty"),
                    rnd("duplicate_penalty", 2).alias("duplicate_penalty"),
                    "constant_penalty", "type_penalty", "score", grade.alias("grade"))


def quality_score(df: DataFrame) -> DataFrame:
    """0.4 completeness + 0.3 consistency (duplicates) + 0.3 usefulness (low variance)."""
    df = nan_to_null(df)
    t = _one_row_counts(df)
    nums = [c for c in df.columns if is_numeric(df.schema[c].dataType)]
    if nums:
        lv = df.agg(sum([F.when(F.coalesce(F.var_samp(col(c)) < 1e-6, F.lit(False)), 1).otherwise(0)
                         for c in nums], F.lit(0)).alias("low_variance_columns"))
    else:
        lv = df.sparkSession.range(1).select(F.lit(0).alias("low_variance_columns"))
    t = with_scalars(t, lv)
    missing_pct = F.coalesce(F.try_divide(F.col("missing_cells") * 100.0, F.col("rows") * F.col("columns")), F.lit(0.0))
    dup_pct = F.coalesce(F.try_divide(F.col("duplicate_rows") * 100.0, F.col("rows")), F.lit(0.0))
    completeness = F.greatest(F.lit(0.0), 100 - missing_pct * 2)
    consistency = F.greatest(F.lit(0.0), 100 - dup_pct * 5)
    usefulness = (F.greatest(F.lit(0.0), 100 - F.col("low_variance_columns") * 100.0 / len(nums) * 10)
                  if nums else F.lit(50.0))
    return t.select(rnd(completeness, 4).alias("completeness"), rnd(consistency, 4).alias("consistency"),
                    rnd(usefulness, 4).alias("usefulness"),
                    rnd(completeness * 0.4 + consistency * 0.3 + usefulness * 0.3, 4).alias("quality_score"))
