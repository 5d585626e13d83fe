"""Composite reports: the quality report, the analysis report and the insight report.

Each report persists the (NaN-normalised) input once and holds the result frames built by
the operators; except for the small tables that several stages of the insight report share, nothing runs until a
result is used or written.  The input is persisted with
MEMORY_AND_DISK so a lost executor only recomputes its own partitions from the source;
``release`` drops it, and ``written`` keeps the whole report as one tall frame without it.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablescope.functions.exprs import is_numeric, is_string, nan_to_null
from tablescope.session import staged, work_path


class Report(dict):
    """Result frames by section, in the order of the report."""

    def __init__(self, base: DataFrame):
        super().__init__()
        self.base = base

    def release(self) -> None:
        """Drop the persisted input; frames that are used later read the source again."""
        self.base.unpersist()

    def _parts(self) -> list[DataFrame]:
        return [frame.select(F.lit(i).alias("position"), F.lit(name).alias("section"),
                             F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("row"))
                for i, (name, frame) in enumerate(self.items())]

    def tall(self) -> DataFrame:
        """(position, section, row): every row of every section as JSON, fields that are null included."""
        parts = self._parts()
        out = parts[0]
        for part in parts[1:]:
            out = out.unionAll(part)
        return out

    def written(self) -> DataFrame:
        """``tall`` written below the checkpoint folder and read back; the persisted input is dropped.

        One section after another: in a single job the stages of all sections queue at once, and small broadcasts
        wait behind them until they time out."""
        parts = self._parts()
        folder = work_path(self.base.sparkSession, "report")
        paths = [f"{folder}/{i}" for i in range(len(parts))]
        try:
            for part, path in zip(parts, paths, strict=True):
                part.write.parquet(path)
        finally:
            self.release()
        return self.base.sparkSession.read.schema(parts[0].schema).parquet(*paths)


def _base(df: DataFrame) -> DataFrame:
    return nan_to_null(df).persist(StorageLevel.MEMORY_AND_DISK)


def quality_report(df: DataFrame) -> Report:
    """All data-quality operators over one persisted input, plus the health score."""
    from tablescope.operators import missing, outliers, profile, quality, scores, types
    base = _base(df)
    out = Report(base)
    out.update({
        "basic_info": profile.basic_info(base),
        "density": profile.data_density(base),
        "missing": missing.missing_profile(base),
        "zero_values": profile.zero_values(base),
        "duplicates": profile.duplicate_rows_subset(base),
        "duplicate_columns": profile.duplicate_columns(base),
        "mixed_types": types.mixed_type_columns(base),
        "dtype_summary": types.dtype_summary(base),
        "cardinality": profile.cardinality_profile(base),
        "constant_columns": profile.constant_columns(base),
        "outliers": outliers.outlier_report(base),
        "format_checks": quality.format_checks(base),
        "health_score": scores.health_score(base),
    })
    return out


def analysis_report(df: DataFrame, target: str | None = None) -> Report:
    """Structure + missingness + PCA + mutual information + interactions."""
    from tablescope.operators import missing, segment, target as tgt, types
    base = _base(df)
    out = Report(base)
    out.update({"structure": types.structure_flags(base, target),
                "missing_summary": missing.missing_summary(base),
                "missing_combinations": missing.missing_combinations(base)})
    nums = [c for c in base.columns if c != target and is_numeric(base.schema[c].dataType)]
    if len(nums) >= 2:
        out.update({f"pca_{k}": v for k, v in segment.pca(base, nums, target=target).items()})
    if target is not None:
        out["mutual_information"] = tgt.mutual_information(base, target)
        if is_numeric(base.schema[target].dataType):
            out["interactions"] = tgt.interaction_strength(base, target)
    return out


def insight_report(df: DataFrame, target: str | None = None) -> Report:
    """The nine insight stages in order: composition, target, feature patterns, warnings,
    quality, relationships, recommendations, business flags, key findings.

    Raises ValueError for fewer than two rows."""
    from tablescope.operators import assoc, findings, profile, quality, stat_tests, types
    if len(df.select(F.lit(1)).take(2)) < 2:
        raise ValueError("an insight report needs at least two rows")
    base = _base(df)
    nums = [c for c in base.columns if c != target and is_numeric(base.schema[c].dataType)]
    strs = [c for c in base.columns if c != target and is_string(base.schema[c].dataType)]
    out = Report(base)
    # what several stages read is worked out once, a few rows each
    warnings = staged(quality.warnings_report(base), "warnings")
    issues = staged(quality.quality_issues(base), "issues")
    profiled = staged(quality.dataset_profile(base, target, warnings), "profile")
    found = staged(findings.findings(base, target, profiled, issues), "findings")
    out.update({"composition": profiled, "types": types.schema_types(base, target)})
    if target is not None:
        out["target"] = profile.target_overview(base, target)
    if nums:
        out["numeric_patterns"] = profile.numeric_profile(base, nums)
    if strs:
        out["categorical_patterns"] = profile.categorical_profile(base, strs)
    out["warnings"] = quality.in_order(warnings)
    out["consistency"] = types.mixed_type_columns(base)
    out["validity"] = quality.range_rules(base)
    out["quality_issues"] = issues
    if len(nums) >= 2:
        out["correlations"] = assoc.corr_detailed(base, nums)
        out["multicollinearity"] = assoc.multicollinearity_groups(base, nums)
    if len(strs) >= 2:
        out["categorical_dependencies"] = stat_tests.categorical_dependencies(base, strs)
    out["findings"] = found
    out["key_findings"] = findings.key_findings(base, target, found=found)
    out["action_items"] = findings.action_items(base, target, found=found)
    return out
