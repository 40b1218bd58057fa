"""Sample quality of the main measurements."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from labspark.functions.predicates import in_range, status_ok, system_is
from labspark.operators import quality as q
from labspark.plans.base import usable_lab
from labspark.session import materialize
from labspark.spec import OBS_EXCLUDED, Spec


def quality_measurements(lab: DataFrame, spec: Spec) -> DataFrame:
    return usable_lab(lab, spec, spec.quality_codes).select(
        "code", "value", "unit", "value_code", "value_code_system", "obs_id", "time", "patient", "ref_high", "ref_low", "interpretation", "basedon").distinct()


def notes(lab: DataFrame, spec: Spec) -> DataFrame:
    return lab.filter(status_ok("status", OBS_EXCLUDED) & system_is("code_system", spec.system) & in_range("time", spec.t_min, spec.t_max)
                      & F.col("note").isNotNull()).select("obs_id", "code", "note").distinct()


def _match_tables(base: DataFrame, match: q.Match, name: str) -> dict[str, DataFrame]:
    matched = match.quality
    return {f"{name}_summary": q.match_summary(base, match), f"{name}_codes": q.pairs_per_code(match),
            f"{name}_numeric": q.numeric_results(matched), f"{name}_ranges": q.reference_availability(matched),
            f"{name}_coded": q.coded_quality(matched, "quality_value_code"),
            f"{name}_systems": q.distinct_systems(matched, "quality_value_system", "quality_value_code"),
            f"{name}_interpreted": q.coded_quality(matched, "quality_interpretation"), f"{name}_incomplete": q.incomplete_groups(match)}


def sample_quality(base: DataFrame, lab: DataFrame, specimens: DataFrame | None, spec: Spec) -> dict[str, DataFrame]:
    """Every table of the sample-quality part. Tables of kinds without data come out empty."""
    quality = materialize(quality_measurements(lab, spec), "quality")
    out = {"quality_codes": q.quality_codes(quality)}
    out.update(_match_tables(base, q.sides_by_time(base, quality), "by_time"))
    out["basedon"] = q.basedon_report(base)
    out.update(_match_tables(base, q.sides_by_reference(base, quality), "by_reference"))
    out["coded_results"] = q.coded_results(base)
    if specimens is not None:
        out["specimens"] = q.specimen_report(base, specimens.select("spec_id", "type", "condition", "condition_system").distinct())
    text = materialize(notes(lab, spec), "notes")
    out["notes"] = q.notes_per_code(text)
    out["notes_main"] = q.notes_report(text, spec.note_snippets, codes=spec.main_codes)
    out["notes_quality"] = q.notes_report(text, spec.note_snippets, codes=spec.quality_codes)
    out["methods"] = q.methods_report(base)
    return out
