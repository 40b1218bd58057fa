"""One call for a whole study: check the extracts, analyse them, publish suppressed results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from labspark.functions.columns import join_nullsafe
from labspark.functions.privacy import k_cells, k_mask
from labspark.operators import clean, describe, intervals, regress, resolve
from labspark.plans import base, covariates, description, quality
from labspark.session import materialize
from labspark.sources import tables
from labspark.spec import OBS_EXCLUDED, Spec


def check_study_units(lab: DataFrame, units: DataFrame, spec: Spec) -> DataFrame:
    """Raises when a unit of any analysed measurement has no conversion; returns how each is treated."""
    groups = {spec.main_label: spec.main_codes, **spec.lab_codes}
    return tables.check_units(tables.labelled_units(lab, groups, spec.t_min, spec.t_max, spec.system, OBS_EXCLUDED), units)


def suppressed(df: DataFrame, k: int) -> DataFrame:
    """Any count of a row in (0, k) masks the counts of the row and blanks its other numbers."""
    counts = [f.name for f in df.schema if isinstance(f.dataType, (T.LongType, T.IntegerType))]
    labels = [f.name for f in df.schema if isinstance(f.dataType, (T.StringType, T.DateType))]
    return k_mask(df, counts, labels, k) if counts else df


def quality_control(sources: dict, study: dict, wide: DataFrame, spec: Spec) -> DataFrame:
    """Counts about the extracts and the steps of the analysis as one table, suppressed."""
    lab, encounters = sources["lab"], study["encounters"]
    rows = materialize(base.raw_measurements(lab, sources["patients"], spec), "qc-measurements")
    compared = base.usable_lab(lab, spec, spec.main_codes)
    sections = {
        "status": clean.counts(lab, "status"), "birth_dates": clean.birthdate_quality(sources["patients"], "birth_raw"),
        "repeats": clean.repeat_report(rows), "repeats_removed": clean.dedupe_counts(rows, base.REPEAT_GROUP),
        "extreme_values": clean.mad_report(rows, cutoff=spec.mad_cutoff).select("code", "unit", "n_implausible"),
        "comparators": clean.comparator_report(compared, ("code", "unit", "comparator")), "decimals": clean.off_grid_report(compared),
        "unit_mismatch": clean.unit_mismatch(compared), "missing": clean.missing_report(compared), "ids": clean.duplicate_ids(compared, "obs_id", "code"),
        "shared_instants": clean.shared_instants(study["facts"]), "results": clean.counts(study["facts"], "result"),
        "exclusions": regress.exclusions(wide, spec.followup_hours),
    }
    if encounters is not None:
        sections |= {"encounter_types": describe.encounter_type_counts(study["encounters_all"]), "ambiguous_first": intervals.ambiguous_first(wide),
                     "same_day": intervals.same_day(wide, encounters), "assignment": intervals.verify_assignment(wide)}
        for name in ("medications", "procedures", "labs", "conditions"):
            if study[name] is not None:
                sections[f"references_{name}"] = resolve.reference_types(study[name], study["encounters_all"])
        if study["conditions"] is not None:
            sections["condition_timing"] = clean.counts(intervals.bucket_to_interval(study["conditions"], encounters), "class", "time_bucket")
    if study["medications"] is not None:
        sections["administration_times"] = describe.timestamp_availability(study["medications"], "effective")
        sections["medication_flags"] = describe.flag_totals(wide, list(spec.medication_groups), "alone_med")
    if study["procedures"] is not None:
        sections["procedure_times"] = describe.timestamp_availability(study["procedures"], "performed")
    return describe.report(sections, spec.k)


def results(sources: dict, units: DataFrame, spec: Spec) -> dict[str, DataFrame]:
    """Every published table of a study, suppressed with ``spec.k``. Parts without a source are left out."""
    spark = sources["lab"].sparkSession
    check_study_units(sources["lab"], units, spec)
    study = base.load_study(spark, sources, units, spec)
    study = {n: None if d is None else materialize(d, f"study-{n}") for n, d in study.items()}
    wide = materialize(covariates.covariate_table(study["facts"], spec, *[study[n] for n in ("encounters", "medications", "labs", "procedures", "conditions")]), "wide")
    out = {f"description_{n}": d for n, d in description.describe_measurements(study["base"], base.usable_lab(sources["lab"], spec, spec.main_codes), spec.k).items()}
    out["description_age_gender"] = suppressed(out["description_age_gender"], spec.k)
    found = quality.sample_quality(study["base"], sources["lab"], sources.get("specimens"), spec)
    for name in ("by_time", "by_reference"):  # the statistics of a group are shown only with its count
        n = found[f"{name}_ranges"].select("quality_code", "quality_unit", "n")
        found[f"{name}_numeric"] = join_nullsafe(found[f"{name}_numeric"], n, ["quality_code", "quality_unit"])
    out |= {f"sample_quality_{n}": suppressed(d, spec.k) for n, d in found.items()}
    timeline, available = covariates.study_availability(study, spec)
    windows = covariates.window_dict(available)
    out["covariate_timeline"] = suppressed(timeline, spec.k)
    out["cooccurrence"] = covariates.cooccurrence_tables(wide, windows, spec)
    out["regressions"] = covariates.regressions(wide, windows, spec)
    out["transitions"] = k_mask(describe.transitions(wide), "n", ["result_detail", "next_result_detail"], spec.k)
    out["sample_comparison"] = covariates.compare_samples(covariates.sample_pairs(study["samples"], wide, spec), spec, windows.get("conditions"))
    out["quality_control"] = quality_control(sources, study, wide, spec)
    # masks above hide rows by their main count; no other count may stay small either
    return {n: d if n == "regressions" else k_cells(d, [c for c in d.columns if c == "n" or c.startswith("n_")], spec.k) for n, d in out.items()}


def run_study(spark: SparkSession, folder: str, units_path: str, target: str, spec: Spec | None = None, converted: bool = False) -> list[str]:
    """Reads the extracts of ``folder``, publishes every result as a CSV folder below ``target``; returns their names.

    ``converted``: the folder holds what ``tables.convert_all`` stored."""
    sources = (tables.read_converted if converted else tables.read_all)(spark, folder)
    published = results(sources, tables.load_units(tables.read_strings(spark, units_path)), spec or Spec())
    for name, df in published.items():
        tables.write_result(df, f"{target.rstrip('/')}/{name}.csv")
    return sorted(published)
