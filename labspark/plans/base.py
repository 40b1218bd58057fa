"""From raw extracts to the cleaned and classified measurement tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from labspark.functions.columns import join_keyed
from labspark.functions.dates import age_years, event_time, partial_date
from labspark.functions.predicates import has_prefix, in_codes, in_range, overlaps, point_or_period, status_ok, system_is
from labspark.functions.values import (classify, classify_detail, classify_one_sided, code_type, compare_value, effective_bound, label_codes,
                                       plausible, ref_id)
from labspark.operators import clean, resolve
from labspark.operators.units import drop_invalid, normalize_units
from labspark.session import materialize
from labspark.spec import (COND_EXCLUDED, COND_VERIFICATION_EXCLUDED, DEVICE_OBS_EXCLUDED, ENC_EXCLUDED, MED_EXCLUDED, OBS_EXCLUDED,
                           PROC_EXCLUDED, Spec)

REPEAT_GROUP = ("patient", "time", "code")


def usable_lab(lab: DataFrame, spec: Spec, codes) -> DataFrame:
    """Measurements of the wanted codes with an acceptable status inside the study period."""
    return lab.filter(status_ok("status", OBS_EXCLUDED) & in_codes("code", codes, "code_system", spec.system)
                      & in_range("time", spec.t_min, spec.t_max))


def patients(raw: DataFrame) -> DataFrame:
    return raw.select("pat_id", "gender", partial_date("birth_raw").alias("birth"))


MEASUREMENT = ("obs_id", "code", "value", "unit", "value_code_system", "value_code", "ref_low", "ref_high", "ref_high_unit", "ref_low_unit",
               "ref_type", "comparator", "patient", "time", "issued", "encounter", "specimen_ref", "basedon", "method_code", "method_system")


def _measurements(lab: DataFrame, pats: DataFrame, spec: Spec) -> DataFrame:
    """Main measurements with patient id, gender and age, and ``__key``, by which they are dealt: the patient, or a text
    that rows of one time and code share where there is none."""
    rows = usable_lab(lab, spec, spec.main_codes).select(*MEASUREMENT)
    known = patients(pats).withColumn("__ref", ref_id("Patient", "pat_id"))
    joined = join_keyed(rows, known, "patient", "__ref", F.pmod(F.xxhash64("time", "code"), F.lit(1024)))
    return joined.withColumn("age", age_years("birth", "time")).drop("birth", "__ref")


def raw_measurements(lab: DataFrame, pats: DataFrame, spec: Spec) -> DataFrame:
    """Main measurements with patient id, gender and age, before cleaning."""
    return _measurements(lab, pats, spec).distinct().drop("__key")


def base_measurements(lab: DataFrame, pats: DataFrame, spec: Spec) -> DataFrame:
    """Main measurements without superseded repeats and extreme values, with a comparison value."""
    # the shuffle of the join serves the distinct rows and the groups of repeats too
    raw = materialize(clean.distinct_dealt(_measurements(lab, pats, spec), ("__key", *REPEAT_GROUP)).drop("__key"), "measurements")
    rows = clean.drop_superseded(raw).withColumn("value_compare", compare_value("value", "comparator", spec.digits))
    return clean.mad_filter(rows, ("code", "unit"), "value", spec.mad_cutoff)


def classified_raw(base: DataFrame, units: DataFrame, spec: Spec) -> DataFrame:
    """Normalised value, result class and grade of every measurement with a usable value and unit."""
    label = F.lit(spec.main_label)
    rows = drop_invalid(base.filter(F.col("value").isNotNull() & F.col("unit").isNotNull()), units, label)
    rows = normalize_units(rows, units, label)
    rows = rows.withColumns({"value_norm_compare": compare_value("value_norm", "comparator", spec.digits),
                             "low": effective_bound("ref_low", "unit_factor", spec.main_range.low, spec.digits),
                             "high": effective_bound("ref_high", "unit_factor", spec.main_range.high, spec.digits)})
    return clean.min_age(rows, spec.min_age).select(
        "code", "obs_id", "patient", "time", "age", "gender", "value", "value_compare", "unit", "comparator", "value_norm", "value_norm_compare",
        F.col("encounter").alias("enc_org"), classify("value_norm_compare", "low", "high").alias("result"),
        classify_detail("value_norm_compare", "low", "high", spec.main_cuts).alias("result_detail"))


def plausible_results(base: DataFrame, units: DataFrame, spec: Spec) -> DataFrame:
    """The rows of ``classified_measurements``, which may repeat."""
    rows = classified_raw(base, units, spec)
    return rows.filter(plausible("value_norm", spec.main_range)).select(
        "obs_id", "patient", "time", "age", "gender", "value", "unit", "value_norm", "result", "result_detail", "enc_org")


def classified_measurements(base: DataFrame, units: DataFrame, spec: Spec) -> DataFrame:
    """The fact table: plausible measurements, one row per distinct result (code left out)."""
    return plausible_results(base, units, spec).distinct()


def sample_measurements(base: DataFrame, units: DataFrame, spec: Spec) -> DataFrame:
    """Plausible measurements with code and kind of sample."""
    rows = classified_raw(base, units, spec)
    kind = label_codes("code", {"serum": spec.serum_codes, "blood": spec.blood_codes})
    return rows.filter(plausible("value_norm", spec.main_range)).select(
        "code", "obs_id", "patient", "time", "value_norm", "result", kind.alias("sample_type")).distinct()


# --- covariate sources -----------------------------------------------------------------------
def encounters_all(raw: DataFrame, spec: Spec) -> DataFrame:
    return raw.filter(status_ok("status", ENC_EXCLUDED) & system_is("type_system", spec.enc_system, null_ok=True)
                      & overlaps("period_start", "period_end", spec.t_min, spec.t_max)).select(
        "enc_id", "patient", "class", "period_start", "period_end", "type").distinct()


def encounters(raw: DataFrame, spec: Spec) -> DataFrame:
    """Encounters of the main type."""
    return clean.main_intervals(encounters_all(raw, spec), spec.main_enc_type)


def _administrations(raw: DataFrame, spec: Spec, last: str) -> DataFrame:
    return raw.filter(status_ok("status", MED_EXCLUDED) & point_or_period("effective", "period_start", "period_end", spec.t_min, spec.t_max)).select(
        "adm_id", "patient", "period_start", "period_end", "effective", "encounter", last).distinct()


def medications(coded: DataFrame | None, one_hop: DataFrame | None, two_hop: DataFrame | None, medication: DataFrame | None,
                spec: Spec) -> DataFrame | None:
    """Administrations with their codes, from up to three kinds of sources.

    Sources that refer to a medication need the medication table. ``time_end`` and ``time_start``
    are the times used for looking back and ahead.
    """
    parts = []
    meds = None if medication is None else medication.select("med_id", "code", "med_med_ref").distinct()
    if one_hop is not None and meds is not None:
        parts.append(resolve.resolve_one_hop(_administrations(one_hop, spec, "med_ref"), meds).withColumn("source", F.lit("medadm_med")))
    if coded is not None:
        parts.append(_administrations(coded, spec, "code").withColumn("source", F.lit("medadm_code")))
    if two_hop is not None and meds is not None:
        parts.append(resolve.resolve_two_hop(_administrations(two_hop, spec, "med_ref"), meds).withColumn("source", F.lit("medadm_complex")))
    out = resolve.union_sources(*parts)
    if out is None:
        return None
    return out.withColumns({"time_end": event_time("effective", "period_end", "period_start"), "time_start": event_time("effective", "period_start")})


def by_label(label, values: dict, default=None):
    """Column with the number that belongs to the row's label, NULL when there is none."""
    out = F.lit(default).cast("double")
    for name, v in values.items():
        out = F.when(F.col(label) == name, F.lit(v).cast("double")).otherwise(out)
    return out


def raw_labs(lab: DataFrame, spec: Spec) -> DataFrame:
    """Measurements of all covariate labels in one pass, without superseded repeats; what ``labs`` tells rows apart by."""
    codes = [c for group in spec.lab_codes.values() for c in group]
    rows = usable_lab(lab, spec, codes).withColumn("label", label_codes("code", spec.lab_codes)).select(
        "code", "value", "unit", "ref_low", "ref_high", "comparator", "patient", "time", "issued", "encounter", "label")
    return clean.drop_superseded(materialize(clean.distinct_repeats(rows, REPEAT_GROUP), "labs"), scope="label")


def labs(raw: DataFrame, units: DataFrame, spec: Spec) -> DataFrame:
    """Normalised, classified and plausible covariate measurements (from ``raw_labs``)."""
    optional = F.col("label").isin(*spec.unit_optional)
    rows = drop_invalid(raw.filter(F.col("value").isNotNull() & (F.col("unit").isNotNull() | optional)), units)
    rows = normalize_units(rows, units, optional_labels=spec.unit_optional, keep_factor=False)
    bound = {side: by_label("label", {n: getattr(r, side) for n, r in spec.lab_ranges.items()}) for side in ("low", "high", "low_ext", "high_ext")}
    rows = rows.withColumns({"value_compare": compare_value("value", "comparator", spec.digits),
                             "value_norm_compare": compare_value("value_norm", "comparator", spec.digits)})
    result = classify_one_sided("value_compare", "value_norm_compare", "ref_low", "ref_high", bound["low"], bound["high"], spec.digits)
    inside = (F.col("value_norm") < bound["high_ext"]) & (F.col("value_norm") > bound["low_ext"])
    return rows.filter(inside).select("patient", "time", "encounter", "label", "value", "value_compare", "value_norm", "value_norm_compare",
                                      result.alias("result")).distinct()


def _procedures(raw: DataFrame, spec: Spec) -> DataFrame:
    wanted = F.coalesce(has_prefix("ops", spec.procedure_prefixes), F.lit(False)) | F.col("snomed").isin(*spec.procedure_snomed)
    return raw.filter(status_ok("status", PROC_EXCLUDED) & wanted & point_or_period("performed", "period_start", "period_end", spec.t_min, spec.t_max)).select(
        "pro_id", "patient", "period_start", "period_end", "performed", "encounter", code_type("ops", "snomed").alias("code_type")).distinct()


def procedures(regular: DataFrame | None, icu: DataFrame | None, device: DataFrame | None, spec: Spec) -> DataFrame | None:
    """Procedures of three kinds in one table; ``time`` is their start."""
    parts = [None if d is None else _procedures(d, spec) for d in (regular, icu)]
    if device is not None:
        parts.append(device.filter(status_ok("status", DEVICE_OBS_EXCLUDED)
                                   & point_or_period("performed", "period_start", "period_end", spec.t_min, spec.t_max)).select(
            "pro_id", "patient", "period_start", "period_end", "performed", "encounter", F.lit("icu_dauer").alias("code_type")).distinct())
    out = resolve.union_sources(*parts)
    return None if out is None else out.withColumn("time", event_time("performed", "period_start"))


def conditions(raw: DataFrame, spec: Spec) -> DataFrame:
    return raw.filter(status_ok("status", COND_EXCLUDED) & status_ok("verification", COND_VERIFICATION_EXCLUDED)
                      & in_range("time", spec.t_min, spec.t_max)).select("con_id", "patient", "time", "encounter", "icd").distinct()


def load_study(spark: SparkSession, sources: dict, units: DataFrame, spec: Spec) -> dict[str, DataFrame | None]:
    """All tables of a study from its typed extracts; kinds without a source are None."""
    get = sources.get
    base = base_measurements(get("lab"), get("patients"), spec)  # filters over a stored table
    return {
        "base": base,
        "facts": classified_measurements(base, units, spec),
        "samples": sample_measurements(base, units, spec),
        "encounters_all": None if get("encounters") is None else encounters_all(get("encounters"), spec),
        "encounters": None if get("encounters") is None else encounters(get("encounters"), spec),
        "medications": medications(get("adm_coded"), get("adm_one_hop"), get("adm_two_hop"), get("medication"), spec),
        "labs": labs(raw_labs(get("lab"), spec), units, spec),
        "procedures": procedures(get("procedures"), get("procedures_icu"), get("device_obs"), spec),
        "conditions": None if get("conditions") is None else conditions(get("conditions"), spec),
    }
