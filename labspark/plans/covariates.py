"""The covariate table: every measurement with its context, follow-up and event flags."""

from __future__ import annotations

from dataclasses import replace
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, functions as F

from labspark.functions.columns import flag
from labspark.functions.dates import hours, hours_between
from labspark.functions.privacy import k_cells, k_mask
from labspark.functions.values import cluster_id
from labspark.operators import cooccur, describe, intervals, regress, windows
from labspark.operators.seek import Source, lookup
from labspark.session import materialize, stored
from labspark.spec import Spec

KEY = ["patient", "time"]


def with_context(facts: DataFrame, encounters: DataFrame | None, once: bool = False) -> DataFrame:
    """Encounter context and the marker of the first measurement per encounter. ``once``: rows of ``facts`` may repeat."""
    out = intervals.assign_interval(facts, encounters, once=once)
    return out.withColumn("first", F.lit(0)) if encounters is None else intervals.first_in_interval(out)


def _lab_picks(spec: Spec, ahead: bool):
    p = "a" if ahead else "b"
    label, result = F.col("label"), F.col("result")
    picks = {f"__{p}_{lab}_{r}": F.when((label == lab) & (result == r), F.col("time")) for lab in spec.lab_windows for r in "NHL"}
    rank = windows.result_rank("result")
    picks.update({f"__{p}_{lab}_v": windows.nearest_picks("time", "value_norm", rank, label == lab, ahead) for lab in spec.lab_windows})
    return picks


def covariate_table(facts: DataFrame, spec: Spec, encounters=None, medications=None, labs=None, procedures=None, conditions=None, once: bool = False) -> DataFrame:
    """Adds everything that is known around each measurement; kinds without a source are left out.

    Measurements and all events are shuffled once and scanned back and ahead; conditions come before that, by a lookup
    of their own because their window starts at the encounter. ``once``: rows of ``facts`` (``base.plausible_results``) may
    repeat; they are made distinct where they have been dealt for their encounters.
    """
    # each of these is read several times below
    facts = facts if once else materialize(facts, "facts")
    facts = materialize(with_context(facts, encounters, once), "context")
    labs, medications, procedures, conditions = (read_often(n, d) for n, d in (
        ("labs", labs), ("medications", medications), ("procedures", procedures), ("conditions", conditions)))
    t = F.col("time")
    payload = F.struct("value_norm", "result", "result_detail", "enc_id")
    # rows of one instant: the greatest id speaks, and among equal ids the greatest payload
    instants = facts.groupBy(*KEY).agg(F.max(F.struct("obs_id", payload.alias("p")))["p"].alias("__p"))
    back, ahead = [], [Source(instants, "time", {"__next": F.struct(F.col("time").alias("t"), F.col("__p").alias("p"))}, inclusive=False, sized=facts)]
    n = F.col("__next")
    cols = {"next_value": n["p"]["value_norm"], "next_result": n["p"]["result"], "next_result_detail": n["p"]["result_detail"],
            "next_enc_id": n["p"]["enc_id"], "next_flag": flag(n.isNotNull()), "next_hours": hours_between(t, n["t"])}
    if labs is not None:
        back.append(Source(labs, "time", _lab_picks(spec, False)))
        ahead.append(Source(labs, "time", _lab_picks(spec, True)))
        for lab, h in spec.lab_windows.items():
            cols.update({f"{lab}_{r}": windows.within("time", f"__b_{lab}_{r}", f"__a_{lab}_{r}", h) for r in "NHL"})
            cols[f"{lab}_value_norm"] = windows.nearest_of("time", f"__b_{lab}_v", f"__a_{lab}_v", h)
    med_flags = list(spec.medication_groups)
    if medications is not None:
        groups = windows.prefix_groups("code", spec.medication_groups)
        back.append(Source(medications, "time_end", {f"__m_{g}": F.when(c, F.col("time_end")) for g, c in groups.items()}))
        ahead.append(Source(medications, "time_start", {f"__t_{g}": F.when(groups[g], F.col("time_start")) for g in spec.treatment_groups}, inclusive=False))
        cols.update({g: flag(F.col(f"__m_{g}") > t - hours(spec.medication_hours)) for g in med_flags})
        cols.update({f"{g}_after": flag(F.col(f"__t_{g}") <= t + hours(spec.treatment_hours)) for g in spec.treatment_groups})
    if procedures is not None:
        back += windows.interval_sources(procedures, "period_start", "period_end", "performed")
        ahead.append(Source(procedures, "time", {"__proc": F.col("time")}, inclusive=False))
        cols.update(windows.interval_flag_columns("time", spec.procedure_hours, "dialyse"))
        cols["dialyse_after"] = flag(F.col("__proc") <= t + hours(spec.procedure_hours))

    rows, cond_flags = facts, []
    if conditions is not None:
        cond_flags = list(spec.condition_groups)
        rows = windows.context_flags(facts, conditions, windows.prefix_groups("icd", spec.condition_groups), "patient", "time", "time")
        rows = rows.withColumns({g: F.when(F.col("time").isNotNull(), F.col(g)).otherwise(0) for g in cond_flags})
    out = lookup(rows, "patient", "time", back, ahead, sized=facts).select(*KEY, *[c for c in facts.columns if c not in KEY], *[c.alias(name) for name, c in cols.items()], *cond_flags)
    extra = {"same_encounter": flag(F.col("enc_id") == F.col("next_enc_id"))}
    if medications is not None:
        extra["alone_med"] = windows.alone(med_flags)
    if conditions is not None:
        extra["alone_cond"] = windows.alone(list(spec.condition_groups), spec.nested_conditions)
    return out.withColumns(extra)


READ = {"encounters": ("enc_id", "patient", "class", "period_start", "period_end", "time"), "medications": ("patient", "code", "time_start", "time_end"),
        "labs": ("patient", "time", "label", "result", "value_norm"), "procedures": ("patient", "period_start", "period_end", "performed", "time"),
        "conditions": ("patient", "time", "icd")}


def read_often(name: str, df: DataFrame | None) -> DataFrame | None:
    """A source, stored with the columns that covariates and their availability need."""
    return None if df is None else df if stored(df) else materialize(df.select(*READ[name]), name)


def study_availability(tables: dict, spec: Spec) -> tuple[DataFrame, DataFrame]:
    """Monthly timeline of the covariate sources and the months with usable data."""
    present = {"medication": tables.get("medications"), "encounter": tables.get("encounters"), "lab": tables.get("labs"),
               "procedures": tables.get("procedures"), "conditions": tables.get("conditions")}
    times = {n: d.select(F.col("time_start" if n == "medication" else "time").alias("time")) for n, d in present.items() if d is not None}
    timeline = describe.monthly_timeline(times, spec.t_min, spec.t_max)
    return timeline, describe.availability(timeline)


def window_dict(availability: DataFrame) -> dict:
    """Time window per source, for use in filters (one row per source)."""
    rows = regress.month_windows(availability).collect()
    return {r["table_name"]: (r["t_min"], r["t_max"]) for r in rows if r["t_min"] is not None}


# --- paired samples --------------------------------------------------------------------------
def sample_pairs(samples: DataFrame, table: DataFrame, spec: Spec) -> DataFrame:
    """Serum measurements with the nearest blood measurement of the same encounter."""
    extra = [spec.platelet_group] if spec.platelet_group in table.columns else []
    context = table.select("obs_id", "enc_id", *extra)
    rows = samples.join(context, "obs_id")
    if not extra:
        rows = rows.withColumn(spec.platelet_group, F.lit(0))
    serum = rows.filter(F.col("sample_type") == "serum").withColumnRenamed("result", "result_serum")
    blood = rows.filter(F.col("sample_type") == "blood")
    keep = {"obs_id": "obs_id", "value_norm": "value_norm", "code": "code", "result": "result"}
    near = windows.pair_nearest(serum, blood, ["patient", "enc_id"], "time", "obs_id", keep, spec.pair_hours, "obs_id")
    return describe.with_difference(near.withColumnRenamed("result_2", "result_blood"))


def compare_samples(pairs: DataFrame, spec: Spec, window=None) -> DataFrame:
    """Differences between paired samples, all pairs and split by platelet diagnosis; suppressed."""
    cohorts = {"all": None}
    if window is not None:
        g, t = F.col(spec.platelet_group), F.col("time")
        usable = (t >= F.lit(window[0])) & (t < F.lit(window[1])) & F.col("enc_id").isNotNull()
        cohorts.update({"thromb": (g == 1) & usable, "no_thromb": (g == 0) & usable})
    out = k_mask(describe.pair_comparison(pairs, cohorts), "n", ["cohort", "chronological_order_filter"], spec.k)
    return k_cells(out, [c for c in out.columns if c.startswith("n_")], spec.k)


# --- regressions -----------------------------------------------------------------------------
RESULT_LEVELS = {"gender": ("male", "female"), "result": ("N", "L", "H")}
GENDER = {"gender": ("male", "female")}


def known() -> Column:
    return F.col("gender").isin("male", "female") & F.col("age").isNotNull()


def _rows(window, *conditions) -> Column:
    """Rows inside a window that meet all conditions."""
    inside = [] if window is None else [F.col("time") >= F.lit(window[0]), F.col("time") < F.lit(window[1])]
    return reduce(and_, [known(), *inside, *conditions])


def _pair(first, every, source, terms, kind="flag") -> list:
    """The model on first measurements and its check on all measurements, clustered by encounter. Terms are judged on the former."""
    rules = tuple(regress.Rule(t, first, kind) for t in terms)
    model = regress.Model(source, "value_norm", tuple(terms), GENDER, "age")
    clustered = replace(model, source=f"{source}_all", cluster=cluster_id("enc_id", "obs_id"))
    return [regress.Draft(model, first, rules), regress.Draft(clustered, every, rules)]


def covariate_models(windows_: dict, spec: Spec) -> list:
    """Medication and conditions jointly, labs and procedures one by one."""
    drafts, first = [], F.col("first") == 1
    for kind, groups in (("medication", spec.medication_groups), ("lab", ()), ("procedures", ()), ("conditions", spec.condition_groups)):
        if not windows_.get(kind):
            continue
        every = _rows(windows_[kind])
        if groups:
            drafts += _pair(_rows(windows_[kind], first), every, kind, list(groups))
        elif kind == "lab":
            for lab in spec.lab_windows:
                c = f"{lab}_value_norm"
                has = F.col(c).isNotNull()
                drafts += _pair(_rows(windows_[kind], first | (F.col("enc_class") == "AMB"), has), every & has, f"lab_{lab}", [c], "number")
        elif kind == "procedures":
            for c in ("dialyse_during", "dialyse_before", "dialyse_unclear"):
                drafts += _pair(_rows(windows_[kind], first), every, f"procedures_{c}", [c])
    return drafts


def _result_model(rows, outcome, source) -> regress.Draft:
    """outcome ~ result, when gender, result and (for flags) the outcome have enough rows per level."""
    factors = ["gender", "result"] + ([outcome] if outcome != "next_hours" else [])
    return regress.Draft(regress.Model(source, outcome, ("result",), RESULT_LEVELS, "age"), rows, required=tuple(regress.Rule(c, rows, "factor") for c in factors))


def outcome_models(windows_: dict, spec: Spec) -> list:
    """Treatment or procedure after the measurement, by result."""
    drafts = []
    for kind, outcomes in (("medication", {f"{g}_after": f"medication_after_{g}" for g in spec.treatment_groups}),
                           ("procedures", {"dialyse_after": "dialysis_after"})):
        if windows_.get(kind):
            rows = _rows(windows_[kind], F.col("first") == 1)
            drafts += [_result_model(rows, c, f"{source}_categorical") for c, source in outcomes.items()]
    return drafts


def _in_time(spec: Spec) -> Column:
    return F.coalesce((F.col("next_flag") == 1) & (F.col("next_hours") <= spec.followup_hours), F.lit(False))


def followup_models(spec: Spec) -> list:
    """Time to the next measurement and whether there is one in time, by result."""
    drafts = []
    for suffix, rows in (("all", known()), ("only_first", known() & (F.col("first") == 1))):
        drafts += [_result_model(rows & _in_time(spec), "next_hours", f"next_k_timing_categorical_{suffix}"),
                   _result_model(rows, "next_occurred", f"next_k_occurred_{suffix}")]
    return drafts


def fitted(df: DataFrame, drafts: list, spec: Spec) -> DataFrame:
    return regress.regressions(df.withColumn("next_occurred", flag(_in_time(spec))), drafts, spec.k)


def regressions(df: DataFrame, windows_: dict, spec: Spec) -> DataFrame:
    """All regressions of a study; ``df`` (the covariate table, stored) is read three times, whatever their number."""
    return fitted(df, covariate_models(windows_, spec) + outcome_models(windows_, spec) + followup_models(spec), spec)


def cooccurrence_tables(df: DataFrame, windows_: dict, spec: Spec) -> DataFrame:
    sources = {}
    if windows_.get("medication"):
        sources.update(medication=list(spec.medication_groups), treatment=[f"{g}_after" for g in spec.treatment_groups])
    if windows_.get("procedures"):
        sources["procedures"] = ["dialyse_during", "dialyse_before", "dialyse_unclear", "dialyse_after"]
    if windows_.get("conditions"):
        sources["conditions"] = list(spec.condition_groups)
    if any(f"{lab}_N" in df.columns for lab in spec.lab_windows):
        sources["lab"] = list(spec.lab_windows)
    return cooccur.cooccurrence_all(df, sources, windows_, spec.k)
