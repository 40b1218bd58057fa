"""Filters, projections and scalar expressions."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from labspark.checks.registry import query, rounded
from labspark.functions import dates, predicates as pred, values
from labspark.operators import clean, describe
from labspark.operators.units import drop_invalid, invalid_count, normalize_units
from labspark.sources.fixtures import cte
from labspark.spec import MAIN_CUTS, Range

LO, HI = datetime(1996, 1, 1), datetime(1998, 12, 31, 23, 59, 59)
_R = "TIMESTAMP '1996-01-01' AND TIMESTAMP '1998-12-31 23:59:59'"
_OVER = "(period_start <= TIMESTAMP '1998-12-31 23:59:59' AND (period_end IS NULL OR period_end >= TIMESTAMP '1996-01-01'))"


@query("filter_status", cte("fx_obs") + "SELECT obs_id, status FROM fx_obs WHERE status IS NULL OR NOT status IN ('cancelled', 'entered-in-error')")
def filter_status(t):
    return t.fx_obs.filter(pred.status_ok("status", ("cancelled", "entered-in-error"))).select("obs_id", "status")


@query("filter_condition_status", cte("fx_obs") + """
SELECT obs_id, status, comparator FROM fx_obs WHERE (status IS NULL OR NOT status IN ('cancelled')) AND (comparator IS NULL OR NOT comparator IN ('<', '>'))""")
def filter_condition_status(t):
    return t.fx_obs.filter(pred.status_ok("status", ["cancelled"]) & pred.status_ok("comparator", ["<", ">"])).select("obs_id", "status", "comparator")


@query("filter_code_system", cte("fx_obs") + "SELECT obs_id, code, unit FROM fx_obs WHERE unit = 'u1' AND code IN ('click', 'view')")
def filter_code_system(t):
    return t.fx_obs.filter(pred.in_codes("code", ["click", "view"], "unit", "u1")).select("obs_id", "code", "unit")


@query("filter_code_system_optional", cte("fx_obs") + "SELECT obs_id, code, unit FROM fx_obs WHERE (unit IS NULL OR unit = 'u1') AND code IN ('click', 'view')")
def filter_code_system_optional(t):
    return t.fx_obs.filter(pred.in_codes("code", ["click", "view"], "unit", "u1", null_system_ok=True)).select("obs_id", "code", "unit")


@query("filter_time_range", cte("fx_line") + f"SELECT obs_id, time FROM fx_line WHERE time BETWEEN {_R}")
def filter_time_range(t):
    return t.fx_line.filter(pred.in_range("time", LO, HI)).select("obs_id", "time")


@query("filter_period_overlap", cte("fx_enc") + f"SELECT enc_id, period_start, period_end FROM fx_enc WHERE {_OVER}")
def filter_period_overlap(t):
    return t.fx_enc.filter(pred.overlaps("period_start", "period_end", LO, HI)).select("enc_id", "period_start", "period_end")


@query("filter_point_or_period", cte("fx_med") + f"SELECT adm_id, effective, period_start, period_end FROM fx_med WHERE effective BETWEEN {_R} OR {_OVER}")
def filter_point_or_period(t):
    return t.fx_med.filter(pred.point_or_period("effective", "period_start", "period_end", LO, HI)).select("adm_id", "effective", "period_start", "period_end")


@query("filter_code_prefix", cte("fx_cond") + "SELECT con_id, icd FROM fx_cond WHERE starts_with(icd, 'E1') OR starts_with(icd, 'N12') OR icd IN ('R10.1')")
def filter_code_prefix(t):
    return t.fx_cond.filter(pred.has_prefix("icd", ["E1", "N12"]) | F.col("icd").isin("R10.1")).select("con_id", "icd")


@query("filter_main_encounter", cte("fx_enc") + """
SELECT *, period_start AS time FROM fx_enc WHERE (type IS NULL OR type = 'main') AND NOT (period_end IS NOT NULL AND period_start > period_end)""")
def filter_main_encounter(t):
    return clean.main_intervals(t.fx_enc, "main")


@query("filter_invalid_units", cte("fx_obs", "fx_units") + """
SELECT obs_id, code, unit FROM fx_obs o
WHERE CASE WHEN EXISTS (SELECT 1 FROM fx_units u WHERE u.label = o.code AND u.target_unit = 'invalid')
 THEN o.unit NOT IN (SELECT source_unit FROM fx_units WHERE target_unit = 'invalid') ELSE TRUE END""")
def filter_invalid_units(t):
    return drop_invalid(t.fx_obs, t.fx_units, "code").select("obs_id", "code", "unit")


@query("filter_invalid_units_count", cte("fx_obs", "fx_units") + """
SELECT count(*) AS n FROM fx_obs o JOIN fx_units u ON u.label = o.code AND u.source_unit = o.unit WHERE u.target_unit = 'invalid'""")
def filter_invalid_units_count(t):
    return invalid_count(t.fx_obs, t.fx_units, "code")


AGED = """, aged AS (SELECT o.*, p.gender, p.birth_raw, date_sub('year', TRY_CAST(CASE length(trim(birth_raw)) WHEN 4 THEN trim(birth_raw) || '-07-01'
 WHEN 7 THEN trim(birth_raw) || '-15' ELSE trim(birth_raw) END AS DATE), CAST(o.time AS DATE)) AS age
 FROM fx_obs o LEFT JOIN fx_patients p ON o.patient = p.pat_id)
"""


def aged(t):
    p = t.fx_patients
    joined = t.fx_obs.join(p, F.col("patient") == F.col("pat_id"), "left").drop("pat_id")
    return joined.withColumn("age", dates.age_years(dates.partial_date("birth_raw"), "time"))


@query("cohort_filter", cte("fx_obs", "fx_patients") + AGED + "SELECT obs_id, age, gender FROM aged WHERE age BETWEEN 18 AND 60 AND gender = 'male'")
def cohort_filter(t):
    return clean.cohort(aged(t), (18, 60), "male").select("obs_id", F.col("age").cast("bigint").alias("age"), "gender")


@query("filter_min_age", cte("fx_obs", "fx_patients") + AGED + "SELECT obs_id, age FROM aged WHERE age > 40 OR age IS NULL")
def filter_min_age(t):
    return clean.min_age(aged(t), 40).select("obs_id", F.col("age").cast("bigint").alias("age"))


@query("plausible_range", cte("fx_obs") + "SELECT obs_id, value FROM fx_obs WHERE value < 300.0 AND value > 5.0")
def plausible_range(t):
    return t.fx_obs.filter(values.plausible("value", Range(low_ext=5.0, high_ext=300.0))).select("obs_id", "value")


@query("implausible_report", cte("fx_obs") + """
SELECT code, count(*) AS n_implausible, min(value) AS min_implausible, max(value) AS max_implausible, round(median(value), 6) AS median_implausible
FROM fx_obs WHERE value >= 100.0 OR value <= 5.0 GROUP BY code""")
def implausible_report(t):
    return rounded(clean.implausible_report(t.fx_obs, "value", Range(low_ext=5.0, high_ext=100.0), "code"), "median_implausible")


@query("select_distinct", cte("fx_line") + "SELECT DISTINCT patient AS pat, code AS flag, sample_type FROM fx_line")
def select_distinct(t):
    return clean.project(t.fx_line, {"pat": "patient", "flag": "code", "sample_type": "sample_type"})


@query("drop_columns", cte("fx_obs") + "SELECT * EXCLUDE (k, ref_type) FROM fx_obs")
def drop_columns(t):
    return t.fx_obs.drop("k", "ref_type")


# --- scalar expressions ----------------------------------------------------------------------
_DATE = """TRY_CAST(CASE WHEN length(trim(birth_raw)) = 4 THEN trim(birth_raw) || '-07-01' WHEN length(trim(birth_raw)) = 7
 THEN trim(birth_raw) || '-15' ELSE trim(birth_raw) END AS DATE)"""


@query("normalize_partial_date", cte("fx_patients") + f"SELECT pat_id, {_DATE} AS birth FROM fx_patients")
def normalize_partial_date(t):
    return t.fx_patients.select("pat_id", dates.partial_date("birth_raw").alias("birth"))


@query("birthdate_quality", cte("fx_patients") + f""", b AS (SELECT birth_raw, length(trim(birth_raw)) AS size, {_DATE} AS day FROM fx_patients),
h AS (SELECT list(size) AS sizes, count(*) AS n, count(birth_raw) AS given, count(day) AS days, count(day) FILTER (size = 10) AS complete FROM b)
SELECT complete, n - given AS missing, given - days AS unparseable, len(list_filter(sizes, lambda x: x = 4)) AS year_only, len(list_filter(sizes, lambda x: x = 7)) AS year_month_only FROM h""")
def birthdate_quality(t):
    return clean.birthdate_quality(t.fx_patients, "birth_raw")


@query("age_at_event", cte("fx_obs", "fx_patients") + AGED + "SELECT obs_id, age FROM aged")
def age_at_event(t):
    return aged(t).select("obs_id", F.col("age").cast("bigint").alias("age"))


COMPARED = """, compared AS (SELECT *, CASE trim(comparator) WHEN '<' THEN round(value, 3) - 1e-6 WHEN '>' THEN round(value, 3) + 1e-6
 ELSE round(value, 3) END AS value_compare FROM fx_obs)
"""


def compared(df):
    return df.withColumn("value_compare", values.compare_value("value", "comparator"))


@query("compare_value", cte("fx_obs") + COMPARED + "SELECT obs_id, round(value_compare, 8) AS value_compare FROM compared")
def compare_value(t):
    return rounded(compared(t.fx_obs).select("obs_id", "value_compare"), digits=8)


@query("off_grid_report", cte("fx_obs") + """
SELECT code, unit, count(*) AS n, count(*) FILTER (WHERE abs(v - round(v, 3)) > 1e-9) AS n_off_grid FROM (SELECT *, value / 7.0 AS v FROM fx_obs)
WHERE v IS NOT NULL GROUP BY code, unit HAVING count(*) FILTER (WHERE abs(v - round(v, 3)) > 1e-9) > 0""")
def off_grid_report(t):
    return clean.off_grid_report(t.fx_obs.withColumn("value", F.col("value") / 7.0))


@query("comparator_report", cte("fx_obs") + """
SELECT code, unit, comparator, value, CASE WHEN n < 2 THEN '<2' ELSE CAST(n AS VARCHAR) END AS n FROM
 (SELECT code, unit, comparator, value, count(*) AS n FROM fx_obs WHERE comparator IS NOT NULL GROUP BY ALL)""")
def comparator_report(t):
    from labspark.functions.privacy import k_mask
    return k_mask(clean.comparator_report(t.fx_obs), "n", ("code", "unit", "comparator", "value"), 2)


@query("unit_normalize", cte("fx_obs", "fx_units") + """
SELECT o.obs_id, round(o.value * u.factor, 6) AS value_norm, round(CASE WHEN o.code = 'error' THEN COALESCE(o.value * u.factor, o.value)
 ELSE o.value * u.factor END, 6) AS value_fallback
FROM fx_obs o LEFT JOIN fx_units u ON u.label = o.code AND u.source_unit = o.unit""")
def unit_normalize(t):
    strict = normalize_units(t.fx_obs, t.fx_units, "code").withColumn("strict", F.col("value_norm")).drop("value_norm", "unit_factor")
    both = normalize_units(strict, t.fx_units, "code", optional_labels=("error",))
    return rounded(both.select("obs_id", F.col("strict").alias("value_norm"), F.col("value_norm").alias("value_fallback")))


_NORM = """, norm AS (SELECT o.*, u.factor AS unit_factor, CASE trim(comparator) WHEN '<' THEN round(value * factor, 3) - 1e-6
 WHEN '>' THEN round(value * factor, 3) + 1e-6 ELSE round(value * factor, 3) END AS vc,
 round(COALESCE(ref_low * factor, 11.0), 3) AS lo, round(COALESCE(ref_high * factor, 61.0), 3) AS hi
 FROM fx_obs o LEFT JOIN fx_units u ON u.label = o.code AND u.source_unit = o.unit)
"""


def normalized(t):
    n = normalize_units(t.fx_obs, t.fx_units, "code")
    return n.withColumns({"vc": values.compare_value("value_norm", "comparator"),
                          "lo": values.effective_bound("ref_low", "unit_factor", 11.0),
                          "hi": values.effective_bound("ref_high", "unit_factor", 61.0)})


@query("classify_lnh", cte("fx_obs", "fx_units") + _NORM + """
SELECT obs_id, CASE WHEN vc IS NULL THEN NULL WHEN vc < lo THEN 'L' WHEN vc > hi THEN 'H' ELSE 'N' END AS result FROM norm""")
def classify_lnh(t):
    return normalized(t).select("obs_id", values.classify("vc", "lo", "hi").alias("result"))


@query("classify_detail", cte("fx_obs", "fx_units") + _NORM + """
SELECT obs_id, CASE WHEN v IS NULL THEN NULL WHEN v < l THEN CASE WHEN v < 2.5 THEN 'L3' WHEN v < 3.0 THEN 'L2' ELSE 'L1' END WHEN v <= h THEN 'N'
 WHEN v <= 5.5 THEN 'H1' WHEN v <= 6.0 THEN 'H2' WHEN v <= 6.5 THEN 'H3' ELSE 'H4' END AS result_detail
FROM (SELECT obs_id, vc / 10 AS v, lo / 4 AS l, hi / 12 AS h FROM norm)""")
def classify_detail(t):
    n = normalized(t)
    return n.select("obs_id", values.classify_detail(F.col("vc") / 10, F.col("lo") / 4, F.col("hi") / 12, MAIN_CUTS).alias("result_detail"))


@query("classify_one_sided", cte("fx_obs") + """, d AS (SELECT obs_id, value, ref_low, ref_high, if(code <> 'view', 9.0, NULL) AS dl, if(code NOT IN ('view', 'click'), 50.0, NULL) AS dh FROM fx_obs),
s AS (SELECT obs_id, if(ref_low IS NULL, [value / 2, dl], [value, round(ref_low, 3)]) AS low, if(ref_high IS NULL, [dh, value / 2], [round(ref_high, 3), value]) AS high FROM d)
SELECT obs_id, if(low[2] IS NULL AND high[1] IS NULL, NULL, ['L', 'H', 'N'][coalesce(list_position([low[1] < low[2], high[1] < high[2]], true), 3)]) AS result FROM s""")
def classify_one_sided(t):
    dl = F.when(F.col("code") != "view", 9.0)
    dh = F.when(~F.col("code").isin("view", "click"), 50.0)
    return t.fx_obs.select("obs_id", values.classify_one_sided("value", F.col("value") / 2, "ref_low", "ref_high", dl, dh).alias("result"))


@query("sample_type", cte("fx_line") + "SELECT obs_id, value, CASE WHEN code IN ('A') THEN 'serum' WHEN code IN ('N') THEN 'blood' END AS kind FROM fx_line")
def sample_type(t):
    return t.fx_line.select("obs_id", "value", values.label_codes("code", {"serum": ["A"], "blood": ["N"]}).alias("kind"))


@query("ref_range_label", cte("fx_obs") + """, b AS (SELECT obs_id, CAST(ref_low AS VARCHAR) AS low, CAST(ref_high AS VARCHAR) AS high FROM fx_obs)
SELECT obs_id, coalesce(low || '-' || high, 'ab ' || low, 'bis ' || high) AS label FROM b""")
def ref_range_label(t):
    return t.fx_obs.select("obs_id", values.range_label("ref_low", "ref_high").alias("label"))


@query("coalesce_event_time", cte("fx_med") + """
SELECT adm_id, COALESCE(effective, period_end, period_start) AS time_end, COALESCE(effective, period_start) AS time_start FROM fx_med""")
def coalesce_event_time(t):
    return t.fx_med.select("adm_id", dates.event_time("effective", "period_end", "period_start").alias("time_end"),
                           dates.event_time("effective", "period_start").alias("time_start"))


@query("reference_prefix", cte("fx_line") + "SELECT obs_id, concat('Patient/', patient) AS ref, split_part(encounter, '/', 1) AS kind, value FROM fx_line")
def reference_prefix(t):
    return t.fx_line.select("obs_id", values.ref_id("Patient", "patient").alias("ref"), values.ref_kind("encounter").alias("kind"), "value")


@query("code_type", cte("fx_obs") + """
SELECT obs_id, CASE WHEN unit IS NOT NULL AND comparator IS NOT NULL THEN 'both' WHEN unit IS NOT NULL THEN 'ops' WHEN comparator IS NOT NULL THEN 'snomed' END AS code_type FROM fx_obs""")
def code_type(t):
    return t.fx_obs.select("obs_id", values.code_type("unit", "comparator").alias("code_type"))


@query("note_regex", "SELECT doc_id FROM documents WHERE regexp_matches(text, 'ÉTION|haemol|Password', 'i')")
def note_regex(t):
    return t.documents.filter(pred.matches_any("text", ["ÉTION", "haemol", "Password"])).select("doc_id")


@query("month_trunc", "SELECT event_id, CAST(date_trunc('month', ts) AS DATE) AS month, date_trunc('day', ts) AS day FROM events")
def month_trunc(t):
    return t.events.select("event_id", dates.month_of("ts").alias("month"), dates.day_of("ts").cast("timestamp_ntz").alias("day"))


@query("hours_between", cte("fx_enc") + "SELECT enc_id, round((epoch(period_end) - epoch(period_start)) / 3600.0, 6) AS hours FROM fx_enc")
def hours_between(t):
    return t.fx_enc.select("enc_id", F.round(dates.hours_between("period_start", "period_end"), 6).alias("hours"))


@query("cluster_id", cte("fx_obs") + "SELECT obs_id, CASE WHEN unit IS NOT NULL THEN unit || '_imp' ELSE CAST(obs_id AS VARCHAR) || '_amb' END AS cluster_id FROM fx_obs")
def cluster_id(t):
    return t.fx_obs.select("obs_id", values.cluster_id("unit", "obs_id").alias("cluster_id"))


@query("excluded_young", cte("fx_obs", "fx_patients") + AGED + "SELECT count(*) AS n FROM aged WHERE age < 30")
def excluded_young(t):
    return aged(t).filter("age < 30").agg(describe.n_rows())
