"""Repeats, extreme values, duplicate ids and unit checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from labspark.checks.registry import query, rounded
from labspark.functions.values import ref_id
from labspark.operators import clean, resolve
from labspark.sources.fixtures import cte

_DUP = cte("fx_obs", "fx_dup_obs")


@query("repeat_report", _DUP + """, per_code AS (SELECT patient, time, code, count(DISTINCT obs_id) AS k FROM fx_dup_obs GROUP BY ALL),
instant AS (SELECT patient, time, max(k) AS most, list_unique(flatten(list(ids))) AS total FROM (SELECT patient, time, max(k) AS k, any_value(ids) AS ids FROM per_code
 JOIN (SELECT patient, time, list(obs_id) AS ids FROM fx_dup_obs GROUP BY ALL) USING (patient, time) GROUP BY ALL) GROUP BY ALL),
crowd AS (SELECT count(DISTINCT obs_id) FILTER (total > 1) AS same_time, count(DISTINCT obs_id) FILTER (most > 1) AS same_time_code, count(DISTINCT obs_id) FILTER (most > 2) AS same_time_code_3
 FROM fx_dup_obs JOIN instant USING (patient, time)),
rep AS (SELECT unnest(list({'id': obs_id, 'lag': epoch_us(issued) - epoch_us(time), 'open': issued IS NULL})) AS r FROM fx_dup_obs GROUP BY patient, time, code HAVING count(*) > 1),
issue AS (SELECT count(DISTINCT r.id) FILTER (r.open) AS issued_na, count(DISTINCT r.id) FILTER (r.lag = 0) AS issued_identical, count(DISTINCT r.id) FILTER (r.lag < 0) AS issued_before,
 count(DISTINCT r.id) FILTER (r.lag > 0) AS issued_after FROM rep)
SELECT metric, n FROM (UNPIVOT crowd ON COLUMNS(*) INTO NAME metric VALUE n) UNION ALL SELECT metric, n FROM (UNPIVOT issue ON COLUMNS(*) INTO NAME metric VALUE n)""")
def repeat_report(t):
    return clean.repeat_report(t.fx_dup_obs)


_GROUPS = """, several AS (SELECT patient, time, code, max(issued) AS newest, list(issued) AS issues, count(*) AS n FROM fx_dup_obs WHERE time IS NOT NULL GROUP BY ALL HAVING count(*) > 1)
"""


@query("dedupe_repeats", _DUP + _GROUPS + """
SELECT obs_id, d.patient, d.time, d.code, issued, value FROM fx_dup_obs d LEFT JOIN several s ON d.patient IS NOT DISTINCT FROM s.patient AND d.time = s.time AND d.code IS NOT DISTINCT FROM s.code
WHERE newest IS NULL OR issued = newest""")
def dedupe_repeats(t):
    return clean.dedupe_repeats(t.fx_dup_obs).select("obs_id", "patient", "time", "code", "issued", "value")


@query("dedupe_repeats_uninformative", _DUP + "SELECT obs_id, patient, time, code, time AS issued FROM fx_dup_obs")
def dedupe_repeats_uninformative(t):
    """Nothing goes when no row was issued after its own time."""
    return clean.dedupe_repeats(t.fx_dup_obs.withColumn("issued", F.col("time"))).select("obs_id", "patient", "time", "code", "issued")


@query("dedupe_removed_unclear", _DUP + _GROUPS + """, k AS (SELECT *, len(list_filter(issues, lambda x: x = newest)) AS kept FROM several)
SELECT CAST(coalesce(sum(n - kept) FILTER (newest IS NOT NULL), 0) AS BIGINT) AS removed, count(*) FILTER (newest IS NULL OR kept > 1) AS unclear FROM k""")
def dedupe_removed_unclear(t):
    return clean.dedupe_counts(t.fx_dup_obs)


_MAD = cte("fx_obs") + """, middle AS (SELECT code, unit, quantile_cont(value, 0.5) AS mid FROM fx_obs GROUP BY ALL),
off AS (SELECT o.*, abs(value - mid) AS d FROM fx_obs o JOIN middle m ON o.code = m.code AND o.unit IS NOT DISTINCT FROM m.unit),
spread AS (SELECT code, unit, 1.4826 * quantile_cont(d, 0.5) AS s FROM off GROUP BY ALL),
judged AS (SELECT off.*, coalesce(s > 0 AND d / s > 5, false) AS bad FROM off JOIN spread p ON off.code = p.code AND off.unit IS NOT DISTINCT FROM p.unit)
"""


@query("mad_outliers_report", _MAD + """, bads AS (SELECT code, unit, list(value) FILTER (bad) AS v FROM judged GROUP BY ALL)
SELECT code, unit, coalesce(len(v), 0) AS n_implausible, list_min(v) AS min_implausible, list_max(v) AS max_implausible, round(list_aggregate(v, 'median'), 6) AS median_implausible FROM bads""")
def mad_outliers_report(t):
    return rounded(clean.mad_report(t.fx_obs, cutoff=5.0), "median_implausible")


@query("mad_outliers_filter", _MAD + "SELECT obs_id, value FROM judged WHERE NOT bad")
def mad_outliers_filter(t):
    return clean.mad_filter(t.fx_obs, cutoff=5.0).select("obs_id", "value")


@query("duplicate_ids", cte("fx_line") + """
SELECT 'ids' AS metric, count(*) AS n FROM (SELECT obs_id FROM fx_line GROUP BY obs_id HAVING count(*) > 1)
UNION ALL SELECT 'ids_and_code', count(*) FROM (SELECT obs_id FROM fx_line GROUP BY obs_id, code HAVING count(*) > 1)""")
def duplicate_ids(t):
    return clean.duplicate_ids(t.fx_line, "obs_id", "code")


@query("code_combinations", cte("fx_line") + """
SELECT code_combo, count(*) AS n_ids FROM (SELECT obs_id, string_agg(DISTINCT code, ', ' ORDER BY code) AS code_combo FROM fx_line GROUP BY obs_id) GROUP BY code_combo""")
def code_combinations(t):
    return clean.code_combinations(t.fx_line, "obs_id", "code")


@query("dangling_refs", cte("fx_medication") + """
SELECT count(*) AS n FROM fx_medication a LEFT JOIN fx_medication b ON a.med_med_ref = concat('Medication/', b.med_id) WHERE b.med_id IS NULL""")
def dangling_refs(t):
    m = t.fx_medication
    return clean.dangling(resolve.resolve(m, "med_med_ref", m.select(F.col("med_id").alias("med_id2")), "Medication", "med_id2"), "med_id2")


@query("unit_mismatch", cte("fx_obs") + """
SELECT unit, ref_low_unit, ref_high_unit, count(*) AS n FROM fx_obs WHERE (unit IS NOT NULL AND ref_low_unit IS NOT NULL AND unit <> ref_low_unit)
 OR (unit IS NOT NULL AND ref_high_unit IS NOT NULL AND unit <> ref_high_unit) GROUP BY ALL""")
def unit_mismatch(t):
    return clean.unit_mismatch(t.fx_obs)


@query("ref_type_counts", cte("fx_obs") + "SELECT ref_type, count(*) AS n FROM fx_obs GROUP BY ref_type")
def ref_type_counts(t):
    return clean.counts(t.fx_obs, "ref_type")


@query("missing_unit_value", cte("fx_obs", "fx_units") + """
SELECT count(*) FILTER (WHERE v IS NOT NULL AND unit IS NULL) AS n_value_without_unit, count(*) FILTER (WHERE v IS NULL) AS n_missing_value,
 count(*) FILTER (WHERE v IS NOT NULL AND v * factor IS NULL) AS n_norm_null
FROM (SELECT o.*, CASE WHEN k % 9 <> 0 THEN value END AS v, factor FROM fx_obs o LEFT JOIN fx_units u ON u.label = o.code AND u.source_unit = o.unit)""")
def missing_unit_value(t):
    from labspark.operators.units import normalize_units
    obs = t.fx_obs.withColumn("value", F.when(F.col("k") % 9 != 0, F.col("value")))
    return clean.missing_report(normalize_units(obs, t.fx_units, "code"), norm="value_norm")


@query("shared_instants", _DUP + "SELECT count(*) AS n FROM (SELECT patient, time FROM fx_dup_obs GROUP BY patient, time HAVING count(*) > 1)")
def shared_instants(t):
    return clean.shared_instants(t.fx_dup_obs)


@query("reference_build", cte("fx_obs") + "SELECT count(DISTINCT concat('Patient/', patient)) AS n FROM fx_obs")
def reference_build(t):
    return t.fx_obs.agg(F.count_distinct(ref_id("Patient", "patient")).alias("n"))
