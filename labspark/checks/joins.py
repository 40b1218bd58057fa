"""Joins: equi-joins, references, and joins along time."""

from __future__ import annotations

from pyspark.sql import functions as F

from labspark.checks.registry import query, rounded
from labspark.functions.columns import add_all
from labspark.functions.dates import event_time
from labspark.functions.values import ref_id
from labspark.operators import clean, describe, intervals, resolve, units, windows
from labspark.sources.fixtures import CONDITION_PREFIXES, PREFIX_GROUPS, cte


@query("join_patient", cte("fx_obs", "fx_patients") + """
SELECT obs_id, patient_ref, pat_id, gender, birth_raw FROM (SELECT *, concat('Patient/', CAST(patient * 2 AS VARCHAR)) AS patient_ref FROM fx_obs) o
LEFT JOIN fx_patients p ON o.patient_ref = concat('Patient/', CAST(p.pat_id AS VARCHAR))""")
def join_patient(t):
    obs = t.fx_obs.withColumn("patient_ref", ref_id("Patient", F.col("patient") * 2))
    return resolve.resolve(obs, "patient_ref", t.fx_patients, "Patient", "pat_id").select("obs_id", "patient_ref", "pat_id", "gender", "birth_raw")


@query("join_unit", cte("fx_obs", "fx_units") + "SELECT obs_id, factor AS unit_factor FROM fx_obs o LEFT JOIN fx_units u ON u.label = o.code AND u.source_unit = o.unit")
def join_unit(t):
    return units.normalize_units(t.fx_obs, t.fx_units, "code").select("obs_id", "unit_factor")


@query("resolve_one_hop", cte("fx_med", "fx_medication") + """
SELECT adm_id, patient, m.med_id, m.code FROM (SELECT adm_id, patient, med_ref FROM fx_med) a LEFT JOIN fx_medication m ON a.med_ref = concat('Medication/', m.med_id)""")
def resolve_one_hop(t):
    return resolve.resolve_one_hop(t.fx_med.select("adm_id", "patient", "med_ref"), t.fx_medication)


@query("resolve_two_hop", cte("fx_med", "fx_medication") + """, link AS (SELECT 'Medication/' || med_id AS ref, med_id, code, med_med_ref FROM fx_medication),
chain AS (SELECT adm_id, patient, a.med_id, list_filter([{'far': CAST(NULL AS BIGINT), 'code': a.code, 'used': a.code IS NOT NULL}, {'far': b.med_id, 'code': b.code, 'used': a.med_med_ref IS NOT NULL}],
 lambda x: x.used) AS ends FROM fx_med LEFT JOIN link a ON med_ref = a.ref LEFT JOIN link b ON a.med_med_ref = b.ref)
SELECT adm_id, patient, med_id, e.far AS med_id2, e.code FROM (SELECT adm_id, patient, med_id, unnest(ends) AS e FROM chain)""")
def resolve_two_hop(t):
    return resolve.resolve_two_hop(t.fx_med.select("adm_id", "patient", "med_ref"), t.fx_medication)


@query("encounter_ref_types", cte("fx_line", "fx_enc") + """
SELECT CASE WHEN t.encounter IS NULL THEN 'no_encounter_reference' WHEN e.enc_id IS NULL THEN 'encounter_reference_without_match'
 WHEN e.type IS NULL THEN 'encounter_type_is_null' ELSE e.type END AS encounter_type, count(*) AS n
FROM (SELECT CASE WHEN obs_id % 7 = 0 THEN NULL WHEN obs_id % 7 = 1 THEN encounter || 'x' ELSE encounter END AS encounter FROM fx_line) t
LEFT JOIN fx_enc e ON t.encounter = concat('Encounter/', e.enc_id) GROUP BY 1""")
def encounter_ref_types(t):
    r = F.col("obs_id") % 7
    line = t.fx_line.withColumn("encounter", F.when(r == 0, None).when(r == 1, F.concat("encounter", F.lit("x"))).otherwise(F.col("encounter")))
    return resolve.reference_types(line, t.fx_enc)


# --- intervals -------------------------------------------------------------------------------
# the encounter of an instant is the greatest (length, smallest id) among those that cover it
ASSIGNED = """, cover AS (
 SELECT patient, i.time, max({'us': epoch_us(period_end) - epoch_us(period_start), 'near_id': -enc_id, 'id': enc_id, 'a': period_start, 'z': period_end}) AS best
 FROM fx_enc JOIN (SELECT patient, time FROM fx_line GROUP BY ALL) i USING (patient) WHERE i.time BETWEEN period_start AND period_end AND class <> 'AMB' GROUP BY ALL),
assigned AS (SELECT fx_line.*, if(best IS NULL, 'AMB', 'IMP') AS enc_class, best.id AS enc_id, best.a AS enc_start, best.z AS enc_end FROM fx_line LEFT JOIN cover USING (patient, time))
"""
_OPENING = """, opening AS (SELECT enc_id, time, count(*) AS n FROM assigned SEMI JOIN (SELECT enc_id, min(time) AS time FROM assigned GROUP BY enc_id) s USING (enc_id, time) GROUP BY ALL)
"""


def assigned(t):
    return intervals.assign_interval(t.fx_line, t.fx_enc)


@query("interval_assign", cte("fx_line", "fx_enc") + ASSIGNED + "SELECT obs_id, patient, time, enc_class, enc_id, enc_start, enc_end FROM assigned")
def interval_assign(t):
    return assigned(t).select("obs_id", "patient", "time", "enc_class", "enc_id", "enc_start", "enc_end")


@query("interval_assign_absent", cte("fx_line") + """
SELECT obs_id, 'AMB' AS enc_class, CAST(NULL AS VARCHAR) AS enc_id, CAST(NULL AS TIMESTAMP) AS enc_start, CAST(NULL AS TIMESTAMP) AS enc_end FROM fx_line""")
def interval_assign_absent(t):
    return intervals.assign_interval(t.fx_line, None).select("obs_id", "enc_class", "enc_id", "enc_start", "enc_end")


@query("first_in_interval", cte("fx_line", "fx_enc") + ASSIGNED + _OPENING + "SELECT obs_id, time, enc_id, CAST(coalesce(n = 1, false) AS INTEGER) AS first FROM assigned LEFT JOIN opening USING (enc_id, time)")
def first_in_interval(t):
    return intervals.first_in_interval(assigned(t)).select("obs_id", "time", "enc_id", "first")


@query("first_in_interval_ambiguous", cte("fx_line", "fx_enc") + ASSIGNED + _OPENING + "SELECT count(*) AS n_ambiguous FROM opening WHERE n > 1")
def first_in_interval_ambiguous(t):
    return intervals.ambiguous_first(assigned(t))


@query("per_interval_summary", cte("fx_line", "fx_enc") + ASSIGNED + """, x AS (
 SELECT 'measurements' AS metric, CAST(count(*) AS DOUBLE) AS x FROM assigned WHERE enc_id IS NOT NULL GROUP BY enc_id
 UNION ALL SELECT 'days', CAST(date_diff('day', min(enc_start), max(enc_end)) AS DOUBLE) FROM assigned WHERE enc_id IS NOT NULL GROUP BY enc_id)
SELECT metric, round(avg(x), 2) AS mean, round(median(x), 2) AS median, round(stddev_pop(x), 2) AS sd, min(x) AS min, max(x) AS max,
 round(quantile_cont(x, 0.25), 2) AS q1, round(quantile_cont(x, 0.75), 2) AS q3 FROM x GROUP BY metric""")
def per_interval_summary(t):
    return describe.per_interval_summary(assigned(t))


@query("amb_same_day", cte("fx_line", "fx_enc") + ASSIGNED + """
SELECT count(DISTINCT p.obs_id) AS n FROM assigned p JOIN (SELECT DISTINCT patient, CAST(period_start AS DATE) AS d FROM fx_enc WHERE class = 'AMB') amb
 ON p.patient = amb.patient AND CAST(p.time AS DATE) = amb.d WHERE p.enc_class = 'AMB'""")
def amb_same_day(t):
    return intervals.same_day(assigned(t), t.fx_enc)


@query("verify_assignment", cte("fx_line", "fx_enc") + ASSIGNED + """
SELECT count(*) FILTER (WHERE enc_org = 'Encounter/' || enc_id) AS same_enc,
 count(*) FILTER (WHERE enc_org IS NOT NULL AND enc_id IS NOT NULL AND enc_org <> 'Encounter/' || enc_id) AS diff_enc,
 count(*) FILTER (WHERE enc_org IS NULL AND enc_id IS NOT NULL) AS only_calc
FROM (SELECT *, CASE WHEN obs_id % 5 = 0 THEN NULL ELSE encounter END AS enc_org FROM assigned) WHERE enc_class = 'IMP'""")
def verify_assignment(t):
    return intervals.verify_assignment(assigned(t).withColumn("enc_org", F.when(F.col("obs_id") % 5 != 0, F.col("encounter"))))


# --- next and nearest events -----------------------------------------------------------------
# one row per instant, the greatest id speaking for it, and a look at the row after
_AHEAD = """, instant AS (SELECT patient, time, max({{'id': obs_id, 'row': {row}}}) AS top FROM {table} GROUP BY ALL),
ahead AS (SELECT patient, time, lead({{'t': time, 'top': top}}) OVER (PARTITION BY patient ORDER BY time) AS nx FROM instant)
"""


@query("next_event", cte("fx_obs") + _AHEAD.format(table="fx_obs", row="{'v': value, 'c': code}") + """
SELECT obs_id, nx.top.row.v AS next_value, nx.top.row.c AS next_code, CAST(nx IS NOT NULL AS INTEGER) AS next_flag, round((epoch_us(nx.t) - epoch_us(time)) / 3.6e9, 4) AS next_hours
FROM fx_obs JOIN ahead USING (patient, time)""")
def next_event(t):
    out = windows.next_event(t.fx_obs, "patient", "time", "obs_id", {"value": "value", "code": "code"})
    return rounded(out.select("obs_id", "next_value", "next_code", "next_flag", "next_hours"), "next_hours", digits=4)


@query("next_event_ties", cte("fx_obs", "fx_dup_obs") + _AHEAD.format(table="fx_dup_obs", row="0") + "SELECT obs_id, nx.top.id AS next_obs_id FROM fx_dup_obs JOIN ahead USING (patient, time)")
def next_event_ties(t):
    return windows.next_event(t.fx_dup_obs, "patient", "time", "obs_id", {"obs_id": "obs_id"}).select("obs_id", "next_obs_id")


def _meds(t, end: bool):
    cols = ("effective", "period_end", "period_start") if end else ("effective", "period_start")
    return t.fx_med.select("patient", "code", (event_time(*cols) + F.expr("INTERVAL '6' HOUR")).alias("time"))


_MEDS_END = """, meds AS (SELECT patient, code, COALESCE(effective, period_end, period_start) + INTERVAL 6 HOUR AS time FROM fx_med)
"""
_MEDS_START = """, meds AS (SELECT patient, code, COALESCE(effective, period_start) + INTERVAL 6 HOUR AS time FROM fx_med)
"""


def _exists(name, cond, lo="m.time > p.time - INTERVAL 24 HOUR", hi="m.time <= p.time", table="meds"):
    return (f"CASE WHEN EXISTS (SELECT 1 FROM {table} m WHERE m.patient = p.patient AND {lo} AND {hi} AND ({cond})) THEN 1 ELSE 0 END AS {name}")


_G1, _G2 = "m.code LIKE 'Brand#1%'", "m.code LIKE 'Brand#2%' OR m.code LIKE 'Brand#3%'"


@query("window_flags_prefix", cte("fx_line", "fx_med") + _MEDS_END + f"""
SELECT obs_id, time, value, g1, g2, CASE WHEN g1 + g2 = 1 THEN 1 ELSE 0 END AS alone_med FROM (SELECT p.*, {_exists('g1', _G1)}, {_exists('g2', _G2)} FROM fx_line p)""")
def window_flags_prefix(t):
    out = windows.flags_before(t.fx_line, _meds(t, True), windows.prefix_groups("code", PREFIX_GROUPS), "patient", "time", "time", 24)
    return out.select("obs_id", "time", "value", "g1", "g2", windows.alone(["g1", "g2"]).alias("alone_med"))


_AFTER = ("m.time > p.time", "m.time <= p.time + INTERVAL 12 HOUR")


@query("window_flags_after", cte("fx_line", "fx_med") + _MEDS_START + f"""
SELECT obs_id, time, value, {_exists('g1_after', _G1, *_AFTER)}, {_exists('g2_after', _G2, *_AFTER)} FROM fx_line p""")
def window_flags_after(t):
    groups = {f"{n}_after": c for n, c in windows.prefix_groups("code", PREFIX_GROUPS).items()}
    return windows.flags_after(t.fx_line, _meds(t, False), groups, "patient", "time", "time", 12).select("obs_id", "time", "value", "g1_after", "g2_after")


_LABELS = {"click": 6, "view": 48}
_LAB = """, lab AS (SELECT patient, time, code AS label, value, CASE WHEN k % 10 = 9 THEN NULL WHEN value < 20 THEN 'L' WHEN value > 80 THEN 'H' ELSE 'N' END AS result
 FROM fx_obs WHERE code IN ('click', 'view')), main AS (SELECT obs_id, patient, time FROM fx_obs WHERE code NOT IN ('click', 'view'))
"""


def _lab(t):
    v = F.col("value")
    res = F.when(F.col("k") % 10 == 9, None).when(v < 20, "L").when(v > 80, "H").otherwise("N")
    return t.fx_obs.filter(F.col("code").isin(*_LABELS)).select("patient", "time", F.col("code").alias("label"), "value", res.alias("result"))


def _main(t):
    return t.fx_obs.filter(~F.col("code").isin(*_LABELS)).select("obs_id", "patient", "time")


# every pair of a measurement and a value near it once; flags and nearest values are aggregates over the pairs
_NEAR = ", near AS (SELECT m.obs_id, label, result, value, abs(epoch_us(l.time) - epoch_us(m.time)) AS gap FROM main m JOIN lab l USING (patient) JOIN (VALUES " + ", ".join(
    f"('{k}', {h})" for k, h in _LABELS.items()) + ") reach(label, hours) USING (label) WHERE abs(epoch_us(l.time) - epoch_us(m.time)) <= hours * 3600000000)\n"


@query("window_flags_label", cte("fx_obs") + _LAB + _NEAR + "SELECT obs_id, " + ", ".join(
    f"CAST(count(*) FILTER (label || result = '{lab}{r}') > 0 AS INTEGER) AS {lab}_{r}" for lab in _LABELS for r in "NHL") + " FROM main LEFT JOIN near USING (obs_id) GROUP BY obs_id")
def window_flags_label(t):
    return windows.label_flags(_main(t), _lab(t), _LABELS, "patient", "time", "time").drop("patient", "time")


@query("nearest_value", cte("fx_obs") + _LAB + _NEAR + "SELECT obs_id, " + ", ".join(
    f"(min({{'gap': gap, 'order': coalesce(list_position(['N', 'L', 'H'], result), 4), 'v': value}}) FILTER (label = '{lab}')).v AS {lab}_value_norm" for lab in _LABELS)
    + " FROM main LEFT JOIN near USING (obs_id) GROUP BY obs_id")
def nearest_value(t):
    return windows.nearest_value(_main(t), _lab(t), _LABELS, "patient", "time", "time", "value").drop("patient", "time")


@query("top1_correlated", cte("fx_line", "fx_enc") + """
SELECT DISTINCT patient, time, (SELECT e.enc_id FROM fx_enc e WHERE e.patient = p.patient AND e.period_start <= p.time ORDER BY e.period_start DESC, e.enc_id LIMIT 1) AS last_enc FROM fx_line p""")
def top1_correlated(t):
    from labspark.operators.seek import Source, seek
    enc = t.fx_enc.groupBy("patient", "period_start").agg(F.min("enc_id").alias("enc_id"))
    pick = F.struct(F.col("period_start").alias("t"), F.col("enc_id").alias("id"))
    return seek(t.fx_line, Source(enc, "period_start", {"e": pick}), "patient", "time").select("patient", "time", F.col("e")["id"].alias("last_enc"))


_IV = """, proc AS (SELECT patient, period_start AS a, period_end AS z, coalesce(performed, period_start) AS moment, coalesce(period_start <> period_end, false) AS lasting,
 coalesce(period_start = period_end, period_end IS NULL) AS momentary FROM fx_proc),
p AS (SELECT row_number() OVER () AS nr, obs_id, patient, value, time + to_hours(CAST(value AS INT) % 30) AS time FROM fx_line),
met AS (SELECT nr, bool_or(lasting AND time BETWEEN a AND z) AS during, bool_or(lasting AND z <= time AND z >= time - INTERVAL 12 HOUR AND NOT time BETWEEN a AND z) AS before,
 bool_or(momentary AND moment <= time AND moment >= time - INTERVAL 12 HOUR) AS unclear FROM p JOIN proc USING (patient) GROUP BY nr)
SELECT obs_id, time, value, CAST(coalesce(during, false) AS INTEGER) AS dialyse_during, CAST(coalesce(before, false) AS INTEGER) AS dialyse_before,
 CAST(coalesce(unclear, false) AS INTEGER) AS dialyse_unclear FROM p LEFT JOIN met USING (nr)"""


def _shifted_line(t):
    shift = F.make_dt_interval(hours=F.col("value").cast("int") % 30)
    return t.fx_line.select("obs_id", "patient", "value", (F.col("time") + shift).alias("time"))


@query("interval_flags", cte("fx_line", "fx_proc") + _IV)
def interval_flags(t):
    return windows.interval_flags(_shifted_line(t), t.fx_proc, "patient", "time").drop("patient")


@query("procedure_after", cte("fx_line", "fx_proc") + f"""
SELECT obs_id, time, value, CASE WHEN EXISTS (SELECT 1 FROM fx_proc d WHERE d.patient = p.patient AND COALESCE(d.performed, d.period_start) > p.time
 AND COALESCE(d.performed, d.period_start) <= p.time + INTERVAL 12 HOUR) THEN 1 ELSE 0 END AS dialyse_after
FROM (SELECT obs_id, patient, value, time - INTERVAL 1 HOUR * (CAST(value AS INT) % 30) AS time FROM fx_line) p""")
def procedure_after(t):
    shift = F.make_dt_interval(hours=F.col("value").cast("int") % 30)
    line = t.fx_line.select("obs_id", "patient", "value", (F.col("time") - shift).alias("time"))
    proc = t.fx_proc.select("patient", event_time("performed", "period_start").alias("start"))
    return windows.flags_after(line, proc, {"dialyse_after": F.lit(True)}, "patient", "time", "start", 12).drop("patient")


_CTX = """((p.enc_class = 'IMP' AND c.time >= p.enc_start AND c.time < p.enc_end + INTERVAL 14 DAY)
 OR (p.enc_class = 'AMB' AND c.time >= date_trunc('day', p.time) AND c.time < date_trunc('day', p.time) + INTERVAL 15 DAY))"""


def _ctx_flag(name, cond):
    return f"CASE WHEN EXISTS (SELECT 1 FROM fx_cond c WHERE c.patient = p.patient AND {_CTX} AND ({cond})) THEN 1 ELSE 0 END AS {name}"


@query("context_flags_prefix", cte("fx_line", "fx_enc", "fx_cond") + ASSIGNED + f"""
SELECT obs_id, time, value, c1, c2, CASE WHEN c1 + c2 - c1 = 1 THEN 1 ELSE 0 END AS alone_cond FROM (
 SELECT p.*, {_ctx_flag('c1', "c.icd LIKE 'E1%'")}, {_ctx_flag('c2', "c.icd LIKE 'E11%' OR c.icd LIKE 'N12%'")} FROM assigned p)""")
def context_flags_prefix(t):
    out = windows.context_flags(assigned(t), t.fx_cond, windows.prefix_groups("icd", CONDITION_PREFIXES), "patient", "time", "time")
    return out.select("obs_id", "time", "value", "c1", "c2", windows.alone(["c1", "c2"], ignore=["c1"]).alias("alone_cond"))


_PAIRS = """, m AS (SELECT obs_id, patient, time, value, code, k % 3 AS enc, k % 2 AS thromb, if(value < 20, 'L', if(value > 80, 'H', 'N')) AS result FROM fx_obs),
closest AS (SELECT s.obs_id, min({'us': abs(epoch_us(b.time) - epoch_us(s.time)), 'id': b.obs_id}) AS c FROM m s JOIN m b USING (patient, enc)
 WHERE s.code IN ('click', 'view') AND b.code IN ('error', 'signup') AND abs(epoch_us(b.time) - epoch_us(s.time)) <= 6 * 3600000000 GROUP BY s.obs_id),
pairs AS (SELECT s.thromb, s.obs_id, b.obs_id AS obs_id_2, b.time AS time_2, s.result AS result_serum, b.result AS result_blood, c.us / 3.6e9 AS hours_between, s.value - b.value AS diff_signed,
 abs(s.value - b.value) AS diff_abs, ['serum_first', 'simultaneous', 'blood_first'][2 + sign(epoch_us(s.time) - epoch_us(b.time))] AS chronological_order
 FROM closest JOIN m s USING (obs_id) JOIN m b ON b.obs_id = c.id)
"""


def pairs(t):
    v = F.col("value")
    m = t.fx_obs.select("obs_id", "patient", "time", "code", v.alias("value_norm"),
                        F.when(v < 20, "L").when(v > 80, "H").otherwise("N").alias("result"),
                        (F.col("k") % 3).alias("enc_id"), (F.col("k") % 2).alias("thromb"))
    serum = m.filter(F.col("code").isin("click", "view")).withColumnRenamed("result", "result_serum")
    blood = m.filter(F.col("code").isin("error", "signup"))
    near = windows.pair_nearest(serum, blood, ["patient", "enc_id"], "time", "obs_id",
                                {"obs_id": "obs_id", "value_norm": "value_norm", "result": "result"}, 6, "obs_id")
    return describe.with_difference(near.withColumnRenamed("result_2", "result_blood"))


@query("pair_nearest", cte("fx_obs") + _PAIRS + """
SELECT obs_id, obs_id_2, time_2, result_serum, result_blood, round(hours_between, 6) AS hours_between, round(diff_signed, 6) AS diff_signed,
 round(diff_abs, 6) AS diff_abs, chronological_order FROM pairs""")
def pair_nearest(t):
    return rounded(pairs(t).select("obs_id", "obs_id_2", "time_2", "result_serum", "result_blood", "hours_between", "diff_signed",
                                   "diff_abs", "chronological_order"))


def _cells(sides):
    """Counts per pair of results, and their sums per side, from the list of result pairs."""
    one = {r + s: f"len(list_filter({sides}, lambda x: x = '{r}{s}'))" for r in "NLH" for s in "NLH"}
    out = [f"{' + '.join(one[r + s] for s in 'NLH')} AS n_serum_{r.lower()}" for r in "NLH"] + [f"{' + '.join(one[r + s] for r in 'NLH')} AS n_blood_{s.lower()}" for s in "NLH"]
    return ", ".join(out + [f"{c} AS n_serum_{k[0].lower()}_blood_{k[1].lower()}" for k, c in one.items()])


@query("pair_comparison", cte("fx_obs") + _PAIRS + f""", member AS (SELECT *, unnest(['all', if(thromb = 1, 'thromb', 'no_thromb')]) AS cohort FROM pairs),
placed AS (SELECT *, unnest(['all', chronological_order]) AS chronological_order_filter FROM member),
g AS (SELECT cohort, chronological_order_filter, count(*) AS n, avg(diff_signed) AS ms, quantile_cont(diff_signed, [0.25, 0.5, 0.75]) AS qs, avg(diff_abs) AS ma, quantile_cont(diff_abs, [0.5, 0.75, 0.9]) AS qa,
 avg(hours_between) AS mh, median(hours_between) AS qh, list(sign(diff_signed)) AS signs, list(result_serum || result_blood) AS sides FROM placed GROUP BY ALL)
SELECT cohort, chronological_order_filter, n, round(ms, 6) AS mean_diff_signed, round(qs[1], 6) AS p25_diff_signed, round(qs[2], 6) AS median_diff_signed, round(qs[3], 6) AS p75_diff_signed,
 len(list_filter(signs, lambda x: x = 1)) AS n_serum_higher, len(list_filter(signs, lambda x: x = -1)) AS n_blood_higher, len(list_filter(signs, lambda x: x = 0)) AS n_equal,
 round(ma, 6) AS mean_diff_abs, round(qa[1], 6) AS median_diff_abs, round(qa[2], 6) AS p75_diff_abs, round(qa[3], 6) AS p90_diff_abs, {_cells('sides')},
 round(mh, 6) AS mean_hours_between, round(qh, 6) AS median_hours_between FROM g""")
def pair_comparison(t):
    th = F.col("thromb")
    return rounded(describe.pair_comparison(pairs(t), {"all": None, "thromb": th == 1, "no_thromb": th == 0}))


# spans of an encounter, best first: (label, start, end, whether the end counts, stays only, measured from the end)
_TIMING = """, visit AS (SELECT enc_id, patient, class, class <> 'AMB' AS stay, period_start AS a, if(class = 'AMB', period_start, period_end) AS z,
  if(class = 'AMB', date_trunc('day', period_start), period_start) AS lo, if(class = 'AMB', date_trunc('day', period_start) + INTERVAL 1 DAY, period_end) AS hi
 FROM fx_enc WHERE coalesce(period_end >= period_start, class = 'AMB')),
span AS (SELECT enc_id, patient, class, stay, if(x.late, z, a) AS ref, x.* FROM (SELECT *, unnest([
 {'nr': 1, 'label': 'day1', 's': lo, 'e': least(lo + INTERVAL 1 DAY, hi), 'shut': false, 'stays': false, 'late': false},
 {'nr': 2, 'label': 'end_date', 's': greatest(lo, hi - INTERVAL 1 DAY), 'e': hi, 'shut': true, 'stays': true, 'late': true},
 {'nr': 3, 'label': 'day2_3', 's': lo, 'e': least(lo + INTERVAL 3 DAY, hi), 'shut': false, 'stays': true, 'late': false},
 {'nr': 4, 'label': 'day4_to_end', 's': lo, 'e': hi, 'shut': true, 'stays': true, 'late': false},
 {'nr': 5, 'label': 'end_to_3d_after', 's': lo, 'e': hi + INTERVAL 3 DAY, 'shut': false, 'stays': false, 'late': true},
 {'nr': 6, 'label': '3d_to_7d_after', 's': lo, 'e': hi + INTERVAL 7 DAY, 'shut': false, 'stays': false, 'late': true},
 {'nr': 7, 'label': '7d_to_14d_after', 's': lo, 'e': hi + INTERVAL 14 DAY, 'shut': false, 'stays': false, 'late': true},
 {'nr': 8, 'label': 'remaining', 's': lo, 'e': TIMESTAMP '9999-01-01', 'shut': false, 'stays': false, 'late': true}]) AS x FROM visit) WHERE stay OR NOT x.stays),
best AS (SELECT con_id, m.enc_id, m.class, m.label AS time_bucket FROM (SELECT con_id, min({'nr': nr, 'visit': NOT stay, 'us': abs(epoch_us(time) - epoch_us(ref)), 'enc_id': enc_id, 'class': class, 'label': label}) AS m
 FROM fx_cond c JOIN span USING (patient) WHERE time >= s AND (time < e OR (shut AND time = e)) GROUP BY con_id))
"""


def _timing(t):
    enc = t.fx_enc.filter(~F.coalesce(F.col("period_start") > F.col("period_end"), F.lit(False)))
    return intervals.bucket_to_interval(t.fx_cond, enc)


@query("bucket_to_interval", cte("fx_cond", "fx_enc") + _TIMING + "SELECT con_id, enc_id, class, time_bucket FROM best")
def bucket_to_interval(t):
    return _timing(t).select("con_id", "enc_id", "class", "time_bucket")


@query("bucket_to_interval_counts", cte("fx_cond", "fx_enc") + _TIMING + "SELECT class, time_bucket, count(*) AS n FROM best GROUP BY class, time_bucket")
def bucket_to_interval_counts(t):
    return clean.counts(_timing(t), "class", "time_bucket")


# --- semi joins and spines -------------------------------------------------------------------
@query("semi_in_tuple", cte("fx_obs", "fx_dup_obs") + """
SELECT count(DISTINCT obs_id) AS n FROM fx_dup_obs WHERE (patient, time) IN (SELECT (patient, time) FROM fx_dup_obs GROUP BY patient, time HAVING count(DISTINCT obs_id) >= 2)""")
def semi_in_tuple(t):
    return clean.ids_in_repeats(t.fx_dup_obs, ["patient", "time"], ["patient", "time"])


@query("join_histogram_spine", cte("fx_obs") + """, bins AS (SELECT code, b FROM (SELECT DISTINCT code FROM fx_obs), generate_series(0, 9) g(b))
SELECT bins.code, CAST(b AS INTEGER) AS bin, COALESCE(n, 0) AS n FROM bins LEFT JOIN (SELECT code, CAST(floor(value / 50) AS BIGINT) AS b, count(*) AS n FROM fx_obs GROUP BY ALL) c USING (code, b)""")
def join_histogram_spine(t):
    counted = t.fx_obs.groupBy("code", F.floor(F.col("value") / 50).cast("int").alias("bin")).agg(describe.n_rows())
    spine = t.fx_obs.select("code").distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(9))))
    return describe.zero_fill(counted, spine, ["code", "bin"])


@query("join_month_spine", """
WITH months AS (SELECT CAST(m AS DATE) AS month FROM generate_series(TIMESTAMP '1994-11-01', TIMESTAMP '2002-02-01', INTERVAL 1 MONTH) g(m)),
a AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, count(*) AS n FROM orders GROUP BY 1),
b AS (SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS month, count(*) AS n FROM lineitem GROUP BY 1)
SELECT month, COALESCE(a.n, 0) AS orders, COALESCE(b.n, 0) AS lines FROM months LEFT JOIN a USING (month) LEFT JOIN b USING (month)""")
def join_month_spine(t):
    from datetime import datetime
    tl = describe.monthly_timeline({"orders": t.orders.select(F.col("o_orderdate").alias("time")), "lines": t.lineitem.select(F.col("l_shipdate").alias("time"))},
                                   datetime(1994, 11, 1), datetime(2002, 2, 28))
    return describe.timeline_wide(tl, ["orders", "lines"])


@query("flag_totals", cte("fx_line", "fx_med") + _MEDS_END + f"""
SELECT CAST(sum(g1 + g2) AS BIGINT) AS n_matches, count(*) FILTER (WHERE g1 + g2 > 0) AS n_any, count(*) FILTER (WHERE g1 + g2 = 1) AS n_alone
FROM (SELECT {_exists('g1', _G1)}, {_exists('g2', _G2)} FROM fx_line p)""")
def flag_totals(t):
    out = window_flags_prefix(t)
    return describe.flag_totals(out, ["g1", "g2"], "alone_med")


@query("count_any_flag", cte("fx_line", "fx_med") + _MEDS_START + f"""
SELECT count(*) AS n FROM (SELECT {_exists('g1', _G1, *_AFTER)}, {_exists('g2', _G2, *_AFTER)} FROM fx_line p) WHERE g1 + g2 > 0""")
def count_any_flag(t):
    return window_flags_after(t).filter(add_all(["g1_after", "g2_after"]) > 0).agg(describe.n_rows())
