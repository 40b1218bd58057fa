"""Descriptive aggregates, suppression and co-occurrence counts."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from labspark.checks.joins import _exists, _G1, _G2, _MEDS_END, window_flags_prefix
from labspark.checks.registry import query, rounded
from labspark.checks.scalars import AGED, COMPARED, aged, compared
from labspark.functions.privacy import k_cells, k_censor, k_mask
from labspark.operators import clean, cooccur, describe, windows
from labspark.sources.fixtures import cte
from labspark.spec import AGE_BANDS, GENDERS, PERCENTILES

# a missing bound makes the joined text NULL, so the first that is left has all its bounds
_RANGE = "coalesce(ref_low::VARCHAR || '-' || ref_high::VARCHAR, 'ab ' || ref_low::VARCHAR, 'bis ' || ref_high::VARCHAR)"
_BELOW, _ABOVE = "coalesce(value_compare < round(ref_low, 3), false)", "coalesce(value_compare > round(ref_high, 3), false)"
_STATS = f"""code, unit, round(avg(value), 6) AS mean_value, round(median(value), 6) AS median_value, round(stddev(value), 6) AS sd_value, min(value) AS min_value,
 max(value) AS max_value, count(*) AS n, count(DISTINCT patient) AS n_pat, {', '.join(f'round(quantile_cont(value, {p}), 6) AS {n}' for n, p in PERCENTILES.items())},
 count(*) FILTER (WHERE value IS NULL) AS n_na,
 count(value) FILTER ({_BELOW}) AS n_below_ref, count(value) FILTER (coalesce(ref_low, ref_high) IS NOT NULL AND NOT {_BELOW} AND NOT {_ABOVE}) AS n_within_ref,
 count(value) FILTER ({_ABOVE}) AS n_above_ref, count(value) - count(value) FILTER (coalesce(ref_low, ref_high) IS NOT NULL) AS n_no_ref,
 string_agg(DISTINCT {_RANGE}, ', ' ORDER BY {_RANGE}) AS reference_ranges, string_agg(DISTINCT ref_low_unit, ', ' ORDER BY ref_low_unit) AS reference_low_units,
 string_agg(DISTINCT ref_high_unit, ', ' ORDER BY ref_high_unit) AS reference_high_units"""


@query("value_statistics", cte("fx_obs") + COMPARED + f"SELECT {_STATS} FROM compared GROUP BY code, unit")
def value_statistics(t):
    return rounded(describe.value_statistics(compared(t.fx_obs)))


def _cohort_where(lo, hi, g):
    conds = ([] if lo is None else [f"age BETWEEN {lo} AND {hi}"]) + ([] if g is None else [f"gender = '{g}'"])
    return " AND ".join(conds) or "TRUE"


_COHORTS = [(lo, hi, g) for lo, hi in AGE_BANDS for g in GENDERS]


def _label(x):
    return "all" if x is None else str(x)


_AGED_COMPARED = cte("fx_obs", "fx_patients") + AGED + """, compared AS (SELECT *, CASE trim(comparator) WHEN '<' THEN round(value, 3) - 1e-6
 WHEN '>' THEN round(value, 3) + 1e-6 ELSE round(value, 3) END AS value_compare FROM aged)
"""


@query("value_statistics_cohorts", _AGED_COMPARED + "\nUNION ALL\n".join(
    f"SELECT {_STATS}, '{_label(lo)}' AS age_min, '{_label(hi)}' AS age_max, '{_label(g)}' AS cohort_gender FROM compared WHERE {_cohort_where(lo, hi, g)} GROUP BY code, unit"
    for lo, hi, g in _COHORTS))
def value_statistics_cohorts(t):
    return rounded(describe.cohort_statistics(compared(aged(t))))


# tenths from 2 to 8, and one open bin at either end
_BINS = "(SELECT t AS bin_key, if(t = 19, NULL, t / 10.0) AS bin_start, if(t = 80, NULL, (t + 1) / 10.0) AS bin_end FROM unnest(range(19, 81)) AS r(t))"
_BIN = "CAST(greatest(19, least(80, floor(vc * 10))) AS BIGINT)"


def _dist_sql(where, extra):
    return f"""SELECT g.code, g.unit, b.bin_start, b.bin_end, COALESCE(c.n, 0) AS n{extra}
FROM (SELECT DISTINCT code, unit FROM small WHERE value IS NOT NULL) g, {_BINS} b
LEFT JOIN (SELECT code, unit, {_BIN} AS bin_key, count(*) AS n FROM small WHERE value IS NOT NULL AND {where} GROUP BY ALL) c
 ON c.code = g.code AND c.unit IS NOT DISTINCT FROM g.unit AND c.bin_key = b.bin_key"""


@query("value_distribution", cte("fx_obs") + COMPARED + ", small AS (SELECT *, value_compare / 16 AS vc FROM compared)\n" + _dist_sql("TRUE", ""))
def value_distribution(t):
    rows = compared(t.fx_obs).withColumn("value_compare", F.col("value_compare") / 16)
    return describe.value_distribution(rows)


@query("value_distribution_cohorts", _AGED_COMPARED + """, small AS (SELECT *, value_compare / 16 AS vc FROM compared)
SELECT code, unit, bin_start, bin_end, age_min, age_max, cohort_gender, CASE WHEN n <> 0 AND n < 5 THEN '<5' ELSE CAST(n AS VARCHAR) END AS n FROM (
""" + "\nUNION ALL\n".join(
    _dist_sql(_cohort_where(lo, hi, g), f", '{_label(lo)}' AS age_min, '{_label(hi)}' AS age_max, '{_label(g)}' AS cohort_gender")
    + f" WHERE EXISTS (SELECT 1 FROM compared WHERE {_cohort_where(lo, hi, g)})" for lo, hi, g in _COHORTS) + ")")
def value_distribution_cohorts(t):
    rows = compared(aged(t)).withColumn("value_compare", F.col("value_compare") / 16)
    return k_mask(describe.cohort_distribution(rows), "n", ["code", "unit", "bin_start", "bin_end", *describe.COHORT_COLUMNS])


@query("monthly_counts", cte("fx_line") + """
SELECT code, sample_type, CAST(date_trunc('month', time) AS DATE) AS month, CASE WHEN n < 5 THEN '<5' ELSE CAST(n AS VARCHAR) END AS n,
 CASE WHEN n >= 5 THEN n_excluded END AS n_excluded, CASE WHEN n >= 5 THEN m END AS median_value FROM (
 SELECT code, sample_type, date_trunc('month', time) AS time, count(*) AS n, count(*) FILTER (WHERE value IS NULL) AS n_excluded, round(median(value), 6) AS m FROM fx_line GROUP BY ALL)""")
def monthly_counts(t):
    out = rounded(describe.monthly_counts(t.fx_line, ["code", "sample_type"]))
    return k_mask(out, "n", ["code", "sample_type", "month"])


_COLUMNS = ("obs_id", "patient", "time", "value", "k", "unit", "comparator", "ref_low", "ref_high", "ref_low_unit", "ref_high_unit", "ref_type", "status")
_CODES = ("click", "error", "purchase", "signup", "view")


@query("column_completeness", cte("fx_obs") + " UNION ALL ".join(
    f"SELECT code, '{c}' AS column_name, count(nullif(CAST({c} AS VARCHAR), '')) AS n FROM fx_obs GROUP BY code" for c in _COLUMNS))
def column_completeness(t):
    return describe.completeness(t.fx_obs, "code")


@query("column_completeness_wide", cte("fx_obs") + " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, " + ", ".join(f"count(nullif(CAST({c} AS VARCHAR), '')) FILTER (code = '{v}') AS {v}" for v in _CODES) + " FROM fx_obs" for c in _COLUMNS))
def column_completeness_wide(t):
    return describe.transpose(describe.completeness(t.fx_obs, "code"), "code", list(_CODES))


@query("dataset_description", cte("fx_obs", "fx_dup_obs") + """, d AS (SELECT x.*, o.status, o.ref_type, CASE WHEN o.k % 8 = 0 THEN NULL ELSE x.obs_id // 2 END AS identifier FROM fx_dup_obs x JOIN fx_obs o USING (obs_id))
SELECT unnest(['patients', 'identifier_distinct', 'identifier_null', 'issued_na', 'issued_identical', 'issued_before', 'issued_after']) AS metric, CAST(NULL AS VARCHAR) AS key,
 unnest([a, b, c, e, f, g, h]) AS n FROM (SELECT count(DISTINCT patient) AS a, count(DISTINCT identifier) AS b, count(*) FILTER (WHERE identifier IS NULL) AS c,
 count(DISTINCT CASE WHEN issued IS NULL THEN obs_id END) AS e, count(DISTINCT CASE WHEN issued = time THEN obs_id END) AS f,
 count(DISTINCT CASE WHEN issued < time THEN obs_id END) AS g, count(DISTINCT CASE WHEN issued > time THEN obs_id END) AS h FROM d)
UNION ALL SELECT 'identifier_duplicate', NULL, count(*) FROM (SELECT identifier FROM d GROUP BY identifier HAVING count(DISTINCT obs_id) > 1)
UNION ALL SELECT 'obs_per_code', code, count(DISTINCT obs_id) FROM d GROUP BY code
UNION ALL SELECT 'status', COALESCE(status, 'NULL'), count(*) FROM d GROUP BY status
UNION ALL SELECT 'interpretation', code || '|' || COALESCE(ref_type, 'NULL'), count(DISTINCT obs_id) FROM d GROUP BY code, ref_type""")
def dataset_description(t):
    obs = t.fx_obs.select("obs_id", "status", "ref_type", F.when(F.col("k") % 8 != 0, F.floor(F.col("obs_id") / 2).cast("bigint")).alias("identifier"))
    return describe.dataset_description(t.fx_dup_obs.join(obs, "obs_id"), interpretation="ref_type")


@query("age_gender_report", cte("fx_obs", "fx_patients") + AGED + """
SELECT 'patients' AS metric, COALESCE(gender, 'NULL') AS key, count(DISTINCT patient) AS n FROM aged GROUP BY gender
UNION ALL SELECT 'measurements', COALESCE(gender, 'NULL'), count(DISTINCT obs_id) FROM aged GROUP BY gender
UNION ALL SELECT unnest(['min_age', 'max_age', 'age_below_0', 'age_above_120']), NULL, unnest([a, b, c, d]) FROM (SELECT min(age) AS a, max(age) AS b,
 count(DISTINCT CASE WHEN age < 0 THEN obs_id END) AS c, count(DISTINCT CASE WHEN age > 120 THEN obs_id END) AS d FROM aged)""")
def age_gender_report(t):
    return describe.age_gender_report(aged(t), patient="patient")


_TL = """WITH m AS (SELECT CAST(m AS DATE) AS month FROM generate_series(TIMESTAMP '1994-06-01', TIMESTAMP '2000-12-01', INTERVAL 1 MONTH) g(m)),
counts AS (SELECT 'orders' AS table_name, CAST(date_trunc('month', o_orderdate) AS DATE) AS month, count(*) AS n FROM orders
  WHERE o_orderdate >= TIMESTAMP '1994-06-01' AND o_orderdate <= TIMESTAMP '2000-12-31 23:59:59' GROUP BY ALL
 UNION ALL SELECT 'lines', CAST(date_trunc('month', l_shipdate) AS DATE), count(*) FROM lineitem WHERE l_shipdate >= TIMESTAMP '1994-06-01' AND l_shipdate <= TIMESTAMP '2000-12-31 23:59:59' GROUP BY ALL),
tl AS (SELECT t.table_name, m.month, COALESCE(c.n, 0) AS n FROM (SELECT unnest(['orders', 'lines']) AS table_name) t, m LEFT JOIN counts c ON c.table_name = t.table_name AND c.month = m.month)
"""


def _timeline(t):
    return describe.monthly_timeline({"orders": t.orders.select(F.col("o_orderdate").alias("time")), "lines": t.lineitem.select(F.col("l_shipdate").alias("time"))},
                                     datetime(1994, 6, 1), datetime(2000, 12, 31, 23, 59, 59))


@query("monthly_timeline", _TL + "SELECT table_name, month, CASE WHEN n <> 0 AND n < 5 THEN '<5' ELSE CAST(n AS VARCHAR) END AS n FROM tl")
def monthly_timeline(t):
    return k_mask(_timeline(t), "n", ["table_name", "month"])


_AVAIL = _TL + """, av AS (SELECT table_name, min(month) FILTER (WHERE n >= mx * 0.5) AS min_available, max(month) FILTER (WHERE n >= mx * 0.5) AS max_available
 FROM (SELECT *, max(n) OVER (PARTITION BY table_name) AS mx FROM tl) GROUP BY table_name)
"""


@query("availability_window", _AVAIL + "SELECT * FROM av")
def availability_window(t):
    return describe.availability(_timeline(t))


@query("regression_window", _AVAIL + "SELECT table_name, CAST(date_trunc('month', min_available) AS DATE) AS t_min, CAST(date_trunc('month', max_available) + INTERVAL 1 MONTH AS DATE) AS t_max FROM av")
def regression_window(t):
    from labspark.operators.regress import month_windows
    return month_windows(describe.availability(_timeline(t)))


@query("lab_summary", cte("fx_obs") + """, s AS (SELECT code, unit, count(*) AS n, count(ref_high) AS n_ref_high, count(ref_low) AS n_ref_low, round(avg(value), 6) AS mean, round(median(value), 6) AS median,
 round(stddev_pop(value), 6) AS sd, min(value) AS min, max(value) AS max, round(quantile_cont(value, 0.25), 6) AS q1, round(quantile_cont(value, 0.75), 6) AS q3 FROM fx_obs GROUP BY code, unit)
SELECT code, unit, n_ref_high, n_ref_low, median, min, max, CASE WHEN n < 230 THEN '<230' ELSE CAST(n AS VARCHAR) END AS n, CASE WHEN n >= 230 THEN mean END AS mean,
 CASE WHEN n >= 230 THEN sd END AS sd, CASE WHEN n >= 230 THEN q1 END AS q1, CASE WHEN n >= 230 THEN q3 END AS q3 FROM s""")
def lab_summary(t):
    return k_mask(rounded(describe.lab_summary(t.fx_obs)), "n", ["code", "unit", "n_ref_high", "n_ref_low", "median", "min", "max"], 230)


@query("result_counts", cte("fx_obs") + """
SELECT 'unit' AS kind, unit AS key, count(*) AS n FROM fx_obs GROUP BY unit UNION ALL SELECT 'comparator', comparator, count(*) FROM fx_obs GROUP BY comparator
UNION ALL SELECT 'code', code, count(*) FROM fx_obs GROUP BY code""")
def result_counts(t):
    from functools import reduce
    return reduce(lambda a, b: a.unionByName(b), [
        clean.counts(t.fx_obs, c).select(F.lit(c).alias("kind"), F.col(c).alias("key"), "n") for c in ("unit", "comparator", "code")])


@query("timestamp_availability", cte("fx_med") + """
SELECT count(*) AS n_total, count(period_start) AS n_period_start_not_null, count(period_end) AS n_period_end_not_null, count(effective) AS n_point_not_null,
 count(*) FILTER (WHERE period_start = period_end) AS n_start_eq_end FROM fx_med""")
def timestamp_availability(t):
    return describe.timestamp_availability(t.fx_med, "effective")


# --- suppression -----------------------------------------------------------------------------
_KC = cte("fx_obs") + ", c AS (SELECT code, unit, comparator, count(*) AS n, count(*) FILTER (WHERE value > 60) AS n_high, round(avg(value), 6) AS mean FROM fx_obs GROUP BY ALL)\n"


def _kc(t):
    return rounded(t.fx_obs.groupBy("code", "unit", "comparator").agg(describe.n_rows(), F.count_if(F.col("value") > 60).alias("n_high"), F.avg("value").alias("mean")))


@query("k_anonymity", _KC + """, f AS (SELECT *, (n <> 0 AND n < 90) OR (n_high <> 0 AND n_high < 90) AS small FROM c)
SELECT code, unit, comparator, CASE WHEN small THEN '<90' ELSE CAST(n AS VARCHAR) END AS n, CASE WHEN small THEN '<90' ELSE CAST(n_high AS VARCHAR) END AS n_high,
 CASE WHEN NOT small THEN mean END AS mean FROM f""")
def k_anonymity(t):
    return k_mask(_kc(t), ["n", "n_high"], ["code", "unit", "comparator"], 90)


@query("k_extra", _KC + """
SELECT code, unit, comparator, CASE WHEN n > 0 AND n < 90 THEN '<90' ELSE CAST(n AS VARCHAR) END AS n, CASE WHEN n_high > 0 AND n_high < 90 THEN '<90' ELSE CAST(n_high AS VARCHAR) END AS n_high, mean FROM c""")
def k_extra(t):
    return k_cells(_kc(t), ["n", "n_high"], 90)


@query("k_censor_log", _KC + "SELECT code, unit, comparator, CASE WHEN n % 90 = 0 OR n % 90 >= 5 THEN CAST(n % 90 AS VARCHAR) ELSE '<5' END AS cell FROM c")
def k_censor_log(t):
    return _kc(t).select("code", "unit", "comparator", k_censor(F.col("n") % 90).alias("cell"))


# --- follow-up -------------------------------------------------------------------------------
_NEXT = """, nx AS (SELECT *, lead(time) OVER w AS nt, lead(obs_id) OVER w AS nid, lead(code) OVER w AS next_code, lead(k) OVER w AS nk,
 CASE WHEN value < 20 THEN 'L' WHEN value > 80 THEN 'H' ELSE 'N' END AS result FROM fx_obs WINDOW w AS (PARTITION BY patient ORDER BY time)),
fu AS (SELECT *, CASE WHEN nid IS NOT NULL THEN 1 ELSE 0 END AS next_flag, round((epoch(nt) - epoch(time)) / 3600.0, 4) AS next_hours, lead(result) OVER (PARTITION BY patient ORDER BY time) AS next_result,
 CASE WHEN nid IS NOT NULL AND k % 4 = nk % 4 THEN 1 ELSE 0 END AS same_encounter, CASE WHEN k % 3 = 0 THEN 1 ELSE 0 END AS first FROM nx)
"""


def followed(t):
    v = F.col("value")
    obs = t.fx_obs.withColumn("result", F.when(v < 20, "L").when(v > 80, "H").otherwise("N"))
    out = windows.next_event(obs, "patient", "time", "obs_id", {"code": "code", "result": "result", "k": "k"})
    same = F.coalesce((F.col("k") % 4) == (F.col("next_k") % 4), F.lit(False)).cast("int")
    return out.withColumns({"same_encounter": same, "first": (F.col("k") % 3 == 0).cast("int"), "next_hours": F.round("next_hours", 4)})


def _hours(grp, where):
    return f"""SELECT '{grp}' AS grp, count(*) AS n, round(avg(next_hours), 2) AS avg, round(median(next_hours), 2) AS median, round(stddev(next_hours), 2) AS sd,
 round(quantile_cont(next_hours, 0.25), 2) AS p25, round(quantile_cont(next_hours, 0.75), 2) AS p75 FROM fu WHERE next_flag = 1 AND {where}"""


@query("followup_report", cte("fx_obs") + _NEXT + " UNION ALL ".join([_hours("total", "TRUE"), _hours("same_encounter", "same_encounter = 1"), _hours("in_time", "next_hours <= 8")]))
def followup_report(t):
    return describe.followup_report(followed(t), 8)


@query("transition_6h", cte("fx_obs") + _NEXT + """, s AS (SELECT code, next_code, count(*) AS n, round(avg(next_hours), 6) AS avg_hours, round(median(next_hours), 6) AS median_hours, round(stddev(next_hours), 6) AS sd_hours,
 round(quantile_cont(next_hours, 0.25), 6) AS p25, round(quantile_cont(next_hours, 0.75), 6) AS p75 FROM fu WHERE next_hours <= 6 GROUP BY code, next_code)
SELECT code, next_code, CASE WHEN n < 150 THEN '<150' ELSE CAST(n AS VARCHAR) END AS n, CASE WHEN n >= 150 THEN avg_hours END AS avg_hours, CASE WHEN n >= 150 THEN median_hours END AS median_hours,
 CASE WHEN n >= 150 THEN sd_hours END AS sd_hours, CASE WHEN n >= 150 THEN p25 END AS p25, CASE WHEN n >= 150 THEN p75 END AS p75 FROM s""")
def transition_6h(t):
    out = rounded(describe.transitions(followed(t), 6, ("code", "next_code")))
    return k_mask(out, "n", ["code", "next_code"], 150)


# --- co-occurrence ---------------------------------------------------------------------------
_CO = cte("fx_line", "fx_med") + _MEDS_END + f""", flagged AS (SELECT *, code AS result, CASE WHEN value > 25 THEN 'IMP' ELSE 'AMB' END AS enc_class, CASE WHEN value > 40 THEN 1 ELSE 0 END AS first,
 CASE WHEN g1 + g2 = 1 THEN 1 ELSE 0 END AS alone_med FROM (SELECT p.*, {_exists('g1', _G1)}, {_exists('g2', _G2)} FROM fx_line p))
"""


def flagged(t):
    out = windows.flags_before(t.fx_line, _meds(t), windows.prefix_groups("code", {"g1": ("Brand#1",), "g2": ("Brand#2", "Brand#3")}), "patient", "time", "time", 24)
    return out.withColumns({"result": F.col("code"), "enc_class": F.when(F.col("value") > 25, "IMP").otherwise("AMB"),
                            "first": (F.col("value") > 40).cast("int"), "alone_med": windows.alone(["g1", "g2"])})


def _meds(t):
    from labspark.checks.joins import _meds as meds
    return meds(t, True)


@query("flag_cooccurrence", _CO + " UNION ALL ".join(
    f"""SELECT '{g}' AS grp, '{c}' AS cohort, result, CAST(sum({g}) AS BIGINT) AS n_match, CAST(sum(1 - {g}) AS BIGINT) AS n_no_match, count(*) AS n_total FROM flagged
 WHERE time >= TIMESTAMP '1996-02-01' AND time < TIMESTAMP '2000-06-01' AND {w} GROUP BY result"""
    for g in ("g1", "g2") for c, w in (("all", "TRUE"), ("without_AMB", "NOT enc_class = 'AMB'"), ("only_first", "first = 1"), ("first_alone", "first = 1 AND alone_med = 1"))))
def flag_cooccurrence(t):
    window = (datetime(1996, 2, 1), datetime(2000, 6, 1))
    return cooccur.cooccurrence(flagged(t), ["g1", "g2"], "result", cooccur.cohorts_medication(), window)


_LABCO = cte("fx_obs") + """, f AS (SELECT *, CASE WHEN k % 7 = 0 THEN 1 ELSE 0 END AS a_H, CASE WHEN k % 5 = 0 THEN 1 ELSE 0 END AS a_N, CASE WHEN k % 11 = 0 THEN 1 ELSE 0 END AS a_L,
 CASE WHEN k % 4 = 0 THEN 1 ELSE 0 END AS b_H, CASE WHEN k % 6 = 0 THEN 1 ELSE 0 END AS b_N, CASE WHEN k % 9 = 0 THEN 1 ELSE 0 END AS b_L,
 code AS result, CASE WHEN value > 25 THEN 'IMP' ELSE 'AMB' END AS enc_class, CASE WHEN value > 40 THEN 1 ELSE 0 END AS first FROM fx_obs)
"""


@query("lab_cooccurrence", _LABCO + " UNION ALL ".join(
    f"""SELECT '{x}_{s}' AS grp, '{c}' AS cohort, result, CAST(sum({x}_{s}) AS BIGINT) AS n_match, CAST(sum({x}_N) AS BIGINT) AS n_normal,
 count(*) FILTER (WHERE {x}_H + {x}_N + {x}_L > 0) AS n_measured FROM f WHERE {w} GROUP BY result"""
    for x in "ab" for s in "HL" for c, w in (("lab", "TRUE"), ("lab_only_first", "first = 1"), ("lab_first_or_amb", "(first = 1 OR enc_class = 'AMB')"))))
def lab_cooccurrence(t):
    mods = {"a_H": 7, "a_N": 5, "a_L": 11, "b_H": 4, "b_N": 6, "b_L": 9}
    rows = t.fx_obs.withColumns({**{n: (F.col("k") % m == 0).cast("int") for n, m in mods.items()}, "result": F.col("code"),
                                 "enc_class": F.when(F.col("value") > 25, "IMP").otherwise("AMB"), "first": (F.col("value") > 40).cast("int")})
    return cooccur.lab_cooccurrence(rows, ["a", "b"], "result", cooccur.cohorts_lab())


@query("followup_cooccurrence", cte("fx_obs") + _NEXT + """, cohort(cohort, lim, pick) AS (VALUES ('5days_all', 120, 'all'), ('2hours_all', 2, 'all'), ('48hours_all', 48, 'all'),
 ('same_encounter', 120, 'same'), ('only_first_5d', 120, 'first')),
member AS (SELECT cohort, result, 'next_' || if(next_flag = 0 OR next_hours > lim, 'no', next_result) AS grp FROM fu JOIN cohort ON pick IN ('all', if(same_encounter = 1, 'same', ''), if(first = 1, 'first', ''))),
whole AS (SELECT cohort, result, count(*) AS n_total FROM member GROUP BY ALL), part AS (SELECT cohort, result, grp, count(*) AS n_match FROM member GROUP BY ALL)
SELECT grp, cohort, result, n_match, n_total - n_match AS n_no_match, n_total FROM part JOIN whole USING (cohort, result)""")
def followup_cooccurrence(t):
    return cooccur.followup_cooccurrence(followed(t), "result")


_SOME = "lambda x: x IS NOT NULL"
_ALL_SQL = f"""{_CO}, d AS (SELECT *, code || '1' AS result_detail, CAST(trunc(value * 2) AS INTEGER) AS age, if(value % 2 = 0, 'male', 'female') AS gender FROM flagged),
ins AS (SELECT patient, time, arg_max(result, obs_id) AS r FROM d GROUP BY ALL),
ahead AS (SELECT patient, time, lead(r) OVER w AS next_result, lead(time) OVER w AS nt FROM ins WINDOW w AS (PARTITION BY patient ORDER BY time)),
e AS (SELECT d.*, next_result, nt IS NOT NULL AS there, (epoch_us(nt) - epoch_us(time)) / 3.6e9 AS h FROM d LEFT JOIN ahead USING (patient, time)),
m AS (SELECT e.*, unnest(list_filter(['', if(age >= 18, 'adults', NULL), if(age < 18, 'children', NULL), if(gender = 'female', 'female', NULL), if(gender = 'male', 'male', NULL)], {_SOME})) AS sub FROM e),
r AS (SELECT *, 'result' AS kind, result AS rc FROM m UNION ALL SELECT *, 'result_detail', result_detail FROM m WHERE sub = ''),
med AS (SELECT kind, rc, sub, g1, g2, unnest(list_filter(['all', if(enc_class <> 'AMB', 'without_AMB', NULL), if(first = 1, 'only_first', NULL), if(first = 1 AND alone_med = 1, 'first_alone', NULL)], {_SOME})) AS cohort
 FROM r WHERE time >= TIMESTAMP '1996-02-01' AND time < TIMESTAMP '2000-06-01'),
nxt AS (SELECT kind, rc, sub, there, h, next_result, unnest(list_filter(['5days_all', '2hours_all', '48hours_all', if(first = 1, 'only_first_5d', NULL)], {_SOME})) AS cohort FROM r),
shown AS (SELECT *, 'next_' || if(NOT there OR h > CASE cohort WHEN '2hours_all' THEN 2 WHEN '48hours_all' THEN 48 ELSE 120 END, 'no', if(next_result IN ('H', 'N', 'L'), next_result, NULL)) AS grp FROM nxt),
found AS (SELECT 'medication ' AS source, kind, rc, sub, cohort, unnest(['g1', 'g2']) AS grp, unnest([sum(g1), sum(g2)])::BIGINT AS hit, count(*) AS n FROM med GROUP BY kind, rc, sub, cohort
 UNION ALL SELECT 'next_measurement ', kind, rc, sub, cohort, grp, count(*), sum(count(*)) OVER (PARTITION BY kind, rc, sub, cohort)::BIGINT FROM shown GROUP BY kind, rc, sub, cohort, grp)
SELECT grp, cohort, rc AS result_class, if(low, '<5', hit::VARCHAR) AS n_match, if(low, '<5', (n - hit)::VARCHAR) AS n_no_match, if(low, NULL, n::VARCHAR) AS n_total, source || kind || if(sub = '', '', ' ' || sub) AS source
FROM (SELECT *, hit BETWEEN 1 AND 4 OR n - hit BETWEEN 1 AND 4 AS low FROM found)"""


@query("cooccurrence_all", _ALL_SQL)
def cooccurrence_all(t):
    rows = flagged(t).withColumns({"result_detail": F.concat("code", F.lit("1")), "age": (F.col("value") * 2).cast("int"),
                                   "gender": F.when(F.col("value") % 2 == 0, "male").otherwise("female")})
    rows = windows.next_event(rows, "patient", "time", "obs_id", {"result": "result"})
    rows = rows.withColumn("same_encounter", F.lit(0))
    return cooccur.cooccurrence_all(rows, {"medication": ["g1", "g2"]}, {"medication": (datetime(1996, 2, 1), datetime(2000, 6, 1))})
