"""Regressions and their model checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from labspark.checks.composites import STUDY, WIDE, regression_table
from labspark.checks.registry import query, rounded
from labspark.checks.scalars import AGED, aged
from labspark.operators import regress
from labspark.plans import covariates
from labspark.sources.fixtures import cte


def sql_ols(base: str, xs: dict[str, str], y: str, source: str, cluster: str | None = None, p: str = "q") -> tuple[str, str]:
    """CTEs and a SELECT for least squares of ``y`` on ``xs`` over the query ``base``, by sweeping the cross products."""
    names = list(xs)
    n = len(names)
    cols = ", ".join(f"CAST({e} AS DOUBLE) AS x{i}" for i, e in enumerate(xs.values()))
    at = {i: f"x{i}" for i in range(n)}
    at[n] = "y"
    extra = f", {cluster} AS cl" if cluster else ""
    parts = [f"{p}d AS MATERIALIZED (SELECT {cols}, CAST({y} AS DOUBLE) AS y{extra} FROM ({base}) b)",
             f"{p}m0 AS MATERIALIZED (" + " UNION ALL ".join(
                 f"SELECT {i} AS i, {j} AS j, sum({at[i]} * {at[j]}) AS v FROM {p}d" for i in range(n + 1) for j in range(n + 1)) + ")"]
    for k in range(n):
        parts.append(f"""{p}m{k + 1} AS MATERIALIZED (SELECT a.i, a.j, CASE WHEN a.i = {k} AND a.j = {k} THEN -1 / d.v WHEN a.i = {k} OR a.j = {k} THEN a.v / d.v
 ELSE a.v - r.v * c.v / d.v END AS v FROM {p}m{k} a JOIN {p}m{k} r ON r.i = a.i AND r.j = {k} JOIN {p}m{k} c ON c.i = {k} AND c.j = a.j JOIN {p}m{k} d ON d.i = {k} AND d.j = {k})""")
    parts.append(f"{p}n AS MATERIALIZED (SELECT count(*) AS n FROM {p}d)")
    parts.append(f"""{p}c AS MATERIALIZED (SELECT b.i, b.v AS estimate, sqrt(-s.v * rss.v / (n.n - {n})) AS se, n.n FROM {p}m{n} b JOIN {p}m{n} s ON s.i = b.i AND s.j = b.i
 JOIN {p}m{n} rss ON rss.i = {n} AND rss.j = {n}, {p}n n WHERE b.j = {n} AND b.i < {n})""")
    term = "CASE i " + " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(names)) + " END"
    if not cluster:
        return ",\n".join(parts), f"""SELECT {term} AS term, '{source}' AS source, round(estimate, 6) AS estimate, round(se, 6) AS std_error, round(estimate / se, 4) AS t_value, n AS n_used,
 CAST(NULL AS DOUBLE) AS deff, CAST(NULL AS DOUBLE) AS icc, CAST(NULL AS BIGINT) AS n_clusters FROM {p}c"""
    fit = " + ".join(f"(SELECT estimate FROM {p}c WHERE i = {i}) * x{i}" for i in range(n))
    parts.append(f"{p}e AS MATERIALIZED (SELECT cl, y - ({fit}) AS e FROM {p}d)")
    parts.append(_deff(f"{p}e", p))
    return ",\n".join(parts), f"""SELECT {term} AS term, '{source}' AS source, round(estimate, 6) AS estimate, round(se * sqrt(f.deff), 6) AS std_error, round(estimate / (se * sqrt(f.deff)), 4) AS t_value,
 {p}c.n AS n_used, round(f.deff, 6) AS deff, round(f.icc, 6) AS icc, f.k AS n_clusters FROM {p}c, {p}f f"""


def _deff(table, p):
    return f"""{p}g AS (SELECT cl, count(*) AS n, sum(e) AS s, sum(e * e) AS q FROM {table} GROUP BY cl),
{p}t AS (SELECT sum(q) AS sst, sum(s * s / n) AS ssb, CAST(sum(n) AS BIGINT) AS n, count(*) AS k FROM {p}g),
{p}v AS (SELECT *, ssb / (k - 1) AS msb, (sst - ssb) / (n - k) AS msw, n / k AS nb FROM {p}t),
{p}r AS (SELECT *, CASE WHEN msb + (nb - 1) * msw > 0 THEN greatest(0, least(1, (msb - msw) / (msb + (nb - 1) * msw))) ELSE 0 END AS icc FROM {p}v),
{p}f AS MATERIALIZED (SELECT *, 1 + (nb - 1) * icc AS deff FROM {p}r)"""


def _checked(fit):
    """The columns of a fit that plain SQL can state too (all but the p-value)."""
    out = fit.select("term", "source", "estimate", "std_error", "t_value", "n_used", "deff", "icc", "n_clusters")
    return rounded(rounded(out, "estimate", "std_error", "deff", "icc"), "t_value", digits=4)


_KNOWN = cte("fx_obs", "fx_patients") + AGED + """, known AS (SELECT *, age - avg(age) OVER () AS age_c, CASE WHEN k % 3 = 0 THEN 1 ELSE 0 END AS flag1, CASE WHEN k % 5 = 0 THEN 1 ELSE 0 END AS flag2
 FROM aged WHERE gender IN ('male', 'female') AND age IS NOT NULL)
"""
_X = {"(Intercept)": "1", "genderfemale": "CASE WHEN gender = 'female' THEN 1 ELSE 0 END", "age": "age_c"}


def known(t):
    k = F.col("k")
    rows = aged(t).filter(F.col("gender").isin("male", "female") & F.col("age").isNotNull())
    return rows.withColumns({"flag1": (k % 3 == 0).cast("int"), "flag2": (k % 5 == 0).cast("int")})


_FIT = sql_ols("SELECT * FROM known", {**_X, "flag1": "flag1", "flag2": "flag2"}, "value", "fit")


@query("ols_fit", _KNOWN + f", {_FIT[0]}\n{_FIT[1]}")
def ols_fit(t):
    return _checked(regress.ols(known(t), regress.Model("fit", "value", ("flag1", "flag2"), covariates.GENDER, "age")))


_CFIT = sql_ols("SELECT * FROM known", {**_X, "flag1": "flag1"}, "value", "fit_all", "CAST(patient AS VARCHAR) || '_imp'")


@query("ols_fit_clustered", _KNOWN + f", {_CFIT[0]}\n{_CFIT[1]}")
def ols_fit_clustered(t):
    cluster = F.concat(F.col("patient").cast("string"), F.lit("_imp"))
    return _checked(regress.ols(known(t), regress.Model("fit_all", "value", ("flag1",), covariates.GENDER, "age", cluster)))


@query("ols_p_values", None)
def ols_p_values(t):
    return regress.ols(known(t), regress.Model("fit", "value", ("flag1", "flag2"), covariates.GENDER, "age"))


@query("factor_dummies", cte("fx_obs") + """
SELECT obs_id, CASE WHEN code NOT IN ('view', 'click', 'error') THEN NULL WHEN code = 'click' THEN 1.0::DOUBLE ELSE 0.0 END AS codeclick,
 CASE WHEN code NOT IN ('view', 'click', 'error') THEN NULL WHEN code = 'error' THEN 1.0::DOUBLE ELSE 0.0 END AS codeerror FROM fx_obs""")
def factor_dummies(t):
    return t.fx_obs.select("obs_id", *[c.alias(n) for n, c in regress.factor_dummies("code", ("view", "click", "error")).items()])


_CHECK = cte("fx_obs") + """, f AS (SELECT *, CASE WHEN k = 0 THEN 1 ELSE 0 END AS rare, CASE WHEN k % 2 = 0 THEN 1 ELSE 0 END AS often, 0 AS never,
 CASE WHEN k % 3 = 0 THEN value END AS x, CASE WHEN k % 3 = 1 THEN 7.0::DOUBLE END AS same, CASE WHEN obs_id < 3 THEN value END AS few FROM fx_obs)
"""


def _flags(t):
    k, v = F.col("k"), F.col("value")
    return t.fx_obs.withColumns({"rare": (k == 0).cast("int"), "often": (k % 2 == 0).cast("int"), "never": F.lit(0), "x": F.when(k % 3 == 0, v),
                                 "same": F.when(k % 3 == 1, 7.0), "few": F.when(F.col("obs_id") < 3, v)})


@query("valid_covariates", _CHECK + "SELECT column_name, valid FROM (" + " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, CASE WHEN count(DISTINCT {c}) = 2 AND least(sum(CASE WHEN {c} = 0 THEN 1 ELSE 0 END), sum(CASE WHEN {c} = 1 THEN 1 ELSE 0 END)) >= 110 THEN 1 ELSE 0 END AS valid FROM f"
    for c in ("rare", "often", "never")) + " UNION ALL " + " UNION ALL ".join(
    f"SELECT '{c}', CASE WHEN count({c}) >= 5 AND count(DISTINCT {c}) > 1 AND stddev({c}) <> 0 THEN 1 ELSE 0 END FROM f WHERE {c} IS NOT NULL" for c in ("x", "same", "few")) + ")")
def valid_covariates(t):
    rows = _flags(t)
    flags, numbers = ["rare", "often", "never"], ["x", "same", "few"]
    ok = set(regress.valid_covariates(rows, flags, 110)) | set(regress.valid_covariates(rows, numbers, 5, continuous=True))
    return t.spark.createDataFrame([(c, int(c in ok)) for c in flags + numbers], "column_name string, valid int")


@query("covariate_checks", _CHECK + " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(*) FILTER (WHERE {c} = 0) AS n_zero, count(*) FILTER (WHERE {c} = 1) AS n_one, count(DISTINCT {c}) > 1 AS varies FROM f" for c in ("rare", "often", "never")))
def covariate_checks(t):
    return regress.covariate_checks(_flags(t), ["rare", "often", "never"])


@query("valid_factor_levels", cte("fx_obs") + """
SELECT count(*) AS n_levels, min(n) AS min_rows, CASE WHEN count(*) >= 2 AND min(n) >= 5 THEN 1 ELSE 0 END AS valid FROM (SELECT comparator, count(*) AS n FROM fx_obs GROUP BY comparator)""")
def valid_factor_levels(t):
    return regress.level_check(t.fx_obs, "comparator")


@query("cluster_design_effect", cte("fx_obs") + ", e AS (SELECT patient AS cl, value - avg(value) OVER (PARTITION BY code) AS e FROM fx_obs),\n" + _deff("e", "q") + """
SELECT n, k AS n_clusters, round(icc, 8) AS icc, round(deff, 8) AS deff, k - 1 AS df FROM qf""")
def cluster_design_effect(t):
    mean = t.fx_obs.groupBy("code").agg(F.avg("value").alias("m"))
    rows = t.fx_obs.join(mean, "code").withColumn("e", F.col("value") - F.col("m"))
    return rounded(regress.design_effect(rows, "e", "patient").drop("sst"), digits=8)


@query("regression_exclusions", WIDE + """
SELECT count(*) FILTER (WHERE gender NOT IN ('male', 'female')) AS n_gender_unknown, count(*) FILTER (WHERE age IS NULL) AS n_age_null,
 count(*) FILTER (WHERE next_flag = 1 AND next_hours <= 120) AS n_valid, count(*) FILTER (WHERE next_flag = 0) AS n_no_next, count(*) FILTER (WHERE next_flag = 1 AND next_hours > 120) AS n_next_too_late FROM wide""")
def regression_exclusions(t):
    return regress.exclusions(regression_table(t)[0])



_RES = {"resultL": "CASE WHEN result = 'L' THEN 1 ELSE 0 END", "resultH": "CASE WHEN result = 'H' THEN 1 ELSE 0 END"}
_IN_TIME = "next_flag = 1 AND next_hours <= 120"
_OCCURRED = f"CASE WHEN {_IN_TIME} THEN 1 ELSE 0 END"


def _followup_sql(where, y, source, p):
    """A model on rows of the covariate table, left out unless every level has at least 5 rows."""
    base = f"SELECT *, {y} AS outcome FROM wide WHERE gender IN ('male', 'female') AND age IS NOT NULL AND {where}"
    ctes, select = sql_ols(f"SELECT *, age - avg(age) OVER () AS age_c FROM ({base}) r", {**_X, **_RES}, "outcome", source, p=p)
    levels = ["gender", "result"] + ([] if y == "next_hours" else ["outcome"])
    valid = " AND ".join(f"(SELECT count(*) >= 2 AND min(n) >= 5 FROM (SELECT {c}, count(*) AS n FROM ({base}) r GROUP BY {c}))" for c in levels)
    return ctes, f"{select} WHERE {valid}"


_FOLLOWUP = [_followup_sql(_IN_TIME, "next_hours", "next_k_timing_categorical_all", "a"), _followup_sql("TRUE", _OCCURRED, "next_k_occurred_all", "b"),
             _followup_sql("first = 1", _OCCURRED, "next_k_occurred_only_first", "c"),
             _followup_sql(f"({_IN_TIME}) AND first = 1", "next_hours", "next_k_timing_categorical_only_first", "d")]


@query("followup_regressions", WIDE + ", " + ", ".join(c for c, _ in _FOLLOWUP) + "\n" + " UNION ALL ".join(q for _, q in _FOLLOWUP))
def followup_regressions(t):
    table, _ = regression_table(t)
    return _checked(covariates.fitted(table, covariates.followup_models(STUDY), STUDY))


@query("covariate_regressions", None)
def covariate_regressions(t):
    table, windows = regression_table(t)
    return covariates.fitted(table, covariates.covariate_models(windows, STUDY), STUDY)


@query("after_outcome_regressions", None)
def after_outcome_regressions(t):
    table, windows = regression_table(t)
    return covariates.fitted(table, covariates.outcome_models(windows, STUDY), STUDY)
