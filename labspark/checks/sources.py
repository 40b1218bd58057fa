"""Scans, contracts and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from labspark.checks.registry import query
from labspark.operators import clean, describe
from labspark.session import scratch_path
from labspark.sources import tables as src
from labspark.sources.fixtures import cte

_EVENT_FIELDS = (src.Field("obs_id", "event_id", "bigint"), src.Field("time", "ts", src.TS), src.Field("code", "event_type"),
                 src.Field("value", "value", "double"), src.Field("props", "props"),
                 src.Field("issued", "issued", src.TS, False))


def _as_csv(df, name):
    path = scratch_path(df.sparkSession, name)
    (df.write.option("header", True).option("escape", '"')
     .option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").csv(path))
    return path


@query("scan_csv_typed", "SELECT event_id AS obs_id, ts AS time, event_type AS code, value, props FROM events")
def scan_csv_typed(t):
    path = _as_csv(t.events, "events-csv")
    return src.read_source(t.spark, path, _EVENT_FIELDS).drop("issued")


@query("scan_csv_strings", "SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, CAST(c_nationkey AS VARCHAR) AS c_nationkey, c_mktsegment, CAST(c_acctbal AS VARCHAR) AS c_acctbal FROM customer")
def scan_csv_strings(t):
    return src.read_strings(t.spark, _as_csv(t.customer, "customer-csv"))


@query("type_overrides", "SELECT o_orderkey AS id, o_totalprice AS price, o_orderdate AS time, o_orderstatus AS status FROM orders")
def type_overrides(t):
    text = t.orders.select(*[F.col(c).cast("string").alias(c) for c in t.orders.columns])
    return src.typed(text, (src.Field("id", "o_orderkey", "bigint"), src.Field("price", "o_totalprice", "double"),
                            src.Field("time", "o_orderdate", src.TS), src.Field("status", "o_orderstatus")))


@query("optional_column", "SELECT event_id AS obs_id, CAST(NULL AS TIMESTAMP) AS issued, event_type AS code FROM events")
def optional_column(t):
    return src.typed(t.events, _EVENT_FIELDS).select("obs_id", "issued", "code")


@query("check_required_columns", """
SELECT 'events' AS source, 'Observation_status' AS missing, count(*) AS n_rows FROM events
UNION ALL SELECT 'events', 'issued', count(*) FROM events
UNION ALL SELECT 'orders', 'o_comment', count(*) FROM orders""")
def check_required_columns(t):
    contracts = {"events": (*_EVENT_FIELDS[:5], src.Field("issued", "issued", src.TS), src.Field("status", "Observation_status")),
                 "orders": (src.Field("id", "o_orderkey"), src.Field("comment", "o_comment"))}
    frames = {"events": t.events, "orders": t.orders}
    sizes = [d.agg(F.lit(n).alias("source"), F.count(F.lit(1)).alias("n_rows")) for n, d in frames.items()]
    return src.check_columns(frames, contracts).join(sizes[0].union(sizes[1]), "source")


@query("unparseable_cells", """
SELECT 'code' AS column_name, count(*) AS n FROM events WHERE event_type IS NOT NULL
UNION ALL SELECT 'value', CAST(0 AS BIGINT)""")
def unparseable_cells(t):
    text = t.events.select(*[F.col(c).cast("string").alias(c) for c in t.events.columns])
    return src.unparseable(text, (src.Field("code", "event_type", "double"), src.Field("value", "value", "double")))


def _raw_units(t):
    """A conversion table derived from the units found in the data, with untrimmed text."""
    return t.fx_obs.filter(F.col("unit").isNotNull()).select(
        F.concat(F.lit(" "), "code").alias("label"), F.concat("unit", F.lit(" ")).alias("source_unit"),
        F.when(F.col("code") == "error", "invalid").otherwise("u1").alias("target_unit"),
        F.when(F.col("code") != "error", F.when(F.col("unit") == "u1", " 1").otherwise("18.02")).alias("factor")).distinct()


@query("load_unit_conversion", cte("fx_obs") + """
SELECT DISTINCT code AS label, unit AS source_unit, CASE WHEN code = 'error' THEN 'invalid' ELSE 'u1' END AS target_unit,
 CAST(CASE WHEN code <> 'error' THEN CASE WHEN unit = 'u1' THEN 1 ELSE 18.02 END END AS DOUBLE) AS factor
FROM fx_obs WHERE unit IS NOT NULL""")
def load_unit_conversion(t):
    return src.load_units(_raw_units(t))


@query("unit_conversion_problems", cte("fx_obs") + """, raw AS (
 SELECT DISTINCT code AS label, unit AS source_unit, CASE WHEN code = 'view' THEN unit ELSE 'u1' END AS target_unit,
  CASE code WHEN 'click' THEN 'x' WHEN 'error' THEN NULL ELSE '2' END AS factor FROM fx_obs WHERE unit IS NOT NULL
 UNION ALL SELECT DISTINCT code, 'u1', 'u1', '3' FROM fx_obs WHERE code = 'signup')
SELECT 'duplicate' AS problem, label, source_unit FROM raw GROUP BY label, source_unit HAVING count(*) > 1
UNION ALL SELECT 'non_numeric_factor', label, source_unit FROM raw WHERE factor IS NOT NULL AND TRY_CAST(factor AS DOUBLE) IS NULL
UNION ALL SELECT 'missing_factor', label, source_unit FROM raw WHERE factor IS NULL
UNION ALL SELECT 'several_targets', label, NULL FROM raw GROUP BY label HAVING count(DISTINCT target_unit) > 1""")
def unit_conversion_problems(t):
    c = F.col("code")
    rows = t.fx_obs.filter(F.col("unit").isNotNull())
    raw = rows.select(c.alias("label"), F.col("unit").alias("source_unit"),
                      F.when(c == "view", F.col("unit")).otherwise("u1").alias("target_unit"),
                      F.when(c == "click", "x").when(c == "error", None).otherwise("2").alias("factor")).distinct()
    again = rows.filter(c == "signup").select(c, F.lit("u1"), F.lit("u1"), F.lit("3")).distinct()
    return src.unit_problems(src.clean_units(raw.union(again)))


@query("check_units", cte("fx_obs", "fx_units") + """
SELECT DISTINCT o.code AS label, o.unit, CASE WHEN u.target_unit IS NULL THEN 'missing' WHEN u.target_unit = 'invalid' THEN 'invalid' ELSE 'ok' END AS state
FROM fx_obs o LEFT JOIN fx_units u ON u.label = o.code AND u.source_unit = o.unit WHERE o.unit IS NOT NULL AND o.code IS NOT NULL""")
def check_units(t):
    return src.unit_usage(t.fx_obs.withColumnRenamed("code", "label"), t.fx_units)


@query("write_csv_results", "SELECT event_type AS code, count(*) AS n FROM events GROUP BY event_type")
def write_csv_results(t):
    path = scratch_path(t.spark, "result-csv")
    src.write_result(clean.counts(t.fx_obs, "code"), path, order=["code"])
    return src.read_strings(t.spark, path).select("code", F.col("n").cast("bigint").alias("n"))


@query("qc_report", cte("fx_obs") + """, cells AS (
 SELECT 'status' AS section, COALESCE(status, 'NULL') AS keys, 'n' AS metric, count(*) AS v FROM fx_obs GROUP BY status
 UNION ALL SELECT 'comparator', code || '|' || comparator, 'n', count(*) FROM fx_obs WHERE comparator IS NOT NULL GROUP BY code, comparator
 UNION ALL SELECT 'missing', '', 'n_value_without_unit', count(*) FILTER (WHERE value IS NOT NULL AND unit IS NULL) FROM fx_obs
 UNION ALL SELECT 'missing', '', 'n_missing_value', count(*) FILTER (WHERE value IS NULL) FROM fx_obs)
SELECT section, keys, metric, CASE WHEN v <> 0 AND v < 5 THEN '<5' ELSE CAST(v AS VARCHAR) END AS value FROM cells""")
def qc_report(t):
    o = t.fx_obs
    return describe.report({
        "status": clean.counts(o, "status"),
        "comparator": clean.comparator_report(o, ("code", "comparator")),
        "missing": clean.missing_report(o)})
