"""Adapters that shape the driver tables like measurement, encounter and event tables.

Each adapter is one SELECT that both Spark and the SQL used for checking understand, but for two
expressions that are filled in per dialect.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from labspark.session import materialize, tasks_for

TABLES = ("customer", "orders", "lineitem", "part", "events", "documents", "labels", "pages", "benchmark",
          "conversations", "embeddings", "supplier", "nation", "region")
DIALECTS = {
    "spark": {"JSONK": "get_json_object(props, '$.k')", "DAY": "CAST(CAST(time AS DATE) AS TIMESTAMP_NTZ)"},
    "duckdb": {"JSONK": "json_extract_string(props, '$.k')", "DAY": "date_trunc('day', time)"},
}

ADAPTERS = {
    "fx_obs": """
SELECT event_id AS obs_id, user_id AS patient, ts AS time, event_type AS code, value, k,
 CASE WHEN k % 10 = 9 THEN NULL WHEN k % 10 < 6 THEN 'u1' ELSE 'u2' END AS unit,
 CASE WHEN k % 20 = 3 THEN '<' WHEN k % 20 = 7 THEN '>' WHEN k % 20 = 11 THEN '<=' END AS comparator,
 CASE WHEN k % 25 = 4 THEN NULL ELSE CAST(10 + k % 5 AS DOUBLE) END AS ref_low,
 CASE WHEN k % 25 = 8 THEN NULL ELSE CAST(60 + k % 7 AS DOUBLE) END AS ref_high,
 CASE WHEN k % 25 = 4 THEN NULL WHEN k % 13 = 0 THEN 'u2' ELSE 'u1' END AS ref_low_unit,
 CASE WHEN k % 25 = 8 THEN NULL WHEN k % 17 = 0 THEN 'u2' ELSE 'u1' END AS ref_high_unit,
 CASE WHEN k % 4 = 0 THEN NULL WHEN k % 4 = 1 THEN 'normal' ELSE 'treatment' END AS ref_type,
 CASE k % 30 WHEN 1 THEN 'cancelled' WHEN 2 THEN 'entered-in-error' WHEN 3 THEN NULL ELSE 'final' END AS status
FROM (SELECT *, CAST({JSONK} AS INT) AS k FROM events) e""",
    "fx_dup_obs": """
SELECT obs_id, patient, {DAY} AS time, code, value, unit,
 CASE WHEN k % 11 = 0 THEN NULL ELSE time END AS issued FROM fx_obs""",
    "fx_patients": """
SELECT c_custkey AS pat_id,
 CASE c_custkey % 3 WHEN 0 THEN 'female' WHEN 1 THEN 'male' ELSE 'unknown' END AS gender,
 CASE c_custkey % 7 WHEN 0 THEN NULL WHEN 1 THEN CAST(1930 + c_custkey % 80 AS STRING)
  WHEN 2 THEN concat(CAST(1930 + c_custkey % 80 AS STRING), '-03') WHEN 3 THEN concat(CAST(1930 + c_custkey % 80 AS STRING), '-02-30')
  ELSE concat(CAST(1930 + c_custkey % 80 AS STRING), '-05-17') END AS birth_raw FROM customer""",
    "fx_line": """
SELECT l_orderkey * 10 + l_linenumber AS obs_id, o_custkey AS patient, l_shipdate AS time, l_quantity AS value,
 l_returnflag AS code, CASE l_linestatus WHEN 'O' THEN 'serum' ELSE 'blood' END AS sample_type, concat('Encounter/', CAST(l_orderkey AS STRING)) AS encounter
FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "fx_enc": """
SELECT o_orderkey AS enc_id, o_custkey AS patient, o_orderdate AS period_start,
 CASE WHEN o_orderkey % 20 = 0 THEN NULL ELSE MAX(l_shipdate) END AS period_end,
 CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'IMP' WHEN o_orderpriority = '3-MEDIUM' THEN 'SS' ELSE 'AMB' END AS class,
 CASE o_orderstatus WHEN 'P' THEN NULL WHEN 'O' THEN 'main' ELSE 'sub' END AS type
FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_custkey, o_orderdate, o_orderpriority, o_orderstatus""",
    "fx_med": """
SELECT l_orderkey * 10 + l_linenumber AS adm_id, o_custkey AS patient, CASE WHEN l_linenumber % 3 = 0 THEN l_shipdate END AS effective,
 CASE WHEN l_linenumber % 3 <> 0 THEN l_shipdate END AS period_start, CASE WHEN l_linenumber % 3 = 1 THEN l_shipdate + INTERVAL '36' HOUR END AS period_end,
 concat('Medication/', CAST(l_partkey AS STRING)) AS med_ref, CASE WHEN l_linenumber % 2 = 0 THEN p_brand END AS code,
 concat('Encounter/', CAST(l_orderkey AS STRING)) AS encounter
FROM lineitem JOIN orders ON l_orderkey = o_orderkey LEFT JOIN part ON l_partkey = p_partkey""",
    "fx_medication": """
SELECT p_partkey AS med_id, CASE WHEN p_size % 4 = 0 THEN NULL ELSE p_brand END AS code,
 CASE WHEN p_size % 4 = 0 THEN concat('Medication/', CAST((p_partkey * 7) % 2500 AS STRING)) END AS med_med_ref FROM part""",
    "fx_cond": """
SELECT o_orderkey AS con_id, o_custkey AS patient, o_orderdate + INTERVAL '30' HOUR AS time,
 concat(CASE o_orderstatus WHEN 'F' THEN 'E' WHEN 'O' THEN 'N' ELSE 'R' END, CAST(10 + o_orderkey % 9 AS STRING), '.', CAST(o_orderkey % 4 AS STRING)) AS icd FROM orders""",
    "fx_proc": """
SELECT l_orderkey * 10 + l_linenumber AS pro_id, o_custkey AS patient, CASE WHEN l_linenumber = 7 THEN NULL ELSE l_shipdate END AS period_start,
 CASE WHEN l_linenumber = 5 THEN l_shipdate + INTERVAL '10' HOUR WHEN l_linenumber = 6 THEN l_shipdate END AS period_end,
 CASE WHEN l_linenumber = 7 THEN l_shipdate END AS performed FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_linenumber >= 5""",
}
# A whole study shaped like the typed extracts: every table of the input contract with text ids.
_T = "l_shipdate + INTERVAL '1' HOUR * CAST((l_partkey % 12) * 4 AS INT)"
ADAPTERS.update({
    "st_lab": f"""
SELECT concat(CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING), '-', CAST(l_partkey AS STRING), '-', CAST(l_suppkey AS STRING)) AS obs_id,
 concat(l_returnflag, l_linestatus) AS code, CASE WHEN l_suppkey % 50 = 7 THEN 'local' ELSE 'http://loinc.org' END AS code_system, l_quantity / 6 AS value,
 CASE l_suppkey % 10 WHEN 0 THEN NULL WHEN 1 THEN 'meq/L' WHEN 2 THEN 'bad' ELSE 'mmol/L' END AS unit,
 CASE l_partkey % 40 WHEN 3 THEN '<' WHEN 5 THEN ' > ' WHEN 8 THEN '>=' END AS comparator,
 CASE WHEN l_partkey % 4 = 0 THEN NULL ELSE concat('id', CAST(l_orderkey AS STRING)) END AS identifier,
 CASE WHEN l_partkey % 5 = 0 THEN 5.2 + l_partkey % 3 END AS ref_high, CASE WHEN l_partkey % 3 = 0 THEN 3.1 ELSE NULL END AS ref_low,
 CASE WHEN l_partkey % 5 = 0 THEN 'mmol/L' END AS ref_high_unit, CASE WHEN l_partkey % 3 = 0 THEN 'mmol/L' END AS ref_low_unit,
 CASE WHEN l_partkey % 2 = 0 THEN 'normal' END AS ref_type, {_T} AS time, {_T} + INTERVAL '1' HOUR * CAST(l_linenumber % 3 AS INT) AS issued,
 concat('Patient/', CAST(o_custkey AS STRING)) AS patient, CASE l_partkey % 60 WHEN 1 THEN 'cancelled' WHEN 2 THEN NULL ELSE 'final' END AS status,
 CASE WHEN l_partkey % 9 = 0 THEN 'H' END AS interpretation, CASE WHEN l_partkey % 11 = 0 THEN concat('c', CAST(l_partkey % 3 AS STRING)) END AS value_code,
 CASE WHEN l_partkey % 11 = 0 THEN 'sys' END AS value_code_system, CASE WHEN l_partkey % 3 > 0 THEN concat('Specimen/', CAST(l_suppkey AS STRING)) END AS specimen_ref,
 concat('Encounter/', CAST(l_orderkey AS STRING)) AS encounter, CASE WHEN l_partkey % 13 = 0 THEN concat('sample ', p_name, ' hämolytisch') ELSE p_name END AS note,
 concat('ServiceRequest/', CAST(l_orderkey AS STRING)) AS basedon, CASE WHEN l_partkey % 7 = 0 THEN p_brand END AS method_code,
 CASE WHEN l_partkey % 7 = 0 THEN 'm' END AS method_system
FROM lineitem JOIN orders ON l_orderkey = o_orderkey LEFT JOIN part ON l_partkey = p_partkey""",
    "st_patients": "SELECT CAST(pat_id AS STRING) AS pat_id, birth_raw, gender FROM fx_patients",
    "st_enc": """
SELECT CAST(enc_id AS STRING) AS enc_id, concat('Patient/', CAST(patient AS STRING)) AS patient, class, period_start, period_end, type,
 CASE WHEN enc_id % 9 = 0 THEN NULL WHEN enc_id % 31 = 0 THEN 'other' ELSE 'http://fhir.de/CodeSystem/Kontaktebene' END AS type_system,
 CASE WHEN enc_id % 37 = 0 THEN 'planned' ELSE 'finished' END AS status FROM fx_enc""",
    "st_med_coded": """
SELECT CAST(adm_id AS STRING) AS adm_id, concat('Patient/', CAST(patient AS STRING)) AS patient, CASE WHEN adm_id % 41 = 0 THEN 'stopped' END AS status,
 period_start, period_end, effective, encounter, code FROM fx_med WHERE code IS NOT NULL""",
    "st_med_one": """
SELECT CAST(adm_id AS STRING) AS adm_id, concat('Patient/', CAST(patient AS STRING)) AS patient, CASE WHEN adm_id % 41 = 0 THEN 'stopped' END AS status,
 period_start, period_end, effective, encounter, med_ref FROM fx_med WHERE code IS NULL AND adm_id % 3 = 0""",
    "st_med_two": """
SELECT CAST(adm_id AS STRING) AS adm_id, concat('Patient/', CAST(patient AS STRING)) AS patient, CASE WHEN adm_id % 41 = 0 THEN 'stopped' END AS status,
 period_start, period_end, effective, encounter, med_ref FROM fx_med WHERE code IS NULL AND adm_id % 3 > 0""",
    "st_medication": "SELECT CAST(med_id AS STRING) AS med_id, code, med_med_ref FROM fx_medication",
    "st_proc": """
SELECT CAST(pro_id AS STRING) AS pro_id, concat('Patient/', CAST(patient AS STRING)) AS patient, CASE WHEN pro_id % 43 = 0 THEN 'not-done' END AS status,
 CASE pro_id % 4 WHEN 0 THEN '8-854.2' WHEN 1 THEN '5-123' WHEN 2 THEN '8-857.1' END AS ops, CASE WHEN pro_id % 3 = 0 THEN '302497006' END AS snomed,
 period_start, period_end, performed, concat('Encounter/', CAST(pro_id AS STRING)) AS encounter FROM fx_proc""",
    # periods only: the point in time is NULL of its type
    "st_proc_icu": """
SELECT concat('icu', CAST(pro_id AS STRING)) AS pro_id, concat('Patient/', CAST(patient AS STRING)) AS patient, CASE WHEN pro_id % 13 = 0 THEN 'on-hold' WHEN pro_id % 5 = 0 THEN 'completed' END AS status,
 CASE pro_id % 5 WHEN 0 THEN '8-855.1' WHEN 1 THEN '8-98f' WHEN 2 THEN '8-853' END AS ops, CASE WHEN pro_id % 4 = 1 THEN '302497006' END AS snomed,
 period_start, period_end, nullif(period_start, period_start) AS performed, concat('Encounter/', CAST(pro_id AS STRING)) AS encounter FROM fx_proc""",
    "st_device": """
SELECT CAST(pro_id AS STRING) AS pro_id, performed, concat('Patient/', CAST(patient AS STRING)) AS patient, CASE WHEN pro_id % 47 = 0 THEN 'preliminary' END AS status,
 period_start, period_end, concat('Encounter/', CAST(pro_id AS STRING)) AS encounter FROM fx_proc WHERE pro_id % 5 = 0""",
    "st_cond": """
SELECT CAST(con_id AS STRING) AS con_id, concat('Patient/', CAST(patient AS STRING)) AS patient, CASE WHEN con_id % 29 = 0 THEN 'remission' END AS status,
 CASE WHEN con_id % 17 = 0 THEN 'refuted' ELSE 'confirmed' END AS verification, icd, time, concat('Encounter/', CAST(con_id AS STRING)) AS encounter FROM fx_cond""",
    "st_specimens": """
SELECT CAST(s_suppkey AS STRING) AS spec_id, 'p' AS patient, CASE WHEN s_nationkey % 2 = 0 THEN 'blood' END AS type,
 CASE WHEN s_nationkey % 5 = 0 THEN 'lysed' END AS condition, 'sct' AS condition_system FROM supplier WHERE s_suppkey % 4 > 0""",
})
BASES = {"fx_obs": ("events",), "fx_dup_obs": ("fx_obs",), "fx_patients": ("customer",), "fx_line": ("lineitem", "orders"),
         "fx_enc": ("orders", "lineitem"), "fx_med": ("lineitem", "orders", "part"), "fx_medication": ("part",),
         "fx_cond": ("orders",), "fx_proc": ("lineitem", "orders"),
         "st_lab": ("lineitem", "orders", "part"), "st_patients": ("fx_patients",), "st_enc": ("fx_enc",), "st_med_coded": ("fx_med",),
         "st_med_one": ("fx_med",), "st_med_two": ("fx_med",), "st_medication": ("fx_medication",), "st_proc": ("fx_proc",), "st_proc_icu": ("fx_proc",),
         "st_device": ("fx_proc",), "st_cond": ("fx_cond",), "st_specimens": ("supplier",)}
SHARED = ("fx_med",)  # joins that a study reads for several of its tables
JOINED = {"lineitem": "l_orderkey", "orders": "o_orderkey"}  # the columns that the adapters join these tables by

UNIT_ROWS = [("click", "u1", "u1", 1.0), ("click", "u2", "u1", 18.02), ("view", "u1", "u1", 1.0), ("view", "u2", "invalid", None)]
PREFIX_GROUPS = {"g1": ("Brand#1",), "g2": ("Brand#2", "Brand#3")}
CONDITION_PREFIXES = {"c1": ("E1",), "c2": ("E11", "N12")}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def dealt(bases: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """``bases`` with the tables of JOINED dealt by the columns of their join, where these have more rows than all cores sort at once.

    Adaptive execution merges the partitions of a join by their compressed size, and few narrow columns compress so well
    that a task would sort many million rows."""
    if not JOINED.keys() <= bases.keys():
        return bases
    parts = max(tasks_for(bases[b], bases[b].count()) for b in JOINED)
    if parts <= bases["orders"].sparkSession.sparkContext.defaultParallelism:
        return bases
    return {b: d.repartition(parts, JOINED[b]) if b in JOINED else d for b, d in bases.items()}


def load(spark: SparkSession, sf_dir: str, name: str, shared: dict[str, DataFrame] | None = None) -> DataFrame:
    """A driver table or an adapter over driver tables. ``shared`` keeps the tables of SHARED, stored once, for further adapters."""
    if name in TABLES:
        return table(spark, sf_dir, name)
    text = ADAPTERS[name].format(**DIALECTS["spark"])

    def base(b):
        if shared is None or b not in SHARED:
            return load(spark, sf_dir, b, shared)
        if b not in shared:
            shared[b] = materialize(load(spark, sf_dir, b), b)
        return shared[b]

    bases = dealt({b: base(b) for b in BASES[name]})
    for b in bases:  # name each base table as a parameter of the statement
        text = re.sub(rf"\b(FROM|JOIN) {b}\b", rf"\1 {{{b}}}", text)
    return spark.sql(text, **bases)


def units(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(UNIT_ROWS, "label string, source_unit string, target_unit string, factor double")


def cte(*names: str, extra: dict[str, str] | None = None) -> str:
    """WITH clause for the checking SQL that defines the adapters and further named queries."""
    done: dict[str, str] = {}

    def add(name):
        for b in BASES[name]:
            if b in ADAPTERS and b not in done:
                add(b)
        done[name] = ADAPTERS[name].format(**DIALECTS["duckdb"]).strip()

    for n in names:
        if n == "fx_units":
            done[n] = ("SELECT * FROM (VALUES ('click','u1','u1',CAST(1.0 AS DOUBLE)), ('click','u2','u1',18.02), "
                       "('view','u1','u1',1.0), ('view','u2','invalid',NULL)) t(label, source_unit, target_unit, factor)")
        elif n not in done:
            add(n)
    done.update(extra or {})
    return "WITH " + ",\n".join(f"{n} AS ({q})" for n, q in done.items()) + "\n"
