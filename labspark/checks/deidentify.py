"""De-identification rules as columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from labspark.checks.registry import query
from labspark.functions import privacy as p
from labspark.sources.fixtures import cte

KEY = "not-a-secret"


@query("hash_ids", cte("fx_line") + f"""
SELECT obs_id, value, substr(sha256('{KEY}' || CAST(obs_id AS VARCHAR)), 1, 32) AS id_hash, 'Encounter/' || substr(sha256('{KEY}' || encounter), 1, 32) AS ref_hash FROM fx_line""")
def hash_ids(t):
    return t.fx_line.select("obs_id", "value", p.hash_id("obs_id", KEY).alias("id_hash"), p.hash_id("encounter", KEY).alias("ref_hash"))


@query("generalize_postcode", "SELECT c_custkey, substr(right(c_name, 5), 1, 2) AS area FROM customer")
def generalize_postcode(t):
    return t.customer.select("c_custkey", p.postcode_area(F.right("c_name", F.lit(5))).alias("area"))


@query("generalize_birthdate", cte("fx_patients") + r"SELECT pat_id, regexp_replace(birth_raw, '(\d{2,4})-(\d{2})-(\d{2})\b', '\1-\2') AS birth FROM fx_patients")
def generalize_birthdate(t):
    return t.fx_patients.select("pat_id", p.birth_month("birth_raw").alias("birth"))


@query("redact_columns", "SELECT c_custkey, c_nationkey, CAST(NULL AS VARCHAR) AS c_mktsegment FROM customer")
def redact_columns(t):
    return p.redact(p.redact(t.customer, ["c_name", "c_acctbal", "c_phone"]), ["c_mktsegment"], blank=True)


@query("mask_identifiers", cte("fx_med") + "SELECT adm_id, CASE WHEN code IS NOT NULL THEN 'masked' END AS code FROM fx_med")
def mask_identifiers(t):
    return t.fx_med.select("adm_id", p.mask("code").alias("code"))


@query("pseudonymize_domain", f"""
SELECT c_custkey, substr(sha256('{KEY}|encounter|' || c_name), 1, 32) AS enc_pseudonym, substr(sha256('{KEY}|patient|' || c_name), 1, 32) AS pat_pseudonym FROM customer""")
def pseudonymize_domain(t):
    return t.customer.select("c_custkey", p.pseudonym("c_name", "encounter", KEY).alias("enc_pseudonym"), p.pseudonym("c_name", "patient", KEY).alias("pat_pseudonym"))
