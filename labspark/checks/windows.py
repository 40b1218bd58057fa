"""Window functions, ordering and set operations."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from labspark.checks.joins import ASSIGNED, assigned
from labspark.checks.registry import query, rounded
from labspark.functions.columns import join_nullsafe
from labspark.operators import clean, describe, resolve
from labspark.operators.quantiles import percentiles
from labspark.sources.fixtures import cte


@query("win_row_number", cte("fx_enc") + "SELECT patient, enc_id, class FROM (SELECT *, row_number() OVER (PARTITION BY patient ORDER BY period_start, enc_id) AS rn FROM fx_enc) WHERE rn = 1")
def win_row_number(t):
    first = t.fx_enc.groupBy("patient").agg(F.min_by(F.struct("enc_id", "class"), F.struct("period_start", "enc_id")).alias("f"))
    return first.select("patient", "f.enc_id", "f.class")


@query("win_partition_agg", cte("fx_obs", "fx_dup_obs") + """
SELECT obs_id, max(issued) OVER w AS max_issued, count(*) OVER w AS n_dup, round(median(value) OVER (PARTITION BY code), 6) AS med
FROM fx_dup_obs WINDOW w AS (PARTITION BY patient, time, code)""")
def win_partition_agg(t):
    d, keys = t.fx_dup_obs, ["patient", "time", "code"]
    groups = d.groupBy(*keys).agg(F.max("issued").alias("max_issued"), F.count(F.lit(1)).alias("n_dup"))
    out = join_nullsafe(join_nullsafe(d, groups, keys), percentiles(d, "code", "value", {"med": 0.5}), "code")
    return rounded(out.select("obs_id", "max_issued", "n_dup", "med"))


@query("win_filtered_count", cte("fx_obs", "fx_dup_obs") + """
SELECT obs_id, count(*) FILTER (WHERE issued = mx) OVER (PARTITION BY patient, time, code) AS n_max
FROM (SELECT *, max(issued) OVER (PARTITION BY patient, time, code) AS mx FROM fx_dup_obs)""")
def win_filtered_count(t):
    keys = ["patient", "time", "code"]
    g = clean._repeat_groups(t.fx_dup_obs, keys, "issued")
    return join_nullsafe(t.fx_dup_obs, g, keys).select("obs_id", F.when(F.col("max_issued").isNull(), F.lit(0)).otherwise(F.col("n_max")).cast("bigint").alias("n_max"))


@query("win_over_agg", cte("fx_obs") + """
SELECT code, unit, count(*) AS n, CAST(sum(count(*)) OVER (PARTITION BY code) - count(*) AS BIGINT) AS n_other FROM fx_obs GROUP BY code, unit""")
def win_over_agg(t):
    g = clean.counts(t.fx_obs, "code", "unit")
    return g.withColumn("n_other", F.sum("n").over(Window.partitionBy("code")) - F.col("n"))


@query("win_qualify", cte("fx_obs", "fx_dup_obs") + "SELECT obs_id FROM fx_dup_obs QUALIFY count(*) OVER (PARTITION BY patient, time, code) >= 2")
def win_qualify(t):
    keys = ["patient", "time", "code"]
    many = t.fx_dup_obs.groupBy(*keys).count().filter("count >= 2").drop("count")
    return join_nullsafe(t.fx_dup_obs, many, keys, "left_semi").select("obs_id")


@query("order_by_report", cte("fx_obs") + "SELECT code, unit, count(*) AS n FROM fx_obs GROUP BY code, unit ORDER BY n DESC, code, unit")
def order_by_report(t):
    return clean.counts(t.fx_obs, "code", "unit").orderBy(F.desc("n"), "code", F.asc_nulls_last("unit"))


@query("limit0_schema", "SELECT column_name FROM (DESCRIBE SELECT * FROM events LIMIT 0) WHERE (SELECT count(*) FROM events) > 0")
def limit0_schema(t):
    rows = t.events.agg(F.count(F.lit(1)).alias("n"))
    return rows.filter("n > 0").select(F.explode(F.array(*[F.lit(c) for c in t.events.columns])).alias("column_name"))


@query("union_all", cte("fx_obs", "fx_line") + "SELECT obs_id, value FROM fx_obs UNION ALL SELECT obs_id, value FROM fx_line")
def union_all(t):
    return t.fx_obs.select("obs_id", "value").union(t.fx_line.select("obs_id", "value"))


@query("union_by_name", cte("fx_med", "fx_proc") + """
SELECT patient, period_start, period_end, code FROM fx_med UNION ALL BY NAME SELECT period_end, period_start, patient FROM fx_proc""")
def union_by_name(t):
    return resolve.union_sources(t.fx_med.select("patient", "period_start", "period_end", "code"), None,
                                 t.fx_proc.select("period_end", "period_start", "patient"))


@query("bind_rows", cte("fx_obs") + """
SELECT 'unit' AS source, unit, NULL AS comparator, count(*) AS n FROM fx_obs GROUP BY unit UNION ALL SELECT 'comparator', NULL, comparator, count(*) FROM fx_obs GROUP BY comparator""")
def bind_rows(t):
    return resolve.union_sources(clean.counts(t.fx_obs, "unit").withColumn("source", F.lit("unit")),
                                 clean.counts(t.fx_obs, "comparator").withColumn("source", F.lit("comparator")))


@query("encounter_class_counts", cte("fx_line", "fx_enc") + ASSIGNED + """
SELECT 'values' AS kind, enc_class AS class, count(*) AS n FROM assigned GROUP BY enc_class
UNION ALL SELECT 'open', class, count(*) FROM fx_enc WHERE class IN ('IMP', 'SS') AND period_end IS NULL GROUP BY class""")
def encounter_class_counts(t):
    values = clean.counts(assigned(t).withColumnRenamed("enc_class", "class"), "class").withColumn("kind", F.lit("values"))
    still_open = t.fx_enc.filter(F.col("class").isin("IMP", "SS") & F.col("period_end").isNull())
    return values.unionByName(clean.counts(still_open, "class").withColumn("kind", F.lit("open")))


@query("encounter_type_counts", cte("fx_enc") + """
SELECT 'all' AS kind, type, class, count(*) AS n FROM fx_enc GROUP BY type, class
UNION ALL SELECT 'open', type, class, count(*) FROM fx_enc WHERE period_end IS NULL GROUP BY type, class
UNION ALL SELECT 'start_after_end', type, class, count(*) FROM fx_enc WHERE period_start > period_end GROUP BY type, class""")
def encounter_type_counts(t):
    return describe.encounter_type_counts(t.fx_enc)
