"""Tables that many results read are stored, and columns that no result needs are not read."""

from datetime import datetime

from pyspark.sql import functions as F

from labspark.operators import intervals, quality as q
from labspark.operators.seek import Source, lookup
from labspark.session import materialize, stored

T0 = datetime(2020, 1, 1)


def test_sides_of_a_match_are_stored(spark):
    base = spark.createDataFrame([("p", T0, "a", "A"), ("p", T0, "a", "A"), (None, T0, "b", "A"), ("q", T0, "c", "A")], "patient string, time timestamp_ntz, obs_id string, code string")
    quality = spark.createDataFrame([("p", T0, "x", "N"), ("p", T0, "y", "N"), ("r", T0, "z", "N")], "patient string, time timestamp_ntz, obs_id string, code string")
    match = q.sides_by_time(base, quality)
    assert stored(match.main) and stored(match.quality)
    assert [tuple(r) for r in match.main.collect()] == [("p", T0, "a", "A")]
    assert sorted(r.quality_obs_id for r in match.quality.collect()) == ["x", "y"]


def test_unused_columns_are_not_read(spark):
    rows = spark.range(40).select("id", F.when(F.col("id") % 3 > 0, F.lit("p")).alias("patient"), F.lit(T0).alias("time"), F.col("id").cast("string").alias("unused"))
    rows = materialize(rows, "rows")
    encounters = spark.createDataFrame([("e", "p", T0, T0, "IMP")], "enc_id string, patient string, period_start timestamp_ntz, period_end timestamp_ntz, class string")
    placed = intervals.assign_interval(rows, encounters)
    found = lookup(rows, "patient", "time", Source(encounters, "period_start", {"last": F.col("period_start")}))
    assert "unused" not in placed.select("id", "enc_id")._jdf.queryExecution().executedPlan().toString()
    for df, name in ((placed, "enc_id"), (found, "last")):
        assert {r["id"] for r in df.collect() if r[name] is not None} == {i for i in range(40) if i % 3}
        assert df.count() == 40
