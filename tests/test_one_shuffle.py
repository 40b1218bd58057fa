"""Steps that move each row once: small tables are broadcast, repeats and lookups have one shuffle, a study is built once."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from labspark.checks import composites, registry
from labspark.operators import clean, resolve
from labspark.operators.seek import Source, _both_ways, lookup
from labspark.operators.units import drop_invalid, normalize_units
from labspark.session import few, materialize

T0 = datetime(2020, 1, 1)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_units_and_spread_are_broadcast(spark):
    units = spark.createDataFrame([("a", "u", "m", 2.0), ("a", "bad", "invalid", None)], "label string, source_unit string, target_unit string, factor double")
    rows = spark.range(1000).select(F.lit("a").alias("label"), F.lit("c").alias("code"), F.when(F.col("id") % 3 > 0, "u").alias("unit"), F.col("id").cast("double").alias("value"))
    for df in (normalize_units(rows, units), drop_invalid(rows, units), clean.mad_filter(rows)):
        assert "SortMergeJoin" not in plan_of(df) and "BroadcastHashJoin" in plan_of(df)
    assert normalize_units(rows, units).agg(F.sum("value_norm")).first()[0] == 2.0 * sum(i for i in range(1000) if i % 3)


def test_large_tables_are_not_broadcast(spark):
    assert "broadcast" not in few(spark.range(5), "t", most=4)._jdf.queryExecution().analyzed().toString().lower()
    kept = materialize(spark.range(3), "t")
    assert materialize(kept, "t") is kept


def test_distinct_repeats_share_a_shuffle(spark):
    rows = [(i % 7, None if i % 5 == 0 else "p", T0, "a", None if i % 4 == 0 else T0 + timedelta(hours=i % 3)) for i in range(60)]
    df = materialize(spark.createDataFrame(rows, "obs_id int, patient string, time timestamp_ntz, code string, issued timestamp_ntz"), "rows")
    marked = clean.distinct_repeats(df)
    assert plan_of(marked).count("Exchange hashpartitioning") == 1
    got = {tuple(r) for r in clean.drop_superseded(materialize(marked, "marked")).collect()}
    assert got == {r for r in set(rows) if r[4] == max(x[4] for x in rows if x[1] == r[1] and x[4])}


def test_events_both_ways_have_one_row(spark):
    rnd = random.Random(5)
    at = lambda: T0 + timedelta(hours=rnd.randrange(60))
    probes = [(i, rnd.choice(["p", "q", None]), rnd.choice([at(), at(), None])) for i in range(120)]
    events = [(rnd.choice(["p", "q", "q", None]), s, s if rnd.random() < .5 else at(), rnd.choice("abz")) for s in [at() for _ in range(150)]]
    df = spark.createDataFrame(probes, "i int, k string, t timestamp_ntz")
    ev = spark.createDataFrame(events, "k string, s timestamp_ntz, e timestamp_ntz, g string")
    back = Source(ev, "e", {f"b_{g}": F.when(F.col("g") == g, F.col("e")) for g in "ab"})
    ahead = Source(ev, "s", {f"f_{g}": F.when(F.col("g") == g, F.col("s")) for g in "ab"}, inclusive=False)
    rows = _both_ways(["k"], [back], [ahead])
    wanted = [e for e in events if e[0] and e[3] != "z"]
    assert len(rows) == 1 and rows[0].count() == sum(1 + (s != e) for _, s, e, _ in wanted)
    for limit in (50_000, 60):  # 60: one key goes the other way
        for r in lookup(df, "k", "t", back, ahead, limit=limit).collect():
            of = [e for e in wanted if e[0] == r.k]
            for g in "ab":
                assert r[f"b_{g}"] == (r.t and max((e for _, _, e, x in of if x == g and e <= r.t), default=None))
                assert r[f"f_{g}"] == (r.t and min((s for _, s, _, x in of if x == g and s > r.t), default=None))


def test_regressions_build_one_study(spark, monkeypatch):
    calls, load = [], composites.plan.load_study
    monkeypatch.setattr(composites.plan, "load_study", lambda *a: calls.append(1) or load(*a))
    monkeypatch.setattr(composites, "wide", lambda t, s=None: spark.range(1) if s or composites.study(t) else None)
    composites.regression_table(registry.Tables(spark, "/root/testdata/sf0.001"))
    assert len(calls) == 1


def test_counted_references_are_not_shuffled_again(spark):
    rows = spark.createDataFrame([(r,) for r in ["Encounter/1"] * 3 + ["Encounter/2", "Encounter/4", "Encounter/9", "Other/1", "1"] + [None] * 2], "encounter string")
    encounters = spark.createDataFrame([(1, "main"), (2, None), (4, "sub"), (4, "main"), (None, "main")], "enc_id int, type string")
    rows, encounters = materialize(rows, "rows"), materialize(encounters, "encounters")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = resolve.reference_types(rows, encounters)
        assert plan_of(found).count("Exchange hashpartitioning") == 3  # references, encounters, types
        got = {r["encounter_type"]: r["n"] for r in found.collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == {"main": 4, "sub": 1, "encounter_type_is_null": 1, "encounter_reference_without_match": 3, "no_encounter_reference": 2}
