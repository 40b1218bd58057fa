"""Rows that are dealt once for several steps, keys that are counted by few counts, inputs that are joined once."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from labspark.functions.columns import join_optional
from labspark.operators import clean, intervals, windows
from labspark.operators.seek import lookup
from labspark.operators.segments import crowd
from labspark.plans import base
from labspark.session import materialize
from labspark.sources import fixtures
from labspark.spec import Spec

T0 = datetime(2020, 1, 1)
SMALL = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_rows_are_dealt_once_for_their_intervals(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = [(i % 9, None if i % 4 == 0 else f"p{i % 3}", T0 + timedelta(hours=i % 12)) for i in range(80)]
        df = materialize(spark.createDataFrame(rows, "obs_id int, patient string, time timestamp_ntz"), "rows")
        enc = spark.createDataFrame([("e1", "p0", T0, T0 + timedelta(hours=5), "IMP"), ("e2", "p1", T0 + timedelta(hours=3), T0 + timedelta(hours=9), "IMP")],
                                    "enc_id string, patient string, period_start timestamp_ntz, period_end timestamp_ntz, class string")
        placed = intervals.assign_interval(df, enc)
        assert plan_of(placed).count("Exchange hashpartitioning") == 2  # the rows, the intervals
        once = intervals.assign_interval(df, enc, once=True)
        assert plan_of(once).count("Exchange hashpartitioning") == 2
        few = intervals.assign_interval(df, enc, once=True, limit=5)  # crowded patients go the other way
        wanted = sorted(map(repr, intervals.assign_interval(df.distinct(), enc).collect()))
        assert sorted(map(repr, once.collect())) == sorted(map(repr, few.collect())) == wanted
        assert placed.count() == 80 > len(wanted) == len(set(rows))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_join_with_patients_serves_repeats(spark):
    rnd = random.Random(5)
    rows = [(f"o{rnd.randrange(6)}", rnd.choice(["Patient/1", "Patient/2", None]), T0 + timedelta(hours=rnd.randrange(2)), "a", rnd.choice([None, T0 + timedelta(hours=rnd.randrange(4))])) for _ in range(120)]
    lab = spark.createDataFrame(rows, "obs_id string, patient string, time timestamp_ntz, code string, issued timestamp_ntz")
    lab = lab.select(*[F.col(c) if c in lab.columns else F.lit(1.0 if c in ("value", "ref_low", "ref_high") else "x").alias(c) for c in base.MEASUREMENT])
    lab = lab.withColumns({"status": F.lit(None).cast("string"), "code_system": F.lit("s")})
    pats = spark.createDataFrame([("1", "1970", "male"), ("2", "1980", "female")], "pat_id string, birth_raw string, gender string")
    spec = Spec(t_min=T0, t_max=T0 + timedelta(days=9), system="s", main_codes=("a",))
    got = clean.distinct_dealt(base._measurements(lab, pats, spec), ("__key", *base.REPEAT_GROUP)).drop("__key")
    wanted = clean.superseded(base.raw_measurements(lab, pats, spec), base.REPEAT_GROUP)
    assert sorted(map(repr, got.select(*wanted.columns).collect())) == sorted(map(repr, wanted.collect()))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        again = clean.distinct_dealt(base._measurements(lab, pats, spec), ("__key", *base.REPEAT_GROUP))
        assert plan_of(again).count("Exchange hashpartitioning") == 2  # measurements, patients
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_join_reads_no_other_column_of_rows_without_key(spark):
    rows = materialize(spark.createDataFrame([(None, 1, "u"), ("a", 2, "u"), ("b", 3, "u")], "k string, id int, unused string"), "rows")
    joined = join_optional(rows, spark.createDataFrame([("a", 7)], "r string, v int"), "k", "r")
    assert "unused" not in plan_of(joined.select("id", "v"))
    assert sorted((r["id"], r["v"] or 0) for r in joined.collect()) == [(1, 0), (2, 7), (3, 0)]


def test_crowded_keys_are_found_by_few_counts(spark):
    rnd = random.Random(1)
    ids = [f"p{rnd.randrange(300)}" for _ in range(900)] + ["hot"] * 60 + ["warm"] * 20
    rows = spark.createDataFrame([(p, 1 + (p == "warm") * 2) for p in ids], "patient string, times int")
    for cells in (4, 2**16):  # 4: many keys share a hash that has too many rows
        assert [r[0] for r in crowd(rows, "patient", 50, cells=cells).keys.collect()] == ["hot"]
        found = crowd(rows, "patient", 50, times="times", cells=cells)
        assert sorted(r[0] for r in found.keys.collect()) == ["hot", "warm"] and found.total == 900 + 60 + 60
        assert not crowd(rows, "patient", 60, cells=cells) and crowd(rows, "patient", 60, cells=cells).total == 980


def test_interval_has_one_row_a_role(spark):
    rows = [(None, T0, None, T0 + timedelta(hours=2)), (T0, T0 + timedelta(hours=1), None, T0), (T0, T0, None, T0), (T0 + timedelta(hours=3), T0 + timedelta(hours=2), None, T0)]
    found = spark.createDataFrame([("p", *r) for r in rows], "patient string, period_start timestamp_ntz, period_end timestamp_ntz, performed timestamp_ntz, time timestamp_ntz")
    sources = windows.interval_sources(found, "period_start", "period_end", "performed")
    assert len({id(s.events) for s in sources}) == 1
    probes = spark.createDataFrame([("p", T0 + timedelta(minutes=30 * i)) for i in range(12)], "patient string, time timestamp_ntz")
    a, b = (lookup(probes, "patient", "time", sources, limit=n).orderBy("time").collect() for n in (50_000, 2))
    assert a == b
    assert [r["__until"] for r in a[:3]] == [T0 + timedelta(hours=1)] * 3 and a[0]["__unclear"] == T0


def test_study_joins_administrations_once(spark):
    shared = {}
    parts = {n: fixtures.load(spark, SMALL, n, shared) for n in ("st_med_coded", "st_med_one", "st_med_two")}
    assert list(shared) == ["fx_med"]
    for n, d in parts.items():
        assert "Join" not in plan_of(d)
        assert d.exceptAll(fixtures.load(spark, SMALL, n)).count() == 0 and d.count() == fixtures.load(spark, SMALL, n).count()
