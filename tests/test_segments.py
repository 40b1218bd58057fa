"""Crowded stretches of one key: cuts of even size, carries across them, and windows that overlap a thousandfold."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from labspark.operators import intervals
from labspark.operators.seek import Source, seek
from labspark.operators.segments import BUCKET, SEGMENT, cut, running, time_bucket
from labspark.session import materialize

T0 = datetime(2021, 6, 1, 12)
MS = timedelta(milliseconds=1)


def at(n):
    return T0 + n * MS


@pytest.fixture(scope="module")
def crowd(spark):
    """One key with 30,000 instants within a minute, among others with a few."""
    rnd = random.Random(2)
    rows = [("hot", at(rnd.randrange(60_000)), rnd.randrange(1000)) for _ in range(30_000)]
    rows += [(f"p{rnd.randrange(40)}", at(rnd.randrange(10**10)), rnd.randrange(1000)) for _ in range(400)]
    return spark.createDataFrame(rows, "patient string, time timestamp_ntz, x int")


def stored(df):
    return materialize(df.groupBy("patient", "time").agg(F.max("x").alias("x")).withColumn(BUCKET, time_bucket("time")), "test")


@pytest.mark.parametrize("parts,borders", [(256, 200_000), (4, 200_000), (4, 0)])  # 4: several rounds of cuts; 0: borders joined by salted keys
def test_even_segments_and_sums(crowd, parts, borders):
    rows, split = cut(stored(crowd).withColumn("n", F.lit(1).cast("long")), "patient", "time", limit=500, parts=parts, broadcast_borders=borders)
    assert split
    sizes = [r["count"] for r in rows.groupBy("patient", BUCKET, SEGMENT).count().collect()]
    assert sum(sizes) == stored(crowd).count() and max(sizes) <= 600
    hot = sorted(r["count"] for r in rows.filter("patient = 'hot'").groupBy(BUCKET, SEGMENT).count().collect())
    assert len(hot) > 40 and hot[0] > 0.4 * hot[-1]
    number = {(r["patient"], r["time"]): r["n"] for r in running(rows, "patient", ["time"], {"n": F.sum}, split).collect()}
    seen = {}
    for p, t in sorted(number):
        seen[p] = seen.get(p, 0) + 1
        assert number[p, t] == seen[p]


def test_ties_are_not_cut(spark):
    rows = spark.createDataFrame([("p", T0, i) for i in range(50)], "patient string, time timestamp_ntz, x int").withColumn(BUCKET, time_bucket("time"))
    assert cut(materialize(rows, "test"), "patient", "time", limit=5)[1] is False
    two = spark.createDataFrame([("p", at(i % 2), i) for i in range(50)], "patient string, time timestamp_ntz, x int").withColumn(BUCKET, time_bucket("time"))
    got, split = cut(materialize(two, "test"), "patient", "time", limit=5)
    assert split and got.groupBy(SEGMENT).count().count() == 2


@pytest.mark.parametrize("ahead", [False, True])
def test_seek_through_cuts(crowd, ahead):
    events = crowd.filter("x % 50 = 0")
    source = Source(events, "time", {"t": F.col("time"), "rare": F.when(F.col("x") == 0, F.struct("time", "x"))}, inclusive=False)
    whole = seek(crowd, source, "patient", "time", ahead)
    parts = seek(crowd, source, "patient", "time", ahead, limit=300)
    assert parts.count() == whole.count() and whole.exceptAll(parts).isEmpty()


def test_envelope(spark):
    rnd = random.Random(5)
    windows = []
    for p, n, span in (("a", 60, 50), ("b", 3, 20), ("c", 1, 9), ("d", 200, 400)):
        for i in range(n):
            low = rnd.randrange(span)
            windows.append((p, at(low), at(low + rnd.choice([0, 1, 2, 7, 40, 300])), rnd.randrange(30), i))
    df = spark.createDataFrame(windows + [(None, T0, at(5), 1, 1), ("a", None, T0, 1, 1)], "patient string, low timestamp_ntz, high timestamp_ntz, w int, i int")
    got = {(r["patient"], r["pos"]): r["best"] and tuple(r["best"]) for r in intervals.envelope(df, "patient", "low", "high", F.struct("w", "i"), limit=20).collect()}
    assert set(got) == {(p, t) for p, low, high, _, _ in windows if low < high for t in (low, high)}
    for (p, t), best in got.items():
        assert best == min(((w, i) for q, low, high, w, i in windows if p == q and low <= t < high), default=None)


def test_work_of_staggered_windows_is_linear(spark):
    """1,000 windows that all overlap: each is at most two blocks of a size, whatever it overlaps with."""
    def blocks(n):
        df = spark.range(n).select(F.col("id").alias("low"), (F.col("id") + n).alias("high"))
        return df.select(F.explode(intervals._dyadic("low", "high")).alias("b")).count()
    assert blocks(1000) <= 2 * 10 * 1000 and blocks(2000) <= 2.3 * blocks(1000)
    cells = spark.sql("SELECT 3L AS low, 21L AS high").select(F.explode(intervals._dyadic("low", "high")).alias("b")).collect()
    assert sorted(c for r in cells for c in range(r["b"]["node"] << r["b"]["level"], (r["b"]["node"] + 1) << r["b"]["level"])) == list(range(3, 21))


def test_staggered_encounters(spark):
    """One patient, 1,000 encounters of an hour, each a second after the other; points at borders and between."""
    n = 1000
    spans = [(f"e{i:04d}", "hot", at(1000 * i), at(1000 * i + 3_600_000 + (i * 7919) % 500)) for i in range(n)]
    rnd = random.Random(4)
    points = [("hot", rnd.choice([t, t + MS, t - MS])) for t in rnd.sample([x for s in spans for x in s[2:]], 300)]
    enc = spark.createDataFrame(spans, "enc_id string, patient string, period_start timestamp_ntz, period_end timestamp_ntz")
    found = intervals.in_interval(spark.createDataFrame(points, "patient string, time timestamp_ntz"), enc, "patient", "time", limit=200)
    got = {r["time"]: r["enc_id"] for r in found.collect()}
    for _, t in points:
        around = [(-(e - s), i) for i, _, s, e in spans if s <= t <= e]
        assert got.get(t) == (min(around)[1] if around else None)


def test_parts_of_many_kinds(spark):
    """All parts, both class ranks, periods that end before they start, open ones, outpatient contacts at any time of day."""
    rnd = random.Random(9)
    H = timedelta(hours=1)
    enc, events = [], []
    for i in range(400):
        s = T0 + rnd.randrange(0, 1500) * H / 2
        e = None if rnd.random() < 0.1 else s + rnd.choice([-30, 0, 1, 12, 24, 30, 72, 80, 200]) * H
        enc.append((f"e{i:03d}", f"p{i % 7}", s, e, rnd.choice(["IMP", "AMB", "AMB", "EMER", "SS"])))
    enc = [x for x in enc if not (x[3] is None and x[4] == "EMER")]
    for i in range(800):
        events.append((f"c{i}", f"p{i % 8}", T0 + rnd.randrange(0, 2400) * H / 2))
    got = {r["con_id"]: (r["enc_id"], r["time_bucket"]) for r in intervals.bucket_to_interval(
        spark.createDataFrame(events, "con_id string, patient string, time timestamp_ntz"),
        spark.createDataFrame(enc, "enc_id string, patient string, period_start timestamp_ntz, period_end timestamp_ntz, class string"), limit=100).collect()}

    day = timedelta(days=1)

    def part(t, cls, start, end):
        if cls == "AMB":
            s = start.replace(hour=0, minute=0, second=0, microsecond=0)
            e, end = s + day, start
        else:
            s, e = start, end
        if t < s:
            return None
        stay = cls != "AMB"
        name = ("day1" if t < min(s + day, e) else "end_date" if stay and e - day <= t <= e else "day2_3" if stay and t < min(s + 3 * day, e)
                else "day4_to_end" if stay and t <= e else "end_to_3d_after" if t < e + 3 * day else "3d_to_7d_after" if t < e + 7 * day
                else "7d_to_14d_after" if t < e + 14 * day else "remaining")
        anchor = start if name in ("day1", "day2_3", "day4_to_end") else end
        return name, abs(t - anchor)

    inpatient = intervals.INPATIENT_CLASSES
    seen = set()
    for c, p, t in events:
        best = None
        for i, q, s, e, cls in enc:
            if p == q and not (e is None and cls != "AMB"):
                found = part(t, cls, s, e)
                if found:
                    key = (intervals.BUCKETS[found[0]], 1 if cls in inpatient else 2, found[1], i, found[0])
                    best = key if best is None or key < best else best
        assert got.get(c) == (best and (best[3], best[4])), (c, t)
        seen.add(best and best[4])
    assert seen >= set(intervals.BUCKETS)
