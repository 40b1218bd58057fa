"""Lookups along time against brute force, with one key that holds a large share of the rows."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from labspark.operators import intervals, windows
from labspark.operators.seek import Source, seek

T0 = datetime(2020, 1, 1)
H = timedelta(hours=1)


def hour(n):
    return T0 + n * H


@pytest.fixture(scope="module")
def data():
    rnd = random.Random(7)

    def patient():
        return "hot" if rnd.random() < 0.4 else f"p{rnd.randrange(12)}"

    facts = [(i, patient(), hour(rnd.randrange(0, 3000, 3)), rnd.randrange(50)) for i in range(500)]
    events = [(i, patient(), hour(rnd.randrange(0, 3000, 3)), rnd.choice("abc"), float(rnd.randrange(20))) for i in range(500)]
    spans = []
    for i in range(150):
        s = rnd.randrange(0, 3000, 3)
        e = None if rnd.random() < 0.1 else s + rnd.choice([-6, 0, 3, 12, 48, 900])
        spans.append((f"e{i:03d}", patient(), hour(s), None if e is None else hour(e), rnd.choice(["IMP", "SS", "AMB"])))
    return facts, events, spans


@pytest.fixture(scope="module")
def frames(spark, data):
    f, e, s = data
    return (spark.createDataFrame(f, "id int, patient string, time timestamp_ntz, v int"),
            spark.createDataFrame(e, "eid int, patient string, time timestamp_ntz, code string, x double"),
            spark.createDataFrame(s, "enc_id string, patient string, period_start timestamp_ntz, period_end timestamp_ntz, class string"))


def by_id(df, *cols):
    return {r["id"]: tuple(r[c] for c in cols) for r in df.collect()}


@pytest.mark.parametrize("bucket_days", [1, 28, 4000])
@pytest.mark.parametrize("ahead,inclusive", [(False, True), (False, False), (True, True), (True, False)])
def test_seek(data, frames, bucket_days, ahead, inclusive):
    facts, events, _ = data
    f, e, _ = frames
    got = {(r["patient"], r["time"]): r["t"] for r in
           seek(f, Source(e, "time", {"t": F.col("time")}, inclusive), "patient", "time", ahead, bucket_days).collect()}
    assert len(got) == len({(p, t) for _, p, t, _ in facts})
    for (p, t), found in got.items():
        ts = [et for _, ep, et, _, _ in events if ep == p and ((et > t or (inclusive and et == t)) if ahead else (et < t or (inclusive and et == t)))]
        assert found == ((min(ts) if ahead else max(ts)) if ts else None)


def test_seek_skips_missing_keys(spark):
    f = spark.createDataFrame([(None, T0), ("p", None), ("p", T0)], "patient string, time timestamp_ntz")
    e = spark.createDataFrame([(None, T0), ("p", T0)], "patient string, time timestamp_ntz")
    assert seek(f, Source(e, "time", {"t": F.col("time")}), "patient", "time").count() == 1


def test_window_flags_and_rows_kept(data, frames):
    facts, events, _ = data
    f, e, _ = frames
    out = windows.flags_before(f, e, {"a": F.col("code") == "a", "bc": F.col("code").isin("b", "c")}, "patient", "time", "time", 24)
    got = by_id(out, "a", "bc")
    assert len(got) == len(facts)
    for i, p, t, _ in facts:
        near = [c for _, ep, et, c, _ in events if ep == p and t - 24 * H < et <= t]
        assert got[i] == (int("a" in near), int(bool({"b", "c"} & set(near))))


def test_window_edges(spark):
    f = spark.createDataFrame([(1, "p", hour(100))], "id int, patient string, time timestamp_ntz")

    def hits(offset, fn, n):
        e = spark.createDataFrame([("p", hour(100 + offset))], "patient string, time timestamp_ntz")
        return fn(f, e, {"x": F.lit(True)}, "patient", "time", "time", n).first()["x"]

    assert [hits(o, windows.flags_before, 24) for o in (-24, -23, 0, 1)] == [0, 1, 1, 0]
    assert [hits(o, windows.flags_after, 12) for o in (0, 1, 12, 13)] == [0, 1, 1, 0]


def test_label_flags_and_nearest(data, frames):
    facts, events, _ = data
    f, e, _ = frames
    lab = e.withColumns({"label": F.when(F.col("code") == "a", "g").otherwise("h"),
                         "result": F.when(F.col("x") < 5, "L").when(F.col("x") > 15, "H").when(F.col("x") != 10, "N")})
    win = {"g": 6, "h": 48}
    flags = by_id(windows.label_flags(f, lab, win, "patient", "time", "time"), *[f"{n}_{r}" for n in win for r in "NHL"])
    near = by_id(windows.nearest_value(f, lab, win, "patient", "time", "time", "x"), "g_value_norm", "h_value_norm")

    def res(x):
        return "L" if x < 5 else "H" if x > 15 else "N" if x != 10 else None

    rank = {"N": 1, "L": 2, "H": 3, None: 4}
    for i, p, t, _ in facts:
        want_flags, want_near = [], []
        for n, h in win.items():
            c = [(abs(et - t), rank[res(x)], x) for _, ep, et, code, x in events if ep == p and (code == "a") == (n == "g") and abs(et - t) <= h * H]
            want_flags += [int(any(rank[r] == k for _, k, _ in c)) for r in "NHL"]
            want_near.append(min(c)[2] if c else None)
        assert flags[i] == tuple(want_flags)
        assert near[i] == tuple(want_near)


def test_next_event(data, frames):
    facts, _, _ = data
    f, _, _ = frames
    got = by_id(windows.next_event(f, "patient", "time", "id", {"v": "v"}), "next_v", "next_flag", "next_hours")
    for i, p, t, _ in facts:
        later = [(ft, -j, v) for j, fp, ft, v in facts if fp == p and ft > t]
        want = (min(later)[2], 1, (min(later)[0] - t) / H) if later else (None, 0, None)
        assert got[i] == want


def test_assign_interval(data, frames):
    facts, _, spans = data
    f, _, s = frames
    got = by_id(intervals.assign_interval(f, s), "enc_class", "enc_id")
    for i, p, t, _ in facts:
        c = [(-(e - b), n) for n, ep, b, e, cls in spans if ep == p and e is not None and cls != "AMB" and b <= t <= e]
        assert got[i] == (("IMP", min(c)[1]) if c else ("AMB", None))


def test_first_in_interval(spark):
    rows = [(1, "e", hour(1)), (2, "e", hour(2)), (3, "d", hour(1)), (4, "d", hour(1)), (5, None, hour(0))]
    df = spark.createDataFrame(rows, "id int, enc_id string, time timestamp_ntz")
    assert by_id(intervals.first_in_interval(df), "first") == {1: (1,), 2: (0,), 3: (0,), 4: (0,), 5: (0,)}
    assert intervals.ambiguous_first(df).first()[0] == 1


def test_interval_flags(data, frames):
    facts, _, spans = data
    f, _, s = frames
    proc = s.withColumn("performed", F.when(F.col("class") == "AMB", F.col("period_start") + F.expr("INTERVAL '3' HOUR")))
    got = by_id(windows.interval_flags(f, proc, "patient", "time"), "dialyse_during", "dialyse_before", "dialyse_unclear")
    for i, p, t, _ in facts:
        during = before = unclear = 0
        for _, ep, b, e, cls in spans:
            if ep != p:
                continue
            if e is None or b == e:
                point = b + 3 * H if cls == "AMB" else b
                unclear |= t - 12 * H <= point <= t
            else:
                during |= b <= t <= e
                before |= t - 12 * H <= e <= t and not b <= t <= e
        assert got[i] == (int(during), int(before), int(unclear))


def test_context_flags(data, frames):
    facts, events, spans = data
    f, e, s = frames
    out = windows.context_flags(intervals.assign_interval(f, s), e, {"a": F.col("code") == "a"}, "patient", "time", "time")
    day = timedelta(days=1)
    for r in out.collect():
        midnight = r["time"].replace(hour=0)
        lo, hi = (r["enc_start"], r["enc_end"] + 14 * day) if r["enc_class"] == "IMP" else (midnight, midnight + 15 * day)
        assert r["a"] == int(any(ep == r["patient"] and c == "a" and lo <= et < hi for _, ep, et, c, _ in events))


def test_pair_nearest(data, frames):
    facts, events, _ = data
    f, e, _ = frames
    got = by_id(windows.pair_nearest(f, e, "patient", "time", "eid", {"eid": "eid"}, 6, "id"), "eid_2", "hours_between")
    for i, p, t, _ in facts:
        c = [(abs(et - t), eid) for eid, ep, et, _, _ in events if ep == p and abs(et - t) <= 6 * H]
        assert got.get(i) == ((min(c)[1], min(c)[0] / H) if c else None)


def test_bucket_to_interval(data, frames):
    _, events, spans = data
    _, e, s = frames
    valid = s.filter(F.col("period_end").isNull() | (F.col("period_start") <= F.col("period_end")))
    got = {r["eid"]: (r["enc_id"], r["time_bucket"]) for r in
           intervals.bucket_to_interval(e, valid, event_id="eid", bucket_days=5).collect()}
    day = timedelta(days=1)
    for eid, p, t, _, _ in events:
        best = None
        for n, ep, b, end, cls in spans:
            if ep != p or (end is not None and b > end) or (end is None and cls != "AMB"):
                continue
            stay = cls != "AMB"
            ws, we, pe = (b, end, end) if stay else (b.replace(hour=0), b.replace(hour=0) + day, b)
            if t < ws:
                continue
            name = ("day1" if t < min(ws + day, we) else "end_date" if stay and we - day <= t <= we else "day2_3" if stay and t < min(ws + 3 * day, we)
                    else "day4_to_end" if stay and t <= we else "end_to_3d_after" if t < we + 3 * day else "3d_to_7d_after" if t < we + 7 * day
                    else "7d_to_14d_after" if t < we + 14 * day else "remaining")
            anchor = b if name in ("day1", "day2_3", "day4_to_end") else pe
            key = (intervals.BUCKETS[name], 1 if stay else 2, abs(t - anchor), n, name)
            best = key if best is None else min(best, key)
        assert got.get(eid) == (None if best is None else (best[3], best[4]))
