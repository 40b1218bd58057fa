"""Keys with few rows are shuffled once; crowded keys go the other way, with the same results."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from labspark.operators import intervals, windows
from labspark.operators.segments import crowd
from labspark.session import materialize

T0, H = datetime(2020, 1, 1), timedelta(hours=1)


@pytest.fixture(scope="module")
def tables(spark):
    rows = [(i, f"p{i % 7}" if i % 11 else None, T0 + 5 * i * H if i % 13 else None) for i in range(300)]
    events = [(1000 + i, "p0" if i % 3 == 0 else f"p{i % 7}", T0 + 7 * i * H, "ab"[i % 2]) for i in range(200)]
    stays = [(f"e{i:03}", f"p{i % 7}" if i % 5 else "p0", T0 + 9 * i * H, T0 + (9 * i + 24 * (i % 6)) * H if i % 8 else None, ("IMP", "SS", "AMB")[i % 3]) for i in range(120)]
    return (materialize(spark.createDataFrame(rows, "id int, patient string, time timestamp_ntz"), "rows"),
            materialize(spark.createDataFrame(events, "con_id int, patient string, time timestamp_ntz, code string"), "events"),
            materialize(spark.createDataFrame(stays, "enc_id string, patient string, period_start timestamp_ntz, period_end timestamp_ntz, class string"), "stays"))


def exchanges(df) -> int:
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.count("Exchange hashpartitioning") + plan.count("Exchange REPARTITION")


def same(a, b):
    assert sorted(map(repr, a.collect())) == sorted(map(repr, b.select(*a.columns).collect()))


def test_flags_shuffle_once(tables):
    rows, events, _ = tables
    out = windows.flags_before(rows, events, {"a": F.col("code") == "a"}, "patient", "time", "time", 24)
    assert exchanges(out) == 1
    assert out.count() == 300


def test_few_encounters_need_no_stretches(tables, monkeypatch):
    rows, events, stays = tables
    crowded = intervals.bucket_to_interval(events, stays, limit=5), intervals.assign_interval(rows, stays, limit=5)

    def never(*args, **kwargs):
        raise AssertionError("stretches of time for keys with few encounters")

    monkeypatch.setattr(intervals, "envelope", never)
    same(crowded[0], intervals.bucket_to_interval(events, stays))
    same(crowded[1], intervals.assign_interval(rows, stays))


def test_only_crowded_keys_are_cut(tables):
    """One key has more rows than the limit; the others do not."""
    rows, events, _ = tables
    found = crowd(events.select("patient"), ["patient"], 60)
    assert [r[0] for r in found.keys.collect()] == ["p0"] and found.total == 200
    assert found.within(rows).count() + found.without(rows).count() == 300
    back = windows.Source(events, "time", {"b": F.col("time")})
    ahead = windows.Source(events, "time", {"a": F.when(F.col("code") == "a", F.struct("time", "con_id"))}, inclusive=False)
    same(windows.lookup(rows, "patient", "time", back, ahead), windows.lookup(rows, "patient", "time", back, ahead, limit=60))
