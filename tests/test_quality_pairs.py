"""Pairs of measurements and quality results: listed once, without a pass over all pairs."""

import random

from pyspark.sql import functions as F

from labspark.operators import quality as q

COLUMNS = "basedon string, patient string, time int, obs_id int, code string"


def test_reference_pairs_are_distinct(spark, monkeypatch):
    rnd = random.Random(3)

    def side(n):  # ids that come with several orders, repeated rows, rows without order
        return [(rnd.choice(["o1", "o2", "o3", None]), "p", 1, rnd.randrange(12), "c") for _ in range(n)]

    main, found = side(60), side(50)
    wanted = {(m[1:], f[3:]) for m in main for f in found if m[0] and m[0] == f[0]}
    for most in (2_000_000, 7):  # 7: every order is split into parts
        monkeypatch.setattr(q, "PAIRS_PER_TASK", most, raising=False)
        df = q.match_reference(spark.createDataFrame(main, COLUMNS), spark.createDataFrame(found, COLUMNS))
        assert df.columns == ["patient", "time", "main_obs_id", "main_code", "quality_obs_id", "quality_code"]
        got = [((r.patient, r.time, r.main_obs_id, r.main_code), (r.quality_obs_id, r.quality_code)) for r in df.collect()]
        assert len(got) == len(set(got)) and set(got) == wanted


def test_pairs_are_not_aggregated(spark):
    rows = spark.createDataFrame([("o", "p", 1, i, "c") for i in range(30)], COLUMNS)
    plan = q.match_time(rows, rows)._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan
    assert q.match_time(rows, rows).count() == 900
    assert q.match_reference(rows, rows).agg(F.count("*")).first()[0] == 900
