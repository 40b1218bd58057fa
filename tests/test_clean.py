"""Percentiles, repeats and extreme values."""

import random
from datetime import datetime

import numpy as np
from pyspark.sql import functions as F

from labspark.operators import clean, describe
from labspark.operators.quantiles import percentiles
from labspark.operators.units import drop_invalid, normalize_units
from labspark.spec import Cohort

T = datetime(2020, 1, 1)


def test_percentiles_match_numpy(spark):
    rnd = random.Random(3)
    groups = {
        "wide": [rnd.choice([-1, 1]) * 10 ** rnd.uniform(-8, 8) for _ in range(400)], "same": [2.5] * 30, "one": [7.0], "zero": [0.0, 0.0, -1.0, 1.0],
        "narrow": [1000 + rnd.random() * 1e-3 for _ in range(300)], None: [rnd.gauss(0, 1) for _ in range(100)]}
    rows = [(g, float(v)) for g, vs in groups.items() for v in vs] + [("empty", None), ("one", None)]
    probs = {"p0": 0.0, "p3": 0.03, "p50": 0.5, "p99": 0.9995, "p100": 1.0}
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r["g"]: r for r in percentiles(df, "g", "v", probs).collect()}
    assert set(got) == set(groups)
    for g, vs in groups.items():
        for n, p in probs.items():
            assert np.isclose(got[g][n], np.quantile(vs, p), rtol=1e-12, atol=1e-12), (g, n)


def dup(spark, rows):
    return spark.createDataFrame(rows, "obs_id int, patient string, time timestamp_ntz, code string, issued timestamp_ntz")


def test_dedupe_keeps_latest_and_ties(spark):
    later = [T.replace(hour=h) for h in range(1, 5)]
    rows = [(1, "p", T, "a", later[0]), (2, "p", T, "a", later[1]), (3, "p", T, "a", later[1]), (4, "p", T, "a", None),
            (5, "p", T, "b", None), (6, "p", T, "b", None), (7, "q", T, "a", None), (8, "q", None, "a", later[0]), (9, "q", None, "a", later[1])]
    df = dup(spark, rows)
    assert sorted(r.obs_id for r in clean.dedupe_repeats(df).collect()) == [2, 3, 5, 6, 7, 8, 9]
    assert tuple(clean.dedupe_counts(df).first()) == (2, 2)


def test_dedupe_needs_informative_issue_times(spark):
    early = T.replace(year=2019)
    rows = [(1, "p", T, "a", early), (2, "p", T, "a", T)]
    assert clean.dedupe_repeats(dup(spark, rows)).count() == 2
    assert tuple(clean.dedupe_counts(dup(spark, rows)).first()) == (0, 0)
    scoped = dup(spark, rows + [(3, "p", T, "b", T), (4, "p", T, "b", T.replace(hour=5))])
    kept = clean.dedupe_repeats(scoped, scope="code").collect()
    assert sorted(r.obs_id for r in kept) == [1, 2, 4]


def test_mad_keeps_null_and_flat_groups(spark):
    rows = [("flat", 1.0)] * 5 + [("flat", 99.0)] + [("null", None)] * 2 + [("x", float(v)) for v in (1, 2, 3, 4, 5, 1000)] + [("x", None)]
    df = spark.createDataFrame(rows, "code string, value double").withColumn("unit", F.lit(None).cast("string"))
    kept = clean.mad_filter(df)
    assert kept.count() == len(rows) - 1
    assert kept.filter("value = 1000").count() == 0
    bad = {r["code"]: (r["n_implausible"], r["median_implausible"]) for r in clean.mad_report(df).collect()}
    assert bad == {"flat": (0, None), "null": (0, None), "x": (1, 1000.0)}


def test_units(spark):
    units = spark.createDataFrame([("a", "u", "u", 2.0), ("a", "bad", "invalid", None), ("b", "u", "u", 3.0)],
                                  "label string, source_unit string, target_unit string, factor double")
    df = spark.createDataFrame([("a", "u", 1.0), ("a", "bad", 1.0), ("a", None, 1.0), ("b", None, 1.0), ("b", "z", 1.0)], "label string, unit string, value double")
    assert {(r.label, r.unit) for r in drop_invalid(df, units).collect()} == {("a", "u"), ("b", None), ("b", "z")}
    norm = {(r.label, r.unit): r.value_norm for r in normalize_units(df, units, optional_labels=("b",)).collect()}
    assert norm == {("a", "u"): 2.0, ("a", "bad"): None, ("a", None): None, ("b", None): 1.0, ("b", "z"): 1.0}


def test_distribution_adds_up(spark):
    vals = [1.9, 2.0, 2.05, 7.99, 8.0, 9.5, None]
    df = spark.createDataFrame([("a", v) for v in vals], "code string, value double").withColumns({"unit": F.lit("u"), "value_compare": F.col("value")})
    out = describe.value_distribution(df).collect()
    assert len(out) == 62 and sum(r.n for r in out) == 6
    ends = {(r.bin_start, r.bin_end): r.n for r in out if r.n}
    assert ends == {(None, 2.0): 1, (2.0, 2.1): 2, (7.9, 8.0): 1, (8.0, None): 2}


def test_cohorts_overlap_and_empty_ones_vanish(spark):
    df = spark.createDataFrame([(1, 30, "male"), (2, 70, "female"), (3, None, "unknown")], "id int, age int, gender string")
    out = describe.with_cohorts(df, [Cohort(), Cohort(18, 39), Cohort(18, 39, "female"), Cohort(None, None, "female")])
    got = {(r.id, r.age_min, r.cohort_gender) for r in out.collect()}
    assert got == {(1, "all", "all"), (2, "all", "all"), (3, "all", "all"), (1, "18", "all"), (2, "all", "female")}
