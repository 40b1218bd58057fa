"""What is published about matches, from the two sides alone, against the pairs themselves."""

import random

import pytest
from pyspark.sql import functions as F

from labspark.operators import quality as q

QUALITY = "patient string, time int, obs_id int, code string, value double, unit string, value_code string, value_code_system string, ref_high double, ref_low double, interpretation string, basedon string"


def frames(spark, hot, n=300):
    rnd = random.Random(hot)

    def order():
        return "o0" if rnd.random() < hot else rnd.choice([None, *(f"o{i}" for i in range(1, 25))])

    mains = [(f"p{rnd.randrange(6)}", rnd.randrange(12), rnd.randrange(n // 2), rnd.choice("ab"), order()) for _ in range(n)]
    qual = [(f"p{rnd.randrange(6)}", rnd.randrange(12), 1000 + rnd.randrange(n // 2), rnd.choice("xyz"), rnd.choice([None, 1.0, 2.5, 7.0]), rnd.choice(["u", "v"]), rnd.choice([None, "c1", "c2"]),
             "s1", rnd.choice([None, 5.0]), None, rnd.choice([None, "high"]), order()) for _ in range(n)]
    return (spark.createDataFrame(mains, "patient string, time int, obs_id int, code string, basedon string"), spark.createDataFrame(qual, QUALITY))


@pytest.mark.parametrize("by_time", [True, False])
@pytest.mark.parametrize("hot", [0.05, 0.6])
def test_sides_give_what_the_pairs_give(spark, hot, by_time):
    df, qual = frames(spark, hot)
    match = (q.sides_by_time if by_time else q.sides_by_reference)(df, qual)
    pairs = [r.asDict() for r in (q.match_time if by_time else q.match_reference)(df, qual).collect()]
    got = {r["metric"]: r["n"] for r in q.match_summary(df, match).collect()}
    per_main = {}
    for p in pairs:
        per_main.setdefault((p["main_obs_id"], p["quality_code"]), set()).add(p["quality_obs_id"])

    def results(c):
        return len({p["quality_obs_id"] for p in pairs if p[c] is not None})

    assert got == {"n_total": df.count(), "n_matched": len({p["main_obs_id"] for p in pairs}), "n_pairs": len({(p["main_obs_id"], p["quality_obs_id"]) for p in pairs}),
                   "n_with_value": results("quality_value"), "n_with_code": results("quality_value_code"), "n_with_interpretation": results("quality_interpretation"),
                   "n_overmatched": len({m for (m, _), ids in per_main.items() if len(ids) > 1})}

    per_code = {(r["main_code"], r["quality_code"]): r["n_pairs"] for r in q.pairs_per_code(match).collect()}
    key = ["patient", "time"] if by_time else ["basedon"]
    m = {tuple(r) for r in df.select(*key, "patient", "time", "obs_id", "code").dropna(subset=key).collect()}
    right = {tuple(r) for r in qual.select(*key, *[c for c in qual.columns if c not in key and (c not in ("patient", "time", "basedon"))]).dropna(subset=key).collect()}
    want, width = {}, len(key)
    for a in m:
        for b in right:
            if a[:width] == b[:width]:
                want[a[-1], b[width + 1]] = want.get((a[-1], b[width + 1]), 0) + 1
    assert per_code == want

    groups = {}
    for p in pairs:
        g = groups.setdefault((p["patient"], p["time"]), (set(), set(), set()))
        g[0].add(p["main_obs_id"]), g[1].add(p["quality_code"]), g[2].add(p["quality_obs_id"])
    assert q.incomplete_groups(match).first()["n"] == sum(len(a) >= 2 and len(c) < len(a) * len(b) for a, b, c in groups.values())


def test_no_pair_table(spark):
    """20,000 rows on either side share one order: 400 million pairs are counted, not built."""
    n = 20_000
    df = spark.range(n).select(F.col("id").alias("obs_id"), F.lit("a").alias("code"), F.lit("p").alias("patient"), F.col("id").alias("time"), F.lit("o").alias("basedon"))
    qual = spark.range(n).select((F.col("id") + n).alias("obs_id"), F.lit("x").alias("code"), F.lit(1.0).alias("value"), F.lit("u").alias("unit"), F.lit(None).cast("string").alias("value_code"),
                                 F.lit(None).cast("string").alias("value_code_system"), F.lit(None).cast("double").alias("ref_high"), F.lit(None).cast("double").alias("ref_low"),
                                 F.lit(None).cast("string").alias("interpretation"), F.lit("o").alias("basedon"))
    match = q.sides_by_reference(df, qual)
    got = {r["metric"]: r["n"] for r in q.match_summary(df, match).collect()}
    assert got["n_pairs"] == n * n and got["n_matched"] == got["n_overmatched"] == n and got["n_with_value"] == n
    assert q.pairs_per_code(match).first()["n_pairs"] == n * n
