"""Rules of models are checked on rows added up per set of conditions, not on a copy of every row per rule."""

import random

from pyspark.sql import functions as F

from labspark.operators import regress


def test_rules_are_checked_on_added_rows(spark, monkeypatch):
    rnd = random.Random(2)
    rows = [(i, rnd.choice([0, 1, None]), rnd.choice(["a", "b", None]), rnd.choice([None, float(rnd.randrange(5))]), rnd.choice([None, 30 + rnd.randrange(40)]), rnd.random() < .6) for i in range(4000)]
    df = spark.createDataFrame(rows, "id int, f int, g string, x double, age int, use boolean")
    use, old = F.col("use"), F.col("age") > 90
    rules = [regress.Rule("f", use), regress.Rule("g", use, "factor"), regress.Rule("x", use, "number"), regress.Rule("f", old), regress.Rule("x", old, "number")]
    drafts = [regress.Draft(regress.Model("m", "x", ("f",), {}, "age"), use), regress.Draft(regress.Model("n", "x", ("f",)), use)]
    plans, collect = [], type(df).collect
    monkeypatch.setattr(type(df), "collect", lambda self: plans.append(self._jdf.queryExecution().optimizedPlan().toString()) or collect(self))
    held, heads = regress.survey(df, rules, drafts, 5)
    assert "Aggregate" in plans[0][plans[0].index("Generate explode"):]  # what is exploded has been added up
    ages = [r[4] for r in rows if r[5] and r[4] is not None]
    n = sum(r[5] for r in rows)
    assert held == [True, True, True, False, False]
    assert [h[0] for h in heads] == [n, n] and abs(heads[0][1] - sum(ages) / len(ages)) < 1e-9 and heads[1][1] is None
