"""Many models over one table: three passes, and the numbers that numpy finds for each model by itself."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from labspark.operators import regress
from labspark.operators.regress import Draft, Model, Rule

GENDER = {"gender": ("male", "female")}
WITH_RESULT = {**GENDER, "result": ("N", "L", "H")}


@pytest.fixture(scope="module")
def rows():
    rnd, out = random.Random(5), []
    for i in range(3000):
        g, a, b = rnd.choice(["male", "female"]), int(rnd.random() < 0.3), int(rnd.random() < 0.5)
        age = None if i % 97 == 0 else rnd.randrange(20, 90)
        lab = None if rnd.random() < 0.4 else math.nan if i == 7 else rnd.gauss(5, 1)
        c = "hot" if rnd.random() < 0.4 else f"c{i % 300}"  # one cluster with more than a third of all rows
        y = None if i % 53 == 0 else 4 + 0.01 * (age or 0) + 0.5 * a - 0.2 * b + (0.5 if c == "hot" else 0.0) + rnd.gauss(0, 0.4)
        out.append((i, g, age, a, b, 0, lab, rnd.choice("NLH"), c, i % 11, y))
    return out


@pytest.fixture(scope="module")
def df(spark, rows):
    return spark.createDataFrame(rows, "id int, gender string, age int, a int, b int, never int, lab double, result string, c string, t int, y double").repartition(7).cache()


def hand(rows, use, outcome, xs, cluster=None):
    """Coefficients and standard errors of one model, its rows chosen in Python."""
    rows = [r for r in rows if use(r)]
    ages = [r[2] for r in rows if r[2] is not None]
    mean = sum(ages) / len(ages)
    full = [r for r in rows if r[2] is not None and outcome(r) is not None and all(f(r) is not None for f in xs)]
    x = np.array([[1.0, r[1] == "female", r[2] - mean, *[f(r) for f in xs]] for r in full], float)
    y = np.array([outcome(r) for r in full], float)
    beta = np.linalg.lstsq(x, y, rcond=None)[0]
    e = y - x @ beta
    se = np.sqrt(np.diag(np.linalg.inv(x.T @ x)) * (e @ e) / (len(y) - x.shape[1]))
    if cluster:
        groups = {}
        for r, v in zip(full, e):
            groups.setdefault(cluster(r), []).append(v)
        n, k = len(e), len(groups)
        between = sum(sum(v) ** 2 / len(v) for v in groups.values())
        msb, msw = between / (k - 1), (e @ e - between) / (n - k)
        size = n / k
        se = se * math.sqrt(1 + (size - 1) * max(0.0, min(1.0, (msb - msw) / (msb + (size - 1) * msw))))
    return len(rows), len(full), beta, se


def drafts():
    early, late, measured = F.col("t") < 6, F.col("t") >= 4, F.col("lab").isNotNull() & ~F.isnan("lab")
    flags = tuple(Rule(c, early) for c in ("a", "b", "never"))
    results = tuple(Rule(c, late, "factor") for c in ("gender", "result", "b"))
    return [Draft(Model("flags", "y", ("a", "b", "never"), GENDER, "age"), early, flags),
            Draft(Model("flags_all", "y", ("a", "b", "never"), GENDER, "age", "c"), F.lit(True), flags),
            Draft(Model("lab", "y", ("lab",), GENDER, "age", F.concat("c", F.lit("_x"))), measured, (Rule("lab", measured, "number"),)),
            Draft(Model("late", "b", ("result",), WITH_RESULT, "age"), late, required=results),
            Draft(Model("nothing", "y", ("never",), GENDER, "age"), early, (Rule("never", early),)),
            Draft(Model("no_rows", "y", ("a",), GENDER, "age"), F.col("t") > 99),
            Draft(Model("one_level", "y", ("a",), GENDER, "age"), F.col("gender") == "male"),
            Draft(Model("refused", "y", ("a",), GENDER, "age"), early, required=(Rule("never", early, "factor"),))]


def test_many_models_equal_single_ones(df, rows):
    fits = {}
    for r in regress.regressions(df, drafts()).collect():
        fits.setdefault(r["source"], []).append(r)
    ok = lambda r: r[6] is not None and not math.isnan(r[6])
    y, a, b, lab = lambda r: r[10], lambda r: r[3], lambda r: r[4], lambda r: r[6]
    want = {"flags": hand(rows, lambda r: r[9] < 6, y, [a, b]), "flags_all": hand(rows, lambda r: True, y, [a, b], lambda r: r[8]),
            "lab": hand(rows, ok, y, [lab], lambda r: r[8]), "late": hand(rows, lambda r: r[9] >= 4, b, [lambda r: r[7] == "L", lambda r: r[7] == "H"])}
    assert list(fits) == list(want)
    for name, (total, used, beta, se) in want.items():
        got = fits[name]
        assert [r["term"] for r in got][:3] == ["(Intercept)", "genderfemale", "age"] and len(got) == len(beta)
        assert {(r["n_total"], r["n_used"]) for r in got} == {(total, used)}
        assert np.allclose([r["estimate"] for r in got], beta, rtol=1e-9) and np.allclose([r["std_error"] for r in got], se, rtol=1e-9)
    clusters = lambda f: len({r[8] for r in rows if r[2] is not None and r[10] is not None and f(r)})
    assert fits["flags_all"][0]["deff"] > 1 and fits["flags_all"][0]["n_clusters"] == clusters(lambda r: True)
    assert fits["lab"][0]["n_clusters"] == clusters(ok) < clusters(lambda r: True)
    assert fits["flags"][0]["model"] == "y ~ gender + age + a + b"


def test_three_passes_however_many_models(spark, df):
    counts = []
    for n in (1, 6):
        read = spark.sparkContext.accumulator(0)

        def watch(batches, read=read):
            for batch in batches:
                read.add(batch.num_rows)
                yield batch

        regress.fit_rows(df.mapInArrow(watch, df.schema), [d for d in drafts() for _ in range(n)])
        counts.append(read.value)
    assert counts == [3 * 3000] * 2


def test_empty_table(spark, df):
    assert regress.fit_rows(df.filter("id < 0"), drafts()) == [] and regress.fit_rows(df, []) == []
    assert regress.regressions(df.filter("id < 0"), drafts()).schema == regress.regressions(df, drafts()[:1]).schema
