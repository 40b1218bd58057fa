"""Least squares, inference and model checks."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from labspark.operators import regress
from labspark.operators.regress import Model, t_two_sided

GENDER = {"gender": ("male", "female")}


def test_t_distribution():
    known = [(2.0, 10, 0.0733880), (1.0, 1, 0.5), (12.7062, 1, 0.05), (2.5758293, 1e7, 0.01), (0.0, 5, 1.0)]
    for t, df, p in known:
        assert math.isclose(t_two_sided(t, df), p, rel_tol=2e-4), (t, df)


def test_t_distribution_against_its_density():
    for t, df in ((3.0, 30), (0.7, 4), (2.2, 7), (5.0, 120), (1.3, 1)):
        u = np.linspace(0, t, 400_001)
        c = math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(df * math.pi)
        tail = 1 - 2 * np.trapezoid(c * (1 + u * u / df) ** (-(df + 1) / 2), u)
        assert math.isclose(t_two_sided(t, df), tail, rel_tol=1e-6, abs_tol=1e-10)


def make(spark, n=400, seed=1):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        g, age, a, b = rnd.choice(["male", "female"]), rnd.randrange(20, 90), rnd.randrange(2), rnd.randrange(2)
        y = 4 + (0.3 if g == "female" else 0) + 0.01 * age + 0.5 * a - 0.2 * b + rnd.gauss(0, 0.4)
        rows.append((i, g, age, a, b, rnd.choice("NLH"), f"c{i % 40}", y))
    rows += [(-1, "unknown", 50, 1, 1, "N", "c0", 4.0), (-2, "male", None, 1, 1, "N", "c0", 4.0), (-3, "male", 50, 1, 1, "N", "c0", None)]
    return rows, spark.createDataFrame(rows, "id int, gender string, age int, a int, b int, result string, c string, y double")


def test_matches_lstsq(spark):
    rows, df = make(spark)
    fit = {r["term"]: r for r in regress.ols(df, Model("m", "y", ("a", "b"), GENDER, "age")).collect()}
    use = [r for r in rows if r[1] != "unknown" and r[2] is not None and r[7] is not None]
    mean = np.mean([r[2] for r in rows if r[2] is not None])
    x = np.array([[1, r[1] == "female", r[2] - mean, r[3], r[4]] for r in use], float)
    y = np.array([r[7] for r in use])
    beta = np.linalg.lstsq(x, y, rcond=None)[0]
    e = y - x @ beta
    se = np.sqrt(np.diag(np.linalg.inv(x.T @ x)) * (e @ e) / (len(y) - 5))
    for i, term in enumerate(["(Intercept)", "genderfemale", "age", "a", "b"]):
        r = fit[term]
        assert np.allclose([r["estimate"], r["std_error"], r["t_value"]], [beta[i], se[i], beta[i] / se[i]], rtol=1e-8)
        assert r["n_used"] == len(use) and r["n_total"] == len(rows) and math.isclose(r["mean_age"], mean)


def test_collinear_columns_are_dropped(spark):
    _, df = make(spark)
    df = df.withColumns({"twice": F.col("a") * 2, "const": F.lit(3)})
    terms = [r["term"] for r in regress.ols(df, Model("m", "y", ("a", "twice", "const", "b"), GENDER, "age")).collect()]
    assert terms == ["(Intercept)", "genderfemale", "age", "a", "b"]


def test_single_level_factor_gives_no_fit(spark):
    _, df = make(spark)
    assert regress.ols(df.filter("gender = 'male'"), Model("m", "y", ("a",), GENDER, "age")) is None
    assert regress.ols(df.filter("id < 0 and gender = 'male'"), Model("m", "y", ("a",), GENDER, "age")) is None
    factors = {**GENDER, "result": ("N", "L", "H")}
    terms = [r["term"] for r in regress.ols(df.filter("result <> 'L'"), Model("m", "y", ("result",), factors, "age")).collect()]
    assert terms == ["(Intercept)", "genderfemale", "age", "resultH"]
    terms = [r["term"] for r in regress.ols(df.filter("result <> 'N'"), Model("m", "y", ("result",), factors, "age")).collect()]
    assert terms == ["(Intercept)", "genderfemale", "age", "resultH"]


def test_cluster_scaling(spark):
    _, df = make(spark)
    df = df.withColumn("y", F.col("y") + F.crc32("c") % 7)
    plain = regress.ols(df, Model("m", "y", ("a",), GENDER, "age")).collect()
    wide = regress.ols(df, Model("m", "y", ("a",), GENDER, "age", "c")).collect()
    deff = wide[0]["deff"]
    assert deff > 1 and wide[0]["n_clusters"] == 40 and 0 < wide[0]["icc"] <= 1
    for p, w in zip(plain, wide):
        assert math.isclose(w["std_error"], p["std_error"] * math.sqrt(deff), rel_tol=1e-9)
        assert math.isclose(w["p_value"], t_two_sided(w["t_value"], 39), rel_tol=1e-9)


def test_design_effect_guards(spark):
    one = spark.createDataFrame([("a", 1.0), ("a", -1.0), ("a", 2.0)], "c string, e double")
    assert tuple(regress.design_effect(one, "e", "c").select("deff", "icc", "df").first()) == (1.0, 0.0, 2)
    each = spark.createDataFrame([("a", 1.0), ("b", -1.0)], "c string, e double")
    assert tuple(regress.design_effect(each, "e", "c").select("deff", "icc", "df").first()) == (1.0, 0.0, 1)


def test_validity_rules(spark):
    rows = [(int(i < 4), int(i < 5), 1, float(i), 2.0) for i in range(20)]
    df = spark.createDataFrame(rows, "four int, five int, always int, x double, flat double")
    assert regress.valid_covariates(df, ["four", "five", "always"], 5) == ["five"]
    assert regress.valid_covariates(df, ["x", "flat"], 5, continuous=True) == ["x"]
    assert regress.valid_levels(df, "five", 5) and not regress.valid_levels(df, "four", 5) and not regress.valid_levels(df, "always", 5)
