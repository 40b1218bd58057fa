"""Registered queries against the SQL that states the same result, on the smallest driver tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from labspark.checks import load_all

SF_DIR = os.environ.get("LABSPARK_SF_DIR", "/root/testdata/sf0.001")
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations").split()
# whole studies take minutes together: all of them only on request
SLOW = {"describe_measurements", "sample_quality", "compare_samples", "cooccurrence_study", "covariate_regressions", "after_outcome_regressions",
        "condition_timing", "regression_exclusions", "encounter_reference_check", "sample_measurements", "value_statistics_published"}
QUERIES, ORACLES = load_all()
KEYS = [k for k in QUERIES if os.environ.get("LABSPARK_ALL") or k not in SLOW]
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="driver tables not found")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    return con


def plain(v):
    return None if isinstance(v, float) and math.isnan(v) else 0.0 if v == 0 else v


def sorted_rows(rows):
    return sorted((tuple(plain(v) for v in r) for r in rows), key=lambda r: tuple((v is None, str(v)) for v in r))


@pytest.mark.parametrize("key", KEYS)
def test_query(spark, duck, key):
    df = QUERIES[key](spark, SF_DIR)
    cols = sorted(df.columns)
    got = sorted_rows([[r[c] for c in cols] for r in df.collect()])
    if key not in ORACLES:
        return
    result = duck.execute(ORACLES[key])
    names = [d[0] for d in result.description]
    assert sorted(names) == cols
    assert got == sorted_rows([[r[names.index(c)] for c in cols] for r in result.fetchall()])


def test_every_sql_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert rows and {"code", "unit", "n_pat"} <= set(rows[0].asDict())
