"""The registered text queries against their SQL, on the smallest driver tables."""

import math
import os

import duckdb
import pytest

from labspark.llm.queries import ORACLES, QUERIES

SF_DIR = os.environ.get("LABSPARK_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="driver tables not found")


def plain(v):
    return None if isinstance(v, float) and math.isnan(v) else 0.0 if v == 0 and not isinstance(v, bool) else v


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_query(spark, key):
    df = QUERIES[key](spark, SF_DIR)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=str)
    assert got
    if key in ORACLES:
        con = duckdb.connect()
        for t in ("documents", "embeddings"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
        result = con.execute(ORACLES[key])
        names = [d[0] for d in result.description]
        assert sorted(names) == cols
        assert got == sorted((tuple(plain(r[names.index(c)]) for c in cols) for r in result.fetchall()), key=str)
