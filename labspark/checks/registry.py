"""Registry of queries: each takes (spark, sf_dir) and returns a DataFrame."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession, functions as F

from labspark.sources import fixtures

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """Driver tables and adapters by attribute: ``t.events``, ``t.fx_obs``."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir, self._shared = spark, sf_dir, {}

    def __getattr__(self, name: str) -> DataFrame:
        return fixtures.units(self.spark) if name == "fx_units" else fixtures.load(self.spark, self.sf_dir, name, self._shared)


def query(key: str, sql: str | None = None):
    """Registers ``fn(tables)`` under ``key``, with the SQL that gives the same rows if there is one."""
    def register(fn):
        QUERIES[key] = partial(_run, fn)
        if sql is not None:
            ORACLES[key] = sql
        return fn
    return register


def _run(fn, spark: SparkSession, sf_dir: str) -> DataFrame:
    return fn(Tables(spark, sf_dir))


def rounded(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    """Doubles rounded so that both engines print the same digits."""
    cols = cols or tuple(f.name for f in df.schema if f.dataType.typeName() == "double")
    return df.withColumns({c: F.round(c, digits) for c in cols})
