"""Small shared helpers for columns and null-safe joins."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, functions as F


def as_col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def as_list(x) -> list:
    return [x] if isinstance(x, str) else list(x)


def join_nullsafe(left: DataFrame, right: DataFrame, on, how: str = "left") -> DataFrame:
    """Equi-join that treats NULL keys as equal and keeps one copy of the key columns."""
    keys = as_list(on)
    renamed = right.withColumnsRenamed({k: f"__r_{k}" for k in keys})
    cond = reduce(and_, [left[k].eqNullSafe(renamed[f"__r_{k}"]) for k in keys])
    joined = left.join(renamed, cond, how)
    return joined if how in ("left_semi", "left_anti") else joined.drop(*[f"__r_{k}" for k in keys])


def add_all(cols) -> Column:
    """Sum of columns with NULL counted as 0."""
    return reduce(lambda a, b: a + b, [F.coalesce(as_col(c), F.lit(0)) for c in cols])


def flag(cond: Column) -> Column:
    """1 where the condition holds, 0 otherwise (also for NULL)."""
    return F.when(cond, F.lit(1)).otherwise(F.lit(0))


def join_optional(left: DataFrame, right: DataFrame, left_key, right_key: str, how: str = "left") -> DataFrame:
    """Equi-join on a key that many rows of ``left`` lack.

    Rows without key match nothing, but would all be sent to one task; those of a partition stay together, under a key
    that no row of ``right`` has. No other column of a row is read for that.
    """
    return join_keyed(left, right, left_key, right_key, F.spark_partition_id(), how).drop("__key")


def join_keyed(left: DataFrame, right: DataFrame, left_key, right_key: str, spread: Column, how: str = "left") -> DataFrame:
    """``join_optional`` with the column ``__key`` that it deals the rows by: the key, or a text from ``spread`` without one."""
    filler = F.concat(F.lit("\u0000"), spread.cast("string"))
    return (left.withColumn("__key", F.coalesce(as_col(left_key).cast("string"), filler))
            .join(right.withColumn("__key", F.col(right_key).cast("string")).filter(F.col("__key").isNotNull()), "__key", how))
