"""Exact ranks and running sums of any group size, in two levels.

Rows get a bucket by their place in the order; one row per (group, bucket) carries the sum of what
lies before, and only a bucket is sorted in one task. Buckets are cut on a uniform hash, so they hold
about ``BUCKET_ROWS`` rows however large the group is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

BUCKET_ROWS = 20_000


def buckets_for(rows: int) -> int:
    return max(1, -(-rows // BUCKET_ROWS))


def hash_bucket(h: Column, buckets: int) -> Column:
    """Bucket of a 64-bit hash; grows with the hash, so buckets are ranges of the order by hash."""
    return F.least(F.floor((h.cast("double") / float(2**64) + 0.5) * buckets), F.lit(buckets - 1)).cast("long")


def with_running(rows: DataFrame, group: list[str], bucket: str, order: list, value: str, sums: DataFrame | None = None) -> DataFrame:
    """``rows`` with ``before``, the sum of ``value`` over earlier rows of the group, and ``whole``, the group's sum.

    ``sums``: rows that give the same buckets as ``rows`` at less cost, if there are any."""
    per_bucket = (rows if sums is None else sums).groupBy(*group, bucket).agg(F.sum(value).alias("_sum"))
    in_group = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    offsets = per_bucket.withColumn("whole", F.sum("_sum").over(in_group)).withColumn(
        "_base", F.coalesce(F.sum("_sum").over(in_group.orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_sum")
    earlier = Window.partitionBy(*group, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = rows.join(offsets, [*group, bucket])
    return out.withColumn("before", F.col("_base") + F.coalesce(F.sum(value).over(earlier), F.lit(0))).drop("_base")
