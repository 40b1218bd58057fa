"""Running values along the sequence of a key, however many rows one key or one stretch of time has.

A sequence is cut into time buckets, and where more than ``limit`` rows fall into one bucket of a key, further
into segments at borders that split the measured rows evenly. Each segment is scanned for itself. What it
inherits is computed on two levels, from one row per segment of a bucket and one row per bucket of a key.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window, functions as F

from labspark.functions.columns import as_col, as_list
from labspark.session import materialize

BUCKET_DAYS = 28
LIMIT = 50_000  # rows of a segment
PARTS = 256  # of one cut; larger buckets are cut again
SALTS = 32
BROADCAST_BORDERS = 200_000  # a checked bound: about 2 MB of times
CELLS = 2**16  # hashes that keys are counted by first
BUCKET, SEGMENT = "__bucket", "__segment"
_ROUNDS = 8


def time_bucket(t, width: int = BUCKET_DAYS) -> Column:
    """Number of the time bucket that holds ``t``."""
    return F.floor(F.unix_date(as_col(t).cast("date")) / F.lit(width)).cast("int")


def _same(left: DataFrame, right: DataFrame, keys) -> Column:
    return reduce(and_, [left[k].eqNullSafe(right[f"__r{i}"]) for i, k in enumerate(keys)])


def _renamed(df: DataFrame, keys) -> DataFrame:
    return df.withColumnsRenamed({k: f"__r{i}" for i, k in enumerate(keys)})


def whole(rows: DataFrame, pos: str) -> DataFrame:
    """``rows`` with SEGMENT where no bucket is cut."""
    return rows.withColumn(SEGMENT, F.lit(None).cast(dict(rows.dtypes)[pos]))


@dataclass(frozen=True)
class Crowd:
    """``keys`` with too many rows to be worked on whole (None: there is no such key), and the number of all rows."""

    keys: DataFrame | None
    by: tuple
    total: int
    small: bool = True

    def __bool__(self):
        return self.keys is not None

    def _join(self, df, how):
        return df.join(F.broadcast(self.keys) if self.small else self.keys, list(self.by), how).select(*df.columns)

    def within(self, df: DataFrame) -> DataFrame:
        return self._join(df, "left_semi")

    def without(self, df: DataFrame) -> DataFrame:
        """The rows of all other keys, also those without key."""
        return self._join(df, "left_anti")


def crowd(rows: DataFrame, by, limit: int = LIMIT, weigh=None, most: int = 0, times=None, cells: int = CELLS) -> Crowd:
    """Keys with more than ``limit`` rows, or with a sum of ``weigh`` above ``most``. A row counts ``times``, or once.

    Rows are counted per hash of the key first, which adds up within each task whatever the number of keys; only keys
    whose hash has too many rows are counted one by one."""
    by, n = as_list(by), F.count("*") if times is None else F.sum(times)
    sums = [n.alias("__n"), *([] if weigh is None else [F.sum(weigh).alias("__w")])]
    over = F.col("__n") > limit if weigh is None else (F.col("__n") > limit) | (F.col("__w") > most)
    rows = rows.withColumn("__cell", F.pmod(F.xxhash64(*by), F.lit(cells)).cast("int"))
    full, total = rows.groupBy("__cell").agg(*sums).agg(F.collect_list(F.when(over, F.col("__cell"))), F.coalesce(F.sum("__n"), F.lit(0))).first()
    if not full:
        return Crowd(None, tuple(by), total)
    full = rows.sparkSession.createDataFrame([(c,) for c in full], "__cell int")
    keys = rows.join(F.broadcast(full), "__cell", "left_semi").groupBy(*by).agg(*sums).filter(over).select(*by)
    keys = materialize(keys, "crowded-keys")
    many = keys.count()
    return Crowd(keys if many else None, tuple(by), total, many <= BROADCAST_BORDERS)


def cut(rows: DataFrame, by, pos: str, limit: int = LIMIT, parts: int = PARTS, broadcast_borders: int = BROADCAST_BORDERS) -> tuple[DataFrame, bool]:
    """``rows`` (stored, with BUCKET) and column SEGMENT: the lower border of a row's segment, NULL for the first of a
    bucket; and whether any bucket was cut. Rows at one position stay together."""
    by = as_list(by)
    keys = [*by, BUCKET, SEGMENT]
    rows, split = whole(rows, pos), False
    for _ in range(_ROUNDS):
        sizes = rows.groupBy(*keys).agg(F.count("*").alias("__n"), F.min(pos).alias("__low"), F.max(pos).alias("__high"))
        crowded = sizes.filter((F.col("__n") > limit) & (F.col("__low") < F.col("__high")))
        many = crowded.count()
        if not many:
            break
        crowded = materialize(crowded, "crowded")
        found = _renamed(crowded.select(*keys, "__n"), keys)
        inside = rows.join(F.broadcast(found) if many <= broadcast_borders else found, _same(rows, found, keys))
        # borders at even ranks; a sketch that is merged map-side, its error far below a segment
        at = F.percentile_approx(pos, [i / parts for i in range(1, parts)], 100 * parts)
        borders = inside.groupBy(*keys).agg(at.alias("__at"), F.first("__n").alias("__n"), F.min(pos).alias("__low"))
        wanted = F.least(F.lit(parts), F.ceil(F.col("__n") / limit)).cast("int")
        picked = F.transform(F.sequence(F.lit(1), F.greatest(wanted - 1, F.lit(1))), lambda i: F.element_at("__at", F.greatest(F.lit(1), (i * parts / F.greatest(wanted, F.lit(2))).cast("int"))))
        borders = materialize(borders.select(*keys, F.array_distinct(F.filter(picked, lambda b: b > F.col("__low"))).alias("__borders")), "borders")
        size = borders.agg(F.sum(F.size("__borders"))).first()[0] or 0
        if not size:  # ties only: nothing left to cut
            break
        split = True
        right = _renamed(borders, keys)
        if size <= broadcast_borders:
            joined = rows.join(F.broadcast(right), _same(rows, right, keys), "left")
        else:  # a crowded segment is spread over SALTS tasks while it gets its borders
            left = rows.withColumn("__salt", F.pmod(F.xxhash64(pos), F.lit(SALTS)).cast("int"))
            right = right.withColumn("__rsalt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
            joined = left.join(right, _same(left, right, keys) & (left["__salt"] == right["__rsalt"]), "left")
        below = F.array_max(F.filter("__borders", lambda b: b <= F.col(pos)))
        rows = materialize(joined.select(*[c for c in rows.columns if c != SEGMENT], F.coalesce(below, F.col(SEGMENT)).alias(SEGMENT)), "segments")
    return rows, split


def running(rows: DataFrame, by, order, how: dict, split: bool, ahead: bool = False) -> DataFrame:
    """``rows`` with every column of ``how`` replaced by its running value up to and with the row.

    ``how``: name -> an aggregate that may be taken of parts first (``F.max``, ``F.min``, ``F.sum``).
    ``order``: columns within a segment, in scan order; they start with the position. ``ahead``: scan from the end.
    """
    by, names = as_list(by), list(how)
    keys = [*by, BUCKET, SEGMENT]

    def scanned(c):
        return F.col(c).desc() if ahead else F.col(c).asc()

    def over(window):
        return [fn(n).over(window).alias(n) for n, fn in how.items()]

    cells = rows.groupBy(*keys).agg(*[fn(n).alias(n) for n, fn in how.items()])
    before = Window.partitionBy(*by).orderBy(scanned(BUCKET)).rowsBetween(Window.unboundedPreceding, -1)
    none = F.lit(None).cast(dict(rows.dtypes)[SEGMENT]).alias(SEGMENT)
    carried = cells.groupBy(*by, BUCKET).agg(*[fn(n).alias(n) for n, fn in how.items()]).select(*by, BUCKET, none, *over(before))
    if split:
        inner = Window.partitionBy(*by, BUCKET).orderBy("__own", scanned(SEGMENT)).rowsBetween(Window.unboundedPreceding, -1)
        both = cells.withColumn("__own", F.lit(1)).unionByName(carried.withColumn("__own", F.lit(0)))
        carried = both.select(*keys, "__own", *over(inner)).filter("__own = 1").drop("__own")
    first = rows.withColumn("__carry", F.lit(1)).unionByName(carried.withColumn("__carry", F.lit(0)), allowMissingColumns=True)
    scan = Window.partitionBy(*keys).orderBy("__carry", *[scanned(c) for c in order]).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    others = [c for c in rows.columns if c not in names]
    return first.select(*others, "__carry", *over(scan)).filter("__carry = 1").drop("__carry")
