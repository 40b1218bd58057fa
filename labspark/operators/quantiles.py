"""Exact percentiles of groups of any size, by radix selection.

Values are first counted per (group, value) and mapped to 64-bit integers of the same order. Counts by the
leading bits tell which cells hold the wanted ranks; only values of those cells go on, to be counted by 20 more
bits, until a cell holds at most 2,048 different values, which are ordered. However close the values of a group lie
together, no group is gathered in one task, and what is ordered in one task is bounded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from labspark.functions.columns import as_col, as_list, join_nullsafe

ROUNDS = (31, 11)  # bits that a round leaves aside: 2**20 cells per power of two at most, then 20 bits more
_LEAST, _STEPS = -1074, 2.0**51  # exponent of the smallest positive double; integers per power of two


def with_ordered_bits(df: DataFrame, v: str = "v", name: str = "__bits") -> DataFrame:
    """Adds a 64-bit integer that grows with ``v``: exponent, then the leading 51 bits of the fraction. NaN comes last, as
    everywhere in Spark's order; both zeros are equal."""
    x = F.abs(v)
    finite = (x > 0) & (x < float("inf"))
    # the logarithm may round across a power of two: the quotient tells, and is exact
    e = df.withColumn("__e", F.when(finite, F.least(F.lit(1023.0), F.greatest(F.lit(float(_LEAST)), F.floor(F.log2(x)).cast("double")))))
    e = e.withColumn("__f", F.when(finite, x / F.pow(F.lit(2.0), "__e")))
    up, down = F.col("__f") >= 2, F.col("__f") < 1
    exponent = F.col("__e") + F.when(up, 1.0).when(down, -1.0).otherwise(0.0)
    fraction = F.when(up, F.col("__f") / 2).when(down, F.col("__f") * 2).otherwise(F.col("__f"))
    size = (exponent - _LEAST).cast("bigint") * F.lit(int(_STEPS)) + F.floor((fraction - 1) * _STEPS) + 1
    last = 2200 * int(_STEPS)
    bits = F.when(F.isnan(v), last + 1).when(F.col(v) == float("inf"), last).when(F.col(v) == float("-inf"), -last).when(F.col(v) > 0, size).when(F.col(v) < 0, -size).otherwise(F.lit(0))
    return e.withColumn(name, bits.cast("bigint")).drop("__e", "__f")


def value_counts(df: DataFrame, keys, value) -> DataFrame:
    """Rows per (keys, value) without NULL values: columns ``v`` and ``n``."""
    return (df.select(*as_list(keys), as_col(value).cast("double").alias("v")).filter(F.col("v").isNotNull())
            .groupBy(*as_list(keys), "v").agg(F.count(F.lit(1)).alias("n")))


def percentiles_of_counts(counts: DataFrame, keys, probs: dict[str, float]) -> DataFrame:
    """Continuous (interpolated) percentiles per group from ``value_counts``.

    ``probs`` maps output names to fractions. Groups without any value get no row.
    """
    keys = as_list(keys)
    total = F.col("__total")
    ranks = sorted({float(p) for p in probs.values()})

    def rank(p, up, total):
        pos = F.lit(float(p)) * (total - 1)
        return (F.ceil(pos) if up else F.floor(pos)).cast("bigint")

    wanted = F.array(*[rank(p, up, total) for p in ranks for up in (False, True)])
    counts = with_ordered_bits(counts.select(*keys, "v", "n"))

    def values_of(cells, shift):
        """Values of the cells, with the number of smaller rows; a cell's number goes with all its leading bits."""
        rows, on = counts.withColumn("__cell", F.shiftright("__bits", shift)), [*keys, "__cell"]
        return join_nullsafe(rows, cells, on, "inner") if keys else rows.join(cells, on)

    cells = None
    for i, shift in enumerate(ROUNDS):
        inside = counts if cells is None else values_of(cells, ROUNDS[i - 1])
        outer = [] if cells is None else ["__cell", "__base", "__total"]
        group = Window.partitionBy(*keys, *outer)
        upto = group.orderBy("__next").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        cells = inside.groupBy(*keys, *outer, F.shiftright("__bits", shift).alias("__next")).agg(F.sum("n").alias("__m")).withColumn("__hi", F.sum("__m").over(upto))
        cells = cells.withColumn("__hi", F.col("__hi") + F.col("__base")) if outer else cells.withColumn("__total", F.sum("__m").over(group))
        lo, hi = F.col("__hi") - F.col("__m"), F.col("__hi")
        cells = cells.filter(F.exists(wanted, lambda r: (r >= lo) & (r < hi))).select(*keys, F.col("__next").alias("__cell"), lo.alias("__base"), "__total")
    inside = values_of(cells, ROUNDS[-1])

    run = (Window.partitionBy(*keys, "__cell").orderBy("v")
           .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = (inside.withColumn("__end", F.col("__base") + F.sum("n").over(run))
              .withColumn("__start", F.col("__end") - F.col("n")))

    def at(p, up):
        r = rank(p, up, total)
        return F.max(F.when((F.col("__start") <= r) & (r < F.col("__end")), F.col("v")))

    aggs, names = [F.max("__total").alias("__total")], {}
    for i, p in enumerate(ranks):
        names[p] = i
        aggs += [at(p, False).alias(f"__lo{i}"), at(p, True).alias(f"__hi{i}")]
    out = placed.groupBy(*keys).agg(*aggs)

    def interpolated(p):
        i = names[float(p)]
        pos = F.lit(float(p)) * (total - 1)
        low, high = F.col(f"__lo{i}"), F.col(f"__hi{i}")
        # equal neighbours need no interpolation, which would turn two infinities into NaN
        return F.when((low == high) | (pos == F.floor(pos)), low).otherwise(low + (high - low) * (pos - F.floor(pos)))

    return out.select(*keys, *[interpolated(p).alias(n) for n, p in probs.items()])


def percentiles(df: DataFrame, keys, value, probs: dict[str, float]) -> DataFrame:
    return percentiles_of_counts(value_counts(df, keys, value), keys, probs)


def with_percentiles(stats: DataFrame, df: DataFrame, keys, value, probs: dict[str, float]) -> DataFrame:
    """Adds percentiles of ``value`` to per-group statistics of the same ``df``."""
    keys = as_list(keys)
    if not keys:
        # one row on both sides; a constant key keeps it an equi-join
        left, right = stats.withColumn("__one", F.lit(1)), df.withColumn("__one", F.lit(1))
        return left.join(percentiles(right, "__one", value, probs), "__one", "left").drop("__one")
    return join_nullsafe(stats, percentiles(df, keys, value, probs), keys)
