"""Overlapping groups of rows without copies of the rows.

Which groups a row belongs to is one bit each in a mask. Rows are reduced to cells, one per mask and key, with
partial results that can be merged; only cells, of which there are few, are copied to the groups they belong to.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from labspark.functions.columns import as_list, join_nullsafe
from labspark.functions.values import range_label
from labspark.operators.quantiles import percentiles_of_counts
from labspark.spec import PERCENTILES

WORD = 62  # groups per mask column


def masks(conditions, name: str = "__mask") -> dict[str, Column]:
    """Mask columns: bit i of word j is condition j * WORD + i; None always holds."""
    conditions, out = list(conditions), {}
    for j in range(0, max(len(conditions), 1), WORD):
        bits = F.lit(0).cast("long")
        for i, cond in enumerate(conditions[j:j + WORD]):
            bits = bits + (F.lit(1 << i) if cond is None else F.when(cond, F.lit(1 << i)).otherwise(F.lit(0)))
        out[f"{name}{j // WORD}"] = bits
    return out


def crossed_masks(sides: list[list[tuple[object, Column | None]]], name: str = "__mask") -> dict[str, Column]:
    """Masks of groups that are conjunctions: ``sides`` has, per side, the condition of every group with a value that tells
    equal conditions apart. Each distinct condition is stated once: 8 bands and 3 genders are 11 conditions, not 48."""
    out = {}
    for j in range(0, max(len(sides[0]), 1), WORD):
        word = None
        for side in sides:
            bits, conditions = {}, {}
            for i, (key, cond) in enumerate(side[j:j + WORD]):
                bits[key] = bits.get(key, 0) | 1 << i
                conditions[key] = cond
            one = F.lit(0).cast("long")
            for key, cond in conditions.items():  # equal conditions share a term; different ones have no bit in common
                one = one + (F.lit(bits[key]).cast("long") if cond is None else F.when(cond, F.lit(bits[key]).cast("long")).otherwise(F.lit(0).cast("long")))
            word = one if word is None else word.bitwiseAND(one)
        out[f"{name}{j // WORD}"] = word
    return out


def has_bit(i: int, name: str = "__mask") -> Column:
    return F.col(f"{name}{i // WORD}").bitwiseAND(F.lit(1 << (i % WORD))) != 0


def unmask(cells: DataFrame, labels: dict[int, Column], name: str = "__mask") -> DataFrame:
    """One row per (cell, group it belongs to): ``labels`` maps a group's bit to a struct whose fields become columns."""
    entries = F.array_compact(F.array(*[F.when(has_bit(i, name), label) for i, label in labels.items()]))
    kept = [c for c in cells.columns if not c.startswith(name)]
    return cells.withColumn("__g", F.explode(entries)).select(*kept, "__g.*")


def side(value: Column, compare: Column, low: Column, high: Column) -> Column:
    """Where a value lies: 0 within its reference range, 1 below, 2 above, 3 both (a range upside down), -1 without
    a range; NULL without a value. A missing bound is no bound."""
    below, above = F.coalesce(compare < low, F.lit(False)).cast("int"), F.coalesce(compare > high, F.lit(False)).cast("int")
    return F.when(value.isNotNull(), F.when(F.coalesce(low, high).isNull(), -1).otherwise(below + 2 * above))


def side_counts(n: Column, side: Column) -> list[Column]:
    """Published counts by ``side``; ``n``: rows that a row stands for."""
    sides = {"n_na": None, "n_below_ref": (1, 3), "n_within_ref": (0,), "n_above_ref": (2, 3), "n_no_ref": (-1,)}
    return [F.coalesce(F.sum(F.when(side.isNull() if s is None else side.isin(*s), n)), F.lit(0)).alias(c) for c, s in sides.items()]


UNITS = {"ref_low_unit": "reference_low_units", "ref_high_unit": "reference_high_units"}


def group_statistics(df: DataFrame, word: dict[str, Column], labels: list[Column], keys=("code", "unit"), value="value", compare="value_compare",
                     patient="patient", probs=None, digits: int = 3) -> DataFrame:
    """``describe.value_statistics`` per group and key. ``word``: the groups' mask columns, ``labels``: a struct per group.

    The rows are reduced to means, to cells, to values and to patients per mask. A patient's groups are the union of
    the rows' masks, so that distinct patients are counted by mask.
    """
    keys, probs = as_list(keys), {**(probs or PERCENTILES), "median_value": 0.5}
    labels, names = dict(enumerate(labels)), list(word)
    units = [u for u in UNITS if u in df.columns]
    low, high = F.round("ref_low", digits), F.round("ref_high", digits)
    v = F.col("__v")
    rows = df.withColumns({**word, "__v": F.col(value).cast("double"), "__side": side(F.col(value), F.col(compare), low, high), "__range": range_label("ref_low", "ref_high")})

    texts = {"reference_ranges": "__range", **{UNITS[u]: u for u in units}}
    cells = rows.groupBy(*keys, *names).agg(
        F.count(F.lit(1)).alias("n"), F.count(v).alias("__k"), F.avg(v).alias("__avg"), (F.var_pop(v) * F.count(v)).alias("__q"),
        F.min(v).alias("min_value"), F.max(v).alias("max_value"), *side_counts(F.lit(1).cast("long"), F.col("__side")), *[F.collect_set(c).alias(t) for t, c in texts.items()])
    each = unmask(cells, labels)
    by = [c for c in each.columns if c not in cells.columns] + keys
    # means are summed over rows, one sum per group side by side: means of cells would round differently
    wide = rows.groupBy(*keys).agg(*[F.avg(F.when(has_bit(i), v)).alias(f"__a{i}") for i in labels])
    means = wide.select(*keys, F.inline(F.array(*[F.struct(label.alias("g"), F.col(f"__a{i}").alias("__mean")) for i, label in labels.items()]))).select(*keys, "g.*", "__mean")
    each = join_nullsafe(each, means, by)
    off = F.col("__avg") - F.col("__mean")  # squares around the cell's mean, then around the group's: no difference of large sums
    sums = ("n", "n_na", "n_below_ref", "n_within_ref", "n_above_ref", "n_no_ref")
    stats = each.groupBy(*by).agg(
        F.first("__mean").alias("mean_value"), F.sum(F.col("__q") + F.when(F.col("__k") > 0, F.col("__k") * off * off)).alias("__q"), F.sum("__k").alias("__k"),
        F.min("min_value").alias("min_value"), F.max("max_value").alias("max_value"), *[F.sum(c).alias(c) for c in sums],
        *[F.array_sort(F.array_distinct(F.flatten(F.collect_list(t)))).alias(t) for t in texts])
    stats = stats.select(*by, "mean_value", F.when(F.col("__k") > 1, F.sqrt(F.col("__q") / (F.col("__k") - 1))).alias("sd_value"), "min_value", "max_value", *sums,
                         *[F.when(F.size(t) > 0, F.array_join(t, ", ")).alias(t) for t in texts])

    per_patient = rows.filter(F.col(patient).isNotNull()).groupBy(*keys, patient).agg(*[F.bit_or(m).alias(m) for m in names])
    patients = unmask(per_patient.groupBy(*keys, *names).agg(F.count(F.lit(1)).alias("__p")), labels).groupBy(*by).agg(F.sum("__p").alias("n_pat"))
    out = join_nullsafe(stats, patients, by).withColumn("n_pat", F.coalesce("n_pat", F.lit(0)))

    values = rows.filter(v.isNotNull()).groupBy(*keys, *names, v.alias("v")).agg(F.count(F.lit(1)).alias("n"))
    counts = unmask(values, labels).groupBy(*by, "v").agg(F.sum("n").alias("n"))
    return join_nullsafe(out, percentiles_of_counts(counts, by, probs), by)


def group_counts(df: DataFrame, word: dict[str, Column], labels: list[Column], keys, sums: dict[str, Column] | None = None, n: str = "n") -> DataFrame:
    """Rows, and sums of columns, per group and key."""
    keys = as_list(keys)
    cells = df.withColumns(word).groupBy(*keys, *word).agg(F.count(F.lit(1)).alias(n), *[c.alias(s) for s, c in (sums or {}).items()])
    each = unmask(cells, dict(enumerate(labels)))
    by = [c for c in each.columns if c not in cells.columns or c in keys]
    return each.groupBy(*by).agg(F.sum(n).alias(n), *[F.sum(s).alias(s) for s in (sums or {})])
