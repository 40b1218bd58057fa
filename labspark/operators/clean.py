"""Cleaning measurements: repeats, extreme values, duplicate ids, unit checks."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, Window, functions as F

from labspark.functions.columns import as_col, as_list, join_nullsafe
from labspark.functions.dates import partial_date
from labspark.functions.values import implausible
from labspark.operators.quantiles import percentiles, percentiles_of_counts, value_counts, with_percentiles
from labspark.session import few, materialize
from labspark.spec import Range

OLD = "__old"  # a later issue of the row is there
MAD_SCALE = 1.4826  # makes the median absolute deviation comparable with a standard deviation


# --- projections and filters -----------------------------------------------------------------
def project(df: DataFrame, mapping: dict, distinct: bool = True) -> DataFrame:
    """Select ``{output: column}``, by default without duplicate rows."""
    out = df.select(*[as_col(c).alias(n) for n, c in mapping.items()])
    return out.distinct() if distinct else out


def main_intervals(df: DataFrame, main: str, type_col="type", start="period_start", end="period_end") -> DataFrame:
    """Encounters of the main type or without type, not ending before they start; adds ``time``."""
    s, e, kind = F.col(start), F.col(end), F.col(type_col)
    return (df.filter((kind.isNull() | (kind == main)) & ~F.coalesce(s > e, F.lit(False)))
            .withColumn("time", s))


def cohort(df: DataFrame, age: tuple | None = None, gender: str | None = None) -> DataFrame:
    """Optional age band (both ends in) and gender."""
    if age is not None:
        df = df.filter(F.col("age").between(*age))
    return df if gender is None else df.filter(F.col("gender") == gender)


def min_age(df: DataFrame, above: int = 1, age="age") -> DataFrame:
    """Age above the limit or unknown."""
    return df.filter((F.col(age) > above) | F.col(age).isNull())


def implausible_report(df: DataFrame, value: str, rng: Range, keys=()) -> DataFrame:
    """Count, min, max and median of the values outside the plausibility limits."""
    bad, keys = df.filter(implausible(value, rng)), as_list(keys)
    stats = bad.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_implausible"), F.min(value).alias("min_implausible"),
                                   F.max(value).alias("max_implausible"))
    return with_percentiles(stats, bad, keys, value, {"median_implausible": 0.5})


# --- birth dates -----------------------------------------------------------------------------
def birthdate_quality(df: DataFrame, raw: str) -> DataFrame:
    c, size = F.col(raw), F.length(F.trim(F.col(raw)))
    parsed = partial_date(raw)
    return df.agg(
        F.count_if(parsed.isNotNull() & (size == 10)).alias("complete"),
        F.count_if(c.isNull()).alias("missing"),
        F.count_if(c.isNotNull() & parsed.isNull()).alias("unparseable"),
        F.count_if(size == 4).alias("year_only"),
        F.count_if(size == 7).alias("year_month_only"))


# --- comparison values -----------------------------------------------------------------------
def off_grid_report(df: DataFrame, keys=("code", "unit"), value="value", digits: int = 3) -> DataFrame:
    """Groups with values that have more decimals than the comparison keeps."""
    v = F.col(value)
    off = F.abs(v - F.round(v, digits)) > 1e-9
    return (df.filter(v.isNotNull()).groupBy(*keys)
            .agg(F.count(F.lit(1)).alias("n"), F.count_if(off).alias("n_off_grid")).filter("n_off_grid > 0"))


def comparator_report(df: DataFrame, keys=("code", "unit", "comparator", "value")) -> DataFrame:
    return (df.filter(F.col("comparator").isNotNull()).groupBy(*keys).agg(F.count(F.lit(1)).alias("n")))


# --- repeated measurements -------------------------------------------------------------------
def ids_in_repeats(df: DataFrame, within, group, obs="obs_id", at_least: int = 2) -> DataFrame:
    """Number of ids whose ``within`` key occurs in a group with that many different ids."""
    keys = (df.dropna(subset=as_list(within)).groupBy(*as_list(group)).agg(F.count_distinct(obs).alias("__n"))
            .filter(F.col("__n") >= at_least).select(*as_list(within)).distinct())
    return df.join(keys, as_list(within), "left_semi").agg(F.count_distinct(obs).alias("n"))


def repeat_report(df: DataFrame, by="patient", t="time", code="code", obs="obs_id", issued="issued") -> DataFrame:
    """Ids that share patient and time (and code), and how ``issued`` compares in repeated rows."""
    counts = [ids_in_repeats(df, [by, t], [by, t], obs).select(F.lit("same_time").alias("metric"), "n"),
              ids_in_repeats(df, [by, t], [by, t, code], obs).select(F.lit("same_time_code").alias("metric"), "n"),
              ids_in_repeats(df, [by, t], [by, t, code], obs, 3).select(F.lit("same_time_code_3").alias("metric"), "n")]
    group = [by, t, code]
    repeated = df.groupBy(*group).count().filter("count >= 2").drop("count")
    rows = join_nullsafe(df, repeated, group, "left_semi")
    i, when, o = F.col(issued), F.col(t), F.col(obs)
    wide = rows.agg(F.count_distinct(F.when(i.isNull(), o)).alias("issued_na"),
                    F.count_distinct(F.when(i == when, o)).alias("issued_identical"),
                    F.count_distinct(F.when(i < when, o)).alias("issued_before"),
                    F.count_distinct(F.when(i > when, o)).alias("issued_after"))
    long = wide.unpivot([], ["issued_na", "issued_identical", "issued_before", "issued_after"], "metric", "n")
    return reduce(DataFrame.unionByName, counts).unionByName(long)


def _repeat_groups(df, group, issued):
    """Per group: rows, latest issue time and number of rows that carry it."""
    per_issue = df.groupBy(*group, issued).agg(F.count(F.lit(1)).alias("__c"))
    latest = F.max(F.struct(F.col(issued), F.col("__c")))  # a NULL issue time sorts first
    return (per_issue.groupBy(*group).agg(F.sum("__c").alias("n_dup"), latest.alias("__l"))
            .select(*group, "n_dup", F.col("__l")[issued].alias("max_issued"), F.col("__l")["__c"].alias("n_max")))


def distinct_repeats(df: DataFrame, group=("patient", "time", "code"), t="time", issued="issued") -> DataFrame:
    """Distinct rows, marked in OLD where another row of the group was issued later. One shuffle serves both."""
    return superseded(df.repartition(*as_list(group)).distinct(), group, t, issued)


def distinct_dealt(df: DataFrame, group, t="time", issued="issued") -> DataFrame:
    """``distinct_repeats`` of rows that may be dealt by a column of the group already. Repeated rows change no mark, so
    they go last: the shuffle that the groups need, if any, serves the distinct rows too."""
    return superseded(df, group, t, issued).distinct()


def superseded(df: DataFrame, group, t="time", issued="issued") -> DataFrame:
    """Adds OLD. A group holds the repeats of one instant, so it is compared in a window."""
    newest = F.max(issued).over(Window.partitionBy(*as_list(group)))  # a row that is not older than itself is the newest or has repeats
    return df.withColumn(OLD, F.coalesce(F.col(t).isNotNull() & newest.isNotNull() & (F.col(issued).isNull() | (F.col(issued) < newest)), F.lit(False)))


def dedupe_repeats(df: DataFrame, group=("patient", "time", "code"), t="time", issued="issued",
                   scope: str | None = None) -> DataFrame:
    """Keeps the latest issued rows of every group of repeats; ties stay.

    Nothing is removed unless some row of the table (of the same ``scope`` value, if given) was
    issued after its own time, which shows that ``issued`` carries information at all.
    """
    return drop_superseded(superseded(df, group, t, issued), t, issued, scope, df)


def drop_superseded(rows: DataFrame, t="time", issued="issued", scope: str | None = None, df: DataFrame | None = None) -> DataFrame:
    """``dedupe_repeats`` for rows marked by ``superseded``; ``df``: the same rows, if they are at hand unmarked."""
    df = rows if df is None else df
    later = F.coalesce(F.bool_or(F.col(issued) > F.col(t)), F.lit(False))
    if scope is None:
        return rows.filter(~(F.col(OLD) & df.agg(later.alias("x")).scalar())).drop(OLD)
    kept = join_nullsafe(rows, few(df.groupBy(scope).agg(later.alias("__later")), "scopes"), scope)
    return kept.filter(~(F.col(OLD) & F.col("__later"))).drop(OLD, "__later")


def dedupe_counts(df: DataFrame, group=("patient", "time", "code"), t="time", issued="issued") -> DataFrame:
    """Rows that ``dedupe_repeats`` removes and groups it cannot decide."""
    group = as_list(group)
    informative = F.col("n_later") > 0
    # everything needed is a sum over groups, so no row is joined back
    per_issue = df.groupBy(*group, issued).agg(F.count(F.lit(1)).alias("__c"))
    per_group = per_issue.groupBy(*group).agg(
        F.sum("__c").alias("n_dup"), F.max(F.struct(F.col(issued), F.col("__c"))).alias("__l"),
        F.sum(F.when(F.col(issued) > F.col(t), F.col("__c")).otherwise(0)).alias("n_later"))
    repeats = F.col(t).isNotNull() & (F.col("n_dup") >= 2)
    latest, n_max = F.col("__l")[issued], F.col("__l")["__c"]
    return per_group.agg(
        F.coalesce(F.sum("n_later"), F.lit(0)).alias("n_later"),
        F.coalesce(F.sum(F.when(repeats & latest.isNotNull(), F.col("n_dup") - n_max)), F.lit(0)).alias("removed"),
        F.count_if(repeats & (latest.isNull() | (n_max >= 2))).alias("unclear"),
    ).select(F.when(informative, F.col("removed")).otherwise(0).alias("removed"),
             F.when(informative, F.col("unclear")).otherwise(0).alias("unclear"))


# --- extreme values --------------------------------------------------------------------------
def mad_table(counts: DataFrame, keys) -> DataFrame:
    """Median and scaled median absolute deviation per group, from value counts."""
    keys = as_list(keys)
    med = percentiles_of_counts(counts, keys, {"__med": 0.5})
    dev = (join_nullsafe(counts, med, keys).withColumn("v", F.abs(F.col("v") - F.col("__med")))
           .groupBy(*keys, "v").agg(F.sum("n").alias("n")))
    mad = percentiles_of_counts(dev, keys, {"__mad": 0.5}).withColumn("__mad", F.col("__mad") * MAD_SCALE)
    return join_nullsafe(med, mad, keys)


def _is_extreme(value, cutoff):
    # a spread of 0 or NULL gives no usable test
    return F.coalesce((F.col("__mad") > 0) & (F.abs((as_col(value) - F.col("__med")) / F.nullif(F.col("__mad"), F.lit(0.0))) > cutoff),
                      F.lit(False))


def mad_filter(df: DataFrame, keys=("code", "unit"), value="value", cutoff: float = 15.0) -> DataFrame:
    """Removes values more than ``cutoff`` scaled deviations away from their group's median."""
    keys = as_list(keys)
    counts = materialize(value_counts(df, keys, value), "value-counts")
    spread = few(mad_table(counts, keys), "spread")
    return join_nullsafe(df, spread, keys).filter(~_is_extreme(value, cutoff)).select(*df.columns)


def mad_report(df: DataFrame, keys=("code", "unit"), value="value", cutoff: float = 15.0) -> DataFrame:
    """Count, min, max and median of the values ``mad_filter`` removes, for every group."""
    keys = as_list(keys)
    counts = value_counts(df, keys, value)
    bad = join_nullsafe(counts, mad_table(counts, keys), keys).filter(_is_extreme("v", cutoff)).select(*keys, "v", "n")
    stats = bad.groupBy(*keys).agg(F.sum("n").alias("n_implausible"), F.min("v").alias("min_implausible"),
                                   F.max("v").alias("max_implausible"))
    stats = join_nullsafe(stats, percentiles_of_counts(bad, keys, {"median_implausible": 0.5}), keys)
    return (join_nullsafe(df.select(*keys).distinct(), stats, keys)
            .withColumn("n_implausible", F.coalesce("n_implausible", F.lit(0)).cast("bigint")))


# --- ids, references, units ------------------------------------------------------------------
def duplicate_ids(df: DataFrame, id_: str, code: str | None = None) -> DataFrame:
    """Ids with several rows, and with several rows of the same code."""
    out = df.groupBy(id_).count().agg(F.count_if(F.col("count") > 1).alias("n_ids"))
    if code is None:
        return out
    pairs = df.groupBy(id_, code).count().agg(F.count_if(F.col("count") > 1).alias("n_pairs"))
    return out.select(F.lit("ids").alias("metric"), F.col("n_ids").alias("n")).unionByName(
        pairs.select(F.lit("ids_and_code").alias("metric"), F.col("n_pairs").alias("n")))


def code_combinations(df: DataFrame, id_: str, code: str) -> DataFrame:
    """How often which codes occur together in one id."""
    combo = F.array_join(F.array_sort(F.collect_set(code)), ", ")
    per_id = df.groupBy(id_).agg(F.when(F.count(code) > 0, combo).alias("code_combo"))
    return per_id.groupBy("code_combo").agg(F.count(F.lit(1)).alias("n_ids"))


def dangling(df: DataFrame, col: str) -> DataFrame:
    """Rows whose looked-up id is missing."""
    return df.agg(F.count_if(F.col(col).isNull()).alias("n"))


def unit_mismatch(df: DataFrame, unit="unit", low="ref_low_unit", high="ref_high_unit") -> DataFrame:
    u = F.col(unit)
    return (df.filter(reduce(or_, [F.coalesce(u != F.col(c), F.lit(False)) for c in (low, high)]))
            .groupBy(unit, low, high).agg(F.count(F.lit(1)).alias("n")))


def counts(df: DataFrame, *cols, name="n") -> DataFrame:
    return df.groupBy(*cols).agg(F.count(F.lit(1)).alias(name))


def missing_report(df: DataFrame, value="value", unit="unit", norm=None) -> DataFrame:
    v, u = F.col(value), F.col(unit)
    cols = [F.count_if(v.isNotNull() & u.isNull()).alias("n_value_without_unit"),
            F.count_if(v.isNull()).alias("n_missing_value")]
    if norm:
        cols.append(F.count_if(v.isNotNull() & F.col(norm).isNull()).alias("n_norm_null"))
    return df.agg(*cols)


def shared_instants(df: DataFrame, by="patient", t="time") -> DataFrame:
    """Number of (patient, time) with more than one row."""
    return df.groupBy(by, t).count().agg(F.count_if(F.col("count") > 1).alias("n"))
