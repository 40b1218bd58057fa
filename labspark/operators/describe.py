"""Descriptive aggregates."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from labspark.functions.columns import add_all, as_list, join_nullsafe
from labspark.functions.dates import month_of
from labspark.functions.values import range_label
from labspark.operators import cells
from labspark.operators.quantiles import percentiles, with_percentiles
from labspark.spec import AGE_BANDS, GENDERS, PERCENTILES, Cohort


def n_rows(name="n") -> Column:
    return F.count(F.lit(1)).alias(name)


def sorted_labels(c) -> Column:
    """Distinct values as one sorted, comma-separated text; NULL when there are none."""
    return F.when(F.count(c) > 0, F.array_join(F.array_sort(F.collect_set(c)), ", "))


# --- cohorts ---------------------------------------------------------------------------------
COHORT_COLUMNS = ("age_min", "age_max", "cohort_gender")


def standard_cohorts() -> list[Cohort]:
    return [Cohort(lo, hi, g) for lo, hi in AGE_BANDS for g in GENDERS]


def _labels(c: Cohort) -> Column:
    return F.struct(*[F.lit("all" if x is None else str(x)).alias(n) for x, n in zip((c.age_min, c.age_max, c.gender), COHORT_COLUMNS, strict=True)])


def cohort_masks(cohorts: list[Cohort] | None = None, age="age", gender="gender") -> tuple[dict[str, Column], list[Column]]:
    """Mask columns of the cohorts (``cells``) and the labels of each. Bounds and gender are text, ``all`` where a cohort has no restriction."""
    chosen = cohorts or standard_cohorts()
    ages = [((c.age_min, c.age_max), None if c.age_min is None else F.col(age).between(c.age_min, c.age_max)) for c in chosen]
    genders = [(c.gender, None if c.gender is None else F.col(gender) == c.gender) for c in chosen]
    return cells.crossed_masks([ages, genders]), [_labels(c) for c in chosen]


def with_cohorts(df: DataFrame, cohorts: list[Cohort] | None = None, age="age", gender="gender") -> DataFrame:
    """One row per (row, cohort it belongs to). Cohorts may overlap; statistics over them do not need these rows (``cells``)."""
    def entry(c: Cohort):
        cond = F.lit(True) if c.age_min is None else F.col(age).between(c.age_min, c.age_max)
        return F.when(cond if c.gender is None else cond & (F.col(gender) == c.gender), _labels(c))

    entries = F.array_compact(F.array(*[entry(c) for c in (cohorts or standard_cohorts())]))
    return df.withColumn("__c", F.explode(entries)).select(*df.columns, "__c.*")


def with_groups(df: DataFrame, conditions: dict[str, Column | None], name="cohort") -> DataFrame:
    """One row per (row, named condition that holds); None always holds."""
    entries = [F.lit(n) if c is None else F.when(c, F.lit(n)) for n, c in conditions.items()]
    return df.withColumn(name, F.explode(F.array_compact(F.array(*entries))))


# --- value statistics ------------------------------------------------------------------------
def value_statistics(df: DataFrame, keys=("code", "unit"), value="value", compare="value_compare",
                     patient="patient", probs=None, digits: int = 3) -> DataFrame:
    """Moments, percentiles and counts relative to the reference range per group."""
    keys, probs = as_list(keys), probs or PERCENTILES
    v = F.col(value)
    where = cells.side(v, F.col(compare), F.round("ref_low", digits), F.round("ref_high", digits))
    stats = df.withColumn("__side", where).groupBy(*keys).agg(
        F.avg(v).alias("mean_value"), F.stddev(v).alias("sd_value"), F.min(v).alias("min_value"), F.max(v).alias("max_value"), n_rows(),
        *cells.side_counts(F.lit(1).cast("long"), F.col("__side")),
        sorted_labels(range_label("ref_low", "ref_high")).alias("reference_ranges"),
        *[sorted_labels(u).alias(n) for u, n in cells.UNITS.items() if u in df.columns])
    patients = df.groupBy(*keys).agg(F.count_distinct(patient).alias("n_pat"))
    out = join_nullsafe(stats, patients, keys)
    return with_percentiles(out, df, keys, value, {**probs, "median_value": 0.5})


def cohort_statistics(df: DataFrame, cohorts: list[Cohort] | None = None, keys=("code", "unit"), **kw) -> DataFrame:
    """``value_statistics`` per cohort and key, without a copy of the rows per cohort."""
    return cells.group_statistics(df, *cohort_masks(cohorts), keys, **kw)


def value_bin(compare, lo: float, hi: float, per_unit: int) -> Column:
    """Number of the histogram bin; everything below ``lo`` and from ``hi`` on shares one bin each."""
    c = F.col(compare)
    return F.when(c < lo, int(lo * per_unit) - 1).when(c >= hi, int(hi * per_unit)).otherwise(F.floor(c * per_unit)).cast("int")


def fill_bins(counted: DataFrame, groups: DataFrame, keys, lo: float, hi: float, per_unit: int) -> DataFrame:
    """Every bin of every group, from counts per (keys, __bin) in ``__n``."""
    first, last = int(lo * per_unit), int(hi * per_unit) - 1
    bins = groups.withColumn("__bin", F.explode(F.sequence(F.lit(first - 1), F.lit(last + 1))))
    x = F.col("__bin")
    return zero_fill(counted, bins, [*keys, "__bin"], "__n").select(
        *keys,
        F.when(x >= first, x / F.lit(float(per_unit))).alias("bin_start"),
        F.when(x <= last, (x + 1) / F.lit(float(per_unit))).alias("bin_end"),
        F.col("__n").alias("n"))


def value_distribution(df: DataFrame, keys=("code", "unit"), value="value", compare="value_compare",
                       lo: float = 2.0, hi: float = 8.0, per_unit: int = 10, spine: DataFrame | None = None) -> DataFrame:
    """Histogram with zero-filled bins of width 1/per_unit and one open bin at each end.

    ``spine`` holds the key combinations that get a full set of bins (default: those in ``df``).
    """
    keys = as_list(keys)
    rows = df.filter(F.col(value).isNotNull())
    counted = rows.groupBy(*keys, value_bin(compare, lo, hi, per_unit).alias("__bin")).agg(n_rows("__n"))
    groups = rows.select(*keys).distinct() if spine is None else spine.select(*keys).distinct()
    return fill_bins(counted, groups, keys, lo, hi, per_unit)


def cohort_distribution(df: DataFrame, cohorts: list[Cohort] | None = None, keys=("code", "unit"), value="value", compare="value_compare",
                        lo: float = 2.0, hi: float = 8.0, per_unit: int = 10) -> DataFrame:
    """Histogram per cohort with a full set of bins for every group of the whole table.

    Cohorts without any row are left out.
    """
    keys, groups = as_list(keys), cohort_masks(cohorts)
    rows = df.filter(F.col(value).isNotNull())
    counted = cells.group_counts(rows.withColumn("__bin", value_bin(compare, lo, hi, per_unit)), *groups, [*keys, "__bin"], n="__n")
    # every group with every present cohort: both sides are small sets of labels, and the cohort
    # labels are gathered into one array so that no join without keys is needed
    present = cells.group_counts(df, *groups, []).agg(F.collect_list(F.struct(*COHORT_COLUMNS)).alias("c")).scalar()
    spine = rows.select(*keys).distinct().withColumn("__c", F.explode(present)).select(*keys, "__c.*")
    return fill_bins(counted, spine, [*COHORT_COLUMNS, *keys], lo, hi, per_unit)


def zero_fill(df: DataFrame, spine: DataFrame, on, count: str = "n") -> DataFrame:
    """Every row of the spine, with a count of 0 where ``df`` has none."""
    return join_nullsafe(spine, df, on).withColumn(count, F.coalesce(F.col(count), F.lit(0)).cast("bigint"))


def monthly_counts(df: DataFrame, keys=("code", "unit"), t="time", value="value") -> DataFrame:
    keys = [*as_list(keys), "month"]
    rows = df.withColumn("month", month_of(t))
    stats = rows.groupBy(*keys).agg(n_rows(), F.count_if(F.col(value).isNull()).alias("n_excluded"))
    return with_percentiles(stats, rows, keys, value, {"median_value": 0.5})


# --- dataset description ---------------------------------------------------------------------
def completeness(df: DataFrame, key: str, columns=None) -> DataFrame:
    """Non-missing entries per column, one row per (column, key). Empty text counts as missing."""
    cols = [c for c in (columns or df.columns) if c != key]

    def filled(c):
        return F.count(F.nullif(F.col(c), F.lit(""))) if isinstance(df.schema[c].dataType, T.StringType) else F.count(c)

    wide = df.groupBy(key).agg(*[filled(c).alias(c) for c in cols])
    return wide.unpivot([key], cols, "column_name", "n")


def transpose(df: DataFrame, key: str, values: list) -> DataFrame:
    """Turns ``completeness`` into one row per column and one column per known key value."""
    return df.groupBy("column_name").pivot(key, values).agg(F.first("n"))


def dataset_description(df: DataFrame, identifier="identifier", obs="obs_id", patient="patient", code="code",
                        t="time", issued="issued", status="status", interpretation=None) -> DataFrame:
    """Counts that describe a measurement table: one row per (metric, key)."""
    i, when, o = F.col(issued), F.col(t), F.col(obs)
    totals = df.agg(
        F.count_distinct(patient).alias("patients"), F.count_distinct(identifier).alias("identifier_distinct"),
        F.count_if(F.col(identifier).isNull()).alias("identifier_null"),
        F.count_distinct(F.when(i.isNull(), o)).alias("issued_na"),
        F.count_distinct(F.when(i == when, o)).alias("issued_identical"),
        F.count_distinct(F.when(i < when, o)).alias("issued_before"),
        F.count_distinct(F.when(i > when, o)).alias("issued_after"))
    parts = [totals.unpivot([], totals.columns, "metric", "n").withColumn("key", F.lit(None).cast("string"))]
    repeated = df.groupBy(identifier).agg(F.count_distinct(obs).alias("c")).agg(F.count_if(F.col("c") > 1).alias("n"))
    parts.append(repeated.select(F.lit("identifier_duplicate").alias("metric"), F.lit(None).cast("string").alias("key"), "n"))
    parts.append(_by(df, "obs_per_code", [code], F.count_distinct(obs)))
    if status in df.columns:
        parts.append(_by(df, "status", [status], F.count(F.lit(1))))
    if interpretation:
        parts.append(_by(df, "interpretation", [code, interpretation], F.count_distinct(obs)))
    return reduce(DataFrame.unionByName, parts).select("metric", "key", "n")


def _by(df, metric, keys, agg):
    text = F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("NULL")) for k in keys])
    return df.groupBy(*keys).agg(agg.alias("n")).select(F.lit(metric).alias("metric"), text.alias("key"), "n")


def age_gender_report(df: DataFrame, obs="obs_id", patient="pat_id", age="age", gender="gender") -> DataFrame:
    per_gender = [_by(df, "patients", [gender], F.count_distinct(patient)),
                  _by(df, "measurements", [gender], F.count_distinct(obs))]
    a, o = F.col(age), F.col(obs)
    totals = df.agg(F.min(a).cast("bigint").alias("min_age"), F.max(a).cast("bigint").alias("max_age"),
                    F.count_distinct(F.when(a < 0, o)).alias("age_below_0"),
                    F.count_distinct(F.when(a > 120, o)).alias("age_above_120"))
    total = totals.unpivot([], totals.columns, "metric", "n").withColumn("key", F.lit(None).cast("string"))
    return reduce(DataFrame.unionByName, [*per_gender, total]).select("metric", "key", "n")


# --- availability over months ----------------------------------------------------------------
def month_spine(spark, lo, hi) -> DataFrame:
    return spark.range(1).select(F.explode(F.sequence(
        F.trunc(F.lit(lo).cast("date"), "month"), F.trunc(F.lit(hi).cast("date"), "month"),
        F.expr("INTERVAL 1 MONTH"))).alias("month"))


def monthly_timeline(tables: dict[str, DataFrame], lo, hi, t="time") -> DataFrame:
    """Rows per (table, month) within [lo, hi], zero-filled over all months of the range."""
    def one(name, df):
        counted = (df.filter(F.col(t).between(F.lit(lo), F.lit(hi))).groupBy(month_of(t).alias("month")).agg(n_rows()))
        spine = month_spine(df.sparkSession, lo, hi)
        return zero_fill(counted, spine, "month").select(F.lit(name).alias("table_name"), "month", "n")

    return reduce(DataFrame.unionByName, [one(n, d) for n, d in tables.items()])


def availability(timeline: DataFrame, share: float = 0.5) -> DataFrame:
    """First and last month per table with at least ``share`` of its best month."""
    best = timeline.groupBy("table_name").agg(F.max("n").alias("__max"))
    enough = F.col("n") >= F.col("__max") * share
    return (timeline.join(best, "table_name").groupBy("table_name")
            .agg(F.min(F.when(enough, F.col("month"))).alias("min_available"),
                 F.max(F.when(enough, F.col("month"))).alias("max_available")))


def timeline_wide(timeline: DataFrame, tables: list[str]) -> DataFrame:
    return timeline.groupBy("month").pivot("table_name", tables).agg(F.first("n"))


# --- smaller summaries -----------------------------------------------------------------------
QUARTILES = {"median": 0.5, "q1": 0.25, "q3": 0.75}


def summary(df: DataFrame, keys, value: str, extra=(), probs=None) -> DataFrame:
    """mean, population sd, min, max and percentiles of a value per group."""
    keys = as_list(keys)
    v = F.col(value)
    stats = df.groupBy(*keys).agg(*extra, F.avg(v).alias("mean"), F.stddev_pop(v).alias("sd"),
                                  F.min(v).alias("min"), F.max(v).alias("max"))
    return with_percentiles(stats, df, keys, value, probs or QUARTILES)


def lab_summary(df: DataFrame, keys=("code", "unit"), value="value") -> DataFrame:
    return summary(df, keys, value, extra=(n_rows(), F.count("ref_high").alias("n_ref_high"),
                                           F.count("ref_low").alias("n_ref_low")))


def timestamp_availability(df: DataFrame, point: str, start="period_start", end="period_end") -> DataFrame:
    return df.agg(n_rows("n_total"), F.count(start).alias("n_period_start_not_null"),
                  F.count(end).alias("n_period_end_not_null"), F.count(point).alias("n_point_not_null"),
                  F.count_if(F.col(start) == F.col(end)).alias("n_start_eq_end"))


def encounter_type_counts(df: DataFrame) -> DataFrame:
    """Encounters by (type, class): all, open ones, and those that start after their end."""
    kinds = with_groups(df, {"all": None, "open": F.col("period_end").isNull(),
                             "start_after_end": F.col("period_start") > F.col("period_end")}, "kind")
    return kinds.groupBy("kind", "type", "class").agg(n_rows())


def per_interval_summary(df: DataFrame, interval="enc_id") -> DataFrame:
    """Rows per encounter and encounter length in days, summarised and rounded to 2 digits."""
    inside = df.filter(F.col(interval).isNotNull())
    rows = inside.groupBy(interval).agg(n_rows("x")).select(F.lit("measurements").alias("metric"), F.col("x").cast("double").alias("x"))
    length = F.datediff(F.max("enc_end"), F.min("enc_start"))
    days = (inside.filter(F.col("enc_start").isNotNull() & F.col("enc_end").isNotNull()).groupBy(interval)
            .agg(length.alias("x")).select(F.lit("days").alias("metric"), F.col("x").cast("double").alias("x")))
    out = summary(rows.unionByName(days), "metric", "x")
    return out.select("metric", *[F.round(c, 2).alias(c) for c in out.columns if c != "metric"])


# --- follow-up -------------------------------------------------------------------------------
HOUR_STATS = {"median": 0.5, "p25": 0.25, "p75": 0.75}


def followup_report(df: DataFrame, max_hours: int = 120) -> DataFrame:
    """Follow-up counts and hours: all, within the same encounter, within the time limit."""
    h = F.col("next_hours")
    rows = with_groups(df.filter(F.col("next_flag") == 1),
                       {"total": None, "same_encounter": F.col("same_encounter") == 1,
                        "in_time": h <= max_hours}, "grp")
    stats = rows.groupBy("grp").agg(n_rows(), F.avg(h).alias("avg"), F.stddev(h).alias("sd"))
    out = with_percentiles(stats, rows, "grp", "next_hours", HOUR_STATS)
    return out.select("grp", "n", *[F.round(c, 2).alias(c) for c in ("avg", "median", "sd", "p25", "p75")])


def transitions(df: DataFrame, max_hours: int = 6, keys=("result_detail", "next_result_detail")) -> DataFrame:
    """Follow-ups within a few hours by grade before and after."""
    h, keys = F.col("next_hours"), as_list(keys)
    rows = df.filter(h <= max_hours)
    stats = rows.groupBy(*keys).agg(n_rows(), F.avg(h).alias("avg_hours"), F.stddev(h).alias("sd_hours"))
    return with_percentiles(stats, rows, keys, "next_hours", {"median_hours": 0.5, "p25": 0.25, "p75": 0.75})


def flag_totals(df: DataFrame, flags, alone: str | None = None) -> DataFrame:
    """Sum of all flags, rows with any flag and, if given, rows with exactly one."""
    total = add_all(flags)
    cols = [F.coalesce(F.sum(total), F.lit(0)).cast("bigint").alias("n_matches"), F.count_if(total > 0).alias("n_any")]
    return df.agg(*cols, *([F.count_if(F.col(alone) == 1).alias("n_alone")] if alone else []))


# --- paired measurements ---------------------------------------------------------------------
def pair_comparison(pairs: DataFrame, cohorts: dict[str, Column | None], first="serum", second="blood") -> DataFrame:
    """Differences of paired values by cohort and order in time.

    ``pairs`` has diff_signed, diff_abs, hours_between, result_<first>, result_<second> and
    chronological_order.
    """
    order = F.col("chronological_order")
    rows = with_groups(pairs, cohorts)
    rows = rows.withColumn("chronological_order_filter", F.explode(F.array(F.lit("all"), order)))
    keys = ["cohort", "chronological_order_filter"]
    d, a, b = F.col("diff_signed"), F.col(f"result_{first}"), F.col(f"result_{second}")
    grades = ("N", "L", "H")
    cells = [F.count_if(a == r).alias(f"n_{first}_{r.lower()}") for r in grades]
    cells += [F.count_if(b == r).alias(f"n_{second}_{r.lower()}") for r in grades]
    cells += [F.count_if((a == r) & (b == s)).alias(f"n_{first}_{r.lower()}_{second}_{s.lower()}")
              for r in grades for s in grades]
    stats = rows.groupBy(*keys).agg(
        n_rows(), F.avg(d).alias("mean_diff_signed"), F.count_if(d > 0).alias(f"n_{first}_higher"),
        F.count_if(d < 0).alias(f"n_{second}_higher"), F.count_if(d == 0).alias("n_equal"),
        F.avg("diff_abs").alias("mean_diff_abs"), *cells, F.avg("hours_between").alias("mean_hours_between"))
    stats = with_percentiles(stats, rows, keys, "diff_signed",
                             {"median_diff_signed": .5, "p25_diff_signed": .25, "p75_diff_signed": .75})
    stats = with_percentiles(stats, rows, keys, "diff_abs",
                             {"median_diff_abs": .5, "p75_diff_abs": .75, "p90_diff_abs": .9})
    return with_percentiles(stats, rows, keys, "hours_between", {"median_hours_between": .5})


def with_difference(pairs: DataFrame, a="value_norm", b="value_norm_2", t1="time", t2="time_2",
                    first="serum", second="blood") -> DataFrame:
    diff = F.col(a) - F.col(b)
    order = (F.when(F.col(t1) == F.col(t2), "simultaneous").when(F.col(t1) < F.col(t2), f"{first}_first")
             .otherwise(f"{second}_first"))
    return pairs.withColumns({"diff_signed": diff, "diff_abs": F.abs(diff), "chronological_order": order})


def report(sections: dict[str, DataFrame], k: int = 5) -> DataFrame:
    """All count tables as one long table (section, keys, metric, value), counts below k suppressed.

    Columns of integer type are counts; all other columns become part of the key text.
    """
    from labspark.functions.privacy import k_censor

    def one(name, df):
        nums = [f.name for f in df.schema if isinstance(f.dataType, (T.LongType, T.IntegerType))]
        keys = [f.name for f in df.schema if f.name not in nums]
        text = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("NULL")) for c in keys]) if keys else F.lit("")
        long = df.select(text.alias("keys"), *[F.col(c).cast("bigint").alias(c) for c in nums]).unpivot(
            ["keys"], nums, "metric", "v")
        return long.select(F.lit(name).alias("section"), "keys", "metric", k_censor("v", k).alias("value"))

    return reduce(DataFrame.unionByName, [one(n, d) for n, d in sections.items()])
