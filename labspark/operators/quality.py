"""Sample quality: linked quality measurements, specimens, notes and methods."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from labspark.functions.predicates import matches_any
from labspark.functions.values import ref_kind
from labspark.operators.describe import n_rows
from labspark.operators.quantiles import with_percentiles
from labspark.operators.resolve import resolve
from labspark.session import few, materialize

PAIR_LEFT = {"main_obs_id": "obs_id", "main_code": "code"}
PAIR_RIGHT = {"quality_obs_id": "obs_id", "quality_code": "code", "quality_value": "value", "quality_unit": "unit",
              "quality_value_code": "value_code", "quality_value_system": "value_code_system",
              "quality_ref_high": "ref_high", "quality_ref_low": "ref_low", "quality_interpretation": "interpretation"}


PAIRS_PER_TASK = 2_000_000


@dataclass(frozen=True)
class Match:
    """The two sides of a match without its pairs: distinct rows of each side that have a partner under the same key.

    A key that a third of all rows share has too many pairs to build. Everything that is published about pairs can be
    counted from the sides: distinct results of one side directly, pairs as products of counts per key.
    """

    main: DataFrame
    quality: DataFrame
    keys: tuple


def _sides(df, quality, keys, extra):
    q = quality.select(*keys, *[F.col(c).alias(n) for n, c in PAIR_RIGHT.items() if c in quality.columns])
    return df.select(*dict.fromkeys([*keys, *extra]), *[F.col(c).alias(n) for n, c in PAIR_LEFT.items()]), q


def _together(m: DataFrame, q: DataFrame, keys) -> DataFrame:
    """Inner join of two sides with many pairs per key: the pairs of a key are split into even parts that are dealt like keys."""
    per = [side.groupBy(*keys).agg(n_rows(n)) for side, n in ((m, "__a"), (q, "__b"))]
    pairs = F.col("__a").cast("double") * F.col("__b")
    sizes = per[0].join(per[1], keys).select(*keys, pairs.alias("__pairs"), F.ceil(pairs / PAIRS_PER_TASK).cast("int").alias("__parts"))
    sizes = materialize(sizes, "pairs-per-key")
    total = sizes.agg(F.coalesce(F.sum("__pairs"), F.lit(0.0))).first()[0]
    tasks = max(m.sparkSession.sparkContext.defaultParallelism, math.ceil(total / PAIRS_PER_TASK))
    sizes = few(sizes.drop("__pairs"), "parts-per-key")
    part = F.pmod(F.xxhash64(*m.columns), F.col("__parts")).cast("int")
    left = m.join(sizes, keys).withColumn("__part", part).drop("__parts")
    right = q.join(sizes, keys).withColumn("__part", F.explode(F.sequence(F.lit(0), F.col("__parts") - 1))).drop("__parts")
    on = [*keys, "__part"]
    return left.repartition(tasks, *on).hint("shuffle_hash").join(right.repartition(tasks, *on), on).drop("__part")


def _pairs(df, quality, keys, extra, keep_keys: bool = True):
    """Distinct pairs, without a pass over them. Distinct rows of the sides have distinct pairs; without the keys a pair
    occurs twice only if both of its rows come with several keys."""
    m, q = (materialize(side.dropna(subset=keys).distinct(), "side") for side in _sides(df, quality, keys, extra))
    if keep_keys:
        return _together(m, q, keys)
    m, q = (side.withColumn(n, F.count("*").over(Window.partitionBy(*[c for c in side.columns if c not in keys])) > 1) for side, n in ((m, "__m"), (q, "__q")))
    m, q = materialize(m, "main-side"), materialize(q, "quality-side")
    once = _together(m, q, keys).filter(~(F.col("__m") & F.col("__q")))
    twice = _together(m.filter("__m"), q.filter("__q"), keys)
    names = [*keys, "__m", "__q"]
    return once.drop(*names).unionByName(twice.drop(*names).distinct())


def _match(df, quality, keys, extra) -> Match:
    m, q = (side.dropna(subset=keys) for side in _sides(df, quality, keys, extra))
    # rows and partners are dealt by the keys, which serves the distinct rows too; a dozen tables read the sides
    m, q = (materialize(side.repartition(*keys).distinct(), "side") for side in (m.join(q.select(*keys), keys, "left_semi"), q.join(m.select(*keys), keys, "left_semi")))
    return Match(m, q, tuple(keys))


def sides_by_time(df: DataFrame, quality: DataFrame) -> Match:
    """The sides of ``match_time``."""
    return _match(df, quality, ["patient", "time"], [])


def sides_by_reference(df: DataFrame, quality: DataFrame, ref="basedon") -> Match:
    """The sides of ``match_reference``."""
    return _match(df, quality, [ref], ["patient", "time"])


def match_time(df: DataFrame, quality: DataFrame) -> DataFrame:
    """Quality results taken at the same patient and time: the same sample is assumed."""
    return _pairs(df, quality, ["patient", "time"], [])


def match_reference(df: DataFrame, quality: DataFrame, ref="basedon") -> DataFrame:
    """Quality results that go back to the same order."""
    return _pairs(df, quality, [ref], ["patient", "time"], keep_keys=False)


def quality_codes(quality: DataFrame) -> DataFrame:
    return quality.groupBy("code").agg(n_rows())


def incomplete_groups(match: Match) -> DataFrame:
    """Shared instants with several measurements where not each of them can have every quality result."""
    keys, at = list(match.keys), ["patient", "time"]
    mains = match.main.groupBy(*at).agg(F.count_distinct("main_obs_id").alias("m"), F.count_distinct(F.struct(*keys)).alias("k")).filter("m >= 2")
    results = [F.count_distinct("quality_code").alias("c"), F.count_distinct("quality_obs_id").alias("q")]
    of_key = match.quality.groupBy(*keys).agg(*results)
    where = match.main.select(*dict.fromkeys([*at, *keys])).distinct()
    if set(keys) == set(at):
        found = mains.join(of_key, at)
    else:  # an instant with one key has that key's results; only those with several keys need the union of them
        known = mains.join(where, at)
        one = known.filter("k = 1").join(of_key, keys).select(*at, "m", "c", "q")
        several = known.filter("k > 1").join(match.quality.select(*keys, "quality_code", "quality_obs_id").distinct(), keys)
        found = one.unionByName(several.groupBy(*at, "m").agg(*results).select(*at, "m", "c", "q"))
    return found.agg(F.count_if(F.col("q") < F.col("m") * F.col("c")).alias("n"))


def _ids(side: DataFrame, keys, ident: str) -> DataFrame:
    """Distinct (key, id), and whether the id comes with several keys."""
    ids = side.select(*keys, ident).filter(F.col(ident).isNotNull()).distinct()
    return ids.withColumn("multi", F.count("*").over(Window.partitionBy(ident)) > 1)


def count_pairs(match: Match) -> DataFrame:
    """Distinct (main, quality) ids, as one row ``n``: products of the counts per key. Only pairs of two ids that both come
    with several keys can occur twice; these are listed."""
    keys = list(match.keys)
    m, q = _ids(match.main, keys, "main_obs_id"), _ids(match.quality, keys, "quality_obs_id")
    per = [side.groupBy(*keys).agg(n_rows(name), F.count_if("multi").alias(f"{name}2")) for side, name in ((m, "a"), (q, "b"))]
    once = per[0].join(per[1], keys).agg(F.coalesce(F.sum(F.col("a") * F.col("b") - F.col("a2") * F.col("b2")), F.lit(0)).alias("n"))
    twice = m.filter("multi").join(q.filter("multi"), keys).select("main_obs_id", "quality_obs_id").distinct().agg(n_rows())
    return once.unionByName(twice).agg(F.sum("n").alias("n"))


def match_summary(df: DataFrame, match: Match) -> DataFrame:
    """Totals of a quality match as (metric, n)."""
    keys, q = list(match.keys), F.col("quality_obs_id")
    mains = match.main.agg(F.count_distinct("main_obs_id").alias("n"))
    wide = match.quality.agg(
        *[F.count_distinct(F.when(F.col(c).isNotNull(), q)).alias(n) for n, c in (
            ("n_with_value", "quality_value"), ("n_with_code", "quality_value_code"),
            ("n_with_interpretation", "quality_interpretation")) if c in match.quality.columns])
    # a measurement has two results of a code if its keys have: smallest and largest id of each key tell
    ends = match.quality.groupBy(*keys, "quality_code").agg(F.min(q).alias("low"), F.max(q).alias("high"))
    over = (match.main.select(*keys, "main_obs_id").distinct().join(ends, keys).groupBy("main_obs_id", "quality_code")
            .agg(F.min("low").alias("low"), F.max("high").alias("high")).filter("low < high").agg(F.count_distinct("main_obs_id").alias("n")))
    named = [("n_total", df.agg(n_rows())), ("n_matched", mains), ("n_pairs", count_pairs(match)), ("n_overmatched", over)]
    return reduce(DataFrame.unionByName, [*[d.select(F.lit(metric).alias("metric"), "n") for metric, d in named], wide.unpivot([], wide.columns, "metric", "n")])


def pairs_per_code(match: Match) -> DataFrame:
    keys = list(match.keys)
    m = match.main.groupBy(*keys, "main_code").agg(n_rows("a"))
    q = match.quality.groupBy(*keys, "quality_code").agg(n_rows("b"))
    return m.join(q, keys).groupBy("main_code", "quality_code").agg(F.sum(F.col("a") * F.col("b")).alias("n_pairs"))


def numeric_results(pairs: DataFrame) -> DataFrame:
    """Numeric quality results per (code, unit), each result counted once; ``pairs`` may be the quality side alone."""
    keys = ["quality_code", "quality_unit"]
    once = (pairs.filter(F.col("quality_value").isNotNull())
            .select("quality_obs_id", *keys, "quality_value").distinct())
    v = F.col("quality_value")
    stats = once.groupBy(*keys).agg(F.avg(v).alias("mean"), F.stddev_pop(v).alias("sd"))
    return with_percentiles(stats, once, keys, "quality_value", {"median": .5, "p25": .25, "p75": .75})


def reference_availability(pairs: DataFrame) -> DataFrame:
    once = pairs.select("quality_obs_id", "quality_code", "quality_unit", "quality_ref_high", "quality_ref_low").distinct()
    return once.groupBy("quality_code", "quality_unit").agg(
        n_rows(), F.count("quality_ref_high").alias("n_ref_high"), F.count("quality_ref_low").alias("n_ref_low"))


def coded_quality(pairs: DataFrame, value: str) -> DataFrame:
    """Counts of a coded or interpreted result per quality code, each result counted once."""
    return (pairs.filter(F.col(value).isNotNull()).select("quality_obs_id", "quality_code", value).distinct()
            .groupBy("quality_code", value).agg(n_rows()))


def distinct_systems(df: DataFrame, system: str, value: str) -> DataFrame:
    return df.filter(F.col(value).isNotNull()).select(system).distinct()


def coded_results(df: DataFrame, code="code", value_code="value_code", system="value_code_system") -> DataFrame:
    """Measurements with a coded result: per (code, system, result) rows."""
    return df.filter(F.col(value_code).isNotNull()).groupBy(code, system, value_code).agg(n_rows())


def join_specimen(df: DataFrame, specimens: DataFrame, ref="specimen_ref") -> DataFrame:
    """Measurements with a specimen reference and the specimen, if it can be found."""
    return resolve(df.filter(F.col(ref).isNotNull()), ref, specimens, "Specimen", "spec_id").select(
        "code", "obs_id", "patient", "time", "spec_id", "type", "condition", "condition_system").distinct()


def specimen_report(df: DataFrame, specimens: DataFrame, ref="specimen_ref") -> DataFrame:
    """Specimen counts, and types and conditions per code, as (metric, key, n)."""
    joined = join_specimen(df, specimens, ref)

    def by(metric, *keys):
        text = F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("NULL")) for k in keys])
        return joined.groupBy(*keys).agg(n_rows()).select(F.lit(metric).alias("metric"), text.alias("key"), "n")

    def total(metric, frame):
        return frame.select(F.lit(metric).alias("metric"), F.lit(None).cast("string").alias("key"), "n")

    return reduce(DataFrame.unionByName, [
        total("specimens", specimens.agg(F.count_distinct("spec_id").alias("n"))),
        total("with_reference", df.filter(F.col(ref).isNotNull()).agg(F.count_distinct("obs_id").alias("n"))),
        total("dangling", joined.agg(F.count_if(F.col("spec_id").isNull()).alias("n"))),
        by("type", "code", "type"), by("condition", "code", "condition")])


def notes_per_code(notes: DataFrame, code="code", note="note") -> DataFrame:
    return notes.filter(F.col(note).isNotNull()).groupBy(code).agg(n_rows())


def notes_report(notes: DataFrame, snippets, code="code", note="note", codes=None) -> DataFrame:
    """Notes that contain any of the snippets, with their number of rows."""
    rows = notes.filter(matches_any(note, snippets))
    if codes is not None:
        rows = rows.filter(F.col(code).isin(*codes))
    return rows.groupBy(note).agg(n_rows())


def methods_report(df: DataFrame, code="code", system="method_system", method="method_code") -> DataFrame:
    return df.filter(F.col(method).isNotNull()).groupBy(code, system, method).agg(n_rows())


def basedon_report(df: DataFrame, ref="basedon") -> DataFrame:
    """Order references by the type of resource they name."""
    return df.filter(F.col(ref).isNotNull()).groupBy(ref_kind(ref).alias("basedon_type")).agg(n_rows())
