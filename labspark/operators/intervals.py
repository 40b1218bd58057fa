"""Assigning rows to intervals and events to parts of intervals.

Most keys have few intervals: up to ``NARROW`` of them travel as one array, and a row takes the best of its key's
array, so that rows and intervals are shuffled once. Keys with more intervals, or with very many rows, are counted
first and go another way, on which no row meets an interval: the borders of all intervals of a key cut time into
stretches in which the same intervals hold; the best interval of every stretch is found once (``envelope``), and
rows look up the last border before them (``seek``). There the work grows with the number of intervals times the
logarithm of the number that one key has, however many of them overlap.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from labspark.functions.columns import as_col, as_list, flag, join_optional
from labspark.functions.dates import day_of, days, micros_between
from labspark.operators.seek import Source, attach, seek
from labspark.operators.segments import BUCKET, BUCKET_DAYS, CELLS, LIMIT, Crowd, crowd, cut, running, time_bucket
from labspark.session import materialize, spread, tasks_for
from labspark.spec import INPATIENT_CLASSES


NARROW = 256  # intervals of a key that rows are compared with one by one
LOST = 1024  # numbers that spread rows without key


def _crowd(rows: DataFrame, intervals: DataFrame, by, limit: int) -> Crowd:
    """Keys with many rows or intervals."""
    one = F.lit(1).alias("__i")
    keys = rows.select(*by, F.lit(0).alias("__i")).unionByName(intervals.select(*by, one))
    return crowd(keys.dropna(subset=by), by, limit, "__i", min(NARROW, limit), cells=4 * CELLS)


def tick() -> Column:
    """The clock's resolution: [a, b] is [a, b + tick)."""
    return F.expr("INTERVAL '0.000001' SECOND")


def _dyadic(low: str, high: str) -> Column:
    """The aligned blocks of 1, 2, 4, ... cells that cells ``low`` .. ``high`` - 1 are made of: at most two of a size."""
    sizes = f"sequence(0, CAST(floor(log2({high} - {low})) AS INT))"
    inside = f"transform({sizes}, k -> named_struct('k', k, 'l', shiftright({low} + shiftleft(1L, k) - 1L, k), 'r', shiftright({high}, k)))"
    ends = ("array(IF(x.l < x.r AND x.l % 2 = 1, named_struct('level', x.k, 'node', x.l), NULL), "
            "IF(x.l < x.r AND x.r % 2 = 1, named_struct('level', x.k, 'node', x.r - 1), NULL))")
    return F.expr(f"filter(flatten(transform({inside}, x -> {ends})), x -> x IS NOT NULL)")


def envelope(windows: DataFrame, by, low, high, rank, bucket_days: int = BUCKET_DAYS, limit: int = LIMIT) -> DataFrame:
    """``pos`` and ``best`` per key: from each border on, up to the next, the least ``rank`` among the windows
    [low, high) that hold there; NULL where none does.

    Borders are numbered along time. A window covers a range of these numbers, which falls into few aligned blocks;
    a block keeps its best window, and a stretch takes the best of the blocks around it, one of each size.
    """
    by = as_list(by)
    w = (windows.select(*by, as_col(low).alias("__low"), as_col(high).alias("__high"), as_col(rank).alias("__rank"))
         .dropna(subset=[*by, "__low", "__high"]).filter("__low < __high"))
    w = materialize(w.groupBy(*by, "__low", "__high").agg(F.min("__rank").alias("__rank")), "windows")
    borders = w.select(*by, F.explode(F.array("__low", "__high")).alias("pos")).distinct()
    borders = borders.withColumns({BUCKET: time_bucket("pos", bucket_days), "cell": F.lit(1).cast("long")})
    borders, split = cut(borders, by, "pos", limit)
    cells = materialize(running(borders, by, ["pos"], {"cell": F.sum}, split).select(*by, "pos", (F.col("cell") - 1).alias("cell")), "cells")

    def numbered(name):
        return cells.select(*by, F.col("pos").alias(f"__{name}"), F.col("cell").alias(name))

    placed = w.join(numbered("low"), [*by, "__low"]).join(numbered("high"), [*by, "__high"])
    blocks = placed.select(*by, "__rank", F.explode(_dyadic("low", "high")).alias("__b"))
    blocks = blocks.groupBy(*by, F.col("__b.level").alias("level"), F.col("__b.node").alias("node")).agg(F.min("__rank").alias("best"))
    top = cells.groupBy(*by).agg(F.floor(F.log2(F.max("cell") + 1)).cast("int").alias("__top"))
    around = cells.join(top, by).select(*by, "pos", "cell", F.explode(F.sequence(F.lit(0), "__top")).alias("level"))
    around = around.withColumn("node", F.expr("shiftright(cell, level)"))
    found = around.join(blocks, [*by, "level", "node"]).groupBy(*by, "pos").agg(F.min("best").alias("best"))
    return cells.select(*by, "pos").join(found, [*by, "pos"], "left")


def _longest_first(enc_id, start, end) -> Column:
    return F.struct((-micros_between(start, end)).alias("d"), F.col(enc_id).alias("id"), F.col(start).alias("s"), F.col(end).alias("e"))


def _beside(df: DataFrame, intervals: DataFrame, by, t, enc_id, start, end, total: int, once: bool = False) -> DataFrame:
    """``df`` with the longest interval around each row, for keys with few intervals: these are joined as one array."""
    missing = F.greatest(*[F.col(c).isNull() for c in by], F.lit(False))
    # equal rows stay together where each is wanted once
    own = F.pmod(F.xxhash64(*df.columns), F.lit(LOST)).cast("int") if once else F.spark_partition_id()
    rows = df.withColumn("__lost", F.when(missing, 1 + own).otherwise(0))
    # 0 in all rows, but no constant: the optimizer would take that for a condition, join by the other keys and deal all rows again
    of_key, on = intervals.withColumn("__lost", F.pmod(F.xxhash64(*by), F.lit(1)).cast("int")), [*by, "__lost"]
    parts = tasks_for(rows, total)
    if parts > df.sparkSession.sparkContext.defaultParallelism:  # as many as ``spread`` deals the rows to
        of_key = of_key.repartition(parts, *on)
    lists = of_key.groupBy(*on).agg(F.collect_list(_longest_first(enc_id, start, end)).alias("__of"))
    joined = spread(rows, total, *on).join(lists, on, "left")
    hit = F.array_min(F.filter("__of", lambda i: (i["s"] <= F.col(t)) & (F.col(t) <= i["e"])))
    joined = joined.select(*on, *[c for c in df.columns if c not in by], hit.alias("__b"))
    if once:
        joined = joined.distinct()
    return joined.select(*df.columns, *[F.col("__b")[c].alias(n) for c, n in (("id", "enc_id"), ("s", "enc_start"), ("e", "enc_end"))])


def in_interval(points: DataFrame, intervals: DataFrame, by, t, enc_id="enc_id", start="period_start",
                end="period_end", bucket_days: int = BUCKET_DAYS, limit: int = LIMIT) -> DataFrame:
    """Longest interval around each distinct point (both ends in); ties take the smallest id."""
    by = as_list(by)
    rank = _longest_first(enc_id, start, end)
    best = envelope(intervals, by, start, F.col(end) + tick(), rank, bucket_days, limit)
    found = seek(points, Source(best, "pos", {"__b": F.struct("pos", "best")}), by, t, bucket_days=bucket_days, limit=limit)
    hit = F.col("__b")["best"]
    return found.filter(hit.isNotNull()).select(*by, t, hit["id"].alias("enc_id"), hit["s"].alias("enc_start"), hit["e"].alias("enc_end"))


def closed_inpatient(intervals: DataFrame, cls="class", start="period_start", end="period_end",
                     classes=INPATIENT_CLASSES) -> DataFrame:
    return intervals.filter(F.col(cls).isin(*classes) & F.col(start).isNotNull()
                            & F.col(end).isNotNull() & (F.col(start) <= F.col(end)))


def assign_interval(df: DataFrame, intervals: DataFrame | None, by="patient", t="time", cls="class",
                    enc_id="enc_id", start="period_start", end="period_end", limit: int = LIMIT, once: bool = False) -> DataFrame:
    """Adds enc_class, enc_id, enc_start and enc_end of the longest closed inpatient encounter.

    Without an encounter source every row is an outpatient one. ``once``: rows of ``df`` may repeat and are returned
    once; they are made distinct where they have been dealt for their encounters, without a shuffle of their own.
    """
    if intervals is None:
        return (df.distinct() if once else df).withColumns({
            "enc_class": F.lit("AMB"), "enc_id": F.lit(None).cast("string"),
            "enc_start": F.lit(None).cast("timestamp_ntz"), "enc_end": F.lit(None).cast("timestamp_ntz")})
    by = as_list(by)
    closed = materialize(closed_inpatient(intervals, cls, start, end).select(*by, enc_id, start, end).dropna(subset=by), "closed")
    crowded = _crowd(df, closed, by, limit)
    if not crowded:
        out = _beside(df, closed, by, t, enc_id, start, end, crowded.total, once)
    else:
        rest = crowded.within(df).distinct() if once else crowded.within(df)
        found = in_interval(rest, crowded.within(closed), by, t, enc_id, start, end, limit=limit)
        out = _beside(crowded.without(df), crowded.without(closed), by, t, enc_id, start, end, crowded.total, once).unionByName(attach(rest, found, [*by, t]))
    return out.select(*df.columns, F.when(F.col("enc_id").isNotNull(), "IMP").otherwise("AMB").alias("enc_class"),
                      "enc_id", "enc_start", "enc_end")


def first_in_interval(df: DataFrame, interval="enc_id", t="time", name="first") -> DataFrame:
    """1 for the single earliest row of each interval; rows that share the earliest time get 0."""
    per_instant = df.filter(F.col(interval).isNotNull()).groupBy(interval, t).count()
    first = (per_instant.groupBy(interval).agg(F.min(F.struct(t, "count")).alias("__f"))
             .select(F.col(interval).alias("__interval"), F.col("__f")[t].alias("__t"), F.col("__f")["count"].alias("__n")))
    return (join_optional(df, first, interval, "__interval")
            .select(*df.columns, flag((F.col(t) == F.col("__t")) & (F.col("__n") == 1)).alias(name)))


def ambiguous_first(df: DataFrame, interval="enc_id", t="time") -> DataFrame:
    """Number of intervals whose earliest time is shared by several rows."""
    per_instant = df.filter(F.col(interval).isNotNull()).groupBy(interval, t).count()
    return (per_instant.groupBy(interval).agg(F.min(F.struct(t, "count")).alias("f"))
            .agg(F.count_if(F.col("f")["count"] > 1).alias("n_ambiguous")))


def same_day(df: DataFrame, intervals: DataFrame, by="patient", t="time", obs="obs_id", start="period_start",
             cls="class", wanted="AMB") -> DataFrame:
    """Outpatient rows that have an outpatient contact starting on the same calendar day."""
    contacts = (intervals.filter(F.col(cls) == wanted)
                .select(by, F.to_date(start).alias("__day")).distinct())
    return (df.filter(F.col("enc_class") == wanted).withColumn("__day", F.to_date(t))
            .join(contacts, [by, "__day"], "left_semi").agg(F.count_distinct(obs).alias("n")))


def verify_assignment(df: DataFrame, recorded="enc_org", assigned="enc_id") -> DataFrame:
    """Agreement between recorded encounter references and assigned encounters (inpatient rows)."""
    ref = F.concat(F.lit("Encounter/"), F.col(assigned).cast("string"))
    r, a = F.col(recorded), F.col(assigned)
    return df.filter(F.col("enc_class") == "IMP").agg(
        F.count_if(r == ref).alias("same_enc"),
        F.count_if(r.isNotNull() & a.isNotNull() & (r != ref)).alias("diff_enc"),
        F.count_if(r.isNull() & a.isNotNull()).alias("only_calc"))


# part of an encounter -> rank; a lower rank wins when an event fits several encounters
BUCKETS = {"day1": 1, "end_date": 2, "day2_3": 3, "day4_to_end": 4, "end_to_3d_after": 5,
           "3d_to_7d_after": 6, "7d_to_14d_after": 7, "remaining": 8}


def encounter_windows(encounters: DataFrame) -> DataFrame:
    """Time window per encounter: the period itself, or the calendar day for outpatient contacts.

    Open inpatient encounters have no window.
    """
    amb = F.col("class") == "AMB"
    return (encounters.filter(~(F.col("class").isin(*INPATIENT_CLASSES) & F.col("period_end").isNull()))
            .withColumns({
                "period_end": F.when(amb, F.col("period_start")).otherwise(F.col("period_end")),
                "win_start": F.when(amb, day_of("period_start")).otherwise(F.col("period_start")),
                "win_end": F.when(amb, day_of("period_start") + days(1)).otherwise(F.col("period_end"))}))


def _parts(cls: Column, start: Column, end: Column, s: Column, e: Column) -> list:
    """Parts of an encounter: name, ahead, window (two), anchor, whether the latest anchor is nearest, for which classes."""
    amb = cls == "AMB"
    day2, day4 = F.greatest(s, F.least(s + days(1), e)), F.greatest(s, F.least(s + days(3), e))
    last_day, over = e - days(1), F.greatest(s, F.when(amb, e).otherwise(e + tick()))
    return [("day1", False, F.when(amb, start).otherwise(s), F.least(s + days(1), e), start, True, None), ("day1", True, s, start, start, False, amb),
            ("end_date", False, F.greatest(last_day, day2), e + tick(), end, False, ~amb), ("day2_3", False, day2, F.least(s + days(3), last_day), start, True, ~amb),
            ("day4_to_end", False, day4, last_day, start, True, ~amb), ("end_to_3d_after", False, over, e + days(3), end, True, None),
            ("3d_to_7d_after", False, F.greatest(s, e + days(3)), e + days(7), end, True, None), ("7d_to_14d_after", False, F.greatest(s, e + days(7)), e + days(14), end, True, None)]


def _part_windows(win: DataFrame, by, enc_id) -> DataFrame:
    """One row per encounter and part of it: the window [low, high) and the ``rank`` of the encounter there.

    Part and class rank come first in the order, then the distance to ``anchor``, the start or end of the period. Within a
    part the nearest anchor is always the latest, or always the earliest, so that the order (``w``) does not depend on
    the event. Only an outpatient day has anchors on both sides: windows up to the start have ``ahead``.
    """
    e = F.col("win_end")
    parts = _parts(F.col("class"), F.col("period_start"), F.col("period_end"), F.col("win_start"), e)
    zero = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    rows = []
    for part, ahead, low, high, anchor, latest, only in parts:
        signed = micros_between(zero, anchor) * (-1 if latest else 1)
        rank = F.struct(F.lit(BUCKETS[part]).alias("o"), F.col("__rank").alias("rank"), signed.alias("w"), F.col(enc_id).alias("id"), F.col("class").alias("class"),
                        F.lit(part).alias("b"), anchor.alias("anchor"))
        row = F.struct(F.lit(ahead).alias("ahead"), low.alias("low"), high.alias("high"), rank.alias("rank"))
        rows.append(row if only is None else F.when(only, row))
    return win.filter(e.isNotNull()).select(by, F.inline(F.filter(F.array(*rows), lambda r: r.isNotNull()))).filter("low < high")


def _choice(o, rank, anchor, id_, cls, part, t) -> Column:
    """The order of preference; ``rank`` of the class."""
    return F.struct(o.alias("o"), rank.alias("rank"), F.abs(micros_between(anchor, t)).alias("gap"), id_.alias("id"), cls.alias("class"), part.alias("b"))


def _best_of_few(ev: DataFrame, win: DataFrame, by, t, event_id, enc_id, total: int) -> DataFrame:
    """Events with their best part ``c``, for keys with few encounters: the events and encounters of a key are brought together
    as two arrays, the parts are laid out once a key, and each event takes the best of those around it."""
    w = F.struct(F.col(enc_id).alias("id"), "class", "period_start", "period_end", "win_start", "win_end", F.col("__rank").alias("rank"))
    e = F.struct(F.col(event_id).alias("event"), F.col(t).alias("t"))
    rows = ev.select(by, e.alias("__e")).unionByName(win.select(by, w.alias("__w")), allowMissingColumns=True)
    both = spread(rows, total, by).groupBy(by).agg(F.collect_list("__e").alias("__e"), F.collect_list("__w").alias("__w"))

    def laid_out(w):
        def part(name, low, high, anchor):
            return F.struct(low.alias("low"), high.alias("high"), F.lit(BUCKETS[name]).alias("o"), w["rank"].alias("rank"), anchor.alias("anchor"),
                            w["id"].alias("id"), w["class"].alias("class"), F.lit(name).alias("b"))

        parts = []
        for name, _, low, high, anchor, _, only in _parts(w["class"], w["period_start"], w["period_end"], w["win_start"], w["win_end"]):
            usable = w["win_end"].isNotNull() & (low < high)
            parts.append(F.when(usable if only is None else usable & only, part(name, low, high, anchor)))
        # over for 14 days or more: a part without end
        over = F.greatest(w["win_end"] + days(14), w["win_start"])
        parts.append(F.when(over.isNotNull(), part("remaining", over, F.lit(None).cast("timestamp_ntz"), w["period_end"])))
        return F.array_compact(F.array(*parts))

    both = both.filter((F.size("__e") > 0) & (F.size("__w") > 0)).select(by, "__e", F.flatten(F.transform("__w", laid_out)).alias("__p"))
    each = both.select(by, "__p", F.explode("__e").alias("__e"))
    at = F.col("__e")["t"]
    around = F.filter("__p", lambda p: (p["low"] <= at) & (p["high"].isNull() | (at < p["high"])))
    best = F.array_min(F.transform(around, lambda p: _choice(p["o"], p["rank"], p["anchor"], p["id"], p["class"], p["b"], at)))
    return each.select(F.col("__e")["event"].alias(event_id), by, at.alias(t), best.alias("c"))


def bucket_to_interval(events: DataFrame, encounters: DataFrame, by="patient", t="time", event_id="con_id",
                       enc_id="enc_id", bucket_days: int = BUCKET_DAYS, limit: int = LIMIT) -> DataFrame:
    """Best encounter of every event and the part of it the event falls into.

    Order of preference: part of the encounter, inpatient before outpatient, distance to the start
    or end of the period, then the smaller encounter id. Events before any encounter are dropped.

    Every part of an encounter is a window of time. Keys with few encounters are worked on whole. For the others the best
    window is known per stretch of time (``envelope``), encounters over for 14 days or more are found by the one that
    ended last: one lookup along time answers all for an instant, and the events are attached to the instants last.
    """
    encounters = encounters.select(by, enc_id, "class", "period_start", "period_end")
    win = encounter_windows(encounters).withColumn("__rank", F.when(F.col("class").isin(*INPATIENT_CLASSES), 1).otherwise(2))
    ev, win = events.select(event_id, by, t).dropna(), materialize(win.dropna(subset=[by]), "encounter-windows")
    crowded = _crowd(ev, win, [by], limit)
    best = _best_of_few(crowded.without(ev) if crowded else ev, crowded.without(win) if crowded else win, by, t, event_id, enc_id, crowded.total)
    if crowded:
        best = best.unionByName(_best_of_many(crowded.within(ev), crowded.within(win), by, t, event_id, enc_id, bucket_days, limit).select(*best.columns))
    # rows of one event id at several times: the best of them
    per_event = best.filter(F.col("c").isNotNull()).groupBy(event_id).agg(F.min(F.struct(F.col("c"), F.col(by).alias("by"), F.col(t).alias("t"))).alias("m"))
    m = F.col("m")
    return per_event.select(event_id, m["by"].alias(by), m["t"].alias(t), m["c"]["class"].alias("class"),
                            m["c"]["id"].alias("enc_id"), m["c"]["b"].alias("time_bucket"))


def _best_of_many(ev: DataFrame, win: DataFrame, by, t, event_id, enc_id, bucket_days: int, limit: int) -> DataFrame:
    """Events with their best part ``c``, by stretches of time."""
    parts = materialize(_part_windows(win, by, enc_id), "parts")
    names = {"p": False, "q": True}
    near = [Source(envelope(parts.filter(F.col("ahead") == ahead), by, "low", "high", "rank", bucket_days, limit), "pos", {n: F.struct("pos", "best")}) for n, ahead in names.items()]

    # latest period end among encounters over for 14 days or more; smallest id of those that share it
    over = win.withColumn("__over", F.greatest(F.col("win_end") + days(14), F.col("win_start")))
    last = (over.groupBy(by, "__over", "__rank", "period_end")
            .agg(F.min(F.struct(F.col(enc_id).alias("id"), F.col("class").alias("class"))).alias("e")))
    pick = F.struct(F.col("period_end").alias("anchor"), F.col("__rank").alias("rank"), F.col("e")["id"].alias("id"), F.col("e")["class"].alias("class"),
                    F.lit("remaining").alias("b"), F.lit(BUCKETS["remaining"]).alias("o"))
    old = Source(last, "__over", {f"r{r}": F.when(F.col("__rank") == r, pick) for r in (1, 2)})

    def choice(c):
        return F.when(c.isNotNull(), _choice(c["o"], c["rank"], c["anchor"], c["id"], c["class"], c["b"], F.col(t)))

    found = seek(ev, [*near, old], by, t, bucket_days=bucket_days, limit=limit)
    choices = [choice(F.col(n)["best"]) for n in names] + [choice(F.col(f"r{r}")) for r in (1, 2)]
    return attach(ev, found.select(by, t, F.least(*choices).alias("c")), [by, t])
