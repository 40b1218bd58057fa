"""Nearest-event lookups along time without pairing rows.

A lookup asks, for every probe (a key and a position in time), for the last or next event of the
same key. Probes and events are merged into one time-ordered sequence per key and a running
maximum (looking back) or minimum (looking ahead) carries the answer to each probe. The work is
one sort of probes plus events however many of them a key has; no probe-event pair is ever built.

A key may hold a large share of all rows. Two things keep every task small:

* keys are counted first. Those with at most ``limit`` rows are shuffled once, by key, and scanned whole; both
  directions and all sources share that shuffle, and ``lookup`` carries the probing rows themselves through it;
* of the others, rows are first reduced to one per (key, instant), so a group is bounded by the resolution of the
  clock and not by the number of rows; their sequence is cut into time buckets, and a crowded bucket into segments of
  even size, that are scanned independently (``segments``). What a segment inherits from those before it is computed
  from one summary row each and enters the scan as its first row.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, Window, functions as F

from labspark.functions.columns import as_col, as_list
from labspark.operators.segments import BUCKET, BUCKET_DAYS, LIMIT, Crowd, crowd, cut, running, time_bucket
from labspark.session import materialize, spread

POS, KIND, AHEAD, ROW, LOST = "__pos", "__kind", "__ahead", "__row", "__lost"
_EVENT_FIRST, _PROBE, _EVENT_LAST = 0, 1, 2


@dataclass(frozen=True)
class Source:
    """Events to look up.

    ``picks`` maps an output name to a column over the events. Its value has to grow with ``when``
    (the time itself, or a struct that starts with it), or be any value whose running extreme is
    wanted; NULL means the event does not count for that output.
    ``inclusive`` tells whether an event at the probe's own instant counts.
    ``sized``: a table with at least as many rows of each key, where the events are costly to count.
    """

    events: DataFrame
    when: object
    picks: dict = field(default_factory=dict)
    inclusive: bool = True
    sized: DataFrame | None = None


def _events(by, s: Source, ahead: bool) -> DataFrame:
    # an event that counts at its own instant has to come before the probe in scan order
    kind = _EVENT_FIRST if s.inclusive != ahead else _EVENT_LAST
    rows = s.events.select(*by, as_col(s.when).alias(POS), F.lit(kind).alias(KIND), *[as_col(c).alias(n) for n, c in s.picks.items()])
    return _counted(rows, by, list(s.picks))


def _counted(rows: DataFrame, by, picks) -> DataFrame:
    """Events that any pick counts."""
    return rows.dropna(subset=[*by, POS]).dropna("all", subset=picks)


def _listed(sources) -> list:
    return [] if sources is None else [sources] if isinstance(sources, Source) else list(sources)


def _merged(parts) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def _names(sources) -> list:
    return [n for s in sources for n in s.picks]


def _only(sources, keep) -> list:
    return [replace(s, events=keep(s.events)) for s in sources]


def _once(keep):
    """``keep``, with one result for each table."""
    known = {}
    return lambda df: known.setdefault(id(df), (df, keep(df)))[1]


def _both_ways(by, back, ahead) -> list:
    """Rows of all events: KIND for the scan back, AHEAD for the one ahead. An event that is looked up both ways at one time has one row."""
    parts, rest = [], list(ahead)
    for s in back:
        twin = next((a for a in rest if a.events is s.events), None)
        if twin is None:
            parts.append(_events(by, s, False).withColumn(AHEAD, F.col(KIND)))
            continue
        rest = [a for a in rest if a is not twin]

        def row(at, *known):
            picks = [as_col(c) if any(w is k for k in known) else F.when(F.lit(False), as_col(c)) for w in (s, twin) for c in w.picks.values()]
            kinds = F.lit(_EVENT_FIRST if s.inclusive else _EVENT_LAST), F.lit(_EVENT_LAST if twin.inclusive else _EVENT_FIRST)
            return F.struct(*[c.alias(n) for c, n in zip([as_col(at.when), *kinds, *picks], [POS, KIND, AHEAD, *s.picks, *twin.picks], strict=True)])

        rows = F.when(as_col(s.when).eqNullSafe(as_col(twin.when)), F.array(row(s, s, twin))).otherwise(F.array(row(s, s), row(twin, twin)))
        parts.append(_counted(s.events.select(*by, F.inline(rows)), by, [*s.picks, *twin.picks]))
    return parts + [_events(by, a, True).withColumn(AHEAD, F.col(KIND)) for a in rest]


def _scanned(probes: DataFrame, back, ahead, by, total: int) -> DataFrame:
    """``probes`` (with POS, KIND, LOST) with all picks, after one shuffle by key."""
    rows = _merged([probes.withColumn(AHEAD, F.lit(_PROBE)), *_both_ways(by, back, ahead)])
    keys = [*by, LOST]
    rows, group = spread(rows, total, *keys), Window.partitionBy(*keys)
    for sources, extreme, order in ((back, F.max, [F.col(POS), F.col(KIND)]), (ahead, F.min, [F.col(POS).desc(), F.col(AHEAD).desc()])):
        scan = group.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        if sources:
            rows = rows.withColumns({n: extreme(n).over(scan) for n in _names(sources)})
        if sources is back and ahead:  # what no pick ahead counts need not be sorted again
            rows = rows.filter(reduce(or_, [F.col(KIND) == _PROBE, *[F.col(n).isNotNull() for n in _names(ahead)]]))
    return rows.filter(F.col(KIND) == _PROBE)


def _cut_up(probes: DataFrame, sources, by, at, ahead: bool, bucket_days: int, limit: int) -> DataFrame:
    """``seek`` for keys of any size."""
    extreme, names = (F.min if ahead else F.max), _names(sources)
    rows = probes.select(*by, as_col(at).alias(POS), F.lit(_PROBE).alias(KIND)).dropna(subset=[*by, POS])
    rows = _merged([rows, *[_events(by, s, ahead) for s in sources]]).withColumn(BUCKET, time_bucket(POS, bucket_days))
    rows = rows.groupBy(*by, BUCKET, POS, KIND).agg(*[extreme(n).alias(n) for n in names])
    rows, split = cut(materialize(rows, "instants"), by, POS, limit)
    found = running(rows, by, [POS, KIND], {n: extreme for n in names}, split, ahead)
    return found.filter(F.col(KIND) == _PROBE).select(*by, F.col(POS).alias(at if isinstance(at, str) else "at"), *names)


def _crowd(probes: DataFrame, sources, by, limit: int) -> Crowd:
    tables = {}  # each is read once, and its rows count as often as they are looked up
    for df in (probes, *[s.events if s.sized is None else s.sized for s in sources]):
        tables[id(df)] = (df, tables.get(id(df), (df, 0))[1] + 1)
    keys = _merged([df.select(*by, F.lit(n).alias("__times")) for df, n in tables.values()]).dropna(subset=by)
    return crowd(keys, by, limit, times="__times")


def seek(probes: DataFrame, sources, by, at, ahead: bool = False,
         bucket_days: int = BUCKET_DAYS, limit: int = LIMIT) -> DataFrame:
    """One row per distinct (by, at) of the probes with every pick of every source.

    Looking back a pick is the maximum over events up to ``at``, looking ahead the minimum over
    events from ``at`` on. Probes without key or position get no row.
    """
    by, sources = as_list(by), _listed(sources)
    crowded = _crowd(probes, sources, by, limit)

    def near(probes, sources):
        rows = probes.select(*by, as_col(at).alias(POS), F.lit(_PROBE).alias(KIND), F.lit(None).cast("int").alias(LOST)).dropna(subset=[*by, POS])
        found = _scanned(rows, *(([], sources) if ahead else (sources, [])), by, crowded.total)
        # the rows of one instant have the same picks; they lie together, so that this needs no further shuffle
        found = found.groupBy(*by, LOST, POS).agg(*[F.first(n).alias(n) for n in _names(sources)])
        return found.select(*by, F.col(POS).alias(at if isinstance(at, str) else "at"), *_names(sources))

    if not crowded:
        return near(probes, sources)
    return near(crowded.without(probes), _only(sources, crowded.without)).unionByName(
        _cut_up(crowded.within(probes), _only(sources, crowded.within), by, at, ahead, bucket_days, limit))


def lookup(df: DataFrame, by, at: str, back=None, ahead=None, bucket_days: int = BUCKET_DAYS, limit: int = LIMIT, sized: DataFrame | None = None) -> DataFrame:
    """``df`` with the picks of the sources looked up ``back`` and ``ahead`` from ``at``; NULL where key or position is missing.

    ``sized``: a table with as many rows of each key as ``df``, where that is costly to count."""
    by, back, ahead = as_list(by), _listed(back), _listed(ahead)
    crowded = _crowd(df if sized is None else sized, [*back, *ahead], by, limit)

    def near(df, back, ahead):
        missing = reduce(or_, [F.col(c).isNull() for c in [*by, at]])
        # rows that nothing can be looked up for stay with those of their partition, and never meet an event
        lost = F.when(missing, F.spark_partition_id())
        rows = df.select(*by, F.col(at).alias(POS), F.lit(_PROBE).alias(KIND), lost.alias(LOST), F.struct(*df.columns).alias(ROW))
        return _scanned(rows, back, ahead, by, crowded.total).select(f"{ROW}.*", *_names([*back, *ahead]))

    if not crowded:
        return near(df, back, ahead)
    rest = crowded.within(df)
    for sources, forward in ((back, False), (ahead, True)):
        if sources:
            rest = attach(rest, _cut_up(crowded.within(df), _only(sources, crowded.within), by, at, forward, bucket_days, limit), [*by, at])
    without = _once(crowded.without)
    return near(without(df), _only(back, without), _only(ahead, without)).unionByName(rest)


def attach(df: DataFrame, found: DataFrame, on) -> DataFrame:
    """Left join of lookup results; row count and row order keys of ``df`` stay as they are."""
    return df.join(found, as_list(on), "left")
