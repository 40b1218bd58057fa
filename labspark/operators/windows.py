"""Flags and values from events in a time window around each row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from labspark.functions.columns import add_all, as_col, as_list, flag
from labspark.functions.dates import days, day_of, hours, hours_between, micros_between
from labspark.functions.predicates import has_prefix
from labspark.operators.seek import Source, lookup


def prefix_groups(code, groups: dict) -> dict[str, Column]:
    """Group name -> predicate on the code column."""
    return {name: has_prefix(code, prefixes) for name, prefixes in groups.items()}


def window_flags(df: DataFrame, events: DataFrame, groups: dict, by, when, lo, hi,
                 lo_open: bool = False, hi_open: bool = False) -> DataFrame:
    """Adds one 0/1 column per group: is there an event of the group in the row's window?

    ``lo`` and ``hi`` are columns of ``df``; ``groups`` maps a name to a predicate on ``events``.
    The window holds an event exactly when the first event from ``lo`` on is not beyond ``hi``.
    """
    names = list(groups)
    base = df.withColumns({"__lo": as_col(lo), "__hi": as_col(hi)})
    picks = {f"__{n}": F.when(cond, as_col(when)) for n, cond in groups.items()}
    out = lookup(base, by, "__lo", ahead=Source(events, when, picks, inclusive=not lo_open))

    def inside(n):
        first = F.col(f"__{n}")
        return first < F.col("__hi") if hi_open else first <= F.col("__hi")

    return out.select(*df.columns, *[flag(inside(n)).alias(n) for n in names])


def flags_before(df, events, groups, by, t, when, n_hours: int) -> DataFrame:
    """Events in (t - n hours, t]."""
    return window_flags(df, events, groups, by, when, as_col(t) - hours(n_hours), as_col(t), lo_open=True)


def flags_after(df, events, groups, by, t, when, n_hours: int) -> DataFrame:
    """Events in (t, t + n hours]."""
    return window_flags(df, events, groups, by, when, as_col(t), as_col(t) + hours(n_hours), lo_open=True)


def alone(flags, ignore=()) -> Column:
    """1 when exactly one flag is set, not counting the ignored ones."""
    return flag(add_all([f for f in flags if f not in ignore]) == 1)


def label_flags(df: DataFrame, events: DataFrame, windows: dict, by, t, when, label="label",
                result="result", results=("N", "H", "L")) -> DataFrame:
    """Adds ``<label>_<result>`` for every label with its own +- window in hours, both ends in.

    Looks for the last event up to ``t`` and the next one from ``t`` on, in one pass each.
    """
    by = as_list(by)

    def picks(prefix):
        return {f"{prefix}{lab}_{r}": F.when((as_col(label) == lab) & (as_col(result) == r), as_col(when))
                for lab in windows for r in results}

    out = lookup(df, by, t, Source(events, when, picks("__b_")), Source(events, when, picks("__a_")))
    return out.select(*df.columns, *[within(t, f"__b_{lab}_{r}", f"__a_{lab}_{r}", h).alias(f"{lab}_{r}")
                                     for lab, h in windows.items() for r in results])


def within(t, before, after, n_hours: int) -> Column:
    """1 when the last time before or the next time after is at most n hours away."""
    t = as_col(t)
    return flag((as_col(before) >= t - hours(n_hours)) | (as_col(after) <= t + hours(n_hours)))


def result_rank(result) -> Column:
    """Preference among equally near values: N, then L, then H, then none."""
    r = as_col(result)
    return F.when(r == "N", 1).when(r == "L", 2).when(r == "H", 3).otherwise(4)


def nearest_picks(when, value, rank, cond, ahead: bool) -> Column:
    """Pick for ``nearest``: time first, then preference, then the smaller value."""
    sign = 1 if ahead else -1
    return F.when(cond, F.struct(as_col(when).alias("t"), (sign * rank).alias("r"), (sign * as_col(value)).alias("v")))


def nearest_of(t, before, after, n_hours: int) -> Column:
    """Value of the nearer of the two candidates, NULL when both are too far away."""
    t, b, a = as_col(t), as_col(before), as_col(after)
    limit = F.lit(int(n_hours) * 3_600_000_000)

    def candidate(c, gap, sign):
        return F.when(gap <= limit, F.struct(gap.alias("g"), (sign * c["r"]).alias("r"), (sign * c["v"]).alias("v")))

    return F.least(candidate(b, micros_between(b["t"], t), -1), candidate(a, micros_between(t, a["t"]), 1))["v"]


def nearest_value(df: DataFrame, events: DataFrame, windows: dict, by, t, when, value,
                  label="label", result="result", suffix="_value_norm") -> DataFrame:
    """Adds the value of the nearest event per label within +- its window.

    Equally near events: result N before L before H before none, then the smaller value.
    """
    by = as_list(by)
    rank = result_rank(result)
    back = Source(events, when, {f"__b_{lab}": nearest_picks(when, value, rank, as_col(label) == lab, False) for lab in windows})
    ahead = Source(events, when, {f"__a_{lab}": nearest_picks(when, value, rank, as_col(label) == lab, True) for lab in windows})
    out = lookup(df, by, t, back, ahead)
    return out.select(*df.columns, *[nearest_of(t, f"__b_{lab}", f"__a_{lab}", h).alias(f"{lab}{suffix}")
                                     for lab, h in windows.items()])


def interval_sources(intervals: DataFrame, start, end, point) -> list[Source]:
    """Sources for ``interval_flags`` (looking back from the row's time)."""
    s, e, p = as_col(start), as_col(end), as_col(point)
    clear, unclear, at = e.isNotNull() & (s != e), e.isNull() | (s == e), F.coalesce(p, s)
    return [
        # latest end among the intervals that have started, and the last point of an unclear one: an interval is either
        Source(intervals, F.when(clear, s).when(unclear, at), {"__until": F.when(clear, e), "__unclear": F.when(unclear, at)}),
        # last end strictly before; an interval that ends at the row's own time still holds it ...
        Source(intervals, e, {"__ended": F.when(clear, e)}, inclusive=False),
        # ... unless it starts later than it ends, when it never holds anything
        Source(intervals, e, {"__ended_inv": F.when(clear & (s > e), e)}),
    ]


def interval_flag_columns(t, n_hours: int, prefix: str) -> dict[str, Column]:
    t = as_col(t)
    oldest = t - hours(n_hours)
    return {
        f"{prefix}_during": flag(F.col("__until") >= t),
        f"{prefix}_before": flag((F.col("__ended") >= oldest) | (F.col("__ended_inv") >= oldest)),
        f"{prefix}_unclear": flag(F.col("__unclear") >= oldest),
    }


def interval_flags(df: DataFrame, intervals: DataFrame, by, t, start="period_start", end="period_end",
                   point="performed", n_hours: int = 12, prefix="dialyse") -> DataFrame:
    """Row lies inside a closed interval, at most n hours after one, or near one of unclear length."""
    by = as_list(by)
    out = lookup(df, by, t, interval_sources(intervals, start, end, point))
    return out.select(*df.columns, *[c.alias(n) for n, c in interval_flag_columns(t, n_hours, prefix).items()])


def context_window(t, enc_class, enc_start, enc_end, after_in: int = 14, after_out: int = 15):
    """Window bounds by context: encounter plus 14 days, or 15 days from midnight for outpatients."""
    c = as_col(enc_class)
    lo = F.when(c == "IMP", as_col(enc_start)).when(c == "AMB", day_of(t))
    hi = F.when(c == "IMP", as_col(enc_end) + days(after_in)).when(c == "AMB", day_of(t) + days(after_out))
    return lo, hi


def context_flags(df: DataFrame, events: DataFrame, groups: dict, by, t, when, enc_class="enc_class",
                  enc_start="enc_start", enc_end="enc_end") -> DataFrame:
    lo, hi = context_window(t, enc_class, enc_start, enc_end)
    return window_flags(df, events, groups, by, when, lo, hi, hi_open=True)


def next_event(df: DataFrame, by, t, tie, values: dict, prefix="next_") -> DataFrame:
    """Adds values of the next strictly later row of the same key.

    Of several rows at that instant the one with the largest ``tie`` is taken.
    ``values`` maps an output suffix to a column of ``df``.
    """
    by = as_list(by)
    payload = F.struct(*[as_col(c).alias(n) for n, c in values.items()])
    # equal ids at one instant: the greatest payload, so that reruns agree
    instants = df.groupBy(*by, t).agg(F.max(F.struct(as_col(tie).alias("tie"), payload.alias("p")))["p"].alias("__p"))
    out = lookup(df, by, t, ahead=Source(instants, t, {"__n": F.struct(F.col(t).alias("t"), F.col("__p").alias("p"))}, inclusive=False))
    n = F.col("__n")
    return out.select(*df.columns,
                      *[n["p"][v].alias(f"{prefix}{v}") for v in values],
                      flag(n.isNotNull()).alias(f"{prefix}flag"),
                      hours_between(t, n["t"]).alias(f"{prefix}hours"))


def pair_nearest(left: DataFrame, right: DataFrame, by, t, tie, keep: dict, n_hours: int, left_id,
                 suffix="_2") -> DataFrame:
    """For every row of ``left`` the nearest row of ``right`` with the same keys within n hours.

    Equally near rows: the smaller ``tie``. Rows of ``left`` without a partner are dropped and one
    row is kept per ``left_id``. ``keep`` maps output names (suffixed) to columns of ``right``.
    """
    by = as_list(by)
    payload = F.struct(*[as_col(c).alias(n) for n, c in keep.items()])
    instants = right.groupBy(*by, t).agg(
        F.min(F.struct(as_col(tie).alias("tie"), payload.alias("p"))).alias("__p"))
    pick = F.struct(F.col(t).alias("t"), F.col("__p")["tie"].alias("tie"), F.col("__p")["p"].alias("p"))
    limit = F.lit(int(n_hours) * 3_600_000_000)

    def candidate(c, gap):
        return F.when(gap <= limit, F.struct(gap.alias("g"), c["tie"].alias("tie"), c["t"].alias("t"), c["p"].alias("p")))

    b, a = F.col("__b"), F.col("__a")
    near = (lookup(left, by, t, Source(instants, t, {"__b": pick}), Source(instants, t, {"__a": pick}))
            .withColumn("__c", F.least(candidate(b, micros_between(b["t"], t)), candidate(a, micros_between(t, a["t"]))))
            .filter(F.col("__c").isNotNull()).drop("__a", "__b"))
    row = F.struct(F.col("__c")["g"].alias("g"), F.col("__c")["tie"].alias("tie"),
                   *[F.col(c).alias(c) for c in left.columns], F.col("__c").alias("c"))
    best = near.groupBy(left_id).agg(F.min(row).alias("__r"))
    r = F.col("__r")
    return best.select(*[r[c].alias(c) for c in left.columns],
                       r["c"]["t"].alias(f"{t}{suffix}"),
                       *[r["c"]["p"][n].alias(f"{n}{suffix}") for n in keep],
                       (r["g"] / F.lit(3.6e9)).alias("hours_between"))
