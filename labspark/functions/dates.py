"""Dates, ages and time differences. Timestamps are zone-free (``timestamp_ntz``)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from labspark.functions.columns import as_col

NTZ = "timestamp_ntz"


def timestamp(c) -> Column:
    """Wall-clock timestamp; text that is no timestamp becomes NULL."""
    return as_col(c).try_cast(NTZ)


def partial_date(raw) -> Column:
    """Date from text that may be a year or a year and month (middle of the period is assumed)."""
    s = F.trim(as_col(raw))
    filled = (F.when(F.length(s) == 4, F.concat(s, F.lit("-07-01")))
              .when(F.length(s) == 7, F.concat(s, F.lit("-15")))
              .otherwise(s))
    return filled.try_cast("date")


def age_years(birth, at) -> Column:
    """Complete years between two dates, truncated toward zero."""
    return (F.months_between(as_col(at).cast("date"), as_col(birth)) / 12).cast("int")


def month_of(t) -> Column:
    return F.trunc(as_col(t).cast("date"), "month")


def day_of(t) -> Column:
    """Midnight of the day, as a zone-free timestamp."""
    return as_col(t).cast("date").cast(NTZ)


def micros_between(a, b) -> Column:
    """Microseconds from ``a`` to ``b``."""
    return F.timestamp_diff("MICROSECOND", as_col(a), as_col(b))


def hours_between(a, b) -> Column:
    return micros_between(a, b) / F.lit(3.6e9)


def hours(n: int) -> Column:
    return F.expr(f"INTERVAL '{int(n)}' HOUR")


def days(n: int) -> Column:
    return F.expr(f"INTERVAL '{int(n)}' DAY")


def event_time(*cols) -> Column:
    """First available time of several candidates."""
    return F.coalesce(*[as_col(c) for c in cols])
