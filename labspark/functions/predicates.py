"""Row predicates: status lists, code lists, time ranges."""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import reduce
from operator import or_

from pyspark.sql import Column, functions as F

from labspark.functions.columns import as_col


def status_ok(status, excluded: Iterable[str]) -> Column:
    """True for a missing status or one that is not excluded."""
    c = as_col(status)
    return c.isNull() | ~c.isin(*excluded)


def in_codes(code, codes: Iterable[str], system=None, expected: str | None = None,
             null_system_ok: bool = False) -> Column:
    """Code in the list and, when given, coding system equal to ``expected``."""
    cond = as_col(code).isin(*codes)
    if system is None:
        return cond
    return cond & system_is(system, expected, null_system_ok)


def system_is(system, expected: str, null_ok: bool = False) -> Column:
    cond = as_col(system) == F.lit(expected)
    return (as_col(system).isNull() | cond) if null_ok else cond


def has_prefix(code, prefixes: Iterable[str]) -> Column:
    c = as_col(code)
    return reduce(or_, [c.startswith(p) for p in prefixes])


def in_range(t, lo, hi) -> Column:
    return as_col(t).between(F.lit(lo), F.lit(hi))


def overlaps(start, end, lo, hi) -> Column:
    """Period touches [lo, hi]; an open end counts as still running."""
    s, e = as_col(start), as_col(end)
    return (s <= F.lit(hi)) & (e.isNull() | (e >= F.lit(lo)))


def point_or_period(t, start, end, lo, hi) -> Column:
    return in_range(t, lo, hi) | overlaps(start, end, lo, hi)


def matches_any(text, snippets: Iterable[str]) -> Column:
    """Case-insensitive search for any of the snippets, umlauts included."""
    return as_col(text).rlike("(?iu)" + "|".join(re.escape(s) for s in snippets))
