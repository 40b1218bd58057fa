"""Registered queries and the SQL that states the same result."""

from __future__ import annotations

from labspark.checks.registry import ORACLES, QUERIES


def load_all() -> tuple[dict, dict]:
    """Imports every query module; returns (queries, checking SQL)."""
    from labspark.checks import (aggregates, cleaning, composites, deidentify, joins, quality,  # noqa: F401
                                 scalars, sources, statistics, windows)
    return QUERIES, ORACLES
