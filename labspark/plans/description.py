"""Description of the measured values: statistics, distributions and timelines."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from labspark.functions.columns import join_nullsafe
from labspark.functions.privacy import k_mask
from labspark.operators import describe
from labspark.session import materialize

KEYS = ("code", "unit")
STATISTICS_COLUMNS = ("obs_id", "code", "value", "unit", "ref_low", "ref_high", "ref_high_unit", "ref_low_unit", "comparator", "value_compare",
                      "time", "gender", "age", "pat_id", "patient")


def describe_measurements(base: DataFrame, raw: DataFrame | None = None, k: int = 5, cohorts=None) -> dict[str, DataFrame]:
    """All result tables of the description part.

    ``base`` is the cleaned measurement table with value_compare, age and gender; ``raw`` the
    status-filtered extract for the completeness table.
    """
    rows = materialize(base.select(*[c for c in STATISTICS_COLUMNS if c in base.columns]).distinct(), "described")
    stats = describe.cohort_statistics(rows, cohorts, KEYS)
    out = {
        "statistics": k_mask(stats, "n_pat", [*describe.COHORT_COLUMNS, *KEYS], k),
        "distribution": k_mask(describe.cohort_distribution(rows, cohorts, KEYS), "n", [*describe.COHORT_COLUMNS, *KEYS, "bin_start", "bin_end"], k),
        "timeline": k_mask(describe.monthly_counts(rows.select("code", "value", "unit", "obs_id", "time").distinct()), "n", [*KEYS, "month"], k),
        "age_gender": describe.age_gender_report(rows),
    }
    if raw is not None:
        out["completeness"] = completeness_masked(raw, k)
    return out


def completeness_masked(raw: DataFrame, k: int = 5, code="code", patient="patient") -> DataFrame:
    """Filled cells per column and code; codes with few patient entries are suppressed."""
    long = describe.completeness(raw, code)
    patients = long.filter(F.col("column_name") == patient).select(code, F.col("n").alias("__p"))
    small = (F.col("__p") != 0) & (F.col("__p") < k)
    return join_nullsafe(long, patients, code).select(
        code, "column_name",
        F.when(small & (F.col("column_name") == patient), F.lit(f"<{k}")).when(~small, F.col("n").cast("string")).alias("n"))
