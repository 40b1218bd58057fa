"""Unit conversion."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from labspark.functions.columns import as_col
from labspark.session import few


def normalize_units(df: DataFrame, units: DataFrame, label="label", unit="unit", value="value",
                    optional_labels=(), keep_factor: bool = True) -> DataFrame:
    """Adds ``value_norm`` (and ``unit_factor``) by a (label, unit) lookup.

    Labels in ``optional_labels`` fall back to the raw value when the unit is missing or unlisted.
    ``label`` is a column name or a column. The conversion table is counted, and broadcast unless it is large.
    """
    conv = few(units.select(F.col("label").alias("__label"), F.col("source_unit").alias("__unit"),
                            F.col("factor").alias("unit_factor")), "units")
    rows = df.withColumn("__l", as_col(label))
    out = rows.join(conv, (rows["__l"] == conv["__label"]) & (rows[unit] == conv["__unit"]), "left")
    norm = F.col(value) * F.col("unit_factor")
    if optional_labels:
        norm = F.when(F.col("__l").isin(*optional_labels), F.coalesce(norm, F.col(value))).otherwise(norm)
    out = out.withColumn("value_norm", norm).drop("__l", "__label", "__unit")
    return out if keep_factor else out.drop("unit_factor")


def drop_invalid(df: DataFrame, units: DataFrame, label="label", unit="unit") -> DataFrame:
    """Removes rows whose unit is marked invalid for their label (a column name or a constant).

    A label that has any invalid unit also loses its rows without unit.
    """
    bad = few(units.filter(F.col("target_unit") == "invalid").select(
        F.col("label").alias("__l"), F.col("source_unit").alias("__u")), "invalid-units")
    rows = df.join(bad, (as_col(label) == bad["__l"]) & (df[unit] == bad["__u"]), "left_anti")
    if not isinstance(label, str):
        any_bad = bad.filter(bad["__l"] == label).agg((F.count(F.lit(1)) > 0).alias("x")).scalar()
        return rows.filter(F.col(unit).isNotNull() | ~any_bad)
    has_bad = few(bad.select("__l").distinct(), "labels-with-invalid")
    return rows.join(has_bad, (as_col(label) == has_bad["__l"]) & F.col(unit).isNull(), "left_anti")


def invalid_count(df: DataFrame, units: DataFrame, label="label", unit="unit") -> DataFrame:
    bad = few(units.filter(F.col("target_unit") == "invalid").select(
        F.col("label").alias("__l"), F.col("source_unit").alias("__u")), "invalid-units")
    return df.join(bad, (as_col(label) == bad["__l"]) & (df[unit] == bad["__u"]), "left_semi").agg(
        F.count(F.lit(1)).alias("n"))
