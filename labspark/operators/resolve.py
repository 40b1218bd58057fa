"""Following references between resources."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from labspark.functions.columns import as_list, join_optional
from labspark.functions.values import ref_id


def resolve(df: DataFrame, ref: str, dim: DataFrame, kind: str, dim_id: str, keep=None, how="left") -> DataFrame:
    """Joins the resource that ``ref`` (``Type/<id>``) points to; ``keep`` limits its columns."""
    right = dim.select(*(keep or dim.columns), ref_id(kind, dim_id).alias("__ref"))
    return join_optional(df, right, ref, "__ref", how).drop("__ref")


def resolve_one_hop(adm: DataFrame, med: DataFrame, ref="med_ref") -> DataFrame:
    """Administration -> medication: its id and code."""
    return resolve(adm, ref, med.select("med_id", "code"), "Medication", "med_id").drop(ref)


def resolve_two_hop(adm: DataFrame, med: DataFrame, ref="med_ref") -> DataFrame:
    """Administration -> medication -> ingredient.

    The code of the first medication stays as one row; a reference to an ingredient adds another
    row with the ingredient's id and code, which may be missing.
    """
    first = resolve(adm, ref, med.select("med_id", "code", "med_med_ref"), "Medication", "med_id").drop(ref)
    base = [c for c in adm.columns if c != ref]
    own = (first.filter(F.col("code").isNotNull())
           .select(*base, "med_id", F.lit(None).cast(med.schema["med_id"].dataType).alias("med_id2"), "code"))
    second = med.select(F.col("med_id").alias("med_id2"), "code")
    deeper = first.filter(F.col("med_med_ref").isNotNull()).drop("code")
    deeper = resolve(deeper, "med_med_ref", second, "Medication", "med_id2").select(*base, "med_id", "med_id2", "code")
    return own.unionByName(deeper)


def reference_types(df: DataFrame, encounters: DataFrame, ref="encounter") -> DataFrame:
    """What the encounter references of a table point to, as counts."""
    dim = encounters.select("enc_id", F.col("type").alias("__type"), ref_id("Encounter", "enc_id").alias("__ref"))
    # references are counted first, so that the join sees each of them once, a missing one too: it needs no spreading, and
    # the counts stay where they are
    counts = df.groupBy(ref).agg(F.count(F.lit(1)).alias("__n"))
    joined = counts.join(dim.filter(F.col("__ref").isNotNull()), F.col(ref) == F.col("__ref"), "left")
    label = (F.when(F.col(ref).isNull(), "no_encounter_reference")
             .when(F.col("enc_id").isNull(), "encounter_reference_without_match")
             .when(F.col("__type").isNull(), "encounter_type_is_null")
             .otherwise(F.col("__type")))
    return joined.groupBy(label.alias("encounter_type")).agg(F.sum("__n").alias("n"))


def union_sources(*dfs: DataFrame | None) -> DataFrame | None:
    """Union by name of the sources that exist; absent columns become NULL."""
    present = [d for d in dfs if d is not None]
    if not present:
        return None
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), present)
