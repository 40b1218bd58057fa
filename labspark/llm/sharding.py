"""Proportional stratified interleaving of rows into shards.

Rows are put in a seeded random order within their source; the row of rank i among n gets the
fraction (i + 1/2) / n. Sorted by fraction, every stretch of the list has all sources in proportion,
so equal cuts give shards whose mixture matches the whole, with row counts at most one apart.

Defined cases. Null source: a source of its own, last. Null id or text, rows sharing an id, equal
rows: each is one row of the result (equal rows are interchangeable). Ties of the fraction go by
source, hash and id. Extra columns stay out unless named in ``carry``. Empty table: empty result.
Fewer rows than shards: some shards are empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from labspark.llm import ranks
from labspark.llm.text import text_or_empty
from labspark.session import materialize


def stratified_shards(docs: DataFrame, shards: int, seed: str = "shards", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                      carry: dict[str, Column] | None = None) -> DataFrame:
    """One row per document: ``doc_id``, the columns of ``carry`` (name -> expression), ``shard`` and ``slot``."""
    carry = carry or {}
    text = text_or_empty(docs, text_col)
    narrow = materialize(docs.select(
        docs[id_col].alias("doc_id"), docs[source_col].isNull().alias("no_source"), F.coalesce(docs[source_col].cast("string"), F.lit("")).alias("stratum"),
        F.xxhash64(F.lit(seed), docs[id_col], text).alias("h"), *[c.alias(f"_{k}") for k, c in carry.items()]), "shard-rows")
    total = narrow.count()
    buckets = ranks.buckets_for(total)
    rows = narrow.withColumn("bucket", ranks.hash_bucket(F.col("h"), buckets)).withColumn("one", F.lit(1).cast("long"))
    by_source = ranks.with_running(rows, ["no_source", "stratum"], "bucket", ["h", "doc_id"], "one")
    placed = by_source.withColumn("fraction", (F.col("before") + 0.5) / F.col("whole")).drop("before", "whole")
    placed = placed.withColumn("bucket", F.floor(F.col("fraction") * buckets).cast("long"))
    order = ranks.with_running(placed, [], "bucket", ["fraction", "no_source", "stratum", "h", "doc_id"], "one")
    cut = order.withColumn("shard", F.expr(f"before * {int(shards)} div whole").cast("int"))
    first = F.expr(f"(shard * whole + {int(shards) - 1}) div {int(shards)}")
    return cut.select("doc_id", *[F.col(f"_{k}").alias(k) for k in carry], "shard", (F.col("before") - first).cast("long").alias("slot"))


def write_shards(docs: DataFrame, path: str, shards: int, **kw) -> None:
    """Writes ``docs`` as one folder per shard, each in slot order."""
    whole = {f"c_{i}": docs[c] for i, c in enumerate(docs.columns)}
    out = stratified_shards(docs, shards, carry=whole, **kw)
    out = out.select("shard", "slot", *[F.col(f"c_{i}").alias(c) for i, c in enumerate(docs.columns) if c not in ("shard", "slot")])
    out.repartition(shards, "shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
