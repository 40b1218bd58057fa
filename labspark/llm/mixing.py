"""Mixing sources to target weights.

Targets: sources share a multiple of all words by weight; a target stops at a multiple of its
source's words, and what it cannot take goes to the others by weight. Within a source the documents
stand in a seeded random order, laid end to end on a line of words. A source is taken in full passes
and one part pass, whose end is moved to the nearest document border and then mended by the one
document whose size fits the rest best. The line of each pass is cut into blocks; a splitting tree
draws, from the root down, how many blocks of each source go to either half of the output shards
(multivariate hypergeometric), so quotas are exact at every node; blocks are dealt to shards in a
permuted order, and a shard is shuffled by a seeded key.

Defined cases. Null source: a source of its own, last. Null or empty text: size 0, takes 0. Null
ids, rows sharing an id and equal rows are rows of their own. Extra columns stay out unless carried.
Empty table: empty result. A source with few documents can miss its target by part of a document,
as documents are never cut.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from labspark.llm import ranks
from labspark.llm.text import count_words, text_or_empty
from labspark.session import materialize

SOURCE = ["no_source", "stratum"]


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """``sizes`` (no_source, stratum, words; one row per source) with ``target``.

    Sorted by the ratio of limit to weight, the limited sources come first: a source is limited when the
    level left by those before it reaches its ratio. One task, one row per source."""
    ordered = Window.partitionBy(F.lit(0)).orderBy(*SOURCE)
    nth = (F.row_number().over(ordered) - 1) % len(weights)
    w = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (nth + 1).cast("int"))).withColumn("limit", F.col("words") * F.lit(most))
    ratio = Window.partitionBy(F.lit(0)).orderBy(F.col("limit") / F.col("weight"), *SOURCE).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(0))
    w = w.withColumns({"_limits": F.coalesce(F.sum("limit").over(ratio), F.lit(0.0)), "_weights": F.coalesce(F.sum("weight").over(ratio), F.lit(0.0)),
                       "_all": F.sum("words").over(everything) * F.lit(share), "_all_weights": F.sum("weight").over(everything)})
    level = (F.col("_all") - F.col("_limits")) / (F.col("_all_weights") - F.col("_weights"))
    w = w.withColumn("_limited", F.col("limit") / F.col("weight") <= level)
    used = F.sum(F.when(F.col("_limited"), F.col("limit")).otherwise(0.0)).over(everything)
    left = F.sum(F.when(F.col("_limited"), 0.0).otherwise(F.col("weight"))).over(everything)
    target = F.when(F.col("_limited"), F.col("limit")).otherwise((F.col("_all") - used) / F.nullif(left, F.lit(0.0)) * F.col("weight"))
    return w.select(*SOURCE, "words", target.alias("target"))


def split_quotas(blocks: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """Blocks per (source, shard) with exact sums: recursive multivariate hypergeometric halving."""
    out = np.zeros((len(blocks), shards), dtype=np.int64)

    def split(quota: np.ndarray, low: int, high: int) -> None:
        if high - low == 1:
            out[:, low] = quota
            return
        middle, total = (low + high) // 2, int(quota.sum())
        # both halves get a share by their number of shards, to the nearest block
        to_left = (total * (middle - low) + (high - low) // 2) // (high - low)
        draw = np.random.default_rng([seed, low, high]).multivariate_hypergeometric(quota, to_left, method="marginals")
        split(draw, low, middle)
        split(quota - draw, middle, high)

    split(blocks.astype(np.int64), 0, shards)
    return out


def mix(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, shards: int = 24, seed: int = 7,
        min_block_words: int = 20_000, max_blocks: int = 200_000, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        carry: dict[str, Column] | None = None) -> DataFrame:
    """One row per document and copy taken, or one with null ``copy`` for a document not taken: ``doc_id``,
    ``size``, ``source_size``, ``target``, ``place`` (start on its source's line; with the source it tells
    rows apart), ``copy``, ``block``, ``shard``, ``shuffle_key``, and the columns of ``carry``.

    Blocks hold at least ``min_block_words`` words, and more where a mix would have over ``max_blocks`` of
    them besides one per source and pass; the driver sees one row per source."""
    text = text_or_empty(docs, text_col)
    keys = docs.select(
        docs[id_col].alias("doc_id"), docs[source_col].isNull().alias("no_source"), F.coalesce(docs[source_col].cast("string"), F.lit("")).alias("stratum"),
        F.xxhash64(F.lit(seed), docs[id_col], text).alias("h"), count_words(text).alias("size"), *[c.alias(f"_{k}") for k, c in (carry or {}).items()])
    names = [f"_{k}" for k in carry or {}]
    narrow = materialize(keys.drop(*names), "mix-rows")
    n_rows, n_words = narrow.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    bucket = ranks.hash_bucket(F.col("h"), ranks.buckets_for(n_rows))
    sums = narrow.withColumn("bucket", bucket)
    sources = materialize(source_targets(narrow.groupBy(*SOURCE).agg(F.sum("size").alias("words")), weights, share, most), "mix-sources")

    # a line of words per source; (source, start) tells rows with words apart
    line = ranks.with_running(keys.withColumn("bucket", bucket) if names else sums, SOURCE, "bucket", ["h", "doc_id"], "size", sums)
    line = line.withColumnRenamed("before", "place").drop("whole", "bucket").join(sources, SOURCE)
    passes = F.least(F.floor(F.col("target") / F.nullif(F.col("words"), F.lit(0))), F.lit(int(most))).cast("long")
    line = line.withColumn("passes", F.coalesce(passes, F.lit(0))).withColumn("rest", F.col("target") - F.col("passes") * F.col("words"))
    line = line.withColumn("part", (F.col("rest") > 0) & (F.col("size") > 0) & (F.col("place") + F.col("size") / 2 <= F.col("rest")))
    line = materialize(line, "mix-line")
    missing = line.groupBy(*SOURCE).agg((F.first("rest") - F.sum(F.when(F.col("part"), F.col("size")).otherwise(0))).alias("miss"))
    change = F.when(F.col("part"), -F.col("size")).otherwise(F.col("size"))
    could = line.filter((F.col("size") > 0) & (F.col("passes") + F.when(F.col("part"), 0).otherwise(1) <= most)).select(*SOURCE, "place", "h", change.alias("change"))
    best = could.join(missing, SOURCE).groupBy(*SOURCE).agg(
        F.min(F.struct(F.abs(F.col("miss") - F.col("change")).alias("left"), "h", "place")).alias("b"), F.first("miss").alias("miss"))
    mend = best.filter(F.col("b.left") < F.abs("miss")).select(*SOURCE, F.col("b.place").alias("place"), F.col("b.h").alias("h"), F.lit(True).alias("mended"))
    line = line.join(mend, [*SOURCE, "place", "h"], "left")
    taken = F.col("passes") + (F.col("part") != F.coalesce(F.col("mended") & (F.col("size") > 0), F.lit(False))).cast("long")
    block_words = max(min_block_words, -(-int(n_words * share) // max_blocks))
    copies = line.withColumn("taken", F.when(F.col("size") > 0, taken).otherwise(0)).withColumn(
        "copy", F.explode_outer(F.when(F.col("taken") > 0, F.sequence(F.lit(1).cast("long"), F.col("taken"))))).withColumn("block", F.floor(F.col("place") / block_words))
    copies = copies.select("doc_id", *SOURCE, "h", "size", "place", F.col("words").alias("source_size"), "target", "copy", "block", *names)
    return _dealt(copies, shards, seed).select(
        "doc_id", "size", "source_size", "target", "place", *SOURCE, "copy", "block", "shard", F.xxhash64(F.lit(seed), "h", "copy").alias("shuffle_key"),
        *[F.col(c).alias(c[1:]) for c in names])


def _dealt(copies: DataFrame, shards: int, seed: int) -> DataFrame:
    """``copies`` with the shard of their block."""
    spark = copies.sparkSession
    block = [*SOURCE, "copy", "block"]
    # blocks number at most max_blocks besides one per source and pass, so a source's permutation fits one task
    blocks = materialize(copies.filter(F.col("copy").isNotNull()).select(*block).distinct().withColumn(
        "nth", F.row_number().over(Window.partitionBy(*SOURCE).orderBy(F.xxhash64(F.lit(seed), F.lit("deal"), *block), "copy", "block")) - 1), "mix-blocks")
    per_source = blocks.groupBy(*SOURCE).count().orderBy(*SOURCE).collect()
    quotas = split_quotas(np.array([r["count"] for r in per_source], dtype=np.int64), shards, seed) if per_source else []
    spans = [(r.no_source, r.stratum, int(end - q), int(end), k) for r, row in zip(per_source, quotas, strict=True) for k, (q, end) in enumerate(zip(row, np.cumsum(row), strict=True)) if q]
    spans = spark.createDataFrame(spans, "no_source boolean, stratum string, low long, high long, shard int")
    numbered = spans.select(*SOURCE, "shard", F.explode(F.sequence("low", F.col("high") - 1)).alias("nth"))
    return copies.join(blocks.join(numbered, [*SOURCE, "nth"]).drop("nth"), block, "left")


def mixed_documents(docs: DataFrame, **kw) -> DataFrame:
    """The mix as rows of ``docs``: a document stands as often as it is taken."""
    out = mix(docs, carry={f"c_{i}": docs[c] for i, c in enumerate(docs.columns)}, **kw)
    return out.filter(F.col("copy").isNotNull()).select(*[F.col(f"c_{i}").alias(c) for i, c in enumerate(docs.columns)])
