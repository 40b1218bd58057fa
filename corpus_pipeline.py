"""Corpus pipeline: quality classifier, line dedup, near-duplicate join, mixing, byte-level BPE.

Each stage takes (spark, docs, sf_dir); its result is stored as Parquet below the shared folder and read
again as the documents of the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from labspark.llm import byte_bpe, jaccard_join, line_dedup, mixing, quality_gam
from labspark.session import materialize


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on the labels, does not reject."""
    return quality_gam.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that others repeat; ``n_chars`` follows the text."""
    kept = line_dedup.apply_bitmaps(docs, line_dedup.keep_bitmaps(docs))
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.when(F.col("_lines.dropped") > 0, F.length("text")).otherwise(F.col("n_chars")))
    return kept.drop("_lines")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return jaccard_join.keep_one(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture takes them."""
    return mixing.mixed_documents(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token count and digests of the encoded and decoded text, per document of the mix."""
    import public_tokenizers
    return byte_bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality_classifier", classify),
    ("line_dedup", drop_lines),
    ("jaccard_join", drop_near_copies),
    ("source_mix", mix),
    ("byte_bpe", tokenize),
]
# neither the classifier nor the tokenizer can be stated in SQL
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents below ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
