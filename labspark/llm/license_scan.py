"""License scan by diagonal voting.

The hashes of all rolling word pairs of a text are joined to their places in license templates. A
pair at word p of the text and word q of a template votes for diagonal p - q. Votes are gathered
per (document, template, diagonal), diagonals that lie close together are merged (words inserted or
left out), and a merged span is verified by the share of the template's pairs that it covers and by
its length. Places of short phrases are the diagonals with all votes of the phrase.

Defined cases. Null or empty text: no words, no labels, score 0. Null id and rows sharing an id:
every row is scanned by itself. Other columns are ignored. Empty table: empty result.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window, functions as F

from labspark.llm.text import ascii_lower, let, split_terms, tail, text_or_empty


@dataclass(frozen=True)
class Template:
    """``phrase``: its exact places are counted. At most 64 words, so that its pairs fit one bit mask."""

    label: str
    text: str
    phrase: bool = False

    @property
    def words(self) -> list[str]:
        return re.findall("[a-z0-9]+", self.text.lower())


# Phrases to count, and well-known opening words of license notices.
PHRASES = (
    Template("mit", "mit license", True),
    Template("apache", "apache license", True),
    Template("gpl", "general public license", True),
)
NOTICES = (
    Template("mit-notice", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    Template("apache-2.0", "licensed under the apache license version 2.0"),
    Template("gpl-3.0", "licensed under the gnu general public license version 3"),
    Template("gpl-notice", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    Template("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2.0"),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    Template("unlicense", "this is free and unencumbered software released into the public domain"),
    Template("cc-by-nc", "licensed under cc by nc 4.0"),
    Template("cc-by-sa", "licensed under cc by sa 4.0"),
    Template("creative-commons", "licensed under a creative commons attribution license"),
)


def scan(docs: DataFrame, templates: tuple[Template, ...] = PHRASES + NOTICES, slack: int = 3, threshold: float = 0.7,
         id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(spans, documents). Spans: verified places of templates, exact phrase places included. Documents:
    ``doc_id``, ``n_words`` and, over the spans of its row, counts, places, labels and the best score.

    ``slack``: most words between merged diagonals. ``threshold``: share of a template's pairs that a span must cover."""
    spark = docs.sparkSession
    if any(not 2 <= len(t.words) <= 64 for t in templates):
        raise ValueError("a template has 2 to 64 words")
    places = [(i, t.label, t.phrase, len(t.words) - 1, q, 1 << q, a, b) for i, t in enumerate(templates) for q, (a, b) in enumerate(zip(t.words, t.words[1:], strict=False))]
    pairs = spark.createDataFrame(places, "template int, label string, phrase boolean, pairs int, q int, bit long, ta string, tb string").withColumn("h", F.xxhash64("ta", "tb"))
    wanted = [r.h for r in pairs.select("h").distinct().collect()]  # as many as the templates have pairs

    base = docs.select(F.monotonically_increasing_id().alias("row"), docs[id_col].alias("doc_id"), split_terms(ascii_lower(text_or_empty(docs, text_col))).alias("w"))
    hits = let(F.col("w"), lambda w: F.transform(
        F.array_compact(F.transform(F.zip_with(w, tail(w, 1), lambda a, b: F.xxhash64(a, b)), lambda h, i: F.when(h.isin(wanted), i))),
        lambda i: F.struct(i.alias("p"), F.get(w, i).alias("a"), F.get(w, i + 1).alias("b"))))
    found = base.select("row", "doc_id", F.size("w").cast("long").alias("n_words"), hits.alias("hits")).select("row", "doc_id", "n_words", F.explode_outer("hits").alias("hit"))
    found = found.select("row", "doc_id", "n_words", F.col("hit.p").alias("p"), F.col("hit.a").alias("a"), F.col("hit.b").alias("b"), F.xxhash64("hit.a", "hit.b").alias("h"))
    # the hash finds the pair, the words confirm it
    votes = found.join(pairs, (found["h"] == pairs["h"]) & (found["a"] == pairs["ta"]) & (found["b"] == pairs["tb"]), "left").drop(pairs["h"]).repartition("row")
    row = ["row", "doc_id", "n_words"]
    lines = votes.groupBy(*row, "template", "label", "phrase", "pairs", (F.col("p") - F.col("q")).alias("diagonal")).agg(
        F.bit_or("bit").alias("mask"), F.min("p").alias("first"), F.max("p").alias("last"))
    in_order = Window.partitionBy("row", "template").orderBy("diagonal")
    apart = F.coalesce((F.col("diagonal") - F.lag("diagonal").over(in_order) > slack).cast("int"), F.lit(1))
    merged = lines.withColumn("apart", apart).withColumn("span", F.sum("apart").over(in_order))
    whole = F.bit_count("mask") == F.col("pairs")
    spans = merged.groupBy(*row, "template", "label", "phrase", "pairs", "span").agg(
        F.bit_or("mask").alias("mask"), F.min("first").alias("first"), F.max("last").alias("last"), F.max(F.bit_count("mask")).alias("straight"),
        F.count_if(whole).alias("places"), F.min(F.when(whole, F.col("diagonal"))).alias("first_place"), F.max(F.when(whole, F.col("diagonal"))).alias("last_place"))
    fits = F.col("last") - F.col("first") + 2 <= 1.5 * (F.col("pairs") + 1) + slack
    covered = F.greatest(F.col("straight"), F.when(fits, F.bit_count("mask")).otherwise(F.lit(0))) / F.col("pairs")
    spans = spans.withColumn("score", covered).withColumn("verified", F.when(F.col("phrase"), F.col("places") > 0).otherwise(F.col("score") >= threshold))
    phrase = F.col("phrase") & (F.col("places") > 0)
    documents = spans.groupBy(*row).agg(
        F.coalesce(F.sum(F.when(phrase, F.col("places"))), F.lit(0)).cast("long").alias("n_base"),
        F.min(F.when(phrase, F.col("first_place"))).cast("long").alias("first_word"), F.max(F.when(phrase, F.col("last_place"))).cast("long").alias("last_word"),
        F.array_sort(F.collect_set(F.when(phrase, F.col("label")))).alias("base_labels"), F.array_sort(F.collect_set(F.when(F.col("verified"), F.col("label")))).alias("labels"),
        F.coalesce(F.max("score"), F.lit(0.0)).alias("score"))
    return spans.filter("verified"), documents.drop("row")
