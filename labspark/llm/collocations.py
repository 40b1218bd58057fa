"""Phrases of two and more words that belong together, mined with stripes.

A stripe is a prefix of words with a counter of the words that follow it. Every task turns its texts
into stripes and shuffles them by prefix, one row per stripe; stripes of one prefix are merged by adding
their counters entry by entry. Level 1 has the empty prefix, whose counter holds all words; level k
extends phrases of k - 1 words by one. What the scoring needs comes from the merged stripes: the count
of a phrase is its entry, the total of a prefix is the entry one level below, and the largest count among
one-word extensions, ahead and behind, is the maximum over the entries that share a prefix or a rest.

A phrase can only reach ``min_count`` if both phrases one word shorter do. Each level is therefore told by
a bitmap (``filter_bits`` bits, whatever the data's size) which shorter phrases did. A set bit may be a
chance hit: that costs work and changes no result, as entries below ``min_count`` go after the merge.
The stripe of a very frequent prefix is cut into ``SEGMENTS`` parts by the hash of the next word, so that
no task merges all words that follow one hot word; level 1 is spread by word in the same way.

Counts and scores are exact (decimal arithmetic); words are told apart by 64-bit hashes that include
the language, phrases by the hashes of their words.

Defined cases. Null text: empty. Null language: ``und``. Null or repeated ids and equal rows: every row
counts. Very long texts are one slice each. No word, or no phrase frequent enough: empty result. Extra
columns are ignored. Empty table: empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from labspark.llm.byte_words import byte_kinds, chain, slices, split, take_bytes, text_bytes
from labspark.llm.text import text_or_empty
from labspark.session import materialize

KINDS = byte_kinds(b" \t", b".,;:!?\n\x0b\x0c\r")
SEGMENTS = 64
_SLICE_BYTES = 16 << 20
_BITMAP_BITS = 1 << 15  # of one row of Spark's bitmap aggregate


class _Bits:
    """Set of hashes, by their remainder; may hold others by chance."""

    def __init__(self, rows, bits: int):
        self.mask = np.uint64(bits - 1)
        self.bytes = np.zeros(max(bits, _BITMAP_BITS) // 8, np.uint8)
        for bucket, bitmap in rows:
            self.bytes[bucket * (_BITMAP_BITS // 8):(bucket + 1) * (_BITMAP_BITS // 8)] = np.frombuffer(bitmap, np.uint8)

    def holds(self, keys: np.ndarray) -> np.ndarray:
        at = keys & self.mask
        return (self.bytes[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0


def _bits(keys: DataFrame, bits: int) -> _Bits:
    """``bits`` is a power of two; the driver sees one row per 32,768 bits at most."""
    at = F.col("key").bitwiseAND(F.lit(bits - 1))
    rows = keys.groupBy(F.shiftright(at, 15).alias("bucket")).agg(F.bitmap_construct_agg(at.bitwiseAND(F.lit(_BITMAP_BITS - 1))).alias("bitmap"))
    return _Bits(rows.collect(), bits)


class _Words:
    """Words of a run of rows: hash (with the language in it), row, and whether the word before is in the same piece."""

    def __init__(self, texts: pa.Array, langs: np.ndarray):
        self.data, ends = text_bytes(texts)
        self.starts, self.ends, h, piece = split(self.data, KINDS)
        self.row = np.searchsorted(ends, self.starts, "right")
        self.h = chain(langs[self.row], h)
        self.follows = np.zeros(len(h), bool)
        self.follows[1:] = piece[1:] == piece[:-1]


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, _Words]]:
    for batch in batches:
        for run in slices(batch, 1, _SLICE_BYTES):
            yield run.column(0), _Words(run.column(1), run.column(2).to_numpy().view(np.uint64))


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counter of the empty prefix, and its total per language in the rows without a word."""
    for langs, words in _runs(batches):
        h, first, count = np.unique(words.h, return_index=True, return_counts=True)
        rows, per_row = np.unique(words.row, return_counts=True)
        row = np.concatenate([words.row[first], rows])
        none = pa.nulls(len(rows), pa.string())
        yield pa.RecordBatch.from_arrays([
            langs.take(pa.array(row)), pa.array(np.concatenate([h.view(np.int64), np.zeros(len(rows), np.int64)])),
            pa.concat_arrays([take_bytes(words.data, words.starts[first], words.ends[first]), none]), pa.array(np.concatenate([count, per_row]))], names=["lang", "h", "word", "a"])


def _phrase_keys(h: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` words from each word on, over the ends of pieces as well."""
    key = h
    for k in range(1, size):
        key = chain(key[:len(h) - k], h[k:])
    return key


def _stripes(size: int, seen, hot):
    """Stripes of phrases of ``size`` words; ``seen`` and ``hot``: broadcast bitmaps of the phrases one word shorter."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for langs, words in _runs(batches):
            n = len(words.h) - size + 1
            if n <= 0:
                continue
            shorter = _phrase_keys(words.h, size - 1)
            known = seen.value.holds(shorter)
            at = np.flatnonzero(reduce(np.logical_and, [words.follows[k:k + n] for k in range(1, size)], known[:n] & known[1:n + 1]))
            _, first, count = np.unique(chain(shorter[at], words.h[at + size - 1]), return_index=True, return_counts=True)
            at = at[first]
            prefix, after = shorter[at], words.h[at + size - 1]
            segment = np.where(hot.value.holds(prefix), after >> np.uint64(58), np.uint64(0)).astype(np.int32)
            order = np.lexsort((segment, prefix))
            at, prefix, after, segment, count = at[order], prefix[order], after[order], segment[order], count[order]
            head = np.ones(len(at), bool)
            head[1:] = (prefix[1:] != prefix[:-1]) | (segment[1:] != segment[:-1])
            head = np.flatnonzero(head)
            bounds = pa.array(np.append(head, len(at)).astype(np.int32))
            prefixes = words.h[at[head][:, None] + np.arange(size - 1)].view(np.int64).ravel()
            yield pa.RecordBatch.from_arrays([
                langs.take(pa.array(words.row[at[head]])), pa.ListArray.from_arrays(pa.array(np.arange(len(head) + 1, dtype=np.int32) * (size - 1)), pa.array(prefixes)),
                pa.array(segment[head]), pa.ListArray.from_arrays(bounds, pa.array(after.view(np.int64))), pa.ListArray.from_arrays(bounds, pa.array(count))],
                names=["lang", "prefix", "segment", "next", "n"])
    return run


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words = batch.column(0)
        size = len(words.flatten()) // max(1, len(words))
        h = words.flatten().to_numpy().view(np.uint64).reshape(len(words), size)
        key = h[:, 0] if size else np.zeros(0, np.uint64)
        for k in range(1, size):
            key = chain(key, h[:, k])
        yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), batch.column(1)], names=["key", "a"])


def phrase_counts(docs: DataFrame, min_count: int = 30, max_words: int = 4, filter_bits: int = 1 << 26, hot_count: int = 1 << 16,
                  text_col: str = "text", lang_col: str = "lang") -> tuple[DataFrame, DataFrame]:
    """Entries of the merged stripes that reach ``min_count``, as (lang, words, a) with the hashes of the words,
    and the words of level 1 as (lang, h, word, a); there the row without a word holds the language's total."""
    source = docs.select(F.coalesce(docs[lang_col].cast("string"), F.lit("und")).alias("lang"), F.concat(text_or_empty(docs, text_col), F.lit("\n")).alias("text"))
    source = source.select("lang", "text", F.xxhash64("lang").alias("seed"))
    counted = source.mapInArrow(_count_words, "lang string, h long, word string, a long").groupBy("lang", "h", "word").agg(F.sum("a").alias("a"))
    words = materialize(counted.filter((F.col("a") >= min_count) | F.col("word").isNull()), "stripe-words")
    levels = [words.filter(F.col("word").isNotNull()).select("lang", F.array("h").alias("words"), "a")]
    context = docs.sparkSession.sparkContext
    for size in range(2, max_words + 1):
        keys = levels[-1].select("words", "a").mapInArrow(_keys, "key long, a long")
        seen, hot = context.broadcast(_bits(keys, filter_bits)), context.broadcast(_bits(keys.filter(F.col("a") >= hot_count), 1 << 20))
        made = source.mapInArrow(_stripes(size, seen, hot), "lang string, prefix array<long>, segment int, next array<long>, n array<long>")
        # whole stripes are shuffled; adding their counters needs no further exchange
        entries = made.repartition("lang", "prefix", "segment").select("lang", "prefix", "segment", F.explode(F.arrays_zip("next", "n")).alias("e"))
        merged = entries.groupBy("lang", "prefix", "segment", F.col("e.next").alias("next")).agg(F.sum("e.n").alias("a")).filter(F.col("a") >= min_count)
        levels.append(materialize(merged.select("lang", F.concat("prefix", F.array("next")).alias("words"), "a"), f"stripes-{size}"))
    return reduce(DataFrame.unionByName, levels), words


def _exact(c: Column) -> Column:
    return c.cast("decimal(20,0)")


def collocations(docs: DataFrame, min_count: int = 30, max_words: int = 4, subsumed_percent: int = 80, top: int = 2000, **kw) -> DataFrame:
    """Per language the ``top`` phrases by score: lang, rank, phrase, a (count), l, r (counts of the two parts
    of the weakest cut), n (words of the language), score."""
    counts, words = phrase_counts(docs, min_count, max_words, **kw)
    phrases = counts.filter(F.size("words") > 1)

    cuts = phrases.select("lang", "words", "a", F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k"))
    cuts = cuts.withColumns({"left": F.slice("words", F.lit(1), F.col("k")), "right": F.slice("words", F.col("k") + 1, F.size("words"))})
    part = {side: counts.select("lang", F.col("words").alias(side), F.col("a").alias(total)) for side, total in (("left", "l"), ("right", "r"))}
    both = cuts.join(part["left"], ["lang", "left"]).join(part["right"], ["lang", "right"])
    score = F.expr("CAST(2000000 AS DECIMAL(7,0)) * CAST(a AS DECIMAL(20,0)) div (CAST(l AS DECIMAL(20,0)) + CAST(r AS DECIMAL(20,0)))")
    weakest = both.groupBy("lang", "words", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("c"))

    # a phrase inside one that is longer by several words is also inside one longer by one word, which is no rarer
    longer = counts.filter(F.size("words") > 2)
    inner = longer.select("lang", F.explode(F.array(F.slice("words", F.lit(1), F.size("words") - 1), F.slice("words", F.lit(2), F.size("words") - 1))).alias("words"), "a")
    most = inner.groupBy("lang", "words").agg(F.max("a").alias("most"))
    kept = weakest.join(most, ["lang", "words"], "left").filter(F.col("most").isNull() | (100 * _exact(F.col("most")) < subsumed_percent * _exact(F.col("a"))))

    spelled = kept.select("lang", "words", F.posexplode("words").alias("at", "h")).join(words.select("lang", "h", "word"), ["lang", "h"])
    spelled = spelled.groupBy("lang", "words").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    total = words.filter(F.col("word").isNull()).select("lang", F.col("a").alias("n"))
    ranked = kept.join(spelled, ["lang", "words"]).withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("c.score"), F.desc("a"), "phrase")))
    return ranked.filter(F.col("rank") <= top).join(total, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", F.col("c.l").alias("l"), F.col("c.r").alias("r"), "n", F.col("c.score").cast("long").alias("score"))
