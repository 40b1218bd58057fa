"""Lines that many documents share are dropped everywhere but in one document.

Line keys become 128-bit hashes. They are spread by range over (hash, document), reduced to one row per
(hash, document) and then to the keeper and the document count per hash; a join takes these back to the
lines. Grouping and the join replace a stream of sorted first occurrences, and the range exchange is not
needed for them. The result is a run-length compressed keep bitmap per document, not text.

Defined cases. Null or empty text: one empty line, never dropped. Null id: the row counts for
nothing and keeps all lines. Rows sharing an id are one document (their lines count once, the
largest id keeps all of them); equal rows share a bitmap. Other columns are ignored by
``keep_bitmaps`` and kept by ``apply_bitmaps``. Empty table: empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from labspark.llm.text import ascii_lower, let, strip, text_or_empty
from labspark.session import materialize

BITMAP = "array<struct<start:int,length:int>>"


def line_key(line: Column) -> Column:
    return ascii_lower(strip(line))


def _occurrences(docs: DataFrame, min_chars: int, id_col: str, text_col: str) -> DataFrame:
    text = text_or_empty(docs, text_col)
    lines = docs.filter(docs[id_col].isNotNull()).select(
        docs[id_col].alias("doc"), F.xxhash64(text).alias("text_hash"), F.size(F.split(text, "\n")).alias("n"), F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    keys = lines.select("doc", "text_hash", "n", "pos", line_key(F.col("line")).alias("key")).filter(F.length("key") >= min_chars)
    return keys.select("doc", "text_hash", "n", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("second"), F.col("key")).alias("h2"))


def keep_bitmaps(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document that loses lines: ``doc``, ``text_hash``, ``n_dropped`` and ``keep``, the kept
    runs of lines (first line, length)."""
    # stored once: the range bounds, the counts and the join below all read these few bytes per line
    lines = materialize(_occurrences(docs, min_chars, id_col, text_col), "line-keys")
    runs = lines.repartitionByRange("h1", "h2", "doc").sortWithinPartitions("h1", "h2", F.desc("doc"), "pos")
    holders = runs.groupBy("h1", "h2", "doc").agg(F.first("pos").alias("first"))
    shared = holders.groupBy("h1", "h2").agg(F.max("doc").alias("keeper"), F.count("*").alias("docs")).filter(F.col("docs") >= min_docs)
    lost = lines.join(shared.select("h1", "h2", "keeper"), ["h1", "h2"]).filter(F.col("doc") < F.col("keeper"))
    per_doc = lost.groupBy("doc", "text_hash").agg(F.max("n").alias("n"), F.sort_array(F.collect_set("pos")).alias("gone"))
    edges = F.concat(F.array(F.lit(-1)), F.col("gone"), F.array(F.col("n")))
    between = let(edges, lambda e: F.filter(F.zip_with(e, F.slice(e, 2, F.size(e)), lambda a, b: F.struct((a + 1).alias("start"), (b - a - 1).alias("length"))),
                                            lambda r: r["length"] > 0))
    return per_doc.select("doc", "text_hash", F.size("gone").alias("n_dropped"), between.cast(BITMAP).alias("keep"))


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``text_col`` reduced to the kept lines, plus struct ``_lines`` (n, dropped)."""
    text = text_or_empty(docs, text_col)
    # the bitmaps are the small side: a hash table of a partition of them spares the sort of all texts
    b = bitmaps.select(F.col("doc").alias("_doc"), F.col("text_hash").alias("_hash"), F.col("n_dropped").alias("_gone"), F.col("keep").alias("_keep")).hint("shuffle_hash")
    both = docs.join(b, (docs[id_col] == b["_doc"]) & (F.xxhash64(text) == b["_hash"]), "left")
    kept = let(F.split(text, "\n"), lambda lines: F.array_join(F.flatten(F.transform(b["_keep"], lambda r: F.slice(lines, r["start"] + 1, r["length"]))), "\n"))
    others = [F.when(b["_gone"].isNull(), docs[c]).otherwise(kept).alias(c) if c == text_col else docs[c] for c in docs.columns]
    return both.select(*others, F.struct(F.size(F.split(text, "\n")).alias("n"), F.coalesce(b["_gone"], F.lit(0)).alias("dropped")).alias("_lines"))
