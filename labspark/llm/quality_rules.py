"""Quality rules: a table of thresholds compiled into one Spark projection.

Defined cases. Null or empty text: no words, every ratio 0, the length rule fails. Null id: the row
is judged like any other. Equal rows and rows sharing an id: each is judged by itself. Other columns
of the input are ignored, whatever their names. Empty table: empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from labspark.llm.text import let, rolling_hashes, split_words, strip, tail, text_or_empty

SYMBOLS = "#*$%&|<>"
# Frequent function words of the languages that are filtered.
STOP_WORDS = (
    "the", "be", "to", "of", "and", "that", "have", "with", "in", "is", "it", "for", "was", "on", "a",
    "der", "die", "das", "und", "den", "von", "zu", "mit", "ist", "ein", "eine", "des", "dem", "nicht", "im", "für", "auf", "als", "auch", "sich", "werden", "einen",
    "le", "la", "les", "et", "de", "du", "un", "une", "que", "en", "dans", "pour", "est", "qui", "au", "par", "sur", "avec", "pas", "plus",
    "el", "los", "las", "y", "del", "se", "por", "con", "para", "su", "lo", "no", "como", "es", "al",
)


@dataclass(frozen=True)
class Rule:
    """Keeps a document whose ``ratio`` (a key of RATIOS) lies within the bounds; None: no bound.

    ``from_words``: shorter documents are not judged by this rule."""

    name: str
    ratio: str
    low: float | None = None
    high: float | None = None
    from_words: int = 0


RULES = (
    Rule("few_words", "n_words", low=20),
    Rule("word_length", "mean_word_length", low=2, high=14),
    Rule("symbols", "symbols_per_word", high=0.2),
    Rule("stop_words", "stop_words", low=0.02, from_words=50),
    Rule("duplicate_lines", "dup_line_ratio", high=0.4),
    Rule("bullet_lines", "bullet_line_ratio", high=0.9),
    Rule("ellipsis_lines", "ellipsis_line_ratio", high=0.3),
    Rule("repeated_words", "repeat_ratio", high=0.3),
)


def _repeated(words: Column, width: int) -> Column:
    """Number of words covered by runs of ``width`` words that occur twice or more, first ones included."""
    def covered(runs: Column) -> Column:
        placed = F.sort_array(F.zip_with(runs, F.sequence(F.lit(0), F.size(runs) - 1), lambda h, p: F.struct(h.alias("h"), p.alias("p"))))
        twins = let(placed, lambda s: F.filter(F.zip_with(s, tail(s, 1), lambda a, b: F.struct(a["h"].alias("h"), a["p"].alias("p"), b["h"].alias("h2"), b["p"].alias("p2"))),
                                               lambda x: x["h"] == x["h2"]))
        starts = let(twins, lambda x: F.sort_array(F.array_distinct(F.concat(F.transform(x, lambda y: y["p"]), F.transform(x, lambda y: y["p2"])))))
        gaps = let(starts, lambda s: F.zip_with(s, tail(s, 1), lambda a, b: F.least(F.lit(width), F.coalesce(b - a, F.lit(width)))))
        return F.aggregate(gaps, F.lit(0), lambda total, x: total + x)

    def unless_distinct(runs: Column, then: Column) -> Column:
        return F.when(F.size(F.array_distinct(runs)) < F.size(runs), then).otherwise(F.lit(0))

    # most texts repeat no run of half the width: a distinct count on plain longs spares them the rest
    half = width // 2
    longer = lambda a: F.slice(F.zip_with(a, tail(a, half), lambda x, y: F.xxhash64(x, y)), 1, F.greatest(F.size(a) - half, F.lit(0)))
    return let(rolling_hashes(F.transform(words, lambda w: F.xxhash64(w)), half),
               lambda a: unless_distinct(a, let(longer(a), lambda runs: unless_distinct(runs, covered(runs))))).cast("long")


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 8) -> DataFrame:
    """Counts per document: id, words, word characters, symbols, lines, repeats and so on."""
    base = docs.select(docs[id_col].alias("doc_id"), text_or_empty(docs, text_col).alias("t"))
    cut = base.select("doc_id", "t", split_words(F.col("t")).alias("w"), F.filter(F.split("t", "\n"), lambda x: strip(x) != "").alias("lines"))
    return cut.select(
        "doc_id", F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        (F.length("t") - F.length(F.regexp_replace("t", f"[{SYMBOLS}]+", ""))).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        _repeated(F.col("w"), window).alias("n_repeat_words"),
        F.size(F.filter("w", lambda w: w.isin(*STOP_WORDS, *(x.capitalize() for x in STOP_WORDS)))).cast("long").alias("n_stop_words"),
        F.size(F.filter("lines", lambda x: strip(x).rlike("^[-*•‣]"))).cast("long").alias("n_bullet_lines"),
        F.size(F.filter("lines", lambda x: strip(x).rlike("(\\.\\.\\.|…)$"))).cast("long").alias("n_ellipsis_lines"))


def _per(part: str, whole: str) -> Column:
    return F.coalesce(F.col(part) / F.nullif(F.col(whole), F.lit(0)), F.lit(0.0))


# name -> expression over the counts; rules refer to these names
RATIOS = {
    "n_words": lambda: F.col("n_words").cast("double"),
    "mean_word_length": lambda: _per("word_chars", "n_words"),
    "symbols_per_word": lambda: _per("n_symbols", "n_words"),
    "stop_words": lambda: _per("n_stop_words", "n_words"),
    "dup_line_ratio": lambda: _per("n_dup_lines", "n_lines"),
    "bullet_line_ratio": lambda: _per("n_bullet_lines", "n_lines"),
    "ellipsis_line_ratio": lambda: _per("n_ellipsis_lines", "n_lines"),
    "repeat_ratio": lambda: _per("n_repeat_words", "n_words"),
}


def compile_rules(rules: tuple[Rule, ...] = RULES) -> Column:
    """Names of the rules that a row of counts breaks, as one expression."""
    broken = []
    for r in rules:
        value, out = RATIOS[r.ratio](), F.lit(False)
        if r.low is not None:
            out = out | (value < r.low)
        if r.high is not None:
            out = out | (value > r.high)
        broken.append(F.when(out & (F.col("n_words") >= r.from_words), F.lit(r.name)))
    return F.array_compact(F.array(*broken))


def quality_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, the counts, ``failed_rules`` and ``passes``."""
    found = measures(docs, id_col, text_col).withColumn("failed_rules", compile_rules(rules))
    return found.withColumn("passes", F.size("failed_rules") == 0)
