"""Column helpers shared by the text operators. All run in the JVM, without user functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

SPACE = " \t\n\x0b\f\r"
SPACES = "[\\x20\\x09-\\x0D]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def text_or_empty(docs: DataFrame, text_col: str = "text") -> Column:
    """The text, empty where null."""
    return F.coalesce(docs[text_col].cast("string"), F.lit(""))


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z only; other scripts keep their case."""
    return F.when(F.length(c) == F.octet_length(c), F.lower(c)).otherwise(F.translate(c, _UPPER, _UPPER.lower()))


def strip(c: Column) -> Column:
    """Removes ASCII white space at both ends."""
    return F.btrim(c, F.lit(SPACE))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row, however often the body uses it.

    Spark evaluates a column again for every mention inside array functions; a lambda argument is not."""
    return F.element_at(F.transform(F.array(value), body), 1)


def split_words(c: Column) -> Column:
    """Runs of other than ASCII white space, in order."""
    bare = strip(c)
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACES))


def split_terms(c: Column) -> Column:
    """Runs of digits, lower-case letters and characters beyond ASCII; ``c`` is lower-cased before."""
    def bare(parts: Column) -> Column:  # punctuation at an end leaves an empty part there
        first = F.when(F.element_at(parts, 1) == "", F.lit(2)).otherwise(F.lit(1))
        last = F.size(parts) - F.when(F.element_at(parts, -1) == "", F.lit(1)).otherwise(F.lit(0))
        return F.slice(parts, first, F.greatest(last - first + 1, F.lit(0)))
    return let(F.split(c, "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"), bare)


def has_terms(c: Column) -> Column:
    """Whether ``split_terms`` of the lower-cased text finds any; stops at the first."""
    return c.rlike("[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]")


def count_words(c: Column) -> Column:
    bare = strip(c)
    return F.when(bare == "", F.lit(0)).otherwise(F.size(F.split(bare, SPACES))).cast("long")


def tail(a: Column, skip: int) -> Column:
    """``a``, a column or lambda argument, without its first ``skip`` elements."""
    return F.slice(a, skip + 1, F.size(a))


def rolling_hashes(hashes: Column, width: int) -> Column:
    """Hash of every run of ``width`` elements (a power of two), by doubling; empty if there are fewer."""
    def double(a: Column, done: int) -> Column:
        if done == width:
            return F.slice(a, 1, F.greatest(F.size(a) - (width - 1), F.lit(0)))
        return let(F.zip_with(a, tail(a, done), lambda x, y: F.xxhash64(x, y)), lambda b: double(b, done * 2))
    return let(hashes, lambda a: double(a, 1))
