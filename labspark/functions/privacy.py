"""Small-count suppression and de-identification columns."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, functions as F

from labspark.functions.columns import as_col, as_list


def k_mask(df: DataFrame, keys, static=(), k: int = 5) -> DataFrame:
    """Suppress whole rows: a key that is NULL or in (0, k) masks every key of the row and blanks
    all columns that are not static. Zero counts are kept."""
    keys, static = as_list(keys), as_list(static)
    small = reduce(or_, [F.col(c).isNull() | ((F.col(c) != 0) & (F.col(c) < k)) for c in keys])

    def shown(c):
        if c in keys:
            return F.when(small, F.lit(f"<{k}")).otherwise(F.col(c).cast("string")).alias(c)
        return F.col(c) if c in static else F.when(~small, F.col(c)).alias(c)

    return df.select(*[shown(c) for c in df.columns])


def k_cells(df: DataFrame, cols, k: int = 5) -> DataFrame:
    """Suppress single cells that hold a number in (0, k)."""
    def shown(c):
        text = F.col(c).cast("string")
        n = text.try_cast("double")
        return F.when((n > 0) & (n < k), F.lit(f"<{k}")).otherwise(text)

    return df.withColumns({c: shown(c) for c in as_list(cols)})


def k_censor(value, k: int = 5) -> Column:
    """Report cell: any number other than 0 that is below k is suppressed (negatives included)."""
    text = as_col(value).cast("string")
    n = text.try_cast("double")
    return F.when((n != 0) & (n < k), F.lit(f"<{k}")).otherwise(text)


def hash_id(value, key: str, n: int = 32) -> Column:
    """Keyed hash of an id, cut to ``n`` characters; a ``Type/`` prefix stays readable."""
    text = as_col(value).cast("string")
    kind = F.regexp_extract(text, r"^([A-Za-z]+/)", 1)
    return F.concat(kind, F.substring(F.sha2(F.concat(F.lit(key), text), 256), 1, n))


def pseudonym(value, domain: str, key: str, n: int = 32) -> Column:
    """Keyed hash with the domain as salt, so that domains cannot be linked."""
    text = as_col(value).cast("string")
    return F.substring(F.sha2(F.concat(F.lit(f"{key}|{domain}|"), text), 256), 1, n)


def postcode_area(code) -> Column:
    return F.substring(as_col(code), 1, 2)


def birth_month(raw) -> Column:
    """Day removed from a full date; shorter dates stay as they are."""
    return F.regexp_replace(as_col(raw), r"(\d{2,4})-(\d{2})-(\d{2})\b", "$1-$2")


def mask(value, text: str = "masked") -> Column:
    """A constant absent-reason wherever there was a value."""
    return F.when(as_col(value).isNotNull(), F.lit(text))


def redact(df: DataFrame, cols, blank: bool = False) -> DataFrame:
    """Drop columns that identify a person, or blank them when the shape must stay."""
    cols = [c for c in as_list(cols) if c in df.columns]
    if not blank:
        return df.drop(*cols)
    return df.withColumns({c: F.lit(None).cast(df.schema[c].dataType) for c in cols})
