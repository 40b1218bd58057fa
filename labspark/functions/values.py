"""Measured values: comparison value, classification, labels."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from labspark.functions.columns import as_col
from labspark.spec import COMPARATORS, Cuts, Range


def number(x) -> Column:
    return F.lit(x).cast("double")


def comparator_of(raw) -> Column:
    """Trimmed comparator, NULL when it is none of the known ones."""
    c = F.trim(as_col(raw))
    return F.when(c.isin(*COMPARATORS), c)


def compare_value(value, comparator, digits: int = 3, eps: float = 1e-6) -> Column:
    """Rounded value, moved just below or above for a strict comparator."""
    v, c = F.round(as_col(value), digits), comparator_of(comparator)
    return F.when(c == "<", v - F.lit(eps)).when(c == ">", v + F.lit(eps)).otherwise(v)


def effective_bound(ref, factor, default: float | None, digits: int = 3) -> Column:
    """The sample's own bound in the target unit, else the default one."""
    return F.round(F.coalesce(as_col(ref) * as_col(factor), number(default)), digits)


def classify(value, low, high) -> Column:
    v = as_col(value)
    return (F.when(v.isNull(), None).when(v < as_col(low), "L").when(v > as_col(high), "H")
            .otherwise("N"))


def classify_detail(value, low, high, cuts: Cuts) -> Column:
    """Grades L3, L2, L1, N, H1 ... H4: bounds decide low/normal, cut-offs decide the grade."""
    v = as_col(value)
    grade_low = F.when(v < cuts.l2, "L3").when(v < cuts.l1, "L2").otherwise("L1")
    return (F.when(v.isNull(), None)
            .when(v < as_col(low), grade_low)
            .when(v <= as_col(high), "N")
            .when(v <= cuts.h1, "H1")
            .when(v <= cuts.h2, "H2")
            .when(v <= cuts.h3, "H3")
            .otherwise("H4"))


def classify_one_sided(raw, norm, low, high, default_low, default_high, digits: int = 3) -> Column:
    """Own bound against the raw value, default bound against the normalised one, side by side.

    NULL when neither side has any bound. Defaults may be numbers, None or columns.
    """
    def bound(d):
        return d if isinstance(d, Column) else number(d)

    raw, norm, low, high = as_col(raw), as_col(norm), as_col(low), as_col(high)
    d_low, d_high = bound(default_low), bound(default_high)
    below = F.when(low.isNotNull(), raw < F.round(low, digits)).otherwise(norm < d_low)
    above = F.when(high.isNotNull(), raw > F.round(high, digits)).otherwise(norm > d_high)
    unbounded = F.coalesce(low, d_low).isNull() & F.coalesce(high, d_high).isNull()
    return F.when(unbounded, None).when(below, "L").when(above, "H").otherwise("N")


def label_codes(code, groups: dict) -> Column:
    """Name of the code list that holds the code, NULL for none."""
    c, out = as_col(code), None
    for name, codes in groups.items():
        out = F.when(c.isin(*codes), name) if out is None else out.when(c.isin(*codes), name)
    return out


def code_type(ops, snomed) -> Column:
    a, b = as_col(ops).isNotNull(), as_col(snomed).isNotNull()
    return F.when(a & b, "both").when(a, "ops").when(b, "snomed")


def range_label(low, high) -> Column:
    """Text of a reference range: ``ab x`` (from), ``bis y`` (up to) or ``x-y``."""
    lo, hi = as_col(low), as_col(high)
    lo_s, hi_s = lo.cast("string"), hi.cast("string")
    return (F.when(hi.isNull() & lo.isNotNull(), F.concat(F.lit("ab "), lo_s))
            .when(lo.isNull() & hi.isNotNull(), F.concat(F.lit("bis "), hi_s))
            .when(lo.isNotNull() & hi.isNotNull(), F.concat(lo_s, F.lit("-"), hi_s)))


def plausible(value, rng: Range) -> Column:
    """Strictly inside the plausibility limits."""
    v = as_col(value)
    return (v < F.lit(rng.high_ext)) & (v > F.lit(rng.low_ext))


def implausible(value, rng: Range) -> Column:
    v = as_col(value)
    return (v >= F.lit(rng.high_ext)) | (v <= F.lit(rng.low_ext))


def ref_id(kind: str, id_) -> Column:
    """Reference text ``Type/<id>``."""
    return F.concat(F.lit(f"{kind}/"), as_col(id_).cast("string"))


def ref_kind(ref) -> Column:
    """Type part of a reference."""
    return F.split_part(as_col(ref), F.lit("/"), F.lit(1))


def cluster_id(enc, obs) -> Column:
    """Encounter as cluster; a measurement without one is its own cluster."""
    e = as_col(enc)
    return (F.when(e.isNotNull(), F.concat(e.cast("string"), F.lit("_imp")))
            .otherwise(F.concat(as_col(obs).cast("string"), F.lit("_amb"))))
