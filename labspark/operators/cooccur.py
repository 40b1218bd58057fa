"""Co-occurrence of covariates with result classes.

Rows are summed up by the set of cohorts they belong to (``cells``); the few cells are then given to each
of their cohorts, so all cohorts are counted in one pass without a copy of any row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from labspark.functions.columns import as_list
from labspark.functions.privacy import k_mask
from labspark.operators.cells import group_counts, masks, unmask
from labspark.operators.describe import n_rows
from labspark.session import materialize


def first_only() -> Column:
    return F.col("first") == 1


def not_outpatient() -> Column:
    return F.col("enc_class") != "AMB"


def cohorts_medication() -> dict:
    return {"all": None, "without_AMB": not_outpatient(), "only_first": first_only(),
            "first_alone": first_only() & (F.col("alone_med") == 1)}


def cohorts_treatment() -> dict:
    return {"all": None, "without_AMB": not_outpatient(), "only_first": first_only()}


def cohorts_procedures() -> dict:
    return {"all": None, "without_AMB": not_outpatient(), "without_AMB_first": not_outpatient() & first_only()}


def cohorts_conditions() -> dict:
    return {"all": None, "without_AMB": not_outpatient(), "only_first": first_only(),
            "first_alone": first_only() & (F.col("alone_cond") == 1)}


def cohorts_lab() -> dict:
    return {"lab": None, "lab_only_first": first_only(),
            "lab_first_or_amb": first_only() | (F.col("enc_class") == "AMB")}


SUBGROUPS = {"": None, "adults": "age >= 18", "children": "age < 18", "female": "gender = 'female'",
             "male": "gender = 'male'"}


def in_window(df: DataFrame, window, t="time") -> DataFrame:
    """Rows in [start, end); ``window`` is a pair of dates or None for no restriction."""
    if window is None:
        return df
    lo, hi = window
    return df.filter((F.col(t) >= F.lit(lo)) & (F.col(t) < F.lit(hi)))


def named_groups(conditions: dict, name="cohort") -> tuple[dict[str, Column], list[Column]]:
    return masks(conditions.values()), [F.struct(F.lit(n).alias(name)) for n in conditions]


def flag_sums(flags) -> dict[str, Column]:
    return {f: F.sum(f) for f in flags}


def lab_sums(labels) -> dict[str, Column]:
    out = {}
    for lab in labels:
        any_result = reduce(lambda a, b: a + b, [F.col(f"{lab}_{r}") for r in "HNL"]) > 0
        out.update({f"{lab}_{r}": F.sum(f"{lab}_{r}") for r in "HLN"})
        out[f"{lab}_any"] = F.count_if(any_result)
    return out


def _flag_table(sums: DataFrame, keys, flags) -> DataFrame:
    return (sums.select(*keys, "n_total", *flags).unpivot([*keys, "n_total"], list(flags), "grp", "n_match")
            .select("grp", *keys, F.col("n_match").cast("bigint"),
                    (F.col("n_total") - F.col("n_match")).cast("bigint").alias("n_no_match"), "n_total"))


def _lab_table(sums: DataFrame, keys, labels) -> DataFrame:
    entries = F.array(*[F.struct(F.lit(f"{lab}_{side}").alias("grp"), F.col(f"{lab}_{side}").cast("bigint").alias("n_match"),
                                 F.col(f"{lab}_N").cast("bigint").alias("n_normal"), F.col(f"{lab}_any").alias("n_measured"))
                        for lab in labels for side in ("H", "L")])
    return sums.select(*keys, F.inline(entries)).select("grp", *keys, "n_match", "n_normal", "n_measured")


def cooccurrence(df: DataFrame, flags, result: str, cohorts: dict, window=None, extra_keys=()) -> DataFrame:
    """Per flag, cohort and result class: rows with the flag, without it, and all rows."""
    extra = as_list(extra_keys)
    sums = group_counts(in_window(df, window), *named_groups(cohorts), [*extra, result], flag_sums(flags), "n_total")
    return _flag_table(sums, [*extra, "cohort", result], flags)


def lab_cooccurrence(df: DataFrame, labels, result: str, cohorts: dict, extra_keys=()) -> DataFrame:
    """Per label and side: rows with an abnormal, a normal and any result of the label."""
    extra = as_list(extra_keys)
    sums = group_counts(df, *named_groups(cohorts), [*extra, result], lab_sums(labels))
    return _lab_table(sums, [*extra, "cohort", result], labels)


FOLLOWUP_COHORTS = {"5days_all": (None, 120), "2hours_all": (None, 2), "48hours_all": (None, 48),
                    "same_encounter": ("same_encounter = 1", 120), "only_first_5d": ("first = 1", 120)}


_OUTCOMES = ("next_no", "next_H", "next_N", "next_L")


def followup_groups() -> dict:
    return {name: F.lit(True) if cond is None else F.expr(cond) for name, (cond, _) in FOLLOWUP_COHORTS.items()}


def followup_sums() -> dict[str, Column]:
    """Rows per outcome of the next measurement, for every time limit; ``other``: rows without a known outcome."""
    out = {}
    for limit in sorted({limit for _, limit in FOLLOWUP_COHORTS.values()}):
        outcome = (F.when((F.col("next_flag") == 0) | (F.col("next_hours") > limit), "next_no")
                   .when(F.col("next_result").isin("H", "N", "L"), F.concat(F.lit("next_"), F.col("next_result"))))
        out.update({f"{o}_{limit}": F.count_if(outcome == o) for o in _OUTCOMES})
        out[f"other_{limit}"] = F.count_if(outcome.isNull())
    return out


def _followup_table(sums: DataFrame, keys) -> DataFrame:
    """Outcomes that occur, next to all rows of the same key."""
    limit = F.create_map(*[F.lit(x) for name, (_, limit) in FOLLOWUP_COHORTS.items() for x in (name, limit)])[F.col("cohort")]
    limits = sorted({limit for _, limit in FOLLOWUP_COHORTS.values()})

    def of(o):
        return reduce(lambda rest, x: F.when(limit == x, F.col(f"{o}_{x}")).otherwise(rest), limits, F.lit(None).cast("bigint"))

    entries = F.array(*[F.struct(F.lit(None if o == "other" else o).cast("string").alias("grp"), of(o).alias("n_match")) for o in (*_OUTCOMES, "other")])
    return (sums.select(*keys, "n_total", F.inline(entries)).filter("n_match > 0")
            .select("grp", *keys, "n_match", (F.col("n_total") - F.col("n_match")).alias("n_no_match"), "n_total"))


def followup_cooccurrence(df: DataFrame, result: str, extra_keys=()) -> DataFrame:
    """Per cohort and result class: what the next measurement within the cohort's time limit shows."""
    extra = as_list(extra_keys)
    sums = group_counts(df, *named_groups(followup_groups()), [*extra, result], followup_sums(), "n_total")
    return _followup_table(sums, [*extra, "cohort", result])


def cooccurrence_all(df: DataFrame, sources: dict, windows: dict, k: int = 5) -> DataFrame:
    """Every co-occurrence table for the result class (five subgroups) and the grade (everybody).

    ``sources`` maps medication, treatment, procedures, conditions to flag lists and lab to labels;
    absent kinds are skipped. ``windows`` maps a kind to the time window with usable data.

    The wide table is read once: rows are summed up by both result classes, the subgroups and the cohorts of all kinds
    that they belong to; every table is made from these few cells.
    """
    kinds = {"next_measurement": (followup_groups(), followup_sums(), None)}
    for kind, cohorts in (("medication", cohorts_medication), ("treatment", cohorts_treatment),
                          ("procedures", cohorts_procedures), ("conditions", cohorts_conditions)):
        if sources.get(kind):
            kinds[kind] = (cohorts(), flag_sums(sources[kind]), windows.get("medication" if kind == "treatment" else kind))
    if sources.get("lab"):
        kinds["lab"] = (cohorts_lab(), lab_sums(sources["lab"]), None)

    subgroups = [F.lit(True) if c is None else F.expr(c) for c in SUBGROUPS.values()]
    conditions, bits, sums = [], {}, {}
    for kind, (cohorts, columns, window) in kinds.items():
        for name, cond in cohorts.items():
            usable = F.lit(True) if window is None else (F.col("time") >= F.lit(window[0])) & (F.col("time") < F.lit(window[1]))
            bits.setdefault(kind, {})[len(conditions)] = F.struct(F.lit(name).alias("cohort"))
            conditions.append(usable if cond is None else usable & cond)
        sums.update({f"{kind}.{c}": col for c, col in columns.items()})
    word, sub = masks(conditions), masks(subgroups, "__submask")
    ids = {c: f"c{i}" for i, c in enumerate(sums)}
    cells = materialize(df.withColumns({**word, **sub}).groupBy("result", "result_detail", *word, *sub)
                        .agg(n_rows("n"), *[c.alias(ids[n]) for n, c in sums.items()]), "cooccurrence-cells")

    tables = []
    for result in ("result", "result_detail"):
        which = {i: F.struct(F.lit(n).alias("subgroup")) for i, n in enumerate(SUBGROUPS) if result == "result" or not n}
        keys = ["subgroup", "cohort", result]
        for kind, (_, columns, _) in kinds.items():
            each = unmask(unmask(cells, bits[kind]), which, "__submask")
            total = each.groupBy(*keys).agg(F.sum("n").alias("n_total"), *[F.sum(ids[f"{kind}.{c}"]).alias(c) for c in columns])
            if kind == "next_measurement":
                table, counts = _followup_table(total, keys), ["n_match", "n_no_match"]
            elif kind == "lab":
                table, counts = _lab_table(total, keys, sources["lab"]), ["n_match", "n_normal"]
            else:
                table, counts = _flag_table(total, keys, sources[kind]), ["n_match", "n_no_match"]
            static = [c for c in table.columns if c not in counts and not c.startswith("n_")]
            label = F.concat_ws(" ", F.lit("medication_after" if kind == "treatment" else kind), F.lit(result), F.nullif(F.col("subgroup"), F.lit("")))
            masked = k_mask(table, counts, static, k)
            tables.append(masked.withColumn("source", label).withColumnRenamed(result, "result_class")
                          .withColumns({c: F.col(c).cast("string") for c in masked.columns if c.startswith("n_")}).drop("subgroup"))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)
