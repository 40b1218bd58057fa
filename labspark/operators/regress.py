"""Linear regressions on data that stays on the executors.

Any number of models over one table is fitted in three passes: what the checks and centres need, the cross
products, and the residuals. Only the p x p table of each model reaches the driver, where it is solved.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field, replace
from functools import reduce
from operator import add, and_, or_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from labspark.functions.columns import as_col

RESULT_SCHEMA = ("term string, estimate double, std_error double, t_value double, p_value double, source string, "
                 "n_used bigint, n_total bigint, se_type string, deff double, icc double, n_clusters bigint, "
                 "mean_age double, model string")


@dataclass(frozen=True)
class Model:
    """outcome ~ factors + centred age + terms."""

    source: str
    outcome: str
    terms: tuple = ()
    factors: dict = field(default_factory=dict)  # column -> levels, the first is the reference
    center: str | None = None
    cluster: object = None  # column whose values group dependent rows


# --- Student t -------------------------------------------------------------------------------
def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz evaluation)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 / (1.0 - (a + b) * x / (a + 1.0) or tiny)
    out = d
    for m in range(1, 500):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        for step in (even, odd):
            d = 1.0 / (1.0 + step * d or tiny)
            c = 1.0 + step / c or tiny
            out *= c * d
        if abs(c * d - 1.0) < 1e-15:
            break
    return out


def t_two_sided(t: float, df: float) -> float:
    """P(|T| > |t|) of Student's t distribution."""
    if math.isnan(t) or df <= 0:
        return float("nan")
    if math.isinf(t):
        return 0.0
    x, a, b = df / (df + t * t), df / 2.0, 0.5
    if x >= 1.0:
        return 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b


# --- model matrix ----------------------------------------------------------------------------
def factor_dummies(col, levels, name: str | None = None) -> dict[str, Column]:
    """0/1 column per level but the first; NULL for values that are not among the levels."""
    c, name = as_col(col), name or str(col)
    known = c.isin(*levels)
    return {f"{name}{lv}": F.when(known, F.when(c == lv, 1.0).otherwise(0.0)) for lv in levels[1:]}


def design(model: Model) -> dict[str, tuple | None]:
    """Terms of the model matrix in order, each with (column, level, levels); numbers have no level, the intercept no column."""
    def dummies(c):
        return {f"{c}{lv}": (c, lv, tuple(model.factors[c])) for lv in model.factors[c][1:]}

    terms = {"(Intercept)": None}
    for c in model.factors:
        if c == "gender":
            terms.update(dummies(c))
    for c in [*([model.center] if model.center else []), *model.terms]:
        terms.update(dummies(c) if c in model.factors else {c: (c, None, None)})
    return terms


def _design_column(key) -> Column:
    if key is None:
        return F.lit(1.0)
    c, level, levels = key
    return F.col(c).cast("double") if level is None else factor_dummies(c, levels)[f"{c}{level}"]


@dataclass
class _Matrix:
    """Columns of all models side by side: x* (design), y* (outcomes), c* (clusters), m* (row is complete for the model)."""

    rows: DataFrame
    xs: list  # per model: numbers of its design columns
    ys: list  # per model: number of its outcome
    clusters: list  # per model: number of its cluster column or None


def _matrix(df: DataFrame, drafts) -> _Matrix:
    terms = [list(design(d.model).values()) for d in drafts]
    keys = list(dict.fromkeys(k for t in terms for k in t))
    outcomes = list(dict.fromkeys(d.model.outcome for d in drafts))
    clusters = {str(as_col(d.model.cluster)): as_col(d.model.cluster) for d in drafts if d.model.cluster is not None}
    xs, ys = [[keys.index(k) for k in t] for t in terms], [outcomes.index(d.model.outcome) for d in drafts]
    rows = df.select(*[_design_column(k).alias(f"x{i}") for i, k in enumerate(keys)], *[F.col(c).cast("double").alias(f"y{i}") for i, c in enumerate(outcomes)],
                     *[c.alias(f"c{i}") for i, c in enumerate(clusters.values())], *[F.coalesce(d.where, F.lit(False)).alias(f"w{i}") for i, d in enumerate(drafts)])
    masks = [reduce(and_, [F.col(f"w{i}"), *[F.col(f"x{j}").isNotNull() for j in x], F.col(f"y{y}").isNotNull()]).alias(f"m{i}") for i, (x, y) in enumerate(zip(xs, ys))]
    rows = rows.select(*[c for c in rows.columns if not c.startswith("w")], *masks).filter(reduce(or_, [F.col(f"m{i}") for i in range(len(drafts))]))
    names = list(clusters)
    return _Matrix(rows, xs, ys, [None if d.model.cluster is None else names.index(str(as_col(d.model.cluster))) for d in drafts])


def cross_products(m: _Matrix, centres: list) -> list[np.ndarray]:
    """Per model the cross products of its design columns and its outcome (last), in one pass.

    ``centres``: per model None or (position of a column, value taken from it). A task adds the products of its Arrow batches and
    hands out one number per cell; the cells of all tasks are added by Spark.
    """
    layout = [(x, y, c) for x, y, c in zip(m.xs, m.ys, centres)]

    def products(batches):
        sums: dict = {}
        for batch in batches:
            col = {n: batch.column(i).to_numpy(zero_copy_only=False) for i, n in enumerate(batch.schema.names)}
            for i, (x, y, centre) in enumerate(layout):
                use = col[f"m{i}"]
                if use.any():
                    a = np.stack([col[f"x{j}"][use] for j in x] + [col[f"y{y}"][use]])
                    if centre is not None:
                        a[centre[0]] -= centre[1]
                    sums[i] = sums.get(i, 0.0) + a @ a.T
        for i, s in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(s.size, i, np.int32)), pa.array(np.arange(s.size, dtype=np.int32)), pa.array(s.ravel())], ["model", "cell", "v"])

    needed = m.rows.select(*[c for c in m.rows.columns if not c.startswith("c")])
    cells = needed.mapInArrow(products, "model int, cell int, v double").groupBy("model", "cell").agg(F.sum("v").alias("v")).collect()
    out = [np.zeros((len(x) + 1) ** 2) for x in m.xs]
    for r in cells:
        out[r["model"]][r["cell"]] = r["v"]
    return [v.reshape(len(x) + 1, -1) for v, x in zip(out, m.xs)]


def independent_columns(xtx: np.ndarray, tol: float = 1e-10) -> list[int]:
    """Columns left after dropping each one that the columns before it already determine."""
    a, kept = xtx.copy(), []
    for j in range(len(a)):
        if a[j, j] > tol * max(xtx[j, j], 1e-300):
            kept.append(j)
            a = a - np.outer(a[:, j], a[j]) / a[j, j]
    return kept


def usable_columns(model: Model, names: list[str], xtx: np.ndarray, n: int) -> list[int] | None:
    """Columns that enter the fit: levels without rows are left out and, when that is the first
    level, the next one with rows becomes the reference. None when a factor has a single level."""
    out = set(range(len(names)))
    for col, levels in model.factors.items():
        if col != "gender" and col not in model.terms:
            continue
        idx = {lv: names.index(f"{col}{lv}") for lv in levels[1:]}
        rows = {lv: xtx[0, i] for lv, i in idx.items()}
        rows = {levels[0]: n - sum(rows.values()), **rows}
        present = [lv for lv in levels if rows[lv] > 0]
        if len(present) < 2:
            return None
        out -= {i for lv, i in idx.items() if lv not in present[1:]}
    return sorted(out)


def solve(xtx, xty, n):
    """Kept columns, coefficients, inverse of their cross products and degrees of freedom."""
    kept = independent_columns(xtx)
    g = xtx[np.ix_(kept, kept)]
    scale = np.sqrt(np.diag(g))
    inv = np.linalg.inv(g / np.outer(scale, scale)) / np.outer(scale, scale)
    beta = inv @ xty[kept]
    df = n - len(kept)
    return kept, beta, inv, df


# --- clustered standard errors ---------------------------------------------------------------
def cluster_sums(df: DataFrame, resid, cluster) -> DataFrame:
    """One row: total squares, squares between clusters, rows and clusters."""
    e = df.select(as_col(cluster).alias("c"), as_col(resid).alias("e"))
    g = e.groupBy("c").agg(F.count(F.lit(1)).alias("n"), F.sum("e").alias("s"), F.sum(F.col("e") * F.col("e")).alias("q"))
    return g.agg(F.sum("q").alias("sst"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("ssb"),
                 F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_clusters"))


def with_effect(sums: DataFrame) -> DataFrame:
    """Adds the intra-cluster correlation, the design effect and the degrees of freedom to rows of ``cluster_sums``."""
    n, k = F.col("n"), F.col("n_clusters")
    usable = (k >= 2) & (n > k)
    msb = F.col("ssb") / F.nullif(k - 1, F.lit(0))
    msw = (F.col("sst") - F.col("ssb")) / F.nullif(n - k, F.lit(0))
    size = n / F.nullif(k, F.lit(0))
    denom = msb + (size - 1) * msw
    rho = F.when(usable & (denom > 0), F.greatest(F.lit(0.0), F.least(F.lit(1.0), (msb - msw) / denom))).otherwise(0.0)
    return (sums.withColumn("icc", rho)
            .withColumns({"deff": F.when(usable, 1 + (size - 1) * F.col("icc")).otherwise(1.0),
                          "df": F.when(usable, k - 1).otherwise(F.greatest(n - 1, F.lit(1)))}))


def design_effect(df: DataFrame, resid, cluster) -> DataFrame:
    """Intra-cluster correlation of residuals and the design effect, as one row."""
    return with_effect(cluster_sums(df, resid, cluster)).select("n", "n_clusters", "sst", "icc", "deff", "df")


def residual_sums(m: _Matrix, betas: dict) -> dict:
    """Per model the sum of squared residuals (sst) and what its clusters need, in one pass.

    ``betas``: number of the model -> (design column, coefficient, value taken from the column) triples. The residuals themselves
    are squared: a difference of large sums would cancel.
    """
    n_keys = max([c for c in m.clusters if c is not None], default=-1) + 1
    keys = [F.struct(F.lit(g).alias("g"), F.col(f"c{g}").cast("string").alias("c")) for g in range(n_keys)] or [F.struct(F.lit(0).alias("g"), F.lit("").alias("c"))]
    rows = m.rows.withColumn("k", F.explode(F.array(*keys)))
    resid = {i: F.col(f"y{m.ys[i]}") - reduce(add, [(F.col(f"x{j}") - F.lit(float(c)) if c else F.col(f"x{j}")) * F.lit(float(b)) for j, b, c in beta])
             for i, beta in betas.items()}
    e = rows.select("k", *[F.when(F.col(f"m{i}") & (F.col("k.g") == (m.clusters[i] or 0)), x).alias(f"e{i}") for i, x in resid.items()])
    clustered = [i for i in betas if m.clusters[i] is not None]
    groups = e.groupBy("k").agg(*[F.sum(F.col(f"e{i}") * F.col(f"e{i}")).alias(f"q{i}") for i in betas],
                                *[f(f"e{i}").alias(f"{n}{i}") for i in clustered for n, f in (("s", F.sum), ("n", F.count))])
    none = F.lit(None)
    total = groups.agg(F.array(*[F.struct(
        F.lit(i).alias("model"), F.sum(f"q{i}").alias("sst"),
        (F.sum(F.col(f"s{i}") * F.col(f"s{i}") / F.nullif(F.col(f"n{i}"), F.lit(0))) if i in clustered else none.cast("double")).alias("ssb"),
        (F.sum(f"n{i}") if i in clustered else none.cast("bigint")).alias("n"),
        (F.count_if(F.col(f"n{i}") > 0) if i in clustered else none.cast("bigint")).alias("n_clusters")) for i in betas]).alias("a"))
    return {r["model"]: r for r in with_effect(total.select(F.inline("a"))).collect()}


# --- fits ------------------------------------------------------------------------------------
@dataclass(frozen=True, eq=False)
class Rule:
    """What ``column`` must show among the rows ``where``: a flag at least k zeros and k ones, a number at least k values
    that are not all equal, a factor at least two levels (NULL counts as one) with k rows each."""

    column: str
    where: Column
    kind: str = "flag"


@dataclass(frozen=True, eq=False)
class Draft:
    """A model over the rows ``where``. A term whose rule in ``optional`` fails is left out, and the whole draft when none
    of its terms remains; all rules in ``required`` must hold."""

    model: Model
    where: Column
    optional: tuple = ()
    required: tuple = ()


def survey(df: DataFrame, rules: list[Rule], drafts: list[Draft], k: int) -> tuple[list[bool], list[tuple]]:
    """Whether each rule holds, and per draft the number of its rows and the mean of its centred column, in one pass."""
    # rows are added up per set of conditions that they meet and value of each flag or factor; few rows remain for the rules
    checks = [(r.where, r.column, r.kind) for r in rules] + [(d.where, d.model.center, "number") for d in drafts]
    wheres = {id(w): w for w, _, _ in checks}
    met = {key: f"w{j}" for j, key in enumerate(wheres)}
    kept = {c: f"c{j}" for j, c in enumerate(dict.fromkeys(c for _, c, kind in checks if kind != "number"))}
    added = {c: j for j, c in enumerate(dict.fromkeys(c for _, c, kind in checks if kind == "number" and c))}
    sums = [f(F.col(c).cast("double")).alias(f"{name}{j}") for c, j in added.items() for name, f in (("n", F.count), ("lo", F.min), ("hi", F.max), ("t", F.sum))]
    cells = df.groupBy(*[w.alias(met[key]) for key, w in wheres.items()], *[F.col(c).alias(name) for c, name in kept.items()]).agg(F.count(F.lit(1)).alias("n"), *sums)
    x, n, none = F.col("x"), F.col("n"), F.lit(None)

    def entry(i, where, column, kind):
        if kind == "number":
            level, parts = none, [F.col(f"{name}{added[column]}") for name in ("n", "lo", "hi", "t")] if column else [none] * 4
        else:
            level, value = F.col(kept[column]), F.col(kept[column]).cast("double")
            parts = [F.when(value.isNotNull(), n), value, value, value * n] if kind == "flag" else [none] * 4
        kinds = zip(parts, ("n_values", "x", "hi", "total"), ("bigint", "double", "double", "double"), strict=True)
        return F.when(F.col(met[id(where)]), F.struct(F.lit(i).alias("i"), level.cast("string").alias("level"), n.alias("n"), *[p.cast(t).alias(c) for p, c, t in kinds]))

    entries = [entry(i, *check) for i, check in enumerate(checks)]
    levels = (cells.select(F.explode(F.array(*entries)).alias("e")).filter("e IS NOT NULL").groupBy("e.i", "e.level")
              .agg(F.sum("e.n").alias("n"), F.coalesce(F.sum("e.n_values"), F.lit(0)).alias("n_values"), F.min("e.x").alias("x"), F.max("e.hi").alias("hi"), F.sum("e.total").alias("total")))
    found = {r["i"]: r for r in levels.groupBy("i").agg(
        F.sum(n).alias("n"), F.count(F.lit(1)).alias("n_levels"), F.min(n).alias("min_rows"), F.sum("n_values").alias("n_values"),
        F.sum("total").alias("total"), F.coalesce(F.min(x) != F.max("hi"), F.lit(False)).alias("varies"),
        F.coalesce(F.sum(F.when(x == 0, n)), F.lit(0)).alias("n_zero"), F.coalesce(F.sum(F.when(x == 1, n)), F.lit(0)).alias("n_one")).collect()}

    def holds(r, kind):
        if r is None:
            return False
        if kind == "factor":
            return r["n_levels"] >= 2 and r["min_rows"] >= k
        return r["varies"] and (r["n_values"] >= k if kind == "number" else min(r["n_zero"], r["n_one"]) >= k)

    heads = [found.get(i) for i in range(len(rules), len(rules) + len(drafts))]
    return ([holds(found.get(i), r.kind) for i, r in enumerate(rules)],
            [(0, None) if h is None else (h["n"], h["total"] / h["n_values"] if h["n_values"] else None) for h in heads])


def _settle(drafts: list[Draft], heads: list[tuple], verdict: dict) -> tuple[list, list]:
    """Drafts that remain after their rules, with their heads."""
    kept = []
    for d, head in zip(drafts, heads):
        failed = {r.column for r in d.optional if not verdict[r]}
        terms = tuple(t for t in d.model.terms if t not in failed)
        if head[0] and all(verdict[r] for r in d.required) and (terms or not d.optional):
            kept.append((replace(d, model=replace(d.model, terms=terms)), head))
    return [d for d, _ in kept], [h for _, h in kept]


def _formula(m: Model) -> str:
    return f"{m.outcome} ~ " + " + ".join([*[c for c in m.factors if c not in m.terms], *([m.center] if m.center else []), *m.terms])


def fit_rows(df: DataFrame, drafts: list[Draft], k: int = 5) -> list[tuple]:
    """Rows of ``RESULT_SCHEMA`` for all models that can be fitted, in three passes over ``df`` however many there are.

    Left out are drafts that fail their rules, have fewer than ``k`` complete rows, or a factor with a single level.
    """
    rules = list({r: None for d in drafts for r in (*d.optional, *d.required)})
    held, heads = survey(df, rules, drafts, k) if drafts else ([], [])
    drafts, heads = _settle(drafts, heads, dict(zip(rules, held)))
    if not drafts:
        return []
    m = _matrix(df, drafts)
    names = [list(design(d.model)) for d in drafts]
    centres = [(t.index(d.model.center), mean) if d.model.center and mean is not None else None for d, t, (_, mean) in zip(drafts, names, heads)]
    solved, betas = {}, {}
    for i, (d, g) in enumerate(zip(drafts, cross_products(m, centres))):
        n = int(g[0, 0])  # squares of the intercept
        usable = usable_columns(d.model, names[i], g[:-1, :-1], n) if n >= k else None
        if usable is not None:
            kept, beta, inv, dof = solve(g[np.ix_(usable, usable)], g[usable, -1], n)
            kept = [usable[j] for j in kept]
            solved[i] = (n, kept, beta, inv, dof)
            betas[i] = [(m.xs[i][j], b, centres[i][1] if centres[i] and centres[i][0] == j else None) for j, b in zip(kept, beta)]
    sums = residual_sums(m, betas) if betas else {}
    out = []
    for i, (n, kept, beta, inv, dof) in solved.items():
        model, (n_total, mean), row = drafts[i].model, heads[i], sums[i]
        se = np.sqrt(np.diag(inv) * row["sst"] / dof) if dof > 0 else np.full(len(kept), np.nan)
        deff = icc = clusters = None
        if model.cluster is not None:
            deff, icc, clusters, dof = row["deff"], row["icc"], row["n_clusters"], row["df"]
            se = se * math.sqrt(deff)
        for j, b, s in zip(kept, beta, se):
            t = float(b / s) if s and not math.isnan(s) else float("nan")
            out.append((names[i][j], float(b), float(s), t, t_two_sided(t, dof), model.source, n, n_total,
                        "normal" if deff is None else "cluster_deff", deff, icc, clusters, mean, _formula(model)))
    return out


def ols(df: DataFrame, model: Model, k: int = 5) -> DataFrame | None:
    """Fits one model on all rows; None when it cannot be fitted."""
    rows = fit_rows(df, [Draft(model, F.lit(True))], k)
    return df.sparkSession.createDataFrame(rows, RESULT_SCHEMA) if rows else None


def regressions(df: DataFrame, drafts: list[Draft], k: int = 5) -> DataFrame:
    """All fits over ``df`` in one table; models without enough rows are left out."""
    return df.sparkSession.createDataFrame(fit_rows(df, drafts, k), RESULT_SCHEMA)


# --- model checks ----------------------------------------------------------------------------
def covariate_checks(df: DataFrame, cols, continuous: bool = False) -> DataFrame:
    """One row per column with the numbers the validity rule needs, from a single aggregation."""
    def parts(c):
        x = F.col(c)
        spread = F.max(x) != F.min(x)
        if continuous:
            return F.struct(F.lit(c).alias("column_name"), F.count(x).alias("n_values"),
                            F.coalesce(spread, F.lit(False)).alias("varies"))
        return F.struct(F.lit(c).alias("column_name"), F.count_if(x == 0).alias("n_zero"), F.count_if(x == 1).alias("n_one"),
                        F.coalesce(spread, F.lit(False)).alias("varies"))

    return df.agg(F.array(*[parts(c) for c in cols]).alias("a")).select(F.inline("a"))


def valid_covariates(df: DataFrame, cols, k: int = 5, continuous: bool = False) -> list[str]:
    """Columns that vary and, for flags, have at least k rows with and without the flag."""
    cols = list(cols)
    if not cols:
        return []
    checks = {r["column_name"]: r for r in covariate_checks(df, cols, continuous).collect()}  # one row per column

    def ok(r):
        return r["varies"] and (r["n_values"] >= k if continuous else min(r["n_zero"], r["n_one"]) >= k)

    return [c for c in cols if ok(checks[c])]


def level_check(df: DataFrame, col, k: int = 5) -> DataFrame:
    """Number of levels, rows of the rarest one, and whether the factor can be used."""
    return (df.groupBy(as_col(col).alias("level")).count()
            .agg(F.count(F.lit(1)).alias("n_levels"), F.min("count").alias("min_rows"))
            .withColumn("valid", F.coalesce((F.col("n_levels") >= 2) & (F.col("min_rows") >= k), F.lit(False)).cast("int")))


def valid_levels(df: DataFrame, col, k: int = 5) -> bool:
    return bool(level_check(df, col, k).first()["valid"])


def exclusions(df: DataFrame, max_hours: int = 120) -> DataFrame:
    """Rows left out of the regressions and how many have a follow-up in time."""
    nxt, h = F.col("next_flag"), F.col("next_hours")
    return df.agg(
        F.count_if(~F.col("gender").isin("male", "female")).alias("n_gender_unknown"),
        F.count_if(F.col("age").isNull()).alias("n_age_null"),
        F.count_if((nxt == 1) & (h <= max_hours)).alias("n_valid"),
        F.count_if(nxt == 0).alias("n_no_next"),
        F.count_if((nxt == 1) & (h > max_hours)).alias("n_next_too_late"))


def month_windows(availability: DataFrame) -> DataFrame:
    """First day of the first usable month and first day after the last one, per table."""
    return availability.select("table_name", F.trunc("min_available", "month").alias("t_min"),
                               F.add_months(F.trunc("max_available", "month"), 1).alias("t_max"))
