"""Quality classifier: a generalised additive model with pairwise interactions.

Each feature of a text falls into a bin; the score is the logistic of the sum of one table value per
feature and one per chosen pair of features. The tables are learned by boosting in turns: for every
feature in order, a shallow tree on its bins fits the residuals and adds a small step to its table.
The strongest pairs, by the gain of one two-way split on the residuals, are boosted the same way.

Fitting sees a bounded sample of labelled rows (``max_rows``, by hash of the id); scoring sees every
row and is a vectorised addition of bins over Arrow batches.

Defined cases. Null or empty text: all features 0, scored like any text. Null id: scored, never
learned from. Rows sharing an id: each is scored by itself. Labels: null ones and ids whose labels
contradict each other are left out. No usable label: ``trained`` is False and every score is 0.5.
Extra columns are ignored. Empty table: empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

FEATURES = ("log_words", "word_length", "word_length_sd", "upper", "digits", "symbols", "punctuation", "exclaims", "bars", "spaces", "distinct_words",
            "same_as_previous", "top_word", "short_words", "long_words", "sentence_words", "line_words", "repeated_lines", "no_letter_words", "pair_repeats",
            "beyond_ascii", "log_lines")
_PUNCTUATION, _SYMBOLS, _DIGITS = ".,;:?'\"()-", "#*$%&<>@^~=+_{}[]\\/", "0123456789"


def features(text: str) -> list[float]:
    """Values of FEATURES; all 0 without words. Linear in the text's length."""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    chars, lengths = len(text), np.fromiter(map(len, words), dtype=np.int64, count=n)
    count = Counter(words)
    lines = [x for x in text.split("\n") if x.strip()]
    same = sum(map(eq, words, words[1:]))
    pairs = set(map(hash, zip(words, words[1:], strict=False)))
    letters = sum(map(str.isalpha, words))
    return [
        float(np.log1p(n)), float(lengths.mean()), float(lengths.std()), sum(map(str.isupper, words)) / n,
        sum(map(text.count, _DIGITS)) / chars, sum(map(text.count, _SYMBOLS)) / n, sum(map(text.count, _PUNCTUATION)) / n,
        text.count("!") / n, text.count("|") / n, (chars - int(lengths.sum())) / chars, len(count) / n, same / n, count.most_common(1)[0][1] / n,
        float((lengths <= 2).mean()), float((lengths >= 12).mean()), n / (1 + text.count(". ") + text.count(".\n")), n / len(lines),
        1 - len(set(lines)) / len(lines), 1 - letters / n, 1 - len(pairs) / max(1, n - 1), (len(text.encode("utf-8")) - chars) / chars, float(np.log1p(len(lines))),
    ]


@dataclass
class Gam:
    """Bin edges and tables. ``single[f]``: value per bin of feature f. ``pairs``: (f, g, table)."""

    edges: list[np.ndarray]
    single: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)
    intercept: float = 0.0
    trained: bool = True

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(self.edges)], axis=1) if len(x) else np.zeros((0, len(self.edges)), int)

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Between 0 and 1, by adding the tables' entries."""
        b = self.bins(x)
        total = np.full(len(x), self.intercept)
        for f, t in enumerate(self.single):
            total += t[b[:, f]]
        for f, g, t in self.pairs:
            total += t[b[:, f], b[:, g]]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _leaf(gradient: float, weight: float) -> float:
    return gradient / (weight + 1.0)


def _gain(gradient, weight):
    return gradient * gradient / (weight + 1.0)


def _tree(g: np.ndarray, h: np.ndarray, leaves: int, least: float) -> np.ndarray:
    """Best-first tree over ordered bins: step per bin. ``g``, ``h``: sums of residuals and weights."""
    parts, out = [(0, len(g))], np.zeros(len(g))
    cg, ch = np.concatenate([[0.0], np.cumsum(g)]), np.concatenate([[0.0], np.cumsum(h)])

    def best(a: int, b: int) -> tuple[float, int]:
        cut = np.arange(a + 1, b)
        if not len(cut):
            return 0.0, -1
        lg, lh, rg, rh = cg[cut] - cg[a], ch[cut] - ch[a], cg[b] - cg[cut], ch[b] - ch[cut]
        gain = np.where((lh >= least) & (rh >= least), _gain(lg, lh) + _gain(rg, rh) - _gain(cg[b] - cg[a], ch[b] - ch[a]), 0.0)
        k = int(gain.argmax())
        return float(gain[k]), int(cut[k])

    while len(parts) < leaves:
        gain, cut, part = max((*best(*p), p) for p in parts)
        if gain <= 0:
            break
        parts.remove(part)
        parts += [(part[0], cut), (cut, part[1])]
    for a, b in parts:
        out[a:b] = _leaf(cg[b] - cg[a], ch[b] - ch[a])
    return out


def _cross(g: np.ndarray, h: np.ndarray, floor: float = 1e-3) -> tuple[float, np.ndarray]:
    """Best split of a two-way table into four quarters: (gain, step per cell)."""
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    row_g, row_h, col_g, col_h, all_g, all_h = cg[:, -1:], ch[:, -1:], cg[-1:, :], ch[-1:, :], cg[-1, -1], ch[-1, -1]
    quarters = [(cg, ch), (row_g - cg, row_h - ch), (col_g - cg, col_h - ch), (all_g - row_g - col_g + cg, all_h - row_h - col_h + ch)]
    gain = sum(_gain(a, b) for a, b in quarters) - _gain(all_g, all_h)
    gain = np.where((np.minimum(row_h, all_h - row_h) > floor) & (np.minimum(col_h, all_h - col_h) > floor), gain, 0.0)[:-1, :-1]
    if not gain.size:
        return 0.0, np.zeros_like(g)
    i, j = np.unravel_index(int(gain.argmax()), gain.shape)
    out = np.zeros_like(g)
    for (a, b), rows, cols in zip(quarters, (slice(0, i + 1), slice(0, i + 1), slice(i + 1, None), slice(i + 1, None)),
                                  (slice(0, j + 1), slice(j + 1, None), slice(0, j + 1), slice(j + 1, None)), strict=True):
        out[rows, cols] = _leaf(float(a[i, j]), float(b[i, j]))
    return float(gain[i, j]), out


def fit_gam(x: np.ndarray, y: np.ndarray, max_bins: int = 48, rounds: int = 80, rate: float = 0.1, leaves: int = 4, pairs: int = 8, pair_rounds: int = 40,
            least: float = 2.0) -> Gam:
    """Boosts feature tables in turns, then tables of the strongest pairs. Deterministic."""
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, max_bins + 1)[1:-1])) if len(x) else np.zeros(0) for f in range(x.shape[1])]
    model = Gam(edges, [np.zeros(len(e) + 1) for e in edges])
    if len(y) == 0:
        model.trained = False
        return model
    rate_of_ones = (y.sum() + 1) / (len(y) + 2)
    model.intercept = float(np.log(rate_of_ones / (1 - rate_of_ones)))
    b, total = model.bins(x), np.full(len(y), model.intercept)
    for _ in range(rounds):
        for f, t in enumerate(model.single):
            p = 1 / (1 + np.exp(-total))
            step = rate * _tree(np.bincount(b[:, f], y - p, len(t)), np.bincount(b[:, f], p * (1 - p), len(t)), leaves, least)
            t += step
            total += step[b[:, f]]
    p = 1 / (1 + np.exp(-total))

    def sums(f: int, g: int, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        shape = (len(model.single[f]), len(model.single[g]))
        cell = b[:, f] * shape[1] + b[:, g]
        size = shape[0] * shape[1]
        return np.bincount(cell, y - p, size).reshape(shape), np.bincount(cell, p * (1 - p), size).reshape(shape)

    gains = sorted(((_cross(*sums(f, g, p))[0], f, g) for f in range(x.shape[1]) for g in range(f + 1, x.shape[1])), key=lambda v: (-v[0], v[1:]))
    model.pairs = [(f, g, np.zeros((len(model.single[f]), len(model.single[g])))) for gain, f, g in gains[:pairs] if gain > 0]
    for _ in range(pair_rounds):
        for f, g, t in model.pairs:
            p = 1 / (1 + np.exp(-total))
            step = rate * _cross(*sums(f, g, p))[1]
            t += step
            total += step[b[:, f], b[:, g]]
    return model


def held_out(id_col: Column) -> Column:
    """Rows never learned from: crc32 of the id's text leaves 2 when divided by 4; a null id counts as empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit(""))) % 4 == 2


def _measured(rows: DataFrame, keep: str) -> DataFrame:
    """Features per row of (keep, text)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [features(t or "") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.list_(pa.float64()))], names=[keep, "x"])
    return rows.mapInArrow(run, f"{keep} {dict(rows.dtypes)[keep]}, x array<double>")


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000, id_col: str = "doc_id", text_col: str = "text") -> Gam:
    """Learns from at most ``max_rows`` labelled rows that are not held out."""
    usable = labels.filter(F.col(id_col).isNotNull() & F.col("quality").isin(0, 1) & ~held_out(F.col(id_col)))
    agreed = usable.groupBy(F.col(id_col).alias("id")).agg(F.min("quality").alias("y"), F.max("quality").alias("z")).filter("y = z").select("id", "y")
    sample = F.broadcast(agreed.orderBy(F.xxhash64("id"), "id").limit(max_rows))  # max_rows ids at most
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text")).join(sample, "id").select("y", "text")
    got = _measured(rows, "y").toPandas()
    x = np.array(got["x"].tolist(), dtype=float).reshape(-1, len(FEATURES))
    y = got["y"].to_numpy(dtype=float)
    order = np.lexsort([*x.T, y])  # the same sums whatever order Spark returns
    return fit_gam(x[order], y[order])


def score(docs: DataFrame, model: Gam, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """``doc_id`` and ``score`` per row; with ``carry`` all columns of ``docs`` and ``_score``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few tables of bins

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([features(t or "") for t in batch.column(batch.num_columns - 1).to_pylist()], dtype=float).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(shared.value.scores(x), pa.float64())], names=names)

    text = docs[text_col].cast("string").alias("_text")
    if carry:
        rows = docs.select(*[docs[c].alias(f"c_{i}") for i, c in enumerate(docs.columns)], text)
        names = [*rows.columns[:-1], "_score"]
        out = rows.mapInArrow(run, ", ".join(f"{c} {t}" for c, t in rows.dtypes[:-1]) + ", _score double")
        return out.select(*[F.col(f"c_{i}").alias(c) for i, c in enumerate(docs.columns)], "_score")
    rows = docs.select(docs[id_col].alias("doc_id"), text)
    names = ["doc_id", "score"]
    return rows.mapInArrow(run, f"doc_id {rows.dtypes[0][1]}, score double")


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, **kw) -> DataFrame:
    """``docs`` without those scored below ``threshold``; all of them if there is nothing to learn from."""
    model = train(docs, labels, **kw)
    return score(docs, model, carry=True).filter(F.col("_score") >= threshold).drop("_score") if model.trained else docs
