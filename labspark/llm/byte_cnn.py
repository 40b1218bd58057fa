"""Language of a text by a byte convolutional network.

A text's UTF-8 bytes (A-Z lower-cased; digits, punctuation and blanks as one class each) are laid into
windows of ``WINDOW`` bytes. Filters of several widths run over every byte, their maxima per window go
through a rectifier into a softmax over the languages. The text's probabilities are the softmax of its
windows' outputs, weighted by their letters: every window of the whole text counts.

A filter is one table per offset, byte class to value. For scoring, two tables that stand side by side are
added up beforehand into one table over byte pairs, so a width of four is two lookups per byte.

Training, in numpy on the driver, sees a bounded sample: of at most ``per_lang`` documents of each language
(smallest hashes of the id) at most ``windows`` windows, spread evenly over the text. It is seeded and
sorted: runs agree.

Defined cases. Null text, or no letter (Unicode category L): ``und`` with score 0, not learned from. Null
language: scored, not learned from. Null id: scored; a null id counts as empty text for the hold-out.
Repeated ids and equal rows: each row by itself. Ties: the smaller language name. No usable label: ``und``
with score 0 for all rows. Extra columns are ignored. Empty table: empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

WINDOW, WIDTHS, FILTERS = 256, (2, 3, 4), 16
_REACH = max(WIDTHS) - 1
_BLOCK = 256  # windows at a time

# 0 padding, 1 blank, 2 digit, 3 other ASCII, 4-29 letters, then every byte beyond ASCII
_CLASS = np.array([0] + [1 if b in b" \t\n\x0b\x0c\r" else 2 if 48 <= b <= 57 else 4 + (b | 32) - 97 if 97 <= (b | 32) <= 122 and b < 128 else 3 if b < 128 else b - 98
                         for b in range(1, 256)], np.int32)
CLASSES = int(_CLASS.max()) + 1


@dataclass
class Cnn:
    """``tables``: per width, one (class, filter) table per offset. ``bias``, ``out``: of the features and the languages."""

    langs: list[str]
    tables: list[list[np.ndarray]]
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    def pairs(self) -> list[list[np.ndarray]]:
        """Per width, tables over pairs of classes (and one over single classes if the width is odd)."""
        made = []
        for ts in self.tables:
            made.append([(a[:, None, :] + b[None, :, :]).reshape(-1, FILTERS) for a, b in zip(ts[::2], ts[1::2])] + ([ts[-1]] if len(ts) % 2 else []))
        return made


def lay_out(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Byte classes of all windows, one row each with the next ``_REACH`` bytes of the text, and the first window of each text and the end."""
    windows = np.array([-(-len(t) // WINDOW) for t in texts], np.int64)
    first = np.concatenate([[0], np.cumsum(windows)])
    data = np.zeros(int(first[-1] + 1) * WINDOW + _REACH, np.uint8)
    for t, at in zip(texts, (first[:-1] * WINDOW).tolist(), strict=True):
        data[at:at + len(t)] = np.frombuffer(t, np.uint8)
    rows = np.lib.stride_tricks.sliding_window_view(data, WINDOW + _REACH)[::WINDOW][:first[-1]]
    classes = _CLASS[rows]
    classes[first[1:][windows > 0] - 1, WINDOW:] = 0  # behind the last window stands another text
    return classes, first


def pooled(classes: np.ndarray, pairs: list[list[np.ndarray]]) -> np.ndarray:
    """Largest value of every filter in every window."""
    n = len(classes)
    out = np.empty((n, len(pairs) * FILTERS), np.float32)
    for low in range(0, n, _BLOCK):
        high = min(low + _BLOCK, n)
        c = classes[low:high]
        both = c[:, :-1] * CLASSES + c[:, 1:]
        for w, tables in enumerate(pairs):
            value = tables[0].take(both[:, :WINDOW], axis=0)
            for k, t in enumerate(tables[1:], 1):
                value += t.take((both if len(t) > CLASSES else c)[:, 2 * k:2 * k + WINDOW], axis=0)
            out[low:high, w * FILTERS:(w + 1) * FILTERS] = value.max(axis=1)
    return out


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def probabilities(model: Cnn, texts: list[bytes], pairs: list[list[np.ndarray]] | None = None) -> np.ndarray:
    """Per text and language."""
    classes, first = lay_out(texts)
    x = np.maximum(pooled(classes, pairs or model.pairs()) + model.bias, 0) @ model.out + model.out_bias
    letters = (classes[:, :WINDOW] > 3).sum(axis=1)
    total = np.zeros((len(texts), len(model.langs)))
    weight = np.zeros(len(texts))
    of = np.repeat(np.arange(len(texts)), np.diff(first))
    np.add.at(total, of, x * letters[:, None])
    np.add.at(weight, of, letters)
    return _softmax(total / np.maximum(weight, 1)[:, None])


def fit(langs: list[str], texts: list[bytes], rounds: int = 6, batch: int = 64, rate: float = 0.01, seed: int = 0) -> Cnn:
    """Learns from windows of text and their languages, each language with equal weight, by Adam."""
    names = sorted(set(langs))
    y = np.array([names.index(x) for x in langs])
    rng = np.random.default_rng(seed)
    features = len(WIDTHS) * FILTERS
    model = Cnn(names, [[rng.normal(0, 0.3, (CLASSES, FILTERS)).astype(np.float32) for _ in range(w)] for w in WIDTHS],
                np.zeros(features, np.float32), rng.normal(0, 0.2, (features, len(names))).astype(np.float32), np.zeros(len(names), np.float32))
    weights = [*[t for ts in model.tables for t in ts], model.bias, model.out, model.out_bias]
    for t in weights[:-3]:
        t[0] = 0  # padding
    share = len(y) / np.maximum(np.bincount(y, minlength=len(names)), 1) / max(len(names), 1)
    windows = np.zeros((len(texts), WINDOW + _REACH), np.int32)
    for i, t in enumerate(texts):
        windows[i, :len(t)] = _CLASS[np.frombuffer(t, np.uint8)][:WINDOW + _REACH]
    first, second, step = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights], 0
    steps = rounds * -(-len(y) // batch)
    for _ in range(rounds):
        order = rng.permutation(len(y))
        for low in range(0, len(order), batch):
            rows = order[low:low + batch]
            c, tops, peaks = windows[rows], [], []
            for w, ts in zip(WIDTHS, model.tables, strict=True):
                value = sum(t[c[:, j:j + WINDOW]] for j, t in enumerate(ts))
                peaks.append(value.argmax(axis=1))  # (row, filter): the byte that the gradient goes to
                tops.append(np.take_along_axis(value, peaks[-1][:, None, :], axis=1)[:, 0, :])
            hidden = np.concatenate(tops, axis=1) + model.bias
            active = np.maximum(hidden, 0)
            d = _softmax(active @ model.out + model.out_bias)
            d[np.arange(len(rows)), y[rows]] -= 1
            d *= (share[y[rows]] / len(rows))[:, None]
            back = (d @ model.out.T) * (hidden > 0)
            slopes = []
            for k, (w, ts) in enumerate(zip(WIDTHS, model.tables, strict=True)):
                part = back[:, k * FILTERS:(k + 1) * FILTERS]
                for j in range(w):
                    slope = np.zeros_like(ts[j])
                    np.add.at(slope, (np.take_along_axis(c, peaks[k] + j, axis=1), np.arange(FILTERS)[None, :]), part)
                    slope[0] = 0
                    slopes.append(slope)
            slopes += [back.sum(axis=0), active.T @ d, d.sum(axis=0)]
            step += 1
            now = rate * (1 - step / (steps + 1))
            for w, s, a, b in zip(weights, slopes, first, second, strict=True):
                a += 0.1 * (s - a)
                b += 0.01 * (s * s - b)
                w -= (now * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
    return model


def held_out(id_col: Column) -> Column:
    """Rows never learned from: crc32 of the id's text leaves 2 when divided by 4; a null id counts as empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit(""))) % 4 == 2


def _spread(windows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = WINDOW + _REACH
        for batch in batches:
            rows, parts = [], []
            for i, t in enumerate(batch.column(2).to_pylist()):
                raw = t.encode()
                last = max(0, len(raw) - size)
                for at in sorted({last * k // max(1, windows - 1) for k in range(windows)}):
                    if (_CLASS[np.frombuffer(raw[at:at + size], np.uint8)] > 3).any():
                        rows.append(i)
                        parts.append(raw[at:at + size])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), batch.column(1).take(pa.array(rows, pa.int64())), pa.array(parts, pa.binary())],
                                             names=["lang", "h", "part"])
    return run


def train(docs: DataFrame, per_lang: int = 1_500, windows: int = 3, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Cnn | None:
    """A network learned from documents that are not held out; None without any. The driver sees ``per_lang`` x ``windows`` short rows per language at most."""
    rows = docs.select(docs[lang_col].cast("string").alias("lang"), F.xxhash64(docs[id_col]).alias("h"), docs[text_col].cast("string").alias("text"),
                       held_out(docs[id_col]).alias("out")).filter(~F.col("out") & F.col("lang").isNotNull() & F.col("text").isNotNull())
    # smallest hashes by their leading 16 bits: few counts per language, whatever the number of documents
    rows = rows.withColumn("lead", F.shiftright("h", 48))
    sizes = rows.groupBy("lang", "lead").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("lang").orderBy("lead")) - F.col("n")
    bounds = sizes.withColumn("before", before).filter(F.col("before") < per_lang).groupBy("lang").agg(F.max("lead").alias("top")).collect()
    if not bounds:
        return None
    tops = F.create_map(*[F.lit(v) for b in bounds for v in (b.lang, b.top)])  # one entry per language
    chosen = rows.filter(F.col("lead") <= tops[F.col("lang")]).select("lang", "h", "text").mapInArrow(_spread(windows), "lang string, h long, part binary")
    sample = chosen.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("h", "part"))).filter(F.col("n") <= per_lang * windows).select("lang", "part").collect()
    sample = sorted((r.lang, bytes(r.part)) for r in sample)
    return fit([x for x, _ in sample], [t for _, t in sample]) if sample else None


def predict(docs: DataFrame, model: Cnn | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row doc_id, lang_pred and score, the probability of that language."""
    text = docs[text_col].cast("string")
    source = docs.select(docs[id_col].alias("doc_id"), text.alias("text"), F.coalesce(text.rlike("\\p{L}"), F.lit(False)).alias("letters"))
    if model is None:
        return source.select("doc_id", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few tables of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cnn = shared.value
        pairs = cnn.pairs()
        for batch in batches:
            langs, scores, texts = [], [], batch.column(1).cast(pa.binary())
            known = batch.column(2).to_pylist()
            at = 0
            while at < len(texts):
                block, size = [], 0
                while at + len(block) < len(texts) and (not block or size < _BLOCK * WINDOW * 16):
                    block.append((texts[at + len(block)].as_py() or b"") if known[at + len(block)] else b"")
                    size += len(block[-1])
                p = probabilities(cnn, block, pairs)
                best = p.argmax(axis=1)
                for i, k in enumerate(best.tolist()):
                    langs.append(cnn.langs[k] if known[at + i] else "und")
                    scores.append(float(p[i, k]) if known[at + i] else 0.0)
                at += len(block)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return source.mapInArrow(run, f"doc_id {dict(source.dtypes)['doc_id']}, lang_pred string, score double")
