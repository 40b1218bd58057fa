"""Periodic runs of words, found in the grammar of a text instead of the text.

A run is a stretch of words with smallest period q (words q apart are identical), at least ``min_exponent``
periods and ``min_length`` words long, which no neighbouring word extends. Texts are taken in blocks of whole
documents; all steps are vectorised over a block:

1. Re-Pair. Symbols that stand next to each other twice or more are replaced by a nonterminal, the most
   frequent pair first; pairs that no better pair touches are replaced in the same round. What remains of a
   document is paired up to one balanced tree. Symbols belong to one document.
2. Every boundary between words is now the cut of some node. For each nonterminal, once and at one of its
   places, the runs are computed that cross its cut. A run with period q in [k, 2k), k a power of two, holds
   one of the places c, c - k .. c - 4k around the cut c from which its stretch of 2k words comes again after
   exactly q words and no sooner (by the periodicity lemma, as the run is four periods long): five lookups per
   cut and power of two. Longest common extensions give its ends within the nonterminal.
3. These runs are translated to all places of the nonterminal. The smallest node around a run holds it whole,
   and its smaller parts come from other nodes: intervals inside a longer one of the same period are merged.

Memory is proportional to a block's words times the logarithm of its longest repeat. Blocks hold
``BLOCK_WORDS`` words, or one longer document.

Defined cases. Null or empty text, or white space only: no words, no run, empty collapsed text. Null or
repeated ids and equal rows: each row by itself. Ties of the best run: smallest start, then smallest period.
Extra columns are ignored. Empty table: empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

BLOCK_WORDS = 1 << 19
RUN = "struct<start:bigint,length:bigint,period:bigint>"


class _Nodes:
    """Places of nonterminals in a derivation; each nonterminal also has one place, its cut and its length."""

    def __init__(self):
        self.symbol, self.place, self.first, self.cut, self.size = [], [], [], [], []
        self.count = 0

    def add(self, group: np.ndarray, start: np.ndarray, middle: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Nodes (start, middle, end); those of one ``group`` share a nonterminal. Numbers of the nonterminals."""
        _, first, member = np.unique(group, return_index=True, return_inverse=True)
        member = member + self.count
        self.symbol.append(member)
        self.place.append(start)
        self.first.append(start[first])
        self.cut.append(middle[first])
        self.size.append(end[first] - start[first])
        self.count += len(first)
        return member

    def arrays(self) -> list[np.ndarray]:
        return [np.concatenate([np.zeros(0, np.int64), *x]) for x in (self.symbol, self.place, self.first, self.cut, self.size)]


def _chosen(order: np.ndarray) -> np.ndarray:
    """Pairs to replace, by their rank (-1: none): stretches of equal rank above both neighbours, every second place of each."""
    head = np.flatnonzero(np.concatenate([[True], order[1:] != order[:-1]]))
    value = order[head]
    edge = np.full(1, -1)
    best = (value >= 0) & (value > np.concatenate([edge, value[:-1]])) & (value > np.concatenate([value[1:], edge]))
    sizes = np.diff(np.append(head, len(order)))
    starts = np.repeat(head[best], sizes[best])
    at = starts + np.arange(len(starts)) - np.repeat(np.cumsum(sizes[best]) - sizes[best], sizes[best])
    return at[(at - starts) % 2 == 0]


def derive(words: np.ndarray, doc: np.ndarray) -> list[np.ndarray]:
    """Grammar of a block: symbol and place of every node; place, cut and length of every nonterminal. ``words``: numbers, distinct between documents."""
    nodes, rest = _Nodes(), []
    symbol, start, end = words, np.arange(len(words)), np.arange(1, len(words) + 1)
    base = int(words.max(initial=0)) + 1
    while len(symbol) > 1:
        often = np.bincount(symbol) > 1
        at = np.flatnonzero((doc[1:] == doc[:-1]) & often[symbol[1:]] & often[symbol[:-1]])
        _, pair, count = np.unique(symbol[at] * (base + nodes.count) + symbol[at + 1], return_inverse=True, return_counts=True)
        rank = np.empty(len(count), np.int64)
        rank[np.argsort(count, kind="stable")] = np.arange(len(count))
        order = np.full(len(symbol), -1)
        order[at] = np.where(count > 1, rank, -1)[pair]
        busy = np.zeros(doc[-1] + 1, bool)
        busy[doc[order >= 0]] = True
        if 2 * np.count_nonzero(busy[doc]) <= len(doc):  # documents that are done leave the rounds
            going = busy[doc]
            rest.append((start[~going], end[~going], doc[~going]))
            symbol, start, end, doc, order = symbol[going], start[going], end[going], doc[going], order[going]
        if not len(symbol):
            break
        left = _chosen(order)
        made = nodes.add(order[left], start[left], start[left + 1], end[left + 1])
        symbol = symbol.copy()
        symbol[left] = base + made
        end = end.copy()
        end[left] = end[left + 1]
        stay = np.ones(len(symbol), bool)
        stay[left + 1] = False
        symbol, start, end, doc = symbol[stay], start[stay], end[stay], doc[stay]
    rest.append((start, end, doc))
    start, end, doc = (np.concatenate(x) for x in zip(*rest))
    by_place = np.argsort(start)
    start, end, doc = start[by_place], end[by_place], doc[by_place]
    while len(start) and (doc[1:] == doc[:-1]).any():  # one balanced tree per document; each node is used once
        head = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
        nth = np.arange(len(doc)) - np.repeat(head, np.diff(np.append(head, len(doc))))
        left = np.flatnonzero((nth[:-1] % 2 == 0) & (doc[1:] == doc[:-1]))
        nodes.add(left, start[left], start[left + 1], end[left + 1])
        end = end.copy()
        end[left] = end[left + 1]
        stay = np.ones(len(doc), bool)
        stay[left + 1] = False
        start, end, doc = start[stay], end[stay], doc[stay]
    return nodes.arrays()


def _repeats(words: np.ndarray, doc_end: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """By power of two: the name of the stretch of 2**i words from each place on, -1 if it comes only once,
    and the distance to where it comes next (0: nowhere)."""
    levels, n, width = [], len(words), 1
    at, code = np.arange(n), words
    while len(at):
        _, name, count = np.unique(code, return_inverse=True, return_counts=True)
        again = count[name] > 1
        at, name = at[again], name[again]
        names, ahead = np.full(n, -1, np.int32), np.zeros(n, np.int32)
        names[at] = name
        by_name = np.argsort(name, kind="stable")
        here, there = at[by_name[:-1]], at[by_name[1:]]
        ahead[here] = np.where(name[by_name[:-1]] == name[by_name[1:]], there - here, 0)
        levels.append((names, ahead))
        at = at[at + 2 * width <= doc_end[at]]
        at = at[names[at + width] >= 0]
        code = names[at].astype(np.int64) * n + names[at + width]
        width *= 2
    return levels


def _extend(levels, a: np.ndarray, b: np.ndarray, back: bool) -> np.ndarray:
    """Number of equal words from places ``a`` and ``b`` on, or before them."""
    done = np.zeros(len(a), np.int64)
    for i in range(len(levels) - 1, -1, -1):
        names, width = levels[i][0], 1 << i
        x, y = (a - done - width, b - done - width) if back else (a + done, b + done)
        inside = (x >= 0) & (y < len(names))
        x, y = np.where(inside, x, 0), np.where(inside, y, 0)
        done += width * (inside & (names[x] >= 0) & (names[x] == names[y]))
    return done


def block_runs(words: np.ndarray, doc: np.ndarray, doc_end: np.ndarray, min_length: int, min_exponent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and period of all runs of a block, by start, then period. ``doc``, ``doc_end``: per word."""
    symbol, place, first, cut, size = derive(words, doc)
    levels = _repeats(words, doc_end)
    found = []
    for i in range(1, len(levels)):
        k, ahead = 1 << (i - 1), levels[i][1]
        node = np.flatnonzero(size >= max(min_length, min_exponent * k))
        for back in range(5):
            p = cut[node] - back * k
            inside = (p >= first[node]) & (p + 3 * k <= first[node] + size[node])
            at, of = p[inside], node[inside]
            q = ahead[at]
            fits = (q >= k) & (q < 2 * k)
            found.append((of[fits], at[fits], q[fits].astype(np.int64)))
    node, p, q = (np.concatenate([np.zeros(0, np.int64), *x]) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 3
    start = np.maximum(p - _extend(levels, p, p + q, True), first[node])
    end = np.minimum(p + q + _extend(levels, p, p + q, False), first[node] + size[node])
    good = (start < cut[node]) & (end > cut[node]) & (end - start >= np.maximum(min_length, min_exponent * q))
    once = np.unique(np.stack([node[good], start[good] - first[node[good]], end[good] - start[good], q[good]]), axis=1)

    by_symbol = np.argsort(symbol, kind="stable")
    low = np.searchsorted(symbol[by_symbol], once[0])
    many = np.searchsorted(symbol[by_symbol], once[0], "right") - low
    nth = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    start = place[by_symbol[np.repeat(low, many) + nth]] + np.repeat(once[1], many)
    length, q = np.repeat(once[2], many), np.repeat(once[3], many)

    order = np.lexsort((-length, start, q))
    start, length, q = start[order], length[order], q[order]
    reach = q * (len(words) + 1) + start + length  # grows from period to period
    longest = np.ones(len(q), bool)
    longest[1:] = reach[1:] > np.maximum.accumulate(reach)[:-1]
    start, length, q = start[longest], length[longest], q[longest]
    order = np.lexsort((q, start))
    return start[order], length[order], q[order]


def _best(runs: list[tuple[int, int, int]]) -> tuple[int, int, int]:
    best = runs[0]
    for run in runs[1:]:
        if run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def _block(texts: list[list[bytes]], min_length: int, min_exponent: int) -> list[tuple[list, bytes]]:
    """Runs (start, length, period) and collapsed text of each document."""
    sizes = np.array([len(w) for w in texts], np.int64)
    ends = np.cumsum(sizes)
    numbers = []
    for w, end in zip(texts, ends.tolist(), strict=True):
        numbers.extend(map({}.setdefault, w, range(end - len(w), end)))
    doc = np.repeat(np.arange(len(texts)), sizes)
    start, length, period = block_runs(np.array(numbers, np.int64), doc, np.repeat(ends, sizes), min_length, min_exponent)
    step = np.zeros(len(doc) + 1, np.int64)
    np.add.at(step, start + period, -1)
    np.add.at(step, start + length, 1)
    kept = np.cumsum(step)[:-1] == 0
    of = doc[start]
    bounds = np.searchsorted(of, np.arange(len(texts) + 1))
    out = []
    for i, (w, end) in enumerate(zip(texts, ends.tolist(), strict=True)):
        a, b = bounds[i], bounds[i + 1]
        if a == b:
            out.append(([], b" ".join(w)))
        else:
            low = end - len(w)
            out.append((list(zip((start[a:b] - low).tolist(), length[a:b].tolist(), period[a:b].tolist(), strict=True)), b" ".join(compress(w, kept[low:end].tolist()))))
    return out


def periodic_runs(docs: DataFrame, min_length: int = 6, min_exponent: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_words, ``runs`` (by start, then period), ``best`` (the run with most periods, null without
    one) and ``collapsed``: the words without those that a run holds beyond its first period, joined by one space."""
    if min_exponent < 4:
        raise ValueError("the lookups around a cut rely on runs of at least four periods")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            at = 0
            while at < len(texts):
                block, words = [], 0
                while at + len(block) < len(texts) and (not block or words < BLOCK_WORDS):
                    block.append((texts[at + len(block)].as_py() or b"").split())
                    words += len(block[-1])
                found = _block(block, min_length, min_exponent)
                runs = [r for r, _ in found]
                dicts = [[dict(zip(("start", "length", "period"), x, strict=True)) for x in r] for r in runs]
                best = [dict(zip(("start", "length", "period"), _best(r), strict=True)) if r else None for r in runs]
                kind = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(at, len(block)), pa.array([len(w) for w in block], pa.int64()), pa.array(dicts, pa.list_(kind)), pa.array(best, kind),
                    pa.array([c for _, c in found], pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "runs", "best", "collapsed"])
                at += len(block)

    source = docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text"))
    return source.mapInArrow(run, f"doc_id {dict(source.dtypes)['doc_id']}, n_words bigint, runs array<{RUN}>, best {RUN}, collapsed string")
