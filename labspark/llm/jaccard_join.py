"""Near-duplicate join: word shingles, MinHash banding, exact verification.

Texts become words (A-Z lower-cased; runs of digits, letters and characters beyond ASCII) and sets of
five-word shingles. Equal word sequences form one class, and only classes are compared. Each class has
one hash per tree, of a signature of fixed depth, and classes meet where these hashes are equal. This
banding stands in for a forest of prefix tries. The depth is the largest, up to ``depth`` values, at which
a pair exactly at the threshold meets in some tree with the target probability; pairs above it meet with
a higher one. It follows from the parameters alone, not from the data.

Classes that meet form candidate groups (connected components). Each group is verified exactly: small
groups share tasks, a large one is cut into blocks, and every pair of blocks is one unit of work, so
a task holds two blocks whatever the group's size. A unit counts links and hands on a spanning forest,
never its pairs.

Defined cases. Texts without words (null, empty, punctuation) and null ids link to nothing: their
``class_id`` is their own id. Fewer than five words: one shingle of all words. Rows sharing an id with
different texts are compared each for itself; equal rows are copies of one another. Class keys and
shingles are 64-bit hashes. Extra columns are ignored. Empty table: empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from labspark.llm.components import components
from labspark.llm.text import ascii_lower, has_terms, split_terms, text_or_empty
from labspark.session import materialize

MIX = np.uint64(0x9E3779B97F4A7C15)  # odd, so that multiplying permutes 64-bit numbers


def prefix_depth(threshold: float, trees: int, depth: int, recall: float) -> int:
    """Longest prefix with which a pair at ``threshold`` meets in some tree with probability ``recall``."""
    while depth > 1 and 1 - (1 - threshold**depth) ** trees < recall:
        depth -= 1
    return depth


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hash per run of ``width`` word hashes; one for all words if there are fewer."""
    if len(words) == 0:
        return words.astype(np.uint64)
    width = min(width, len(words))
    n = len(words) - width + 1
    out = np.zeros(n, dtype=np.uint64)
    for i in range(width):
        out = (out ^ words[i:i + n].view(np.uint64)) * MIX
        out ^= out >> np.uint64(29)
    return out


def _signatures(trees: int, depth: int, width: int, seed: int):
    rng = np.random.default_rng(seed)
    factors = rng.integers(0, 2**63, trees * depth, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    offsets = rng.integers(0, 2**63, trees * depth, dtype=np.int64).astype(np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column(2)
            flat, ends = words.flatten().to_numpy(zero_copy_only=False), words.value_lengths().to_numpy(zero_copy_only=False).cumsum()
            keys = np.zeros((batch.num_rows, trees), dtype=np.int64)
            for r, (a, b) in enumerate(zip(np.concatenate([[0], ends[:-1]]), ends, strict=True)):
                s = shingle_hashes(flat[a:b], width)
                least = np.full(trees * depth, np.iinfo(np.uint64).max, dtype=np.uint64)
                for at in range(0, len(s), 4096):  # a block of shingles at a time bounds the memory for long texts
                    np.minimum(least, (s[at:at + 4096, None] * factors + offsets).min(axis=0), out=least)
                node = np.zeros(trees, dtype=np.uint64)
                for k in range(depth):
                    node = (node ^ least[k::depth]) * MIX
                    node ^= node >> np.uint64(31)
                keys[r] = node.view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(keys[:, t]) for t in range(trees)]],
                                             names=["doc_id", "class", *[f"k{t}" for t in range(trees)]])
    return run


def _adjacency(left: list[np.ndarray], right: list[np.ndarray], threshold: float) -> np.ndarray:
    """Which pairs reach the threshold: intersections by matrix products over the shingles that several sets hold."""
    sets = left + right
    sizes = np.array([len(s) for s in sets])
    values, inverse, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    kept = np.flatnonzero(count > 1)
    column = np.full(len(values), -1)
    column[kept] = np.arange(len(kept))
    column = column[inverse]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    both = np.zeros((len(left), len(right)), dtype=np.float32)
    for at in range(0, len(kept), 4096):
        a, b = np.searchsorted(column, [at, at + 4096])
        m = np.zeros((len(sets), min(4096, len(kept) - at)), dtype=np.float32)
        m[owner[a:b], column[a:b] - at] = 1
        both += m[:len(left)] @ m[len(left):].T
    return both >= threshold * (sizes[:len(left), None] + sizes[None, len(left):] - both) - 1e-6


def _roots(links: np.ndarray) -> np.ndarray:
    """Least index of each node's component in a symmetric adjacency matrix."""
    root = np.full(len(links), -1)
    for start in range(len(links)):
        if root[start] >= 0:
            continue
        front = np.zeros(len(links), dtype=bool)
        front[start] = True
        while front.any():
            root[front] = start
            front = links[front].any(axis=0) & (root < 0)
    return root


def _verify(width: int, threshold: float):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, g in group.drop_duplicates(["class", "root", "side"]).groupby("root", sort=False):
            g = g.sort_values(["side", "class"])
            sets = [np.unique(shingle_hashes(np.fromiter(map(hash, t.split(" ")), dtype=np.int64), width)) for t in g["words"]]
            ids, n = g["class"].to_numpy(), g["n"].to_numpy()
            cut = int((g["side"] == 0).sum())
            if cut in (0, len(g)):  # one block against itself
                links = _adjacency(sets, sets, threshold)
                np.fill_diagonal(links, False)
            else:
                links = np.zeros((len(g), len(g)), dtype=bool)
                links[:cut, cut:] = _adjacency(sets[:cut], sets[cut:], threshold)
                links |= links.T
            out.append(pd.DataFrame({"class": ids, "links": links @ n, "to": ids[_roots(links)]}))
        return pd.concat(out) if out else pd.DataFrame({"class": [], "links": [], "to": []}).astype("int64")
    return run


def _blocked(candidates: DataFrame, block: int, groups: int) -> DataFrame:
    """Units of work: small groups packed together, block pairs of large ones. ``side`` tells the two blocks of a pair apart."""
    sizes = candidates.groupBy("root").agg(F.count("*").alias("size"))
    c = candidates.join(sizes, "root").withColumn("blocks", F.ceil(F.col("size") / block).cast("int")).withColumn("own", F.pmod(F.xxhash64(F.lit("block"), "class"), F.col("blocks")).cast("int"))
    c = c.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    low, high = F.least("own", "other"), F.greatest("own", "other")
    pack = F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("root"), F.lit(groups))).otherwise(F.col("root"))
    return c.select("class", "doc_id", "n", "root", pack.alias("pack"), (F.col("blocks") > 1).alias("large"), low.alias("low"), high.alias("high"),
                    (F.col("own") == high).cast("int").alias("side"))


def words(c: Column) -> Column:
    return split_terms(ascii_lower(c))


def near_duplicates(docs: DataFrame, threshold: float = 0.8, width: int = 5, trees: int = 25, depth: int = 10, recall: float = 0.999, block: int = 512, seed: int = 5,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id``, ``class_id`` (least id among the documents that links connect it to, its own
    included), ``copy_of`` (least id with the same words) and ``n_links`` (documents at or above the threshold)."""
    return _judged(docs, threshold, width, trees, depth, recall, block, seed, id_col, text_col).drop("class")


def _judged(docs: DataFrame, threshold: float = 0.8, width: int = 5, trees: int = 25, depth: int = 10, recall: float = 0.999, block: int = 512, seed: int = 5,
            id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``near_duplicates`` with the ``class`` that each row's words are (null without words or id)."""
    depth = prefix_depth(threshold, trees, depth, recall)

    base = docs.select(docs[id_col].alias("doc_id"), text_or_empty(docs, text_col).alias("t"))
    linked = base.filter(F.col("doc_id").isNotNull() & has_terms(F.col("t")))
    hashed = linked.select("doc_id", words(F.col("t")).alias("w")).select("doc_id", F.xxhash64("w").alias("class"), F.transform("w", lambda w: F.xxhash64(w)).alias("hashes"))
    kind = dict(hashed.dtypes)["doc_id"]
    names = [f"k{t}" for t in range(trees)]
    members = materialize(hashed.mapInArrow(_signatures(trees, depth, width, seed), f"doc_id {kind}, class bigint, " + ", ".join(f"{k} bigint" for k in names)), "join-members")
    classes = materialize(members.groupBy("class").agg(F.min("doc_id").alias("copy_of"), F.count("*").alias("n"), *[F.first(k).alias(k) for k in names]), "join-classes")

    meets = classes.select("class", F.posexplode(F.array(*names)).alias("tree", "node"))
    nodes = meets.groupBy("tree", "node").agg(F.min("class").alias("least"), F.count("*").alias("size")).filter("size > 1").drop("size")
    roots = components(meets.join(nodes, ["tree", "node"]).select(F.col("class").alias("a"), F.col("least").alias("b")), "join-candidates")
    candidates = materialize(classes.select("class", F.col("copy_of").alias("doc_id"), "n").join(roots, F.col("class") == F.col("node")).drop("node"), "join-groups")
    groups = max(1, candidates.count() // block)
    units = _blocked(candidates, block, groups)
    # candidates grow with the corpus, so they are never broadcast; words are made after the join, for candidates only
    found = linked.join(units.hint("shuffle_hash"), "doc_id").withColumn("w", words(F.col("t"))).filter(F.xxhash64("w") == F.col("class"))
    work = found.select("class", "n", "root", "pack", "large", "low", "high", "side", F.array_join("w", " ").alias("words")).groupBy("large", "pack", "low", "high")
    verified = materialize(work.applyInPandas(_verify(width, threshold), "class bigint, links bigint, to bigint"), "join-links")
    joined = components(verified.select(F.col("class").alias("a"), F.col("to").alias("b")), "join-components")
    links = verified.groupBy("class").agg(F.sum("links").alias("links"))
    named = classes.select("class", "copy_of", "n").join(joined.withColumnRenamed("node", "class"), "class", "left").withColumn("root", F.coalesce("root", "class"))
    first = named.groupBy("root").agg(F.min("copy_of").alias("class_id"))
    per_class = materialize(named.join(first, "root").join(links, "class", "left").select(
        "class", "class_id", "copy_of", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")), "join-result")
    out = members.select("doc_id", "class").join(per_class, "class").select("doc_id", "class", "class_id", "copy_of", "n_links")
    alone = base.filter(F.col("doc_id").isNull() | ~has_terms(F.col("t"))).select(
        "doc_id", F.lit(None).cast("bigint").alias("class"), F.col("doc_id").alias("class_id"), F.col("doc_id").alias("copy_of"), F.lit(0).cast("long").alias("n_links"))
    return out.unionByName(alone)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """``docs`` with one document of each linked group: the one with the least id. Rows
    without id stay, and equal rows of the document that stays are one document and stay together.
    Rows sharing an id with different texts go or stay each by itself."""
    found = _judged(docs, id_col=id_col, text_col=text_col, **kw)
    gone = found.filter(F.col("doc_id") != F.col("class_id")).select(F.col("doc_id").alias("_gone"), F.col("class").alias("_class")).distinct()
    own = F.xxhash64(words(text_or_empty(docs, text_col)))
    return docs.join(gone, (docs[id_col] == gone["_gone"]) & (own == gone["_class"]), "left_anti")
