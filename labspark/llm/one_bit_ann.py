"""Nearest neighbours by inner product over randomly rotated one-bit codes.

Every vector minus a centre is scaled to length 1, rotated at random and reduced to the signs of its
coordinates: d bits, and two numbers (its length, and how well the signs match it). From the packed
bits the inner product with a query is estimated without bias, with an error that stays within a
known bound with high probability. A query first takes the best estimates and computes their exact
products; every further vector whose upper bound reaches the k-th of these is computed exactly too.

Queries and vectors are dealt into blocks; each pair of blocks is one group, so memory is bounded by
two blocks, and each group hands on at most k rows per query. Centre: mean of a bounded sample
(``fit_rows``, by hash); every row is indexed.

Defined cases. Vectors null, empty, all zero, or holding null or non-finite components take no part,
nor do those of another length than most (ties: the longer) and null ids. Rows sharing an id count
as one, the greatest vector by Spark's array order. A vector is no neighbour of its own id. Ties go
to the smaller id. Extra columns are ignored. Empty table, no queries or one vector: empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from labspark.session import materialize

RESULT = "query_id long, vec_id long, score double"


def rotation(d: int, seed: int) -> np.ndarray:
    """A random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


def encode(x: np.ndarray, centre: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(packed signs, length of x - centre, match of the signs) per row of ``x``."""
    rest = x - centre
    length = np.linalg.norm(rest, axis=1)
    turned = rest @ turn.T / np.where(length > 0, length, 1)[:, None]
    match = np.abs(turned).sum(1) / np.sqrt(x.shape[1])
    return np.packbits(turned > 0, axis=1), length, np.where(length > 0, match, 1.0)


def valid_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``vec_id`` and ``v`` (array of double) of the vectors that take part."""
    v = F.col("v")
    fine = v.isNotNull() & (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = vectors.select(vectors[id_col].cast("long").alias("vec_id"), vectors[vec_col].cast("array<double>").alias("v")).filter(F.col("vec_id").isNotNull() & fine)
    one = materialize(rows.groupBy("vec_id").agg(F.max("v").alias("v")), "ann-vectors")
    most = one.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return one.filter(F.size("v") == (most.d if most else 0))


def products(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products of rows of ``x`` with ``q`` (one vector, or one per row), summed from the first component on,
    so that equal vectors score equally to the last bit."""
    total = np.zeros(len(x))
    for j in range(x.shape[1]):
        total += x[:, j] * q[..., j]
    return total


def _pair_search(k: int, first: int, sureness: float, at_once: int = 128):
    empty = pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    def search(queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        if queries.empty or rows.empty:
            return empty
        x, ids, length, match = np.stack(rows["v"].to_numpy()), rows["vec_id"].to_numpy(), rows["length"].to_numpy(), rows["match"].to_numpy()
        d, slack = x.shape[1], 1e-5 * (1 + np.abs(x).max())
        signs = np.unpackbits(np.stack([np.frombuffer(c, dtype=np.uint8) for c in rows["code"]]), axis=1, count=d).astype(np.float32) * 2 - 1
        per_unit = (length / match / np.sqrt(d)).astype(np.float32)
        spread = (length * np.sqrt(np.maximum(0.0, 1 - match**2)) / match * sureness / np.sqrt(max(d - 1, 1))).astype(np.float32)
        out = []
        for start in range(0, len(queries), at_once):
            asked = queries.iloc[start:start + at_once]
            q, names = np.stack(asked["v"].to_numpy()), asked["vec_id"].to_numpy()
            estimate = np.stack(asked["turned"].to_numpy()).astype(np.float32) @ signs.T
            estimate *= per_unit
            estimate += asked["on_centre"].to_numpy(dtype=np.float32)[:, None]
            own = names[:, None] == ids
            estimate[own] = -np.inf
            n = min(first, len(ids))
            tried = np.argpartition(-estimate, n - 1, axis=1)[:, :n]
            of, row = np.repeat(np.arange(len(q)), n), tried.ravel()
            near = np.einsum("ij,ij->i", x[row], q[of])
            near[own[of, row]] = -np.inf
            least = np.sort(near.reshape(len(q), n), axis=1)[:, -min(k, n)]
            # what the bound cannot rule out is computed as well
            estimate += spread * asked["norm"].to_numpy(dtype=np.float32)[:, None]
            estimate[np.arange(len(q))[:, None], tried] = -np.inf
            more_of, more_row = np.nonzero(estimate >= (least - slack)[:, None].astype(np.float32))
            of, row = np.concatenate([of, more_of]), np.concatenate([row, more_row])
            near = np.concatenate([near, np.einsum("ij,ij->i", x[more_row], q[more_of])])
            # the few that can be among the k best get their final score, summed in a fixed order
            left = (near >= least[of] - slack) & ~own[of, row]
            of, row = of[left], row[left]
            exact = products(x[row], q[of])
            order = np.lexsort((ids[row], -exact, of))
            of, row, exact = of[order], row[order], exact[order]
            best = np.arange(len(of)) - np.searchsorted(of, of) < k
            out.append(pd.DataFrame({"query_id": names[of[best]], "vec_id": ids[row[best]], "score": exact[best]}))
        return pd.concat(out)
    return search


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, seed: int = 11, fit_rows: int = 10_000, query_block: int = 2_048, row_block: int = 8_192,
            first: int = 64, sureness: float = 3.0, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id`` and ``score`` of the ``k`` nearest of every query.

    ``is_query``: condition on ``vec_id``. ``sureness``: width of the error bound, in the usual measure for such codes."""
    rows = valid_vectors(vectors, id_col, vec_col)
    sample = rows.orderBy(F.xxhash64(F.lit(seed), "vec_id"), "vec_id").limit(fit_rows).select("v").collect()
    sample = [r.v for r in sample]  # fit_rows vectors at most
    d = len(sample[0]) if sample else 1
    centre, turn = (np.mean(np.array(sample), axis=0) if sample else np.zeros(1)), rotation(d, seed)
    n_rows, n_queries = rows.count(), rows.filter(is_query).count()
    row_blocks, query_blocks = max(1, -(-n_rows // row_block)), max(1, -(-n_queries // query_block))

    def coded(batches):
        for b in batches:
            code, length, match = encode(np.stack(b["v"].to_numpy()), centre, turn) if len(b) else (np.zeros((0, 1), np.uint8), np.zeros(0), np.zeros(0))
            yield b.assign(code=[c.tobytes() for c in code], length=length, match=match)

    def turned(batches):
        for b in batches:
            q = np.stack(b["v"].to_numpy()) if len(b) else np.zeros((0, d))
            yield b.assign(turned=list(q @ turn.T), on_centre=q @ centre, norm=np.linalg.norm(q, axis=1))

    def block(of: int, salt: str) -> Column:
        return F.pmod(F.xxhash64(F.lit(salt), "vec_id"), F.lit(of)).cast("int")

    index = rows.mapInPandas(coded, "vec_id long, v array<double>, code binary, length double, match double")
    asked = rows.filter(is_query).mapInPandas(turned, "vec_id long, v array<double>, turned array<double>, on_centre double, norm double")
    left = asked.withColumn("qb", block(query_blocks, "q")).withColumn("rb", F.explode(F.sequence(F.lit(0), F.lit(row_blocks - 1))))
    right = index.withColumn("rb", block(row_blocks, "r")).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))
    found = left.groupBy("qb", "rb").cogroup(right.groupBy("qb", "rb")).applyInPandas(_pair_search(k, first, sureness), RESULT)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
