"""Language-model scores by deleted interpolation.

The probability of a word after another mixes three maximum-likelihood estimates: of the pair, of the
word alone, and the same for every word. The weights depend on how often the context was seen (one
set per power of two) and are learned by expectation-maximisation on deleted counts: each pair is
predicted from the counts without the occurrence at hand.

Plan. Documents are cut into chunks of tokens. A chunk sends its distinct words, then its distinct
pairs, as packed sorted hashes to buckets by hash; a bucket adds up what all chunks counted and
answers each chunk with the totals of its own list, in order, so no key travels back. A word in a
third of all documents is one entry per chunk. Sums for the weights come from the buckets, in cells
of rounded counts. Chunks, pieces and totals are stored tables.

Defined cases. Null or empty text: the end token only. Null id: learned from and scored, as crc32 of
the empty text decides. Rows sharing an id and equal rows: each counts. No training row: every
probability is 1 / (V + 1) = 1. Words and pairs are told apart by 64-bit hashes. Extra columns are
ignored. Empty table: empty result.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from labspark.llm.text import ascii_lower, split_words, text_or_empty
from labspark.session import materialize, scratch_path

END, START = np.int64(0x454E44), np.int64(0x5354415254)  # stand for hashes of the text's end and start
MIX = np.uint64(0x9E3779B97F4A7C15)
PIECE = "chunk long, bucket int, kind int, payload binary"
STATE, WORDS, PAIRS, CELLS = 0, 1, 2, 3
PER_OCTAVE, EXACT = 4, 32


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as compressed byte planes: the high bytes of small numbers are all alike."""
    raw = pickle.dumps([(a.dtype.str, len(a), np.ascontiguousarray(a).view(np.uint8).reshape(len(a), -1).T.tobytes() if len(a) else b"") for a in arrays])
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unpack(data: bytes) -> list[np.ndarray]:
    raw = pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)
    out = []
    for kind, n, planes in pickle.loads(raw):
        kind = np.dtype(kind)
        out.append(np.frombuffer(np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(kind.itemsize, n).T).tobytes(), kind) if n else np.zeros(0, kind))
    return out


def _in_buckets(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(order by bucket and key, bucket of each key)."""
    bucket = ((keys >> np.uint64(40)) % np.uint64(buckets)).astype(np.int64)
    return np.lexsort((keys, bucket)), bucket


def pieces(keys: np.ndarray, columns: list[np.ndarray], buckets: int) -> Iterator[tuple[int, bytes]]:
    """A packed piece per bucket: gaps between sorted keys, and the columns."""
    order, bucket = _in_buckets(keys, buckets)
    cuts = np.flatnonzero(np.diff(bucket[order])) + 1
    for part in np.split(order, cuts) if len(order) else ():
        yield int(bucket[part[0]]), pack(np.diff(keys[part], prepend=np.uint64(0)), *[c[part] for c in columns])


def aligned(keys: np.ndarray, answers: list[tuple[int, bytes]], buckets: int) -> np.ndarray:
    """Totals in the order of ``keys`` from the answers (bucket, packed totals)."""
    order, _ = _in_buckets(keys, buckets)
    out = np.zeros(len(keys), dtype=np.int64)
    if len(order):
        out[order] = np.concatenate([unpack(p)[0] for _, p in sorted(answers, key=lambda a: a[0])])
    return out


def small(counts: np.ndarray) -> np.ndarray:
    """Counts in the least unsigned type that holds them."""
    return counts.astype(np.min_scalar_type(int(counts.max()) if len(counts) else 0))


def rounded(counts: np.ndarray) -> np.ndarray:
    """Codes of counts: exact up to EXACT, then PER_OCTAVE steps per power of two."""
    c = counts.astype(np.float64)
    steps = EXACT + np.floor(PER_OCTAVE * np.log2(np.maximum(c, EXACT) / EXACT))
    return np.where(c <= EXACT, c, steps + 1).astype(np.uint8)


def unrounded(codes: np.ndarray) -> np.ndarray:
    """The middle of the counts that share a code."""
    c = codes.astype(np.float64)
    return np.where(c <= EXACT, c, EXACT * 2 ** ((c - EXACT - 0.5) / PER_OCTAVE))


def context_bucket(counts: np.ndarray) -> np.ndarray:
    """0 for an unseen context, else 1 + the power of two below its count."""
    return np.where(counts > 0, 1 + np.floor(np.log2(np.maximum(counts, 1))), 0).astype(int)


class Chunk:
    """Documents of a chunk as indexes into their distinct words; ``ids`` may be of any type."""

    def __init__(self, ids: list, held: np.ndarray, lengths: np.ndarray, words: np.ndarray, index: np.ndarray):
        self.ids, self.held, self.lengths, self.words, self.index = ids, held, lengths, words, index

    @classmethod
    def of(cls, docs: list[tuple]) -> Chunk:
        """From (id, held out, word hashes) per document; the end token is added."""
        tokens = np.concatenate([x for _, _, w in docs for x in (w, [END])]).astype(np.int64)
        words, index = np.unique(tokens, return_inverse=True)
        return cls([d[0] for d in docs], np.array([d[1] for d in docs]), np.array([len(d[2]) + 1 for d in docs]), words, index.astype(np.int32))

    def packed(self) -> bytes:
        return pickle.dumps((self.ids, pack(self.held, self.lengths, self.words, self.index)))

    @classmethod
    def unpacked(cls, data: bytes) -> Chunk:
        ids, rest = pickle.loads(data)
        return cls(ids, *unpack(rest))

    def trained(self) -> np.ndarray:
        """Whether each token belongs to a training document."""
        return np.repeat(~self.held, self.lengths)

    def word_counts(self) -> np.ndarray:
        return np.bincount(self.index, self.trained(), len(self.words)).astype(np.int64)

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(left word, right word) of the distinct pairs, as indexes (left: number of words for the text's start), and each token's pair."""
        left = np.concatenate([[0], self.index[:-1]]).astype(np.int64)
        left[np.cumsum(self.lengths) - self.lengths] = len(self.words)
        code, index = np.unique(left * (len(self.words) + 1) + self.index, return_inverse=True)
        return code // (len(self.words) + 1), code % (len(self.words) + 1), index

    def pair_keys(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        h = np.append(self.words, START).view(np.uint64)
        key = (h[left] * MIX) ^ (h[right] + MIX)
        key ^= key >> np.uint64(32)
        key *= np.uint64(0xD6E8FEB86659FD93)
        return key ^ (key >> np.uint64(32))


def _chunks(tokens: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, size, number = [], 0, TaskContext.get().partitionId() << 24

        def flush():
            chunk = Chunk.of(kept)
            rows = [(STATE, -1, chunk.packed()), *((WORDS, b, p) for b, p in pieces(chunk.words.view(np.uint64), [small(chunk.word_counts())], buckets))]
            return pa.RecordBatch.from_arrays([pa.array([number] * len(rows), pa.int64()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[0] for r in rows], pa.int32()),
                                               pa.array([r[2] for r in rows], pa.binary())], names=["chunk", "bucket", "kind", "payload"])

        for batch in batches:
            flat, ends = batch.column(2).flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], batch.column(2).value_lengths().to_numpy(zero_copy_only=False).cumsum()])
            for i, held, (a, b) in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), pairwise(ends), strict=True):
                kept.append((i, held, flat[a:b]))
                size += b - a + 1
                if size >= tokens:
                    yield flush()
                    kept, size, number = [], 0, number + 1
        if kept:
            yield flush()
    return run


def _add_up(kind: int):
    """Totals per key of a bucket, answered to each chunk; for pairs also the cells for the weights, for words (N, V)."""
    def run(group: pd.DataFrame) -> pd.DataFrame:
        bucket, parts = int(group["bucket"].iat[0]), [unpack(p) for p in group["payload"]]
        keys = np.concatenate([np.cumsum(p[0], dtype=np.uint64) for p in parts])
        counts = np.concatenate([p[1].astype(np.int64) for p in parts])
        distinct, index = np.unique(keys, return_inverse=True)
        totals = np.bincount(index, counts, len(distinct)).astype(np.int64)
        answers = np.split(totals[index], np.cumsum([len(p[0]) for p in parts])[:-1])
        rows = [(c, bucket, kind, pack(small(a))) for c, a in zip(group["chunk"], answers, strict=True)]
        if kind == WORDS:
            rows.append((-1, bucket, CELLS, pack(np.array([totals.sum(), (totals > 0).sum()]))))
        else:
            codes = np.zeros((2, len(distinct)), dtype=np.uint8)  # chunks that trained on a pair all sent the same codes
            for k in (0, 1):
                np.maximum.at(codes[k], index, np.concatenate([p[2 + k] for p in parts]))
            seen = totals > 0
            code = (codes[0].astype(np.int64) << 16 | codes[1].astype(np.int64) << 8 | rounded(totals))[seen]
            cell, at = np.unique(code, return_inverse=True)
            weight = np.bincount(at, totals[seen], len(cell))
            cells = [(cell >> shift & 255).astype(np.uint8) for shift in (16, 8, 0)]
            rows.append((-1, bucket, CELLS, pack(*cells, weight.astype(np.int64))))
        return pd.DataFrame(rows, columns=["chunk", "bucket", "kind", "payload"])
    return run


def _answers(counts: pd.DataFrame, kind: int) -> list[tuple[int, bytes]]:
    own = counts[counts["kind"] == kind]
    return list(zip(own["bucket"], own["payload"], strict=True))


def _contexts(chunk: Chunk, word_totals: np.ndarray, documents: int) -> np.ndarray:
    """Count of each context: of a word as many as its occurrences (the end is none), of the start the documents."""
    out = np.append(word_totals, documents)
    out[:-1][chunk.words == END] = 0
    return out


def _pair_pieces(buckets: int, documents: int):
    def run(state: pd.DataFrame, counts: pd.DataFrame) -> pd.DataFrame:
        number, chunk = int(state["chunk"].iat[0]), Chunk.unpacked(state["payload"].iat[0])
        totals = aligned(chunk.words.view(np.uint64), _answers(counts, WORDS), buckets)
        left, right, index = chunk.pairs()
        seen = np.bincount(index, chunk.trained(), len(left)).astype(np.int64)
        codes = [np.where(seen > 0, rounded(c), 0).astype(np.uint8) for c in (_contexts(chunk, totals, documents)[left], totals[right])]
        rows = [(number, b, PAIRS, p) for b, p in pieces(chunk.pair_keys(left, right), [small(seen), *codes], buckets)]
        return pd.DataFrame(rows, columns=["chunk", "bucket", "kind", "payload"])
    return run


def learn_weights(cells: pd.DataFrame, train_tokens: int, vocabulary: int, rounds: int = 60, prior: float = 20.0) -> np.ndarray:
    """Weights (pair, word, uniform) per context bucket, by expectation-maximisation on deleted counts.

    ``cells``: rounded counts of context, word and pair, and the tokens that have them. A bucket starts from,
    and with few tokens stays near, the weights of all buckets together; unseen contexts use no pair."""
    out = np.tile([0.0, 0.0, 1.0], (66, 1))
    if train_tokens == 0:
        return out
    context, word, pair, weight = (cells[c].to_numpy(dtype=float) for c in ("context", "word", "pair", "weight"))
    p = np.stack([np.maximum(pair - 1, 0) / np.maximum(context - 1, 1), np.maximum(word - 1, 0) / max(train_tokens - 1, 1), np.full(len(pair), 1 / (vocabulary + 1))])
    p[0] = np.minimum(p[0], 1)

    def maximise(p: np.ndarray, weight: np.ndarray, start: np.ndarray, prior: float) -> np.ndarray:
        now = start
        for _ in range(rounds):
            share = now[:, None] * p
            now = (share / share.sum(0) * weight).sum(1) + prior * start
            now /= now.sum()
        return now

    overall = maximise(p, weight, np.array([0.4, 0.4, 0.2]), 0.0)
    bucket = context_bucket(context)
    for b in range(66):
        own = bucket == b
        out[b] = maximise(p[:, own], weight[own], overall, prior) if own.any() else overall
    out[0] = [0.0, *(overall[1:] / max(overall[1:].sum(), 1e-300))]
    return out


def _scores(buckets: int, documents: int, train_tokens: int, vocabulary: int, weights: np.ndarray):
    def run(state: pd.DataFrame, counts: pd.DataFrame) -> pd.DataFrame:
        chunk = Chunk.unpacked(state["payload"].iat[0])
        totals = aligned(chunk.words.view(np.uint64), _answers(counts, WORDS), buckets)
        left, right, index = chunk.pairs()
        together = aligned(chunk.pair_keys(left, right), _answers(counts, PAIRS), buckets)
        context = _contexts(chunk, totals, documents)[left]
        w = weights[context_bucket(context)]
        p = w[:, 0] * together / np.maximum(context, 1) + w[:, 1] * totals[right] / max(train_tokens, 1) + w[:, 2] / (vocabulary + 1)
        first = np.cumsum(chunk.lengths) - chunk.lengths

        def per_document(x):
            return np.add.reduceat(x, first)

        return pd.DataFrame({"doc_id": chunk.ids, "held_out": chunk.held, "n_tokens": chunk.lengths, "n_known": per_document((totals > 0)[chunk.index].astype(np.int64)),
                             "base_score": per_document(np.log10((totals + 1) / (train_tokens + vocabulary + 1))[chunk.index]), "score": per_document(np.log10(p)[index])})
    return run


def held_out(id_col: Column) -> Column:
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit(""))) % 7 == 2


def score(docs: DataFrame, out_of_training: Column | None = None, chunk_tokens: int = 2_000_000, bucket_bytes: int = 16_000_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document ``doc_id``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` and ``score`` (both log10).

    Chunks and buckets have a fixed size, so their number grows with the corpus."""
    spark = docs.sparkSession
    held = held_out(docs[id_col]) if out_of_training is None else out_of_training
    text = text_or_empty(docs, text_col)
    n_bytes, documents = docs.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0)), F.coalesce(F.sum(F.when(held, 0).otherwise(1)), F.lit(0))).first()
    buckets = max(1, -(-n_bytes // bucket_bytes))
    hashed = docs.select(docs[id_col].alias("doc_id"), held.alias("held_out"), F.transform(split_words(ascii_lower(text)), lambda w: F.xxhash64(w)).alias("w"))
    kind = dict(hashed.dtypes)["doc_id"]
    path = scratch_path(spark, "lm-chunks")
    hashed.mapInArrow(_chunks(chunk_tokens, buckets), PIECE).write.partitionBy("kind").parquet(path)
    stored = spark.read.schema(PIECE).parquet(path)
    states = stored.filter(F.col("kind") == STATE).groupBy("chunk")
    words = materialize(stored.filter(F.col("kind") == WORDS).groupBy("bucket").applyInPandas(_add_up(WORDS), PIECE), "lm-words")
    # N and V are sums of two numbers per bucket
    sums = words.filter(F.col("kind") == CELLS).select("bucket", "payload").mapInPandas(
        lambda it: (pd.DataFrame([unpack(p)[0] for p in b["payload"]], columns=["n", "v"], dtype="int64") for b in it), "n long, v long")
    train_tokens, vocabulary = sums.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("v"), F.lit(0))).first()
    to_words = words.filter(F.col("kind") == WORDS)
    sent = states.cogroup(to_words.groupBy("chunk")).applyInPandas(_pair_pieces(buckets, documents), PIECE)
    pairs = materialize(sent.groupBy("bucket").applyInPandas(_add_up(PAIRS), PIECE), "lm-pairs")

    def open_cells(batches):
        for b in batches:
            for p in b["payload"]:
                context, word, pair, weight = unpack(p)
                yield pd.DataFrame({"context": context, "word": word, "pair": pair, "weight": weight}).astype("int64")

    # cells are combinations of three rounded counts, however large the corpus
    cells = pairs.filter(F.col("kind") == CELLS).select("payload").mapInPandas(open_cells, "context long, word long, pair long, weight long")
    cells = cells.groupBy("context", "word", "pair").agg(F.sum("weight").alias("weight")).orderBy("context", "word", "pair").toPandas()
    for c in ("context", "word", "pair"):
        cells[c] = unrounded(cells[c].to_numpy())
    weights = learn_weights(cells, train_tokens, vocabulary)
    answers = to_words.unionByName(pairs.filter(F.col("kind") == PAIRS))
    out = states.cogroup(answers.groupBy("chunk")).applyInPandas(
        _scores(buckets, documents, train_tokens, vocabulary, weights), f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return out.withColumn("train_tokens", F.lit(train_tokens).cast("long"))
