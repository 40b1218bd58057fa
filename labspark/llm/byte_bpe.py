"""Byte-level BPE: texts to token ids and back, with character offsets.

The tokenizers library runs over Arrow batches, one tokenizer per Python worker, built from a rank
file. It merges every distinct word once: a worker remembers the ids of the words it has met, up to ``REMEMBERED``, and only the new words
of a batch go through the library. Byte-level BPE works on 256 stand-in characters, one per byte; the byte table maps them back,
so that ids decode to exact bytes even where a token ends inside a character.

Defined cases. Null text: treated as empty, no tokens. Null id, rows sharing an id, equal rows: one
result row each. Extra columns are ignored. Empty table: empty result. The vocabulary has no special
tokens: their strings are ordinary text.
"""

from __future__ import annotations

import base64
import codecs
import collections
import functools
import hashlib
import itertools
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

REMEMBERED = 200_000  # words whose ids a worker keeps: some 50 MB; beyond that it starts anew
LONGEST = 64  # characters of such a word


def byte_characters() -> list[str]:
    """Stand-in character of every byte: printable Latin-1 bytes stand for themselves, the others get the
    characters from 256 on, in order."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in printable else next(spare)) for b in range(256)]


def read_ranks(spark: SparkSession, path: str) -> bytes:
    """The rank file's bytes, whether it lies on the driver or in a store that Spark reads."""
    if os.path.exists(path):
        with open(path, "rb") as f:
            return f.read()
    return bytes(spark.read.format("binaryFile").load(path).first()["content"])


@functools.lru_cache(maxsize=4)
def tables(ranks: bytes) -> tuple[list[bytes], dict[bytes, int]]:
    """(bytes per id, id per bytes)."""
    pairs = [line.split() for line in ranks.splitlines() if line.strip()]
    ids = {base64.b64decode(a): int(b) for a, b in pairs}
    by_id = [b""] * (max(ids.values(), default=-1) + 1)
    for token, i in ids.items():
        by_id[i] = token
    return by_id, ids


@functools.lru_cache(maxsize=4)
def tokenizer(ranks: bytes):
    """A tokenizer of single words that merges as the ranks say: every split of a token into two tokens is a merge with
    the token's own priority."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs one task per core already
    from tokenizers import Tokenizer, models, pre_tokenizers
    stand_in = byte_characters()
    by_id, ids = tables(ranks)
    name = {token: "".join(stand_in[b] for b in token) for token in ids}
    merges = [(name[t[:i]], name[t[i:]]) for t in by_id for i in range(1, len(t)) if t[:i] in ids and t[i:] in ids]
    made = Tokenizer(models.BPE(vocab={name[t]: i for t, i in ids.items()}, merges=merges, ignore_merges=False, cache_capacity=0))
    made.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
    return made


@functools.lru_cache(maxsize=4)
def splitter(pattern: str):
    """Words of a text: what the pattern matches, and what lies between the matches."""
    import regex
    found = regex.compile(pattern)

    def split(text: str) -> list[str]:
        words = [m.group() for m in found.finditer(text)] if found.groups else found.findall(text)
        if sum(map(len, words)) == len(text):
            return words
        cuts = [0, *(x for m in found.finditer(text) for x in m.span()), len(text)]
        return [text[i:j] for i, j in itertools.pairwise(cuts) if i < j]

    return split


@functools.lru_cache(maxsize=4)
def remembered(ranks: bytes) -> dict[str, list[int]]:
    """The ids of words met in this process."""
    return {}


@functools.lru_cache(maxsize=4)
def _sizes(ranks: bytes) -> np.ndarray:
    """Bytes of every id."""
    return np.array([len(t) for t in tables(ranks)[0]], dtype=np.int64)


def merged(words: list[str], ranks: bytes) -> list[list[int]]:
    """Ids of each word, from one call of the library. Tokens end where words end, so the bytes tell whose they are."""
    made = tokenizer(ranks)
    ids = made.encode_batch_fast([words], is_pretokenized=True, add_special_tokens=False)[0].ids
    ends, sizes = np.cumsum(_sizes(ranks)[ids]), np.cumsum([len(w.encode()) for w in words])
    if not ids or ends[-1] != sizes[-1]:  # a vocabulary without some byte
        return [e.ids for e in made.encode_batch_fast(words, add_special_tokens=False)]
    cuts = [0, *(np.searchsorted(ends, sizes) + 1).tolist()]
    return [ids[i:j] for i, j in itertools.pairwise(cuts)]


def decode(ids, by_id: list[bytes]) -> bytes:
    return b"".join([by_id[i] for i in ids])


def decode_pieces(ids, by_id: list[bytes]) -> list[str]:
    """Text that each token completes: a character split across tokens belongs to the last of them."""
    decoder = codecs.getincrementaldecoder("utf-8")(errors="replace")
    pieces = [decoder.decode(by_id[i]) for i in ids]
    rest = decoder.decode(b"", final=True)
    if rest and pieces:
        pieces[-1] += rest
    return pieces


def character_offsets(ids, text: str, by_id: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """First character and end of each token. A token that holds part of a character covers all of it."""
    raw = np.frombuffer(text.encode("utf-8"), dtype=np.uint8)
    character = np.cumsum((raw & 0xC0) != 0x80) - 1  # of each byte
    ends = np.cumsum([len(by_id[i]) for i in ids])
    starts = ends - [len(by_id[i]) for i in ids]
    return character[starts], character[ends - 1] + 1


def _encode(texts: list[str], ranks: bytes, pattern: str) -> Iterator[list[int]]:
    known, split = remembered(ranks), splitter(pattern)
    for text in texts:
        words = split(text)
        new = list(set(words).difference(known))
        of = known
        if new:
            ids = dict(zip(new, merged(new, ranks), strict=True))
            if len(known) + len(new) > REMEMBERED:
                of = {**{w: known[w] for w in words if w in known}, **ids}
                known.clear()
            else:
                of = known if all(len(w) <= LONGEST for w in new) else collections.ChainMap(ids, known)
            known.update((w, i) for w, i in itertools.islice(ids.items(), REMEMBERED) if len(w) <= LONGEST)
        yield list(itertools.chain.from_iterable(map(of.__getitem__, words)))


def _texts(batch: pa.RecordBatch) -> list[str]:
    return [t or "" for t in batch.column(1).to_pylist()]


def encode(docs: DataFrame, ranks_path: str, pattern: str, offsets: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``ids``; with ``offsets`` also ``starts`` and ``ends``, in characters."""
    ranks = docs.sparkSession.sparkContext.broadcast(read_ranks(docs.sparkSession, ranks_path))  # the vocabulary's size, whatever the data's

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = _texts(batch)
            ids = list(_encode(texts, ranks.value, pattern))
            out = [batch.column(0), pa.array(ids, pa.list_(pa.int32()))]
            if offsets:
                spans = [character_offsets(i, t, tables(ranks.value)[0]) if i else ([], []) for i, t in zip(ids, texts, strict=True)]
                out += [pa.array([s[k] for s in spans], pa.list_(pa.int64())) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays(out, names=names)

    source = docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text"))
    kind = dict(source.dtypes)["doc_id"]
    names = ["doc_id", "ids", *(["starts", "ends"] if offsets else [])]
    return source.mapInArrow(run, f"doc_id {kind}, ids array<int>" + ", starts array<bigint>, ends array<bigint>" * offsets)


def decode_ids(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """``doc_id`` and ``bytes`` for rows of ``encode``."""
    ranks = encoded.sparkSession.sparkContext.broadcast(read_ranks(encoded.sparkSession, ranks_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_id = tables(ranks.value)[0]
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([decode(i or [], by_id) for i in batch.column(1).to_pylist()], pa.binary())], names=["doc_id", "bytes"])

    source = encoded.select("doc_id", "ids")
    return source.mapInArrow(run, f"doc_id {dict(source.dtypes)['doc_id']}, bytes binary")


def round_trip(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes, decodes and returns per document ``doc_id``, ``n_tokens`` and hex digests of the ids (little-endian
    unsigned 32-bit) and of the decoded bytes, in one pass and without keeping the ids."""
    ranks = docs.sparkSession.sparkContext.broadcast(read_ranks(docs.sparkSession, ranks_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_id = tables(ranks.value)[0]
        for batch in batches:
            counts, of_ids, of_bytes = [], [], []
            for ids in _encode(_texts(batch), ranks.value, pattern):
                counts.append(len(ids))
                of_ids.append(hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest())
                of_bytes.append(hashlib.sha256(decode(ids, by_id)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_bytes, pa.string())],
                                             names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    source = docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text"))
    return source.mapInArrow(run, f"doc_id {dict(source.dtypes)['doc_id']}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
