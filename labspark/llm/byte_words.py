"""Words of many texts at once: their UTF-8 bytes are split and hashed in numpy, without a loop over words.

Only ASCII bytes separate words, so bytes can be looked at one by one. A word's hash is a polynomial over
its bytes, taken as the difference of two running sums, then mixed; 64 bits tell words apart."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

_BASE = 0x9E3779B97F4A7C15  # odd, so that its powers can be inverted modulo 2**64
_INVERSE = pow(_BASE, -1, 2**64)


def mix(x: np.ndarray) -> np.ndarray:
    """Scrambles 64-bit numbers, one to one."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)
    return x ^ (x >> np.uint64(32))


def chain(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of a sequence whose start has hash ``a`` and whose last word has hash ``b``."""
    return mix(a * np.uint64(0x2545F4914F6CDD1D) + b)


@lru_cache(maxsize=2)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    def of(x):
        return np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size, x, np.uint64)]), dtype=np.uint64)
    return of(_BASE), of(_INVERSE)


def byte_kinds(blanks: bytes, breaks: bytes) -> np.ndarray:
    """Table by byte: 0 part of a word, 1 between words, 2 between pieces."""
    kinds = np.zeros(256, np.uint8)
    kinds[list(blanks)], kinds[list(breaks)] = 1, 2
    return kinds


_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint64) + np.uint64(1)


_BLOCK = 1 << 20  # bytes whose running sums are held at a time


def split(data: np.ndarray, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end, hash (A-Z lower-cased) and piece number of each word of ``data`` (bytes)."""
    kind = kinds[data]
    edge = np.diff((kind == 0).view(np.int8), prepend=np.int8(0), append=np.int8(0))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    h, piece = np.empty(len(starts), np.uint64), np.empty(len(starts), np.int64)
    first, breaks, done = 0, 0, 0
    while first < len(starts):
        low = starts[first]
        last = max(first + 1, int(np.searchsorted(ends, low + _BLOCK, "right")))
        high = ends[last - 1]
        up, down = _powers(1 << max(20, int(high - low).bit_length()))
        sums = np.zeros(high - low + 1, np.uint64)
        np.cumsum(_LOWER[data[low:high]] * up[:high - low], out=sums[1:])
        x, y = starts[first:last] - low, ends[first:last] - low
        h[first:last] = mix((sums[y] - sums[x]) * down[x])
        passed = np.cumsum(kind[done:high] == 2, dtype=np.int64)
        piece[first:last] = breaks + passed[x + (low - done)]
        first, breaks, done = last, breaks + int(passed[-1]), high
    return starts, ends, h, piece


def slices(batch: pa.RecordBatch, column: int, max_bytes: int) -> Iterator[pa.RecordBatch]:
    """``batch`` in runs of rows with at most ``max_bytes`` of text each; a longer text makes a run of its own."""
    offsets = np.frombuffer(batch.column(column).buffers()[1], np.int32 if batch.column(column).type == pa.string() else np.int64)
    offsets = offsets[batch.column(column).offset:][:batch.num_rows + 1]
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + max_bytes, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a text column (no nulls) and the end of each row's text in them."""
    offsets = np.frombuffer(column.buffers()[1], np.int32 if column.type == pa.string() else np.int64)[column.offset:][:len(column) + 1]
    if not len(column) or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column), np.int64)
    return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0]:offsets[-1]], offsets[1:].astype(np.int64) - int(offsets[0])


def take_bytes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The stretches of ``data`` as strings, A-Z lower-cased."""
    sizes = ends - starts
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    where = np.repeat(starts - offsets[:-1], sizes) + np.arange(offsets[-1])
    values = (_LOWER[data[where]] - np.uint64(1)).astype(np.uint8)
    return pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(values)).cast(pa.string())
