"""Vectorised word handling shared by the text operators.

Texts arrive as Arrow string arrays; words are maximal runs of bytes outside
``\\x20 \\x09-\\x0D`` (all of them ASCII, so byte runs equal code point runs).
Everything here works on whole texts and costs a few numpy passes per byte,
with no Python object per word.
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)
_SEP = np.zeros(256, bool)
_SEP[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: For plain words: ASCII punctuation separates too.
_PLAIN_SEP = _SEP.copy()
_PLAIN_SEP[[c for c in range(0x21, 0x7F) if not chr(c).isalnum()]] = True
_MASK = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [(1 << 64) - 1], U64)
_LONG_WORD = 256
BLOCK_BYTES = 2 << 20


def release() -> None:
    """Gives memory that the last step freed back to the system: workers live on between stages."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def releasing(f: Callable) -> Callable:
    """``f`` of a group, with ``release`` after it."""

    def done(out: pa.Table) -> pa.Table:
        release()
        return out

    # Spark counts the arguments.
    if f.__code__.co_argcount == 2:
        return lambda key, rows: done(f(key, rows))
    return lambda key, left, right: done(f(key, left, right))


def mix(x: np.ndarray) -> np.ndarray:
    """Invertible 64-bit finaliser (xor-shift, multiply)."""
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    x = x * U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    return x


@dataclass
class Words:
    """Words of a block of texts. ``first[i]:first[i + 1]`` are those of text i."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    def hashes(self) -> np.ndarray:
        """64-bit hash of every word: eight bytes at a time, mixed after each step."""
        n = len(self.starts)
        h = np.full(n, 0x9E3779B97F4A7C15, U64)
        if not n:
            return h
        size = (self.ends - self.starts).astype(np.int64)
        padded = np.concatenate([self.data, np.zeros(8, np.uint8)])
        loads = np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))
        h = (h ^ (loads[self.starts] & _MASK[np.minimum(size, 8)])) * U64(0xBF58476D1CE4E5B9)
        h ^= h >> U64(29)
        todo, k = np.flatnonzero((size > 8) & (size <= _LONG_WORD)), 8
        while len(todo):
            part = loads[self.starts[todo] + k] & _MASK[np.minimum(size[todo] - k, 8)]
            x = (h[todo] ^ part) * U64(0xBF58476D1CE4E5B9)
            h[todo] = x ^ (x >> U64(29))
            k += 8
            todo = todo[size[todo] > k]
        for i in np.flatnonzero(size > _LONG_WORD):
            d = hashlib.blake2b(self.data[self.starts[i] : self.ends[i]].tobytes(), digest_size=8).digest()
            h[i] = U64(int.from_bytes(d, "little"))
        return mix(h ^ size.astype(U64))

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def doc_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts())


def words_of(texts: pa.Array, lower: bool = False, plain: bool = False) -> Words:
    """Word spans of an Arrow string array; a null text has no words.

    lower: A-Z become a-z. plain: that, the accented capitals of Latin-1 as well, and ASCII
    punctuation separates words.
    """
    if texts.null_count:
        texts = texts.fill_null("")
    large = pa.types.is_large_string(texts.type)
    _, off, buf = texts.buffers()
    offsets = np.frombuffer(off, np.int64 if large else np.int32, len(texts) + 1, texts.offset * (8 if large else 4)).astype(np.int64)
    lo, hi = int(offsets[0]), int(offsets[-1])
    data = np.frombuffer(buf, np.uint8, hi - lo, lo) if hi > lo else np.zeros(0, np.uint8)
    offsets = offsets - lo
    if lower or plain:
        data = _LOWER[data]
    if plain and len(data):
        capital = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        data[1:][capital] += 0x20
    sep = (_PLAIN_SEP if plain else _SEP)[data]
    edge = np.ones(len(data) + 1, bool)
    edge[1:] = np.append(sep[:-1], True) if len(data) else True
    edge[offsets[:-1]] = True
    word = ~sep
    starts = np.flatnonzero(word & edge[:-1])
    after = np.ones(len(data), bool)
    after[:-1] = sep[1:]
    inner = offsets[1:][(offsets[1:] > 0)] - 1
    after[inner] = True
    ends = np.flatnonzero(word & after) + 1
    return Words(data, starts, ends, np.searchsorted(starts, offsets))


def blocks(batch: pa.RecordBatch, column: str, limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``limit`` bytes of text each (one text at least)."""
    texts = batch.column(batch.schema.get_field_index(column))
    sizes = np.asarray(pc.binary_length(texts).fill_null(0), dtype=np.int64)
    part = (np.cumsum(sizes) - sizes) // limit
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(sizes)]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def ngrams(h: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-grams that lie within one text, and the index of their first word."""
    total = len(h) - n + 1
    if total <= 0:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    g = np.zeros(total, U64)
    for k in range(n):
        g = (g ^ h[k : k + total]) * U64(0x9E3779B97F4A7C15)
        g ^= g >> U64(31)
    last = np.repeat(first[1:], np.diff(first))[:total]
    at = np.flatnonzero(np.arange(total) + n <= last)
    return mix(g[at]), at
