"""Interpolated modified Kneser-Ney n-gram model, counted in Spark, memory-mapped by workers.

Words are counted first. Triples and pairs are then counted together: triples go to buckets by
their middle word, so a bucket has all of a context (its first two words) and of a pair (its last
two) at once, and an exchange of triples yields both sizes. A word with too large a share of all
tokens is spread over several buckets by the last word; sums of its contexts, and of the words
that end pairs, are completed at the end. Buckets are dealt to rounds, a job each: a round reads
all texts and exchanges its own buckets' triples, whose files go before the next round.

Longer n-grams (and pairs alone, in order 2) are counted by one job for each size. A map task reduces its
texts to distinct n-grams of 64-bit word hashes and sends them, their words coded by a list of
each payload's distinct ones, to buckets on a grid: rows of the grid by the context, columns by
the word, so that neither a frequent word nor a frequent context fills one bucket alone. A bucket
of the longest n-grams sums their counts; one of shorter ones counts the words seen before each.
It writes them as a sorted hash array, and passes on the partial sums of its contexts and words,
which a second exchange completes and writes the same way. Nothing but sums and the frequent words
(two a bucket at most) reaches the driver. The files of a job's exchanges go when it ends (also where
the session keeps them otherwise), so that no more than one job's are there at once.

Arrays of n-grams and contexts hold 48 bits of each hash within a bucket and counts in a byte
each, with a list of the larger ones; words are held by 64 bits.

Scoring maps the arrays into memory from the shared folder and looks the n-grams of each block of
texts up by binary search, bucket by bucket and nearly in order. Texts begin with as many starts as
the longest context has words.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, parts_for, shared_dir
from .textcore import U64, Words, blocks, mix, release, releasing, words_of

START, END = U64(0x51A7C0FFEE150001), U64(0xE4D0FD0C5EED0003)
ORDER = 3
COLUMNS = 8
FLUSH_TOKENS = 4_000_000
ROUNDS = 4
ROUND_BUCKETS = 16
MERGE = 4_000_000
#: Candidates for frequent words that a bucket of words names; 2 are frequent on average at most.
NAMED = 16


def pair_key(u: np.ndarray, w: np.ndarray) -> np.ndarray:
    return mix(u * U64(0x9E3779B97F4A7C15) + w)


def tokens_of(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, place in its text, text) of every token: the words of each text and one END."""
    h, n = words.hashes(), words.counts()
    text = np.repeat(np.arange(len(n)), n + 1)
    ends = np.cumsum(n + 1) - 1
    w = np.empty(len(h) + len(n), U64)
    is_word = np.ones(len(w), bool)
    is_word[ends] = False
    w[is_word], w[ends] = h, END
    return w, np.arange(len(w)) - np.repeat(ends - n, n + 1), text


def shifted(w: np.ndarray, place: np.ndarray, size: int, start: int) -> np.ndarray:
    """A column per token: the ``size`` tokens that end with it, ``start`` where the text has not begun."""
    x = np.empty((size, len(w)), w.dtype)
    for back, row in enumerate(x[::-1]):
        row[back:] = w[: max(len(w) - back, 0)]
        row[place < back] = start
    return x


def token_grams(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(grams, text) of every token, START where the text has not begun."""
    w, place, text = tokens_of(words)
    return shifted(w, place, size, START), text


def context_hash(x: np.ndarray) -> np.ndarray:
    """Hash of the tokens of each column; a text's beginning is one START, however long."""
    u = x[0]
    for row in x[1:]:
        u = np.where(row == START, START, pair_key(u, row))
    return u


def gram_hash(x: np.ndarray) -> np.ndarray:
    return pair_key(context_hash(x[:-1]), x[-1])


# --- sorted hash arrays ------------------------------------------------------------------


def _store(root: str, name: str, *columns: np.ndarray) -> None:
    """Writes columns one after the other; the rename makes a repeated task harmless."""
    where, path = pafs.FileSystem.from_uri(root)
    tmp = f"{path}/.{name}-{uuid.uuid4().hex}"
    with where.open_output_stream(tmp) as out:
        out.write(np.int64(len(columns[0])).tobytes())
        for c in columns:
            out.write(np.ascontiguousarray(c).tobytes())
    where.move(tmp, f"{path}/{name}")


@lru_cache(maxsize=4096)
def _load(root: str, name: str, kinds: tuple[str, ...]) -> list[np.ndarray]:
    """The columns as views of the mapped file; a store without a local path is copied first."""
    where, path = pafs.FileSystem.from_uri(root)
    path = f"{path}/{name}"
    if not isinstance(where, pafs.LocalFileSystem):
        with where.open_input_stream(path) as src, tempfile.TemporaryFile() as own:
            while part := src.read(1 << 24):
                own.write(part)
            own.flush()
            raw = np.memmap(own, np.uint8, "r").view(np.ndarray)
    else:
        raw = np.memmap(path, np.uint8, "r").view(np.ndarray)
    n, at, out = int(raw[:8].view(np.int64)[0]), 8, []
    for kind in kinds:
        end = at + n * np.dtype(kind).itemsize
        out.append(raw[at:end].view(kind))
        at = end
    return out


def _find(keys: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros(len(q), np.int64), np.zeros(len(q), bool)
    at = np.minimum(np.searchsorted(keys, q), len(keys) - 1)
    return at, keys[at] == q


def _store_counts(root: str, name: str, x: np.ndarray, *values: np.ndarray) -> None:
    """Counts by sorted 48-bit keys, a byte each; rows with one of 255 and more are listed whole, and
    those whose first count is 1 (the second too then, no other) are keys alone."""
    one = values[0] == 1
    large = np.logical_or.reduce([v > 254 for v in values])
    keys = lambda k: ((k >> U64(16)).astype(np.uint32), k.astype(np.uint16))
    _store(root, f"{name}-one", *keys(x[one]))
    _store(root, name, *keys(x[~one]), *(np.minimum(v[~one], 255).astype(np.uint8) for v in values))
    _store(root, f"{name}-large", x[large], *(v[large].astype(np.int64) for v in values))


def _find_parted(high: np.ndarray, low: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which of ``x`` are known, their places) among sorted 48-bit keys."""
    q, tail = (x >> U64(16)).astype(np.uint32), x.astype(np.uint16)
    left, at = np.arange(len(x)), np.searchsorted(high, q)
    which, where = [], []
    while len(left):  # several keys may share the first 32 bits
        here = at < len(high)
        here[here] = high[at[here]] == q[left[here]]
        left, at = left[here], at[here]
        hit = low[at] == tail[left]
        which.append(left[hit])
        where.append(at[hit])
        left, at = left[~hit], at[~hit] + 1
    return np.concatenate([*which, left]), np.concatenate([*where, at])


def _read_counts(root: str, name: str, width: int, x: np.ndarray) -> np.ndarray:
    """The counts (a row for each value) of 48-bit keys; 0 where unknown."""
    out = np.zeros((width, len(x)))
    which, _ = _find_parted(*_load(root, f"{name}-one", ("u4", "u2")), x)
    for o in out[:2]:
        o[which] = 1
    rest = np.flatnonzero(out[0] == 0)  # a key is in one of the arrays
    high, low, *values = _load(root, name, ("u4", "u2", *["u1"] * width))
    which, where = _find_parted(high, low, x[rest])
    which, found = rest[which], [v[where] for v in values]
    for o, v in zip(out, found):
        o[which] = v
    many = which[np.logical_or.reduce([v == 255 for v in found])]
    if len(many):
        keys, *full = _load(root, f"{name}-large", ("u8", *["i8"] * width))
        place, _ = _find(keys, x[many])
        for o, v in zip(out, full):
            o[many] = v[place]
    return out


def _store_words(root: str, name: str, x: np.ndarray, values: np.ndarray) -> None:
    _store(root, name, x, np.minimum(values, 255).astype(np.uint8))
    _store(root, f"{name}-large", x[values > 254], values[values > 254].astype(np.int64))


def _read_words(root: str, name: str, x: np.ndarray) -> np.ndarray:
    out = np.zeros(len(x))
    for part, kind in ((name, "u1"), (f"{name}-large", "i8")):
        keys, values = _load(root, part, ("u8", kind))
        at, hit = _find(keys, x)
        out[hit] = values[at[hit]]
    return out


# --- counting ----------------------------------------------------------------------------


def _pack(*arrays: np.ndarray) -> bytes:
    return np.array([len(a) for a in arrays], np.int64).tobytes() + b"".join(np.ascontiguousarray(a).tobytes() for a in arrays)


def _unpack(raw: memoryview, *kinds: str) -> list[np.ndarray]:
    sizes, at, out = np.frombuffer(raw, np.int64, len(kinds)), 8 * len(kinds), []
    for n, kind in zip(sizes, kinds):
        out.append(np.frombuffer(raw, kind, n, at))
        at += int(n) * np.dtype(kind).itemsize
    return out


def _narrow(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts in a byte each; those of 255 and more are listed by their place, in 64 bits."""
    big = np.flatnonzero(values > 254)
    return np.minimum(values, 255).astype(np.uint8), big.astype(np.uint32), values[big].astype(np.int64)


def _widen(small: np.ndarray, big: np.ndarray, full: np.ndarray) -> np.ndarray:
    out = small.astype(np.int64)
    out[big] = full
    return out


def _starts(k: np.ndarray) -> np.ndarray:
    """Where each run of equal keys begins."""
    return np.flatnonzero(np.append(True, k[1:] != k[:-1])) if len(k) else np.zeros(0, np.int64)


def _sums(key: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys, sorted, with the sums of the values; the order used comes last."""
    order = np.argsort(key)
    k = key[order]
    first = _starts(k)
    return (k[first], *(np.add.reduceat(v[order], first) if len(k) else v for v in values), order[first])


def _distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values, and the place of each among them."""
    coded = pa.array(x).dictionary_encode()
    return coded.dictionary.to_numpy(), coded.indices.to_numpy()


def _code(words: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words that occur among ``ids``, and the places of all in this list."""
    if ids.size > len(words) // 8:
        used = np.zeros(len(words), bool)
        used[ids] = True
        return words[used], (np.cumsum(used) - 1)[ids]
    used, at = np.unique(ids, return_inverse=True)
    return words[used], at.reshape(ids.shape)


def _width(known: np.ndarray) -> int:
    return max(1, (len(known).bit_length() + 7) // 8)


def _gram_rows(x: np.ndarray, size: int, counted: bool, rows: int) -> Iterator[tuple[int, bytes]]:
    """Distinct columns of ``x`` by the bucket of their last ``size`` tokens, as places in a list of
    the payload's words, byte by byte (the first token's sorted, as steps); with counts where ``counted``."""
    _, count, rep = _sums(gram_hash(x), np.ones(x.shape[1], np.int64))
    words, ids = np.unique(x[-1], return_inverse=True)
    x = x[:, rep]
    last, words = ids[rep], np.append(words, START)
    ids = np.where(x[:-1] == START, len(words) - 1, np.searchsorted(words[:-1], x[:-1]))
    ids = np.vstack([ids, last])
    bucket = bucket_of(context_hash(x[-size:-1]), x[-1], rows)
    del x
    order = np.argsort((bucket << 32) | ids[0])
    yield from _payloads(words, ids[:, order], count[order], bucket[order], counted)


def _payloads(words: np.ndarray, ids: np.ndarray, count: np.ndarray, bucket: np.ndarray, counted: bool) -> Iterator[tuple[int, bytes]]:
    """Columns sorted by bucket and first token, a payload for each bucket."""
    cuts = np.flatnonzero(np.diff(bucket)) + 1
    for a, b in zip([0, *cuts], [*cuts, len(count)]):
        known, at = _code(words, ids[:, a:b])
        at = np.ascontiguousarray(at, "<u4")
        at[0, 1:] = np.diff(at[0])
        planes = at.view(np.uint8).reshape(len(at), b - a, 4)[:, :, : _width(known)].transpose(0, 2, 1)
        yield int(bucket[a]), _pack(known, planes.reshape(-1), *(_narrow(count[a:b]) if counted else ()))


def _mid_rows(words: np.ndarray, ids: np.ndarray, counted: bool, by: Spread, own: range) -> Iterator[tuple[int, bytes]]:
    """Distinct columns of places in ``words`` whose bucket, by the last word but one, is in ``own``; with
    counts where ``counted``. A column is sorted as one integer; too many words for that are halved."""
    base, splits = by.base(words), by.splits(words)
    bucket_of = lambda mid, last: (base[mid] + spread_by(words[last]) % splits[mid]) % by.parts
    if len(own) < by.parts:
        bucket = base[ids[-2]]
        many = np.flatnonzero((splits > 1)[ids[-2]])
        bucket[many] = bucket_of(ids[-2][many], ids[-1][many])
        ids = ids[:, (bucket >= own.start) & (bucket < own.stop)]
    bits = max(1, (len(words) - 1).bit_length())
    if bits * len(ids) > 64:
        half = ids.shape[1] // 2
        for part in (ids[:, :half], ids[:, half:]):
            yield from _mid_rows(*_code(words, part), counted, by, range(by.parts))
        return
    key = np.zeros(ids.shape[1], U64)
    for row in ids:
        key = (key << U64(bits)) | row.astype(U64)
    key.sort()
    first = _starts(key)
    count, key = np.diff(np.append(first, len(key))), key[first]
    ids = np.stack([((key >> U64(bits * back)) & U64((1 << bits) - 1)).astype(np.int32) for back in range(len(ids) - 1, -1, -1)])
    bucket = bucket_of(ids[-2], ids[-1])
    order = np.argsort(bucket.astype(np.uint16) if by.parts <= 1 << 16 else bucket, kind="stable")
    if len(order):
        yield from _payloads(words, ids[:, order], count[order], bucket[order], counted)


def _read_grams(payloads: pa.ChunkedArray, length: int, counted: bool) -> tuple[np.ndarray, np.ndarray]:
    """Distinct columns of all payloads and their summed counts. They are summed whenever some MERGE have
    come, so that memory follows the distinct ones."""
    xs, cs, new = [], [], 0

    def merged() -> tuple[np.ndarray, np.ndarray]:
        x = np.concatenate(xs, axis=1)
        _, count, rep = _sums(gram_hash(x), np.concatenate(cs) if counted else np.ones(x.shape[1], np.int64))
        return x[:, rep], count

    for raw in payloads:
        known, planes, *c = _unpack(raw.as_buffer(), "u8", "u1", *(("u1", "u4", "i8") if counted else ()))
        planes = planes.reshape(length, _width(known), -1)
        at = np.zeros((length, planes.shape[2], 4), np.uint8)
        at[:, :, : planes.shape[1]] = planes.transpose(0, 2, 1)
        at = at.view("<u4")[:, :, 0]
        at[0] = np.cumsum(at[0], dtype=np.uint32)
        xs.append(known[at])
        if counted:
            cs.append(_widen(*c))
        new += at.shape[1]
        if new >= max(MERGE, xs[0].shape[1]):
            x, count = merged()
            xs, cs, new = [x], [count], 0
    return merged()


def bucket_of(u: np.ndarray, w: np.ndarray, rows: int) -> np.ndarray:
    return ((u >> U64(24)) % U64(rows) * U64(COLUMNS) + (w >> U64(24)) % U64(COLUMNS)).astype(np.int64)


def key_bucket(x: np.ndarray, parts: int) -> np.ndarray:
    return (mix(x) % U64(parts)).astype(np.int64)


def spread_by(w: np.ndarray) -> np.ndarray:
    return (w >> U64(40)).astype(np.int64)


@dataclass(frozen=True, eq=False)
class Spread:
    """Buckets of triples and pairs: by the middle word, those of a frequent one over ``shares`` buckets by the last."""

    parts: int
    frequent: np.ndarray
    shares: np.ndarray

    def base(self, mid: np.ndarray) -> np.ndarray:
        return key_bucket(mid, self.parts)

    def splits(self, mid: np.ndarray) -> np.ndarray:
        out = np.ones(len(mid), np.int64)
        at, hit = _find(self.frequent, mid)
        out[hit] = self.shares[at[hit]]
        return out


@dataclass(frozen=True)
class KneserNey:
    """A fitted model: where its arrays are, the corpus sums, and the discounts of orders 1, 2, ..."""

    root: str
    order: int
    rows: int
    parts: int
    tokens: int
    vocabulary: int
    pairs: int
    discounts: tuple[tuple[float, float, float], ...]
    low_left: float
    #: Per kind of array a bit for each bucket that was stored.
    stored: dict[str, bytes] = field(default_factory=dict)
    #: Where triples and pairs are, if they were counted together.
    spread: Spread | None = None

    def holds(self, kind: str, bucket: int) -> bool:
        """Whether a bucket was stored: only others may be absent, and count as zero."""
        bits = self.stored.get(kind, b"")
        return bucket >> 3 < len(bits) and bool(bits[bucket >> 3] >> (bucket & 7) & 1)

    def delete(self) -> None:
        where, path = pafs.FileSystem.from_uri(self.root)
        where.delete_dir(path)


def _stored(root: str) -> dict[str, bytes]:
    """The buckets whose arrays are in a model's folder, as a bit each."""
    where, path = pafs.FileSystem.from_uri(root)
    by: dict[str, list[int]] = {}
    for info in where.get_file_info(pafs.FileSelector(path)):
        kind, _, bucket = info.base_name.rpartition("-")
        if bucket.isdigit():
            by.setdefault(kind, []).append(int(bucket))
    out = {}
    for kind, buckets in by.items():
        bits = np.zeros(max(buckets) + 1, np.uint8)
        bits[buckets] = 1
        out[kind] = np.packbits(bits, bitorder="little").tobytes()
    return out


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts from counts of counts; 0.75 where these are not enough."""
    if not (n1 and n2 and n3 and n4):
        return (0.75, 0.75, 0.75)
    y = n1 / (n1 + 2 * n2)
    raw = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
    return tuple(min(max(d, 0.0), k) for k, d in enumerate(raw, 1))


def _by_count(values: np.ndarray) -> np.ndarray:
    return np.bincount(np.minimum(values, 5), minlength=6)[1:5]


def _by_bucket(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(bucket, kind="stable")
    for own in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1):
        if len(own):
            yield int(bucket[own[0]]), own


CONTEXTS, WORDS, SUMS = range(3)
_SENT = "bucket int, payload binary"
_PASSED = "kind int, bucket int, payload binary"
NAMES = ("n", "total", "of1", "of2", "of3", "of4")


def _followed(c: np.ndarray) -> tuple[np.ndarray, ...]:
    """What grams of these counts add to their contexts."""
    one, two = (c == 1).astype(np.int64), (c == 2).astype(np.int64)
    return c, one, two, 1 - one - two


def _passed(rows: list[tuple]) -> pa.Table:
    return pa.table([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int32(), pa.binary()))], names=["kind", "bucket", "payload"])


def _parted(kind: int, parts: int, x: np.ndarray, *values: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
    """Partial sums by word (64 bits) or context (48 bits), for the bucket of each."""
    x, *sums, _ = _sums(x, *values)
    for b, own in _by_bucket(key_bucket(x, parts)):
        key = (x[own],) if kind % 3 == WORDS else ((x[own] >> U64(32)).astype(np.uint32), (x[own] >> U64(16)).astype(np.uint16))
        yield kind, b, _pack(*key, *(a for v in sums for a in _narrow(v[own])))


def _read_parted(kind: int, payloads: pa.ChunkedArray, width: int) -> tuple[np.ndarray, ...]:
    """Sorted keys and their whole sums."""
    words = kind % 3 == WORDS
    keys = ("u8",) if words else ("u4", "u2")
    got = [_unpack(raw.as_buffer(), *keys, *["u1", "u4", "i8"] * width) for raw in payloads]
    x = np.concatenate([g[0] if words else (g[0].astype(U64) << U64(16)) | g[1] for g in got])
    return _sums(x, *(np.concatenate([_widen(*g[len(keys) + 3 * i :][:3]) for g in got]) for i in range(width)))[:-1]


def fit(texts: DataFrame, order: int = 2, bytes_each: int = 8 << 20, rounds: int | None = None) -> KneserNey:
    """Learns n-grams of up to ``order`` (2 or more) words from the column ``text`` of all rows
    (null: an empty text, which has an END). The texts are read once for the words, once in each of
    ``rounds`` for triples and pairs (None: up to ROUNDS, fewer for small texts), once for each longer size."""
    if order < 2:
        raise ValueError("an n-gram model has order 2 or more")
    spark: SparkSession = texts.sparkSession
    rows = max(2, -(-parts_for(texts, bytes_each, 24) // COLUMNS))
    parts = rows * COLUMNS
    base = shared_dir(spark)
    base = base.replace("s3a://", "s3://", 1)  # pyarrow's name of that store
    if base.startswith("file:/"):
        base = "/" + base.removeprefix("file:").lstrip("/")
    root = (base if "://" in base else f"file://{os.path.abspath(base)}").rstrip("/") + f"/ngrams-{uuid.uuid4().hex}"
    if root.startswith("file:/"):
        os.makedirs(root.removeprefix("file://"), exist_ok=True)
    else:
        where, path = pafs.FileSystem.from_uri(root)
        where.create_dir(path)
    texts = texts.select(F.coalesce("text", F.lit("")).alias("text"))
    found = {k: _count(texts, k, order, root, rows) for k in range(order, 3 if order > 2 else 1, -1)}
    tokens, by = (found[2][WORDS], None) if order == 2 else _count_words(texts, root, parts)
    if by:
        found |= _count_triples(texts, order, root, by, rounds or min(ROUNDS, parts // ROUND_BUCKETS))
    if not found[2][SUMS]["n"]:
        return KneserNey(root, order, rows, parts, 0, 0, 0, ((0.75,) * 3,) * order, 1.0)
    low, pairs = found[2][WORDS], found[2][SUMS]["n"]
    spread = lambda r: discounts(*(r[f"of{i}"] for i in range(1, 5)))
    d = (spread(low), *(spread(found[k][SUMS]) for k in range(2, order + 1)))
    left = (d[0][0] * low["of1"] + d[0][1] * low["of2"] + d[0][2] * (low["n"] - low["of1"] - low["of2"])) / pairs
    return KneserNey(root, order, rows, parts, tokens["total"], tokens["n"], pairs, d, left, _stored(root), by)


def _count(texts: DataFrame, size: int, order: int, root: str, rows: int) -> dict[int, dict]:
    """Counts, stores and sums the n-grams of one size (above 3, or 2 alone): raw counts in the highest
    order, the number of different words before them in the others."""
    counted, parts = size == order, rows * COLUMNS
    length = size if counted else size + 1

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def out() -> pa.RecordBatch:
            found = list(_gram_rows(np.concatenate(held, axis=1), size, counted, rows))
            return pa.RecordBatch.from_arrays([pa.array([b for b, _ in found], pa.int32()), pa.array([x for _, x in found], pa.binary())], names=["bucket", "payload"])

        for b in batches:
            for s in blocks(b, "text"):
                held.append(token_grams(words_of(s.column(0), lower=True), length)[0])
                n += held[-1].shape[1]
                if n >= FLUSH_TOKENS:
                    yield out()
                    held, n = [], 0
        if n:
            yield out()
        held.clear()
        release()

    @releasing
    def bucket(key: tuple[pa.Scalar, ...], sent: pa.Table) -> pa.Table:
        x, c = _read_grams(sent.column("payload"), length, counted)
        x = x[-size:]
        if not counted:
            _, c, rep = _sums(gram_hash(x), np.ones(x.shape[1], np.int64))
            x = x[:, rep]
        u, w = context_hash(x[:-1]), x[-1]
        k, total, _ = _sums(pair_key(u, w) >> U64(16), c)
        _store_counts(root, f"grams-{size}-{key[0].as_py()}", k, total)
        out = [(SUMS, key[0].as_py(), _pack(np.array([len(c), 0, *_by_count(c)])))]
        out += _parted(CONTEXTS, parts, u, *_followed(c))
        if size == 2:
            out += _parted(WORDS, parts, w, c, np.ones_like(c))
        return _passed(out)

    @releasing
    def totals(key: tuple[pa.Scalar, ...], sent: pa.Table) -> pa.Table:
        kind, at = key[0].as_py(), key[1].as_py()
        figures = np.zeros(6, np.int64)
        if kind == SUMS:
            figures = sum(_unpack(raw.as_buffer(), "i8")[0] for raw in sent.column("payload"))
        else:
            x, *sums = _read_parted(kind, sent.column("payload"), 2 if kind == WORDS else 4)
            if kind == CONTEXTS:
                _store_counts(root, f"contexts-{size}-{at}", x, *sums)
            else:
                _store_words(root, f"tokens-{at}", x, sums[0])
                _store_words(root, f"kinds-{at}", x, sums[1])
                figures = np.array([len(x), sums[0].sum(), *_by_count(sums[1])])
        return pa.table({"kind": pa.array([kind], pa.int32()), "f": pa.array([figures.tolist()], pa.list_(pa.int64()))})

    with _freeing(texts.sparkSession):
        got = (
            texts.mapInArrow(grams, _SENT)
            .repartition(parts, "bucket").groupBy("bucket").applyInArrow(bucket, _PASSED)
            .repartition(parts, "kind", "bucket").groupBy("kind", "bucket").applyInArrow(totals, "kind int, f array<bigint>")
            .groupBy("kind").agg(*[F.sum(F.col("f")[i]).alias(x) for i, x in enumerate(NAMES)])
        )
        none = {kind: dict.fromkeys(NAMES, 0) for kind in range(3)}
        return none | {r["kind"]: r.asDict() for r in got.collect()}  # three rows


def _in_flushes(batches: Iterator[pa.RecordBatch], rows: Callable[[np.ndarray, np.ndarray], Iterator[tuple[int, bytes]]]) -> Iterator[pa.RecordBatch]:
    """``rows`` of the tokens and their places in their texts, FLUSH_TOKENS or little more at a time."""
    held, n = [], 0

    def out() -> pa.RecordBatch:
        found = list(rows(*(np.concatenate(c) for c in zip(*held))))
        return pa.RecordBatch.from_arrays([pa.array([b for b, _ in found], pa.int32()), pa.array([x for _, x in found], pa.binary())], names=["bucket", "payload"])

    for b in batches:
        for s in blocks(b, "text"):
            w, place, _ = tokens_of(words_of(s.column(0), lower=True))
            held.append((w, np.minimum(place, 255).astype(np.uint8)))
            n += len(w)
            if n >= FLUSH_TOKENS:
                yield out()
                held, n = [], 0
    if n:
        yield out()
    held.clear()
    release()


def _kept(root: str) -> str:
    """Where Spark keeps what is needed until the counting ends, in a model's folder."""
    return f"{root.replace('s3://', 's3a://', 1)}/passed"


def _count_words(texts: DataFrame, root: str, parts: int) -> tuple[dict, Spread]:
    """Counts and stores the words. A word with more than half a bucket's mean share of the tokens is
    frequent; this decides where its triples go, no count depends on it."""

    def rows(w: np.ndarray, _: np.ndarray) -> Iterator[tuple[int, bytes]]:
        w = np.sort(w)
        first = _starts(w)
        for _, b, payload in _parted(WORDS, parts, w[first], np.diff(np.append(first, len(w)))):
            yield b, payload

    @releasing
    def bucket(key: tuple[pa.Scalar, ...], sent: pa.Table) -> pa.Table:
        x, c = _read_parted(WORDS, sent.column("payload"), 1)
        _store_words(root, f"tokens-{key[0].as_py()}", x, c)
        top = np.argsort(-c, kind="stable")[:NAMED]
        lists = [pa.array([v.tolist()], pa.list_(pa.int64())) for v in (x[top].view(np.int64), c[top])]
        return pa.table([pa.array([len(x)], pa.int64()), pa.array([c.sum()], pa.int64()), *lists], names=["n", "total", "words", "counts"])

    spark, kinds = texts.sparkSession, "n bigint, total bigint, words array<bigint>, counts array<bigint>"
    with _freeing(spark):
        sent = texts.mapInArrow(lambda batches: _in_flushes(batches, rows), _SENT)
        sent.repartition(parts, "bucket").groupBy("bucket").applyInArrow(bucket, kinds).write.parquet(f"{_kept(root)}/words")
        found = spark.read.schema(kinds).parquet(f"{_kept(root)}/words")
        sums = found.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n", "total")]).first().asDict()
        named = found.select(F.explode(F.arrays_zip("words", "counts")).alias("x")).where(F.col("x.counts") * 2 * parts > sums["total"])
        counts = {r["x"]["words"] % (1 << 64): r["x"]["counts"] for r in named.collect()}
    if int(END) in counts:  # as many texts begin as end
        counts[int(START)] = counts[int(END)]
    keys = np.array(sorted(counts), U64)
    return sums, Spread(parts, keys, np.array([min(parts, -(-2 * parts * counts[int(k)] // sums["total"])) for k in keys], np.int64))


def _count_triples(texts: DataFrame, order: int, root: str, by: Spread, rounds: int) -> dict[int, dict]:
    """Counts, stores and sums triples (raw counts in order 3, else the number of different words before
    them) and pairs (the number of different words before them), as ``_count`` does."""
    spark, parts, counted, length = texts.sparkSession, by.parts, order == 3, min(order, 4)
    kept = _kept(root)

    def of_round(own: range) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def rows(w: np.ndarray, place: np.ndarray) -> Iterator[tuple[int, bytes]]:
            words, ids = _distinct(w)
            return _mid_rows(np.append(words, START), shifted(ids, place, length, len(words)), counted, by, own)

        return lambda batches: _in_flushes(batches, rows)

    @releasing
    def bucket(key: tuple[pa.Scalar, ...], sent: pa.Table) -> pa.Table:
        at = key[0].as_py()
        out = []

        def keep(size: int, k: np.ndarray, u: np.ndarray, mid: np.ndarray, c: np.ndarray) -> None:
            """Grams by sorted hashes; contexts here too, unless a frequent word has spread them."""
            k = k >> U64(16)
            first = _starts(k)
            _store_counts(root, f"grams-{size}-{at}", k[first], np.add.reduceat(c, first))
            out.append((3 * size + SUMS, at, _pack(np.array([len(c), 0, *_by_count(c)]))))
            spread, values = by.splits(mid) > 1, _followed(c)
            x, *sums, _ = _sums(u[~spread] >> U64(16), *(v[~spread] for v in values))
            _store_counts(root, f"contexts-{size}-{at}", x, *sums)
            out.extend(_parted(3 * size + CONTEXTS, parts, u[spread], *(v[spread] for v in values)))

        x, c = _read_grams(sent.column("payload"), length, counted)
        x = x[-3:]
        k = gram_hash(x)
        if not counted:
            k, c, rep = _sums(k, np.ones(len(k), np.int64))
            x = x[:, rep]
        keep(3, k, context_hash(x[:-1]), x[-2], c)
        k, c, rep = _sums(pair_key(x[-2], x[-1]), np.ones(len(k), np.int64))
        mid, last = x[-2:, rep]
        keep(2, k, mid, mid, c)
        out += _parted(3 * 2 + WORDS, parts, last, np.ones_like(c))
        return _passed(out)

    @releasing
    def totals(key: tuple[pa.Scalar, ...], sent: pa.Table) -> pa.Table:
        (size, kind), at = divmod(key[0].as_py(), 3), key[1].as_py()
        figures = np.zeros(6, np.int64)
        if kind == SUMS:
            figures = sum(_unpack(raw.as_buffer(), "i8")[0] for raw in sent.column("payload"))
        else:
            x, *sums = _read_parted(kind, sent.column("payload"), 1 if kind == WORDS else 4)
            if kind == CONTEXTS:
                _store_counts(root, f"spread-{size}-{at}", x, *sums)
            else:
                _store_words(root, f"kinds-{at}", x, sums[0])
                figures = np.array([len(x), sums[0].sum(), *_by_count(sums[0])])
        return pa.table({"kind": key[:1], "f": pa.array([figures.tolist()], pa.list_(pa.int64()))})

    found = {size: {kind: dict.fromkeys(NAMES, 0) for kind in range(3)} for size in (2, 3)}
    with _freeing(spark):
        for r in range(rounds):
            own = range(r * parts // rounds, (r + 1) * parts // rounds)
            texts.mapInArrow(of_round(own), _SENT).repartition(parts, "bucket").groupBy("bucket").applyInArrow(bucket, _PASSED).write.parquet(f"{kept}/{r}")
        got = (
            spark.read.schema(_PASSED).parquet(*[f"{kept}/{r}" for r in range(rounds)])
            .repartition(parts, "kind", "bucket").groupBy("kind", "bucket").applyInArrow(totals, "kind int, f array<bigint>")
            .groupBy("kind").agg(*[F.sum(F.col("f")[i]).alias(x) for i, x in enumerate(NAMES)])
        )
        for r in got.collect():  # five rows
            found[r["kind"] // 3][r["kind"] % 3] = r.asDict()
    where, path = pafs.FileSystem.from_uri(root)
    where.delete_dir(f"{path}/passed")
    return found


@contextmanager
def _freeing(spark: SparkSession) -> Iterator[None]:
    """Files of exchanges go at the end of the queries made and run inside."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


# --- scoring -----------------------------------------------------------------------------


def _near_order(bucket: np.ndarray, x: np.ndarray) -> np.ndarray:
    """An order by bucket and, as far as the bits go, by ``x``: searches in it run along the arrays."""
    bits = len(x).bit_length()
    if not len(x) or int(bucket.max()) >= 1 << 16 or bits > 32:
        return np.lexsort((x, bucket))
    key = ((bucket.astype(U64) << U64(48)) | (x >> U64(16))) >> U64(bits) << U64(bits) | np.arange(len(x), dtype=U64)
    key.sort()
    return (key & U64((1 << bits) - 1)).astype(np.int64)


def _lookup(model: KneserNey, kind: str, x: np.ndarray, bucket: np.ndarray, width: int, read: Callable[[str, np.ndarray], np.ndarray]) -> np.ndarray:
    """Rows of values for ``x``, read bucket by bucket; 0 where no training n-gram fell into a bucket. A
    bucket that was stored and isn't there raises."""
    out = np.zeros((width, len(x)))
    order = _near_order(bucket, x)
    for own in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1):
        if len(own) and model.holds(kind, b := int(bucket[own[0]])):
            for o, v in zip(out, read(f"{kind}-{b}", x[own])):
                o[own] = v
    return out


def log_probabilities(model: KneserNey, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """log10 probability of the last token of each column after those before it, and its training count."""
    w = x[-1]
    y, of = _distinct(w)
    mids, mid = _distinct(x[-2])
    spread = model.spread
    if spread:
        base, splits = spread.base(mids), spread.splits(mids)
        triples = (base[mid] + spread_by(w) % splits[mid]) % model.parts

    def words(name: str) -> np.ndarray:
        return _lookup(model, name, y, key_bucket(y, model.parts), 1, lambda f, q: [_read_words(model.root, f, q)])[0]

    def counts(kind: str, q: np.ndarray, where: np.ndarray, width: int) -> np.ndarray:
        return _lookup(model, kind, q, where, width, lambda f, q: _read_counts(model.root, f, width, q >> U64(16)))

    take = lambda v, d: v - np.array((0.0, *d))[np.minimum(v, 3).astype(np.int64)]
    p = (take(words("kinds"), model.discounts[0]) / max(model.pairs, 1) + model.low_left / (model.vocabulary + 1))[of]
    for size, d in zip(range(2, model.order + 1), model.discounts[1:]):
        u = context_hash(x[-size:-1])
        by = spread if size < 4 else None
        c = counts(f"grams-{size}", pair_key(u, w), triples if by else bucket_of(u, w, model.rows), 1)[0]
        v, which = (mids, np.arange(len(mids))) if size == 2 else (u, mid)
        if by:
            many, found = (splits > 1)[which], np.zeros((4, len(v)))
            found[:, ~many] = counts(f"contexts-{size}", v[~many], base[which[~many]], 4)
            found[:, many] = counts(f"spread-{size}", v[many], key_bucket(v[many], model.parts), 4)
        else:
            found = counts(f"contexts-{size}", v, key_bucket(v, model.parts), 4)
        total, n1, n2, n3 = found
        left = np.where(total > 0, (d[0] * n1 + d[1] * n2 + d[2] * n3) / np.maximum(total, 1), 1.0)
        total = np.maximum(total, 1)
        if size == 2:
            left, total = left[mid], total[mid]
        p = take(c, d) / total + left * p
    return np.log10(p), words("tokens")[of]


def score(docs: DataFrame, model: KneserNey, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns with n_tokens, n_known, base_score and score of whole texts.

    Null text: as an empty one, whose only token is the END. Rows that repeat score alike.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in blocks(b, "text", 4 << 20):
                x, text = token_grams(words_of(s.column(len(keep)), lower=True), model.order)
                logp, c = log_probabilities(model, x)
                base = np.log10((c + 1) / (model.tokens + model.vocabulary + 1))
                n = s.num_rows
                add = lambda v: np.bincount(text, v, n)
                yield pa.RecordBatch.from_arrays(
                    [*s.columns[:-1], pa.array(np.bincount(text, minlength=n)), pa.array(add(c > 0).astype(np.int64)), pa.array(add(base)), pa.array(add(logp))],
                    names=[*keep, "n_tokens", "n_known", "base_score", "score"],
                )
            release()

    kinds = dict(docs.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "n_tokens bigint, n_known bigint, base_score double, score double"])
    return docs.select(*keep, F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, schema)


def op5_lm_score(spark, sf_dir):
    """Learns from rows whose id's crc32 mod 7 is not 2 and scores all rows."""
    from .common import table
    from .language import fold

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = fold(F.col("doc_id"), 7) == 2
    model = fit(docs.where(~held).select("text"), ORDER)
    out = cut(score(docs, model).select("doc_id", held.alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score"))
    model.delete()
    return out
