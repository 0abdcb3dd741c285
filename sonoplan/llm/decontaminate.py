"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

The test items are a stated query set, held in blocks of bounded size; every block meets all
documents in two passes. The first counts in how many documents each n-gram of the items
occurs. The second looks for seeds, n-grams that are not much more frequent than the median
one of their item, and aligns the item with the passage around them. Rarity is relative to
the item, so half of an item's n-grams at least are seeds, however common its words are or
however often it leaked, and copies that were edited alike don't make the rest look common.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, free_name, text_key
from .textcore import U64, blocks, ngrams, release, words_of

GRAM = 3
#: A seed occurs in at most this many times the documents of its item's median n-gram, plus this.
RARE_TIMES, RARE_PLUS = 4, 4
MATCH, MISMATCH, GAP = 2, -1, -1
#: An alignment counts from this share of the item's perfect score on.
LEAST_SCORE = 0.5
#: Text of the items that are held at once.
BLOCK_BYTES = 16 << 20
_FILTER_BITS = 20


@dataclass
class Items:
    """Items of one block: word hashes (CSR) and their n-grams, each with its occurrences."""

    ids: list[int | None]
    words: np.ndarray
    first: np.ndarray
    grams: np.ndarray
    gram_item: np.ndarray
    gram_at: np.ndarray
    gram_first: np.ndarray

    def find(self, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position in ``g``, index of the gram) of those that belong to the items."""
        if not len(self.grams):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        table = np.zeros(1 << _FILTER_BITS, bool)
        table[(self.grams >> U64(64 - _FILTER_BITS)).astype(np.int64)] = True
        near = np.flatnonzero(table[(g >> U64(64 - _FILTER_BITS)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.grams, g[near]), len(self.grams) - 1)
        hit = self.grams[at] == g[near]
        return near[hit], at[hit]


def make_items(rows: list[tuple[int | None, str | None]]) -> Items:
    """Items with fewer than GRAM words have no n-grams and match nothing."""
    words = words_of(pa.array([t for _, t in rows], pa.string()), plain=True)
    h = words.hashes()
    g, at = ngrams(h, words.first, GRAM)
    item = np.searchsorted(words.first, at, side="right") - 1
    order = np.argsort(g, kind="stable")
    g, item, at = g[order], item[order], at[order] - words.first[item[order]]
    first = np.flatnonzero(np.append(True, g[1:] != g[:-1])) if len(g) else np.zeros(0, np.int64)
    return Items([i for i, _ in rows], h, words.first, g[first], item, at, np.append(first, len(g)))


def rare_seeds(items: Items, documents: np.ndarray) -> np.ndarray:
    """For each occurrence of a gram: is it rare as the grams of its item go?"""
    n = documents[np.repeat(np.arange(len(items.grams)), np.diff(items.gram_first))]
    order = np.lexsort((n, items.gram_item))
    size = np.bincount(items.gram_item, minlength=len(items.ids))
    middle = np.cumsum(size) - size + size // 2
    most = np.zeros(len(items.ids))
    most[size > 0] = n[order][middle[size > 0]]
    return n <= RARE_TIMES * most[items.gram_item] + RARE_PLUS


def align(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int]:
    """Best local alignment of item ``a`` in ``b``: (score, start, end) in b, end exclusive.

    A row's gaps along b are a running maximum, so each row is a few vector operations.
    """

    def best(x: np.ndarray, y: np.ndarray) -> tuple[int, int]:
        slope = -GAP * np.arange(len(y) + 1)
        row, top, where = np.zeros(len(y) + 1, np.int64), 0, 0
        for w in x:
            new = np.maximum(row + GAP, 0)
            new[1:] = np.maximum(new[1:], row[:-1] + np.where(y == w, MATCH, MISMATCH))
            row = np.maximum.accumulate(new + slope) - slope
            k = int(row.argmax())
            if row[k] > top:
                top, where = int(row[k]), k
        return top, where

    score, end = best(a, b)
    return (score, end - best(a[::-1], b[:end][::-1])[1], end) if score else (0, 0, 0)


def _aligned(items: Items, rare: np.ndarray, h: np.ndarray, first: np.ndarray) -> list[tuple[int, int, float, int, int]]:
    """(text, item, score, start, end) of a block of texts, the best passage of each pair."""
    g, at = ngrams(h, first, GRAM)
    where, gram = items.find(g)
    size = np.diff(items.gram_first)[gram]
    begin = np.cumsum(size) - size
    occ = np.arange(int(size.sum())) + np.repeat(items.gram_first[gram] - begin, size)
    at = np.repeat(at[where], size)
    keep = rare[occ]
    occ, at = occ[keep], at[keep]
    if not len(occ):
        return []
    text = np.searchsorted(first, at, side="right") - 1
    item = items.gram_item[occ]
    diagonal = at - items.gram_at[occ]
    order = np.lexsort((diagonal, item, text))
    text, item, diagonal = text[order], item[order], diagonal[order]
    length = np.diff(items.first)[item]
    new = np.append(True, (text[1:] != text[:-1]) | (item[1:] != item[:-1]) | (np.diff(diagonal) > length[1:]))
    starts = np.flatnonzero(new)
    ends = np.append(starts[1:], len(text)) - 1
    best: dict[tuple[int, int], tuple[float, int, int]] = {}
    for s, e in zip(starts, ends):
        t, i, n = int(text[s]), int(item[s]), int(length[s])
        a = items.words[items.first[i] : items.first[i + 1]]
        lo, hi = int(first[t]), int(first[t + 1])
        exact = next((d for d in sorted({int(diagonal[s]), int(diagonal[e])}) if lo <= d <= hi - n and np.array_equal(h[d : d + n], a)), None)
        if exact is not None:
            found = (1.0, exact - lo, exact - lo + n)
        else:
            x, y = max(lo, int(diagonal[s]) - n // 2 - 1), min(hi, int(diagonal[e]) + n + n // 2 + 1)
            score, p, q = align(a, h[x:y])
            found = (score / (MATCH * n), x - lo + p, x - lo + q)
        if found[0] >= LEAST_SCORE and found[0] > best.get((t, i), (0.0,))[0]:
            best[t, i] = found
    return [(t, i, *f) for (t, i), f in best.items()]


def block_count(benchmark: DataFrame) -> int:
    return max(1, -(-(benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // BLOCK_BYTES))


def item_blocks(benchmark: DataFrame) -> Iterator[list[tuple[int | None, str | None]]]:
    """The items, in blocks of about BLOCK_BYTES of text; one block is on the driver at a time."""
    n = block_count(benchmark)
    for k in range(n):
        part = benchmark.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        yield [(r[0], r[1]) for r in part.select("item_id", "text").orderBy("item_id", "text").collect()]


def _one_block(docs: DataFrame, items: Items) -> DataFrame:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(items.grams), np.int64)
        for b in batches:
            for s in blocks(b, "text"):
                w = words_of(s.column(0), plain=True)
                g, at = ngrams(w.hashes(), w.first, GRAM)
                where, gram = items.find(g)
                doc = np.searchsorted(w.first, at[where], side="right") - 1
                pair = np.unique(doc * len(total) + gram) if len(gram) else gram
                total += np.bincount(pair % max(len(total), 1), minlength=len(total))
        own = np.flatnonzero(total)
        release()
        yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(total[own])], names=["gram", "n"])

    found = docs.select("text").mapInArrow(count, "gram bigint, n bigint").groupBy("gram").agg(F.sum("n").alias("n"))
    documents = np.zeros(len(items.grams), np.int64)
    for r in found.collect():  # at most the grams of one block of items
        documents[r["gram"]] = r["n"]
    rare = rare_seeds(items, documents)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in blocks(b, "text"):
                w = words_of(s.column(2), plain=True)
                out = _aligned(items, rare, w.hashes(), w.first)
                take = pa.array([o[0] for o in out], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [s.column(0).take(take), s.column(1).take(take), pa.array([items.ids[o[1]] for o in out], pa.int64()), pa.array([o[2] for o in out], pa.float64()), pa.array([o[3] for o in out], pa.int64()), pa.array([o[4] for o in out], pa.int64())],
                    names=["doc_id", "key", "item_id", "score", "start_word", "end_word"],
                )
            release()

    rows = docs.select("doc_id", text_key(F.col("doc_id"), F.col("text")).alias("key"), "text")
    return rows.mapInArrow(search, "doc_id bigint, key binary, item_id bigint, score double, start_word bigint, end_word bigint")


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document and test item that it holds: doc_id, key (of the row), item_id,
    score (share of the perfect alignment score, LEAST_SCORE or more), start_word, end_word.

    Words are compared without case and punctuation. Whole texts; null or empty texts hold
    nothing, items of fewer than three words match nothing. Repeated rows are found each,
    repeated items too. Other columns are not read. Empty tables: empty result.
    """
    docs = docs.select("doc_id", "text")
    found = (_one_block(docs, make_items(rows)) for rows in item_blocks(benchmark))
    # Several blocks: the leaks of each are written before the next is read, so the driver holds one.
    return next(found) if block_count(benchmark) == 1 else reduce(DataFrame.unionByName, map(cut, found))


def drop_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the rows that hold a test item.

    Null and empty texts hold none and stay; repeated rows go or stay together; columns of any name
    pass through. Empty tables: nothing goes.
    """
    key = free_name(docs.columns, "leak_key")
    bad = find_leaks(docs, benchmark).select(F.col("key").alias(key)).distinct()
    return docs.join(bad, text_key(F.col("doc_id"), F.col("text")) == F.col(key), "left_anti")


def op10_decontaminate(spark, sf_dir):
    """doc_id, item_id, score and word range of every leak.

    Nulls, empty and very long texts, repeated rows, empty tables: as in find_leaks.
    """
    from .common import table

    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("key")
