"""Substring dedup against a dictionary of windows; the index against plain search."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np

from sonoplan.llm import substrings
from sonoplan.llm.fmindex import FmIndex

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows):
    words = [WORD.findall(t or "") for _, t in rows]
    first = {}
    order = lambda i: float("inf") if i is None else i
    for (i, _), w in zip(rows, words):
        for k in range(len(w) - 12):
            g = tuple(w[k : k + 13])
            first[g] = min(first.get(g, float("inf")), order(i))
    for (i, _), w in zip(rows, words):
        gone = {k + j for k in range(len(w) - 12) if first[tuple(w[k : k + 13])] < order(i) for j in range(13)}
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        yield i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()


def run(spark, path, rows):
    spark.createDataFrame(rows, "doc_id long, text string").withColumn("chunk", substrings.F.lit("x")).write.parquet(f"{path}/documents.parquet")
    got = sorted(map(tuple, substrings.op1_substrings(spark, str(path)).collect()), key=str)
    assert got == sorted(brute(rows), key=str)


def test_equals_brute_force(spark, tmp_path):
    rng = random.Random(1)
    word = lambda: rng.choice(["a", "b", "of", "é", *[f"w{k}" for k in range(200)]])
    passages = [[word() for _ in range(rng.randint(10, 60))] for _ in range(12)]
    rows = []
    for i in range(150):
        w = []
        for _ in range(rng.randint(0, 6)):
            w += rng.choice(passages) if rng.random() < 0.5 else [word() for _ in range(rng.randint(0, 40))]
            if w and rng.random() < 0.3:
                w[rng.randrange(len(w))] = word()
        rows.append((i * 3, rng.choice([" ", "\n", "  "]).join(w)))
    rows += [(7, rows[3][1]), (0, rows[9][1]), (9, rows[3][1]), (None, rows[3][1]), (None, rows[3][1]), (1, None), (2, ""), (4, " \t")]
    rows += [(1000, "x " * 30000), (1001, "x " * 40), (1002, "y" * 50000), (-5, " ".join(passages[0]))]
    run(spark, tmp_path, rows)


def test_empty(spark, tmp_path):
    run(spark, tmp_path, [])


def test_index_matches_plain_search():
    rng = np.random.default_rng(2)
    text = np.append(rng.integers(0, 5, 400), 0)
    index = FmIndex(text, 6)
    query = rng.integers(0, 6, 120)
    query[query == 0] = 5  # 5 never occurs
    query[query == 5] = 0
    seen = {}
    for _, at, size, lo, hi in index.matching(query, np.array([0]), np.array([len(query)]), 13):
        seen[int(at[0])] = int(size[0]), sorted(index.order[int(lo[0]) : int(hi[0])])
    for i in range(len(query)):
        best, places = 0, list(range(len(text)))
        while best < 13 and i + best < len(query) and query[i + best]:
            now = [p for p in places if p + best < len(text) and text[p + best] == query[i + best]]
            if not now:
                break
            best, places = best + 1, now
        assert seen[i][0] == best
        if best:
            assert seen[i][1] == sorted(places)
