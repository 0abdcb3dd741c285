"""Leaks against a plain dynamic programme over all pairs, and planted edits."""

from __future__ import annotations

import random
import re

import numpy as np

from sonoplan.llm import decontaminate as d


def words(t):
    low = re.sub("[A-ZÀ-ÖØ-Þ]", lambda m: m[0].lower(), t or "")
    return [w for w in re.split(r"[\x00-\x1f !-/:-@\[-`{-~]+", low) if w]


def smith_waterman(a, b):
    row, top = [0] * (len(b) + 1), 0
    for x in a:
        new = [0]
        for j, y in enumerate(b, 1):
            new.append(max(0, row[j - 1] + (2 if x == y else -1), row[j] - 1, new[j - 1] - 1))
        row, top = new, max(top, *new)
    return top


def test_alignment_equals_plain_programme():
    rng = np.random.default_rng(4)
    for _ in range(60):
        a, b = rng.integers(0, 6, rng.integers(1, 25)), rng.integers(0, 6, rng.integers(1, 60))
        score, start, end = d.align(a, b)
        assert score == smith_waterman(a, b)
        if score:
            assert smith_waterman(a, b[start:end]) == score


def test_finds_edited_copies_and_nothing_else(spark, tmp_path):
    rng = random.Random(6)
    vocabulary = ["the", "of", "and", *[f"w{k}é" for k in range(400)]]
    prose = lambda n: [rng.choice(vocabulary[:3]) if rng.random() < 0.3 else rng.choice(vocabulary) for _ in range(n)]
    items = [(k, " ".join(prose(rng.randint(15, 50)))) for k in range(30)] + [(98, None), (99, "the of"), (3, None)]
    docs, want = [], set()
    for i in range(200):
        w = prose(rng.randint(0, 200))
        if i % 4 == 0:
            k = i % 30
            copy = items[k][1].split()
            if i % 8 == 0:
                copy = [rng.choice(vocabulary) if j % 6 == 5 else x for j, x in enumerate(copy)]
            if i % 12 == 0:
                del copy[len(copy) // 2]
            at = rng.randint(0, len(w))
            w[at:at] = [x.upper() if j % 7 == 0 else x + "," for j, x in enumerate(copy)]
            want.add((i, k))
        docs.append((i, " ".join(w)))
    docs += [(900, None), (901, ""), (None, items[2][1]), (7, items[5][1]), (903, "x " * 40000)]
    want |= {(None, 2), (7, 5)}
    s = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", d.F.lit("q"))
    b = spark.createDataFrame(items, "item_id long, text string")
    s.write.parquet(f"{tmp_path}/documents.parquet"), b.write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = d.op10_decontaminate(spark, str(tmp_path)).collect()
    assert {(r["doc_id"], r["item_id"]) for r in rows} == want
    texts = dict(docs[:200])
    for r in rows:
        if r["doc_id"] is not None and r["doc_id"] not in (7,):
            a, w = words(items[r["item_id"]][1]), words(texts[r["doc_id"]])
            assert abs(r["score"] - smith_waterman(a, w) / 2 / len(a)) < 1e-9
            assert smith_waterman(a, w[r["start_word"] : r["end_word"]]) == round(r["score"] * 2 * len(a))
    assert d.drop_leaks(s, b).count() == len(docs) - len(want)


def test_blocks_and_empty(spark, monkeypatch):
    s = spark.createDataFrame([(1, "a b c d e f"), (2, "k l m n o p")], "doc_id long, text string")
    b = spark.createDataFrame([(1, "a b c d e f"), (2, "k l m n o p")], "item_id long, text string")
    monkeypatch.setattr(d, "BLOCK_BYTES", 8)
    assert sorted((r["doc_id"], r["item_id"]) for r in d.find_leaks(s, b).collect()) == [(1, 1), (2, 2)]
    assert d.find_leaks(s.limit(0), b).count() == 0
    assert d.find_leaks(s, b.limit(0)).count() == 0
