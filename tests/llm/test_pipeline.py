"""The stages of the corpus pipeline, each against a plain version on what the one before kept."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import defaultdict

import corpus_pipeline as pipeline
import pytest
from pyspark.sql import functions as F

from .test_decontaminate import smith_waterman
from .test_decontaminate import words as plain_words
from .test_jaccard import shingles

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def corpus():
    rng = random.Random(21)
    vocabulary = ["the", "of", *["".join(rng.choice("abcdeéfgh") for _ in range(5)) for _ in range(500)]]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(k, prose(30)) for k in range(6)]
    rows = []
    for i in range(160):
        lines = [prose(rng.randint(4, 40)) for _ in range(rng.randint(1, 4))]
        if i % 5 == 0:
            lines.append(f"All rights reserved {1900 + i} by the authors of this very page")
        if i % 9 == 0:
            lines.insert(1, items[i % 6][1])
        rows.append([i, "\n".join(lines)])
    for i in range(160, 190):
        w = rows[i - 150][1].split(" ")
        if i % 2:
            w[len(w) // 2] = "changed"
        rows.append([i, " ".join(w)])
    rows += [[300, None], [301, ""], [302, "12 34 !!"], [303, "All rights reserved 2024 by the authors of this very page"], [None, prose(50)]]
    return [(i, t, "en" if k % 2 else "fr", f"s{k % 4}", len(t) if t else None) for k, (i, t) in enumerate(rows)], items


def templates(line):
    raw = re.sub(r"[ \t\x0b\f\r]+", " ", line).strip(" ").split(" ")
    if raw == [""]:
        return []
    t = ["<*>" if re.search("[0-9]", x) else x for x in raw]
    n, constant, same = len(t), sum(x != "<*>" for x in t), [("same", *raw)]
    if n < 3 or constant * 2 < n:
        return same
    if n < 9 or constant * 3 < 2 * n:
        return [*same, (n, tuple(t))]
    at = lambda k: 2 + (n - 2) * k // 3
    return [*same, *((n, k, tuple(t[: at(k)]), tuple(t[at(k + 1) :])) for k in range(3))]


def lines_stage(rows):
    inf = float("inf")
    seen = defaultdict(list)
    for r in rows:
        for g in {g for line in r[1].split("\n") for g in templates(line)}:
            seen[g].append(inf if r[0] is None else r[0])
    out = []
    for r in rows:
        own = inf if r[0] is None else r[0]
        kept = [x for x in r[1].split("\n") if not any(len(seen[g]) >= (2 if g[0] == "same" else 3) and min(seen[g]) != own for g in templates(x))]
        text = "\n".join(kept)
        if len(kept) == len(r[1].split("\n")) or text.strip():
            out.append((r[0], text, r[2], r[3], len(text)))
    return out


def near_stage(rows):
    sets, root = [shingles(r[1], 5) for r in rows], list(range(len(rows)))

    def find(i):
        return i if root[i] == i else find(root[i])

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    groups = defaultdict(list)
    for i, r in enumerate(rows):
        groups[find(i) if sets[i] else -1 - i].append(r)
    return [min(g, key=lambda r: (r[0] is None, r[0] or 0)) for g in groups.values()]


def leak_stage(rows, items):
    bad = lambda t: any(smith_waterman(plain_words(x), plain_words(t)) >= len(plain_words(x)) for _, x in items)
    return [r for r in rows if not bad(r[1])]


def mix_stage(rows):
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t))
    total = defaultdict(int)
    for r in rows:
        total[r[3]] += size(r[1])
    weight = {s: k % 3 + 1 for k, s in enumerate(sorted(total))}
    target, free, left = {}, set(total), float(sum(total.values()))
    while free:  # reshare what the capped ones leave
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] >= 3 * total[s]}
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 3.0 * total[s]
            left -= target[s]
        free -= over
    out = []
    seen = {}
    for r in rows:
        rate = target[r[3]] / total[r[3]]
        md5 = lambda x: hashlib.md5(x.encode()).hexdigest()
        key = md5(md5(f"{'' if r[0] is None else r[0]}{'-' if r[1] is None else '+'}{r[1] or ''}") + ("-" if r[3] is None else "+" + r[3]))
        seen[key] = seen.get(key, 0) + 1  # equal rows have numbers
        u = int(md5(f"mix17:{key}:{seen[key]}")[:13], 16) / (1 << 52)
        out += [(*r, k + 1) for k in range(min(3, int(rate) + (u < rate - int(rate))))]
    return out


def test_stages_equal_plain_versions(spark, tmp_path):
    rows, items = corpus()
    d = str(tmp_path)
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{d}/benchmark.parquet")
    assert [name.split("_")[-1] for name, _ in pipeline.STAGES] == ["7", "8", "3", "10", "2"]
    want = [r for r in rows if r[1] and any(c.isalpha() for c in r[1])]
    docs = spark.read.parquet(f"{d}/documents.parquet")
    steps = [lambda r: r, lines_stage, near_stage, lambda r: leak_stage(r, items), mix_stage]
    for (name, stage), plain in zip(pipeline.STAGES, steps):
        want = plain(want)
        out = stage(spark, docs, d)
        assert out.columns == COLUMNS + ["mix_copy"] * (name == "mix_2")
        out.write.parquet(f"{d}/{name}")
        docs = spark.read.parquet(f"{d}/{name}")
        assert sorted(map(tuple, docs.collect()), key=str) == sorted(want, key=str), name
    assert len(want) > 50
    assert sorted(map(tuple, pipeline.run(spark, d).collect()), key=str) == sorted(want, key=str)


def test_empty_tables(spark, tmp_path):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() == 0


def test_the_network_rejects_what_it_cannot_read(spark):
    rng = random.Random(8)
    syllables = {"en": ["the", "ing", "and", "er", "on"], "de": ["sch", "ein", "ung", "der", "ich"]}
    speak = lambda lang, n: " ".join("".join(rng.choice(syllables[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n))
    rows = [(i, speak(("en", "de")[i % 2], rng.randint(5, 120)), ("en", "de")[i % 2]) for i in range(300)]
    noise = [(900 + k, "".join(rng.choice("QXZKVJWqxzkvjw0123456789+/=") for _ in range(400)), "en") for k in range(5)]
    # Letters alone don't save a text, nor does its label; those of noise are held out of training.
    noise = [(next(i for i in range(d * 100, d * 100 + 100) if zlib.crc32(str(i).encode()) % 5 == 0), t, lang) for d, t, lang in noise]
    docs = spark.createDataFrame(rows + noise, "doc_id bigint, text string, lang string")
    got = pipeline.language(spark, docs, "").collect()
    assert sorted(map(tuple, got)) == rows


@pytest.mark.parametrize("labelled", [None, 0], ids=["none", "held out only"])
def test_unlabelled_texts_stay(spark, labelled):
    rows = [r for r in corpus()[0] if r[0] is not None]
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    rows = [(i, t, lang if labelled == 0 and held(i) else None, s, n) for i, t, lang, s, n in rows]
    assert labelled is None or any(r[2] for r in rows)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = pipeline.language(spark, docs, "")
    assert got.columns == COLUMNS
    want = [r for r in rows if r[1] and any(c.isalpha() for c in r[1])]
    assert len(want) > 180 and sorted(map(tuple, got.collect())) == sorted(want)


def test_columns_that_clash(spark, tmp_path):
    df = spark.createDataFrame([(i, f"some words that are quite different {'x' * i} and {i * 7} more", "en", "s", 1) for i in range(1, 9)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for c in ("score", "lang_pred", "key", "root", "class", "n", "l", "rate", "leak_key", "jj_key", "JJ_row", "jj_whole", "stage_lang", "stage_score", "stage_noise", "stage_noise_", "copies", "doc"):
        df = df.withColumn(c, F.lit("clash"))
    spark.createDataFrame([(1, "not in any document at all")], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for _, stage in pipeline.STAGES:
        out = stage(spark, df, str(tmp_path))
        assert out.columns[: len(df.columns)] == df.columns and out.count() >= 1
