"""Near-duplicate components against all pairs."""

from __future__ import annotations

import random
import re

import pytest

from sonoplan.llm import graph, jaccard


def shingles(text, size=3):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            x = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * x >= 90 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    for i, (d, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        yield d, len(sets[i]), (min(ids) if ids else None) if sets[i] else d


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice(["the", "of", "É", *[f"w{k}" for k in range(150)]])
    rows, common = [], [word() for _ in range(14)]
    for g in range(25):
        base = [word() for _ in range(rng.choice([1, 2, 3, 8, 12, 20, 40, 90, 200]))]
        if g % 3 == 0:
            base += common
        for _ in range(rng.choice([1, 2, 3, 12])):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 3])):
                w = w or [word()]
                k = rng.randrange(len(w))
                w[k : k + 1] = rng.choice([[word()], [], [w[k].upper()], [word(), word()]])
            rows.append((len(rows) * 3 % 701, " ".join(w)))
    chain = [word() for _ in range(120)]
    for k in range(12):
        chain[k * 9 : k * 9 + 2] = [word(), word()]
        rows.append((1000 - k, " ".join(chain)))
    return rows + [(2000, None), (2001, ""), (2002, " \n"), (None, rows[4][1]), (None, "only here twice"), (None, "Only here TWICE"), (rows[0][0], rows[9][1]), (3000, rows[9][1])]


@pytest.mark.parametrize(("seed", "block"), [(1, 1_000), (2, 3)])
def test_equals_all_pairs(spark, tmp_path, monkeypatch, seed, block):
    monkeypatch.setattr(jaccard, "BLOCK_SETS", block)
    rows = corpus(seed)
    spark.createDataFrame(rows, "doc_id long, text string").withColumn("root", jaccard.F.lit(1)).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, jaccard.op3_jaccard(spark, str(tmp_path)).collect()), key=str)
    assert got == sorted(brute(rows), key=str)


@pytest.mark.parametrize(("shingle", "percent"), [(5, 80), (2, 60), (3, 100)])
def test_other_lengths_and_similarities(spark, shingle, percent):
    rows = [(i, t) for i, t in corpus(3) if i is not None]
    rng = random.Random(4)
    long = [f"w{rng.randrange(10**6)}" for _ in range(3000)]  # parts of it stay empty
    rows += [(4000, " ".join(long)), (4001, " ".join(["x"] * 9 + long[:2700]))]
    words = [re.findall(r"[^\x20\x09-\x0D]+", (t or "").replace("É", "é").lower().replace("é", "É")) for _, t in rows]
    sets = [{tuple(w[k : k + shingle]) for k in range(len(w) - shingle + 1)} or ({tuple(w)} if w else set()) for w in words]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and root[i] != root[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                root = [root[j] if r == root[i] else r for r in root]
    least = {r: min((rows[i][0] for i in range(len(rows)) if root[i] == r)) for r in set(root)}
    want = sorted((d, len(sets[i]), least[root[i]] if sets[i] else d) for i, (d, _) in enumerate(rows))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = jaccard.near_duplicates(df, shingle, percent).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got)) == want
    kept = jaccard.keep_one(df, shingle, percent)
    alone = {rows[i] for i in range(len(rows)) if not sets[i]}
    assert kept.count() == len({root[i] for i in range(len(rows)) if sets[i]}) + len(alone)


def test_keep_one_breaks_ties_and_passes_columns(spark):
    rows = [(1, "a b c d", "y", "k"), (1, "a b c d", "x", "k"), (2, "A B c d", "w", "k"), (None, "a b c d", "v", "k"), (5, None, "s", "k"), (5, None, "s", "k"), (None, None, None, "k"), (None, None, None, "k"), (6, " ", "t", "k"), (None, "z z", "p", "k"), (None, "z z", None, "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, jj_key string").withColumn("JJ_ROW", jaccard.F.lit(1)).withColumn("jj_whole", jaccard.F.lit(2))
    got = jaccard.keep_one(df)
    assert got.columns == df.columns
    want = [rows[1], *rows[4:9], rows[9]]
    assert sorted((tuple(r)[:4] for r in got.collect()), key=str) == sorted(want, key=str)
    assert jaccard.keep_one(df.limit(0)).count() == 0


@pytest.mark.parametrize("ids", ["none", "one"])
def test_rows_without_ids_meet_by_their_text(spark, monkeypatch, ids):
    """Null or equal ids: no text meets another for the sake of its id; the shuffle path as well."""
    monkeypatch.setattr(jaccard, "BROADCAST_ROWS", 0)
    rng = random.Random(6)
    texts = [" ".join(rng.choice("abcdefghij") * rng.randint(1, 3) for _ in range(60)) for _ in range(150)]
    rows = [(None if ids == "none" else 7, t + x) for t in texts for x in ("", " one more")]
    got = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got.select("root").distinct().count() == len(texts) and got.count() == len(rows)
    kept = jaccard.keep_one(spark.createDataFrame(rows + rows[:5], "doc_id long, text string"))
    assert kept.count() == len(texts)


def test_a_large_group_and_the_rest(spark, monkeypatch):
    """Blocks of 20: near copies of one text, a far chain tied to it, and texts that share a passage alone."""
    monkeypatch.setattr(jaccard, "BLOCK_SETS", 20)
    rng = random.Random(9)
    base, passage = [f"w{rng.randrange(10**6)}" for _ in range(300)], [f"p{k}" for k in range(60)]
    rows = []
    for k in range(150):
        w = list(base)
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        rows.append((k, " ".join(w)))
    chain = list(base)
    for k in range(25):
        for _ in range(2):
            chain[rng.randrange(len(chain))] = f"y{rng.randrange(10**6)}"
        rows.append((200 + k, " ".join(chain)))
    rows += [(300 + k, " ".join([*passage, *(f"z{rng.randrange(10**6)}" for _ in range(rng.randint(10, 40)))])) for k in range(120)]
    got = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "n_shingles", "component_id")
    assert sorted(map(tuple, got.collect())) == sorted(brute(rows))


def test_empty(spark):
    assert jaccard.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_components_of_a_path_and_a_star(spark):
    edges = [(k, k + 1) for k in range(100, 160)] + [(500, 500 + k) for k in range(1, 40)] + [(7, 7)]
    got = dict(map(tuple, graph.components(spark.createDataFrame(edges, "u long, v long")).collect()))
    assert all(got[k] == 100 for k in range(100, 161))
    assert all(got[500 + k] == 500 for k in range(40))
