"""The n-gram model against a dictionary version."""

from __future__ import annotations

import math
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from sonoplan.llm import ngramlm


def tokens(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), None]


def brute(train, texts, order):
    top, c = Counter(), Counter()
    for t in train:
        ws = tokens(t)
        c.update(ws)
        padded = ["<s>"] * (order - 1) + ws
        top.update(tuple(padded[i : i + order]) for i in range(len(ws)))
    levels = {order: top}
    for n in range(order, 1, -1):
        levels[n - 1] = Counter(g[1:] for g in levels[n])
    spread = lambda v: ngramlm.discounts(*[sum(x == k for x in v) for k in (1, 2, 3, 4)])
    d = {n: spread(g.values()) for n, g in levels.items()}
    total, kinds = Counter(), defaultdict(lambda: [0, 0, 0])
    for grams in levels.values():
        for g, n in grams.items():
            total[g[:-1]] += n
            kinds[g[:-1]][min(n, 3) - 1] += 1
    cut = lambda n, ds: n - ds[min(n, 3) - 1] if n else 0

    def p(g):
        rest = p(g[1:]) if len(g) > 1 else 1 / (len(c) + 1)
        ctx, ds = g[:-1], d[len(g)]
        if not total[ctx]:
            return rest
        return cut(levels[len(g)][g], ds) / total[ctx] + sum(x * y for x, y in zip(ds, kinds[ctx])) / total[ctx] * rest

    for t in texts:
        ws = tokens(t)
        padded = ["<s>"] * (order - 1) + ws
        s = sum(math.log10(p(tuple(padded[i : i + order]))) for i in range(len(ws)))
        b = sum(math.log10((c[w] + 1) / (sum(c.values()) + len(c) + 1)) for w in ws)
        yield len(ws), sum(c[w] > 0 for w in ws), sum(c.values()), b, s


def held_out(i):
    return zlib.crc32(str(i if i is not None else "").encode()) % 7 == 2


def equal(got, want):
    got, want = sorted(map(tuple, got), key=str), sorted(want, key=str)
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert a[:-2] == b[:-2]
        assert all(math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-9) for x, y in zip(a[-2:], b[-2:])), (a, b)


def check(spark, tmp_path, rows):
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    train = [t for i, t, _ in rows if not held_out(i)]
    found = brute(train, [t for _, t, _ in rows], ngramlm.ORDER)
    equal(ngramlm.op5_lm_score(spark, str(tmp_path)).collect(), [(i, held_out(i), *x) for (i, _, _), x in zip(rows, found)])


def texts_of(n):
    rng = random.Random(3)
    vocabulary = [f"W{k}é" if k % 3 else f"w{k}" for k in range(40)]
    return [" ".join(rng.choice(vocabulary[: rng.randint(2, 40)]) for _ in range(rng.randint(0, 60))) for _ in range(n)]


def test_scores_equal_brute_force(spark, tmp_path):
    rows = [(i, t, "s") for i, t in enumerate(texts_of(120))]
    rows += [(200, None, None), (201, "", "s"), (202, " \n", "s"), (5, rows[5][1], "s"), (None, "w0 W1é", "s"), (204, "word " * 3000 + "x" * 5000, "s")]
    check(spark, tmp_path, rows)


def test_empty_and_untrained(spark, tmp_path):
    check(spark, tmp_path / "a", [])
    check(spark, tmp_path / "b", [(next(i for i in range(99) if zlib.crc32(str(i).encode()) % 7 == 2), "a b", "s")])


@pytest.mark.parametrize("order", [2, 3, 4])
def test_every_order_equals_brute_force(spark, order):
    texts = [*texts_of(60), None, "", "w0 w1 w0 w1 w0"]
    model = ngramlm.fit(spark.createDataFrame([(t,) for t in texts[:40]], "text string"), order)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = [(i, n, known, b, s) for i, (n, known, _, b, s) in enumerate(brute(texts[:40], texts, order))]
    equal(ngramlm.score(docs, model).collect(), want)
    model.delete()


def test_no_order_below_two(spark):
    with pytest.raises(ValueError):
        ngramlm.fit(spark.createDataFrame([("a",)], "text string"), 1)


def test_counts_of_any_size():
    v = np.array([0, 1, 254, 255, 256, 5_000_000_000, 3], np.int64)
    small, big, full = ngramlm._narrow(v)
    assert small.dtype == np.uint8 and (ngramlm._widen(small, big, full) == v).all()
    assert (ngramlm._widen(*ngramlm._unpack(ngramlm._pack(*ngramlm._narrow(v)), "u1", "u4", "i8")) == v).all()


def test_keys_that_share_their_first_bits(tmp_path):
    """Counts by 48-bit keys: neighbours that differ in the last 16 bits alone, large ones, unknown ones."""
    x = np.array([5 << 16, (5 << 16) + 1, (5 << 16) + 9, 7 << 16, (1 << 48) - 1], np.uint64)
    a, b = np.array([1, 255, 3, 70_000, 2]), np.array([1, 1, 254, 5_000_000_000, 9])
    ngramlm._store_counts(f"file://{tmp_path}", "t", x, a, b)
    q = np.append(x, [0, (5 << 16) + 2, (7 << 16) + 1, (1 << 48) - 2]).astype(np.uint64)
    got = ngramlm._read_counts(f"file://{tmp_path}", "t", 2, q)
    assert got.tolist() == [[*a, 0, 0, 0, 0], [*b, 0, 0, 0, 0]]


def test_payloads_hold_the_grams():
    """Few and many distinct words (indices of one to three bytes) come back with their counts."""
    for kinds in (3, 300, 70_000):
        words = np.random.default_rng(kinds).integers(1, 2**63, kinds).astype(np.uint64)
        x = np.resize(words, (3, 2 * kinds + 7)).copy()
        x[1] = np.roll(x[0], 1)
        x[0, ::5] = ngramlm.START
        found = [ngramlm._read_grams([ngramlm.pa.scalar(raw, ngramlm.pa.binary())], 3, True) for _, raw in ngramlm._gram_rows(x, 3, True, 2)]
        got = Counter({tuple(g): int(n) for grams, counts in found for g, n in zip(grams.T.tolist(), counts)})
        assert got == Counter(map(tuple, x.T.tolist()))


def test_a_pair_more_frequent_than_a_byte_holds(spark):
    """One pair 700 times: its score equals the formula on the whole counts."""
    model = ngramlm.fit(spark.createDataFrame([("a b " * 700,), ("a c",)], "text string"), 2)
    x = np.stack([ngramlm.words_of(ngramlm.pa.array([t]), lower=True).hashes() for t in ("a", "b")])
    logp, seen = ngramlm.log_probabilities(model, x)
    low, d = model.discounts
    total = 701  # a: 700 times before b, once before c
    left = (d[0] * 1 + d[2] * 1) / total
    cont = 1 - low[0]  # only a comes before b
    p = (700 - d[2]) / total + left * (cont / model.pairs + model.low_left / (model.vocabulary + 1))
    assert seen[0] == 700 and abs(10 ** logp[0] - p) < 1e-12
    model.delete()


def test_a_lost_file_raises(spark, tmp_path):
    rng = random.Random(8)
    texts = [" ".join(f"w{rng.randint(0, 60)}" for _ in range(30)) for _ in range(60)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    model = ngramlm.fit(df.select("text"), 3)
    folder = model.root.removeprefix("file://")
    kinds = {n.rsplit("-", 1)[0] for n in os.listdir(folder) if n.rsplit("-", 1)[1].isdigit()}
    assert kinds == set(model.stored) and all(model.holds(n.rsplit("-", 1)[0], int(n.rsplit("-", 1)[1])) for n in os.listdir(folder) if n.rsplit("-", 1)[1].isdigit())
    before = ngramlm.score(df, model).agg({"score": "sum"}).first()[0]
    assert before < 0 and not model.holds("tokens", 10**6) and not model.holds("none", 0)
    lost = sorted(n for n in os.listdir(folder) if n.startswith("grams-3-") and n.endswith("-one") and os.path.getsize(f"{folder}/{n}") > 8)[0]
    os.remove(f"{folder}/{lost}")
    ngramlm._load.cache_clear()
    with pytest.raises(Exception, match="(?i)no such file|FileNotFound"):
        ngramlm.score(df.repartition(7), ngramlm.KneserNey(**{**model.__dict__, "root": model.root + "/."})).agg({"score": "sum"}).first()
    model.delete()


def shuffle_files(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {f for i in range(files.size()) if (f := files.apply(i).getName()).startswith("shuffle_")}


@pytest.mark.parametrize("order,rounds", [(3, 1), (3, 3), (4, 2)])
def test_rounds_and_frequent_words_equal_brute_force(spark, tmp_path, order, rounds):
    """Words with a large share of all tokens, in the middle of most triples, are spread over buckets of several rounds."""
    rng = random.Random(5)
    texts = [" ".join(rng.choice(["the", "the", "of", f"w{rng.randint(0, 300)}"]) for _ in range(rng.randint(0, 80))) for _ in range(150)]
    texts += ["the " * 400, "of the", ""]
    spark.createDataFrame([(t,) for t in texts[:120]], "text string").write.parquet(f"{tmp_path}/texts.parquet")
    before = shuffle_files(spark)
    model = ngramlm.fit(spark.read.parquet(f"{tmp_path}/texts.parquet"), order, rounds=rounds)
    assert not shuffle_files(spark) - before  # an exchange's files go with its job
    the = ngramlm.words_of(ngramlm.pa.array(["the"])).hashes()
    assert model.spread.splits(the)[0] > 4 and 1 < len(model.spread.frequent) <= 2 * model.parts
    folder = model.root.removeprefix("file://")
    names = os.listdir(folder)
    assert "passed" not in names and any(n.startswith("spread-3-") and os.path.getsize(f"{folder}/{n}") > 8 for n in names)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = [(i, n, known, b, s) for i, (n, known, _, b, s) in enumerate(brute(texts[:120], texts, order))]
    equal(ngramlm.score(docs, model).collect(), want)
    model.delete()


def test_a_round_exchanges_its_share_alone():
    """The rounds' payloads hold every triple once, and none has much more than its part of the bytes."""
    rng = np.random.default_rng(1)
    words = np.append(rng.integers(1, 2**63, 5000).astype(np.uint64), ngramlm.START)
    ids = rng.integers(0, 5001, (3, 60_000)).astype(np.int32)
    ids[1, ::3] = 7
    by = ngramlm.Spread(32, words[7:8], np.array([20]))
    whole = list(ngramlm._mid_rows(words, ids, True, by, range(32)))
    rounds = [list(ngramlm._mid_rows(words, ids, True, by, range(a, a + 8))) for a in range(0, 32, 8)]
    size = lambda rows: sum(len(x) for _, x in rows)
    assert all(a <= b < a + 8 for a, rows in zip(range(0, 32, 8), rounds) for b, _ in rows)
    assert sorted(sum(rounds, [])) == sorted(whole) and max(map(size, rounds)) < 0.4 * size(whole)
    found = [ngramlm._read_grams([ngramlm.pa.scalar(raw, ngramlm.pa.binary())], 3, True) for _, raw in whole]
    got = Counter({tuple(g): int(n) for grams, counts in found for g, n in zip(grams.T.tolist(), counts)})
    assert got == Counter(map(tuple, words[ids].T.tolist()))
    assert max(size([r]) for r in whole) < 0.1 * size(whole)  # a third of all have one middle word


def test_too_many_words_for_one_integer():
    """Grams whose words' numbers don't fit 64 bits are counted in halves; sums are the same."""
    rng = np.random.default_rng(2)
    words = rng.integers(1, 2**63, 70_000).astype(np.uint64)
    ids = rng.integers(0, 70_000, (4, 90_000)).astype(np.int32)
    ids[:, 45_000:] = ids[:, :45_000]
    by = ngramlm.Spread(24, np.zeros(0, np.uint64), np.zeros(0, np.int64))
    rows = {}
    for b, raw in ngramlm._mid_rows(words, ids, True, by, range(24)):
        rows.setdefault(b, []).append(ngramlm.pa.scalar(raw, ngramlm.pa.binary()))
    found = [ngramlm._read_grams(raws, 4, True) for raws in rows.values()]
    got = Counter({tuple(g): int(n) for grams, counts in found for g, n in zip(grams.T.tolist(), counts)})
    assert got == Counter(map(tuple, words[ids].T.tolist()))


def test_many_payloads_of_a_bucket_are_summed_as_they_come(monkeypatch):
    """Merging after every few columns gives the grams and counts of one merge."""
    rng = np.random.default_rng(4)
    words = rng.integers(1, 2**63, 30).astype(np.uint64)
    parts = [words[rng.integers(0, 30, (3, 400))] for _ in range(9)]
    raws = [ngramlm.pa.scalar(raw, ngramlm.pa.binary()) for x in parts for _, raw in ngramlm._gram_rows(x, 3, True, 2)]
    monkeypatch.setattr(ngramlm, "MERGE", 100)
    x, counts = ngramlm._read_grams(raws, 3, True)
    got = dict(zip(map(tuple, x.T.tolist()), counts.tolist()))
    assert len(got) == x.shape[1] and got == Counter(map(tuple, np.concatenate(parts, axis=1).T.tolist()))
