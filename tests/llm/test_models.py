"""Token lengths against plain encoding; the byte network on held-out text."""

from __future__ import annotations

import os
import random
import time

import pytest
from pyspark.sql import functions as F

from sonoplan.llm import language, lengths


@pytest.mark.skipif(not os.path.exists(lengths.VOCABULARY), reason="no vocabulary")
def test_lengths_and_limits(spark, tmp_path):
    rng = random.Random(4)
    texts = [" ".join(rng.choice(["the", "of", "Größe", "42", "...", "\n"]) for _ in range(rng.randint(0, 80))) for _ in range(150)]
    texts += [None, "", "x" * 3000, " " * 500, texts[0], texts[0]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("n_tokens", F.lit("clash"))
    df.write.parquet(f"{tmp_path}/documents.parquet")
    n = sorted(len(lengths.encoder(lengths.VOCABULARY).encode_ordinary(t)) if t else 0 for t in texts)
    limits = lengths.op4_token_counts(spark, str(tmp_path)).persist()
    for r in limits.collect():
        at = r["n_tokens"]
        assert (r["n_docs"], r["docs_over"], r["tokens_over"]) == (n.count(at), sum(x > at for x in n), sum(x for x in n if x > at))
        assert r["cut_total"] == sum(min(x, at) for x in n) and r["total_tokens"] == sum(n) and r["total_docs"] == len(n)
    assert limits.count() == len(set(n))
    for limit in (0, 1, 17, 60, 10_000):
        assert lengths.cut_total(limits, limit).first()["cut_total"] == sum(min(x, limit) for x in n)
    ten = lengths.limit_table(spark.range(1, 11).select(F.col("id").alias("n_tokens"), F.lit(1).cast("bigint").alias("n_docs")))
    assert [lengths.quantile(ten, k / 10).first()["n_tokens"] for k in range(1, 11)] == list(range(1, 11))
    assert lengths.quantile(ten.limit(0), 0.5).first()["n_tokens"] is None
    for q in (0.1, 0.5, 0.99, 1.0):
        got = lengths.quantile(limits, q).first()["n_tokens"]
        assert sum(x <= got for x in n) >= q * len(n) and (got == n[0] or sum(x < got for x in n) < q * len(n))
    empty = lengths.limit_table(lengths.length_histogram(df.limit(0)))
    assert empty.count() == 0 and lengths.cut_total(empty, 5).first()["cut_total"] == 0
    per = lengths.token_lengths(df.select("doc_id", "text")).collect()
    assert sorted(r["n_tokens"] for r in per) == n


@pytest.mark.skipif(not os.path.exists(lengths.VOCABULARY), reason="no vocabulary")
def test_long_runs_count_as_the_pattern_cuts_them(monkeypatch):
    e = lengths.encoder(lengths.VOCABULARY)
    rng = random.Random(2)
    monkeypatch.setattr(lengths, "_RUN", lengths.re.compile(lengths._RUN.pattern.replace("{1000,}", "{3,}")))
    signs = [" ", "  ", "\n", "\t", "\u3000", "\xa0", "\x1c", "\x85", "a", "Bc", "é", "'s", "12", "!?", "\r\n"]
    for _ in range(3000):
        t = "".join(rng.choice(signs) * rng.choice([1, 1, 1, 4]) for _ in range(rng.randint(0, 12)))
        assert lengths.n_tokens(e, t) == len(e.encode_ordinary(t)), repr(t)


@pytest.mark.skipif(not os.path.exists(lengths.VOCABULARY), reason="no vocabulary")
def test_a_million_signs_of_a_kind(spark):
    n = 1_000_000
    texts = [" " * n + "a", " " * n, "\n" * n + "x", "a" * n, "\t " * (n // 2) + "end", "!" * n, "x" + " " * n + "y" + "\n" * n]
    start = time.time()
    got = lengths.token_lengths(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert time.time() - start < 120
    by = {r["doc_id"]: r["n_tokens"] for r in got}
    few = lambda t: len(lengths.encoder(lengths.VOCABULARY).encode_ordinary(t))
    assert len(by) == 7 and by[1] == few(" " * 1000) * 1000 and by[0] == few(" " * 999) + few(" " * 1000) * 999 + few(" a")


def speech(rng, letters, n):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 7))) for _ in range(n))


def test_language_on_held_out_text(spark, tmp_path):
    rng = random.Random(5)
    kinds = {"aa": "abcde", "ee": "eéèfg", "zh": "语言文字", "rare": "xyzq"}
    rows = []
    for i in range(400):
        lang = "rare" if i % 40 == 7 else ["aa", "ee", "zh"][i % 3]
        rows.append((i, speech(rng, kinds[lang], rng.randint(1, 200)), lang if i % 11 else None))
    rows += [(900, None, "aa"), (901, "", "ee"), (902, "123 ... !!", "aa"), (None, "abc abd", "aa"), (903, "é" * 40000, "ee"), (0, rows[0][1], "aa")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("clash")).withColumn("l", F.lit(1))
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = language.op7_language(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    truth = {i: "rare" if i % 40 == 7 else ["aa", "ee", "zh"][i % 3] for i in range(400)}
    held = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    assert len(held) > 50 and sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) >= 0.97 * len(held)
    by = {r["doc_id"]: r for r in got}
    assert all(by[i]["lang_pred"] == "und" and by[i]["score"] == 0 for i in (900, 901, 902)) and by[903]["lang_pred"] == "ee"
    assert all(0 <= r["score"] <= 1 for r in got) and by[None]["held_out"]


def test_nothing_to_learn_from(spark, tmp_path):
    df = spark.createDataFrame([(1, "abc", None), (2, None, None)], "doc_id long, text string, lang string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    assert {r["lang_pred"] for r in language.op7_language(spark, str(tmp_path)).collect()} == {"und"}
    assert language.predict(df.limit(0), None).count() == 0


def plain_forward(net, window):
    """One window through the network, filter by filter and byte by byte."""
    import numpy as np

    pooled = []
    for table in net.tables:
        for f in range(table.shape[2]):
            best = max(sum(float(table[j, window[at + j], f]) for j in range(len(table))) for at in range(len(window) - len(table) + 1))
            pooled.append(max(best + float(net.bias[len(pooled)]), 0.0))
    z = [sum(p * float(w) for p, w in zip(pooled, net.out[:, k])) + float(net.out_bias[k]) for k in range(net.out.shape[1])]
    e = np.exp(np.array(z) - max(z))
    return e / e.sum()


def test_prediction_equals_a_plain_forward_pass(spark):
    import numpy as np

    rng = random.Random(3)
    kinds = {"aa": "abcde", "ee": "eéèfg"}
    rows = [(i, speech(rng, kinds[k], rng.randint(3, 90)), k) for i in range(60) for k in kinds]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    net = language.train_on(df, F.lit(True))
    some = rows[:6] + [(900, "qXz9+/" * 30, None), (901, "é" * 300, None)]
    got = language.predict(spark.createDataFrame(some, "doc_id long, text string, lang string"), net, ("doc_id",), ("p", "s", "n")).collect()
    for (_, text, _), r in zip(some, sorted(got, key=lambda r: [x[0] for x in some].index(r["doc_id"]))):
        raw, total = text.encode(), np.zeros(3)
        for at in range(0, len(raw), language.WINDOW):
            w = raw[at : at + language.WINDOW]
            total += plain_forward(net, w.ljust(language.WINDOW, b"\0")) * len(w)
        total /= len(raw)
        langs = total[:2] / total[:2].sum()
        assert r["p"] == net.langs[int(langs.argmax())]
        assert abs(r["s"] - langs.max()) < 1e-4 and abs(r["n"] - total[2]) < 1e-4


def test_gradients_equal_finite_differences():
    import numpy as np

    rng = np.random.default_rng(2)
    f = len(language.WIDTHS) * language.FILTERS
    x, y, weight = rng.integers(97, 101, (5, 40)).astype(np.uint8), np.array([0, 1, 2, 1, 0]), np.array([1, 2, 0.5, 1, 1.0])
    net = language.ByteCnn(["a", "b"], [rng.normal(0, 0.3, (w, 256, language.FILTERS)) for w in language.WIDTHS], rng.normal(0, 0.1, f), rng.normal(0, 0.3, (f, 3)), rng.normal(0, 0.1, 3))
    loss = lambda: float((-np.log(net.probabilities(x)[np.arange(5), y]) * weight).mean())
    for p, g in zip([*net.tables, net.bias, net.out, net.out_bias], language.gradients(net, x, y, weight)):
        for at in [np.unravel_index(k, p.shape) for k in np.argsort(-np.abs(g).ravel())[:4]]:
            old = p[at]
            p[at] = old + 1e-6
            up = loss()
            p[at] = old - 1e-6
            down = loss()
            p[at] = old
            assert abs((up - down) / 2e-6 - g[at]) < 1e-5


def test_the_sample_has_a_bound_whatever_repeats(spark, monkeypatch):
    monkeypatch.setattr(language, "DOCS_PER_LANG", 20)
    rows = [("one text", "aa")] * 3000 + [(f"text {i}", "aa") for i in range(300)] + [(f"text {i}", "bb") for i in range(7)] + [(None, "aa"), ("x", None)]
    sample = language.training_sample(spark.createDataFrame(rows, "text string, lang string"), F.lit(True))
    n = [lang for lang, _ in sample].count("aa")
    assert 12 <= n <= 20 and len(sample) == n + 7 and len({(a, tuple(b)) for a, b in sample}) == len(sample)
    monkeypatch.setattr(language, "SAMPLE_DOCS", 2)
    assert len(language.training_sample(spark.createDataFrame(rows, "text string, lang string"), F.lit(True))) == 2
