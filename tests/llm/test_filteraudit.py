"""The filter audit against DuckDB and against the orders played document by document."""

from __future__ import annotations

import random
from collections import Counter
from fractions import Fraction
from itertools import permutations

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from sonoplan.llm import filteraudit as fa

DOCS = "doc_id bigint, text string, lang string, source string"
LABELS = "doc_id bigint, quality int, toxic int"


def rows():
    rng = random.Random(5)
    texts = ["", "few words", "word " * 300, " ".join(f"w{i}" for i in range(250)), "LOUD " * 60 + "x" * 20, "a|b " * 10, "É$ " + "Ünï " * 400, " \n\t ", "A" * 400_000, " ".join(f"W{i}" for i in range(3000))]
    docs = [(i, rng.choice(texts) if rng.random() < 0.6 else " ".join(rng.choice(["aa", "Bb", "c&", "dd"]) for _ in range(rng.randint(0, 420))), rng.choice(["en", "de", None, ""]), "s") for i in range(150)]
    docs += [(200, None, "en", "s"), (201, None, "fr", "s"), (None, "few words", "en", None), (None, "few words", "en", None), (None, None, None, None)]
    docs += [docs[7], docs[7], (docs[8][0], docs[8][1], "xx", "s"), (docs[9][0], "other text", "en", "s"), (-5, texts[2], "en", "s"), (-5, texts[2], "de", "s")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 150, 2)] + [(4, 1, 1), (4, 0, 0), (None, 1, 1), (9999, 1, 0)]
    return docs, labels


def played(docs, labels):
    good, toxic = ({i for i, *x in labels if i is not None and x[k] == 1} for k in (0, 1))
    least = {}
    for i, t, *_ in docs:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    parts = {}
    for i, t, lang, _ in docs:
        t = t or ""
        w = [x for x in __import__("re").split(r"[\x20\x09-\x0D]+", t) if x]
        fails = set()
        if len(w) < 200:
            fails.add("A")
        if 100 * len(set(w)) < 50 * len(w):
            fails.add("B")
        if 100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t):
            fails.add("C")
        if set(t) & set("#$%&*|"):
            fails.add("D")
        if i is not None and least[t] < i:
            fails.add("E")
        parts.setdefault(lang or "", []).append((fails, i in good, i in toxic))
    out = []
    for part, held in parts.items():
        total, own = Counter(), []
        for order in map("".join, permutations("ABCDE")):
            left = held
            for step, x in enumerate(order, 1):
                gone = [d for d in left if x in d[0]]
                left = [d for d in left if x not in d[0]]
                total[x] += len(gone)
                fails = sum(x in d[0] for d in held)
                own.append((x, (part, order, step, len(left), len(gone), fails - len(gone), sum(d[0] == {x} for d in held), sum(d[1] for d in gone), sum(d[2] for d in gone))))
        out += [(*r, total[x]) for x, r in own]
    return sorted(out)


def write(spark, folder, docs, labels):
    d = spark.createDataFrame(docs, DOCS)
    for c in ("part", "mask", "key", "n", "id", "good"):
        d = d.withColumn(c, F.lit("clash"))
    d.repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, LABELS).withColumn("part", F.lit(1)).repartition(2).write.parquet(f"{folder}/labels.parquet")


@pytest.mark.parametrize("empty", [None, "docs", "labels"])
def test_equals_duckdb_and_the_orders_played(spark, tmp_path, empty):
    docs, labels = rows()
    docs, labels = ([] if empty == "docs" else docs), ([] if empty == "labels" else labels)
    write(spark, tmp_path, docs, labels)
    names = [f.split()[0] for f in fa._OUT.split(", ")]
    out = fa.op11_filter_audit(spark, str(tmp_path))
    assert out.columns == names
    got = sorted(tuple(r) for r in out.collect())
    assert got == played(docs, labels) and len(got) == 600 * len({d[2] or "" for d in docs})
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    cur = con.execute(fa.OP11_SQL)
    assert [c[0] for c in cur.description] == names and sorted(cur.fetchall()) == got


def test_polynomial_and_shapley_by_hand():
    c = np.zeros(8, np.int64)
    c[[0, 1, 3, 6, 7]] = [5, 2, 4, 1, 3]
    v = fa.corners(fa.polynomial(c))
    assert [int(x) for x in v] == [sum(int(c[m]) for m in range(8) if m & s) for s in range(8)]
    assert [fa.shapley(fa.polynomial(c), i) for i in range(3)] == [sum((Fraction(int(c[m]), m.bit_count()) for m in range(8) if m >> i & 1), Fraction(0)) for i in range(3)]


def test_other_filters_and_large_counts(spark):
    counts = spark.createDataFrame([("p", 1, 10**15, 10**14, 0), ("p", 1, 10**15, 0, 7), ("p", 3, 6, 6, 6), ("q", 0, 4, 4, 4)], "part string, mask int, n long, good long, toxic long")
    got = {(r["part"], r["filter_order"], r["step"]): r for r in fa.interactions(counts, "XY").collect()}
    assert len(got) == 8 and got["p", "XY", 1]["removed"] == 2 * 10**15 + 6 and got["p", "XY", 2]["redundant"] == 6
    assert got["p", "YX", 1]["shapley"] == 6 and got["p", "YX", 2]["shapley"] == 4 * 10**15 + 6 and got["q", "XY", 2]["kept"] == 4


def test_one_text_in_most_rows_shuffles_as_counts(spark):
    docs = spark.createDataFrame([(i, "same" if i % 3 else f"own {i}", "en") for i in range(3000)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], LABELS)
    r = fa.audit(docs, labels).where("filter_order = 'EABCD' AND step = 1").collect()
    assert len(r) == 1 and r[0]["removed"] == 1999 and r[0]["unique_fails"] == 0
