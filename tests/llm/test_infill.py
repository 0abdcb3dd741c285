"""Fill-in-middle against DuckDB and a plain version on awkward rows; round trips; marks."""

from __future__ import annotations

import hashlib
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from sonoplan.llm import infill

SCHEMA = "doc_id bigint, text string, source string, lang string"


def rows():
    rng = random.Random(3)
    bits = ["a", "β", "\n", "\n\n", "\r\n", "<", "<P", "P>", "<M", ">", "word ", "漢字", "😀", "\t", "<S"]
    out = [(i, "".join(rng.choice(bits) for _ in range(rng.randint(1, 30))), "s", "en") for i in range(200)]
    out += [(300, None, None, None), (301, "", "s", "en"), (302, "\n", "s", "en"), (303, "x" * 1_200_000, "s", "en"), (304, "line\n" * 100_000, "s", "en"), (None, "one\ntwo\nthree", "s", "en")]
    return out + [(305, "holds <M> a mark\nhere", "s", "en"), out[4], out[4], (out[5][0], "other\ntext", "s", "en"), (-7, "minus\nseven", "s", "en")]


def plain(doc_id, text):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    h = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    pre, mid, suf = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in infill.SENTINELS) or h3 % 100 >= 100:
        return len(units), "plain", None, None, text
    if h4 % 100 < 50:
        return len(units), "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return len(units), "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


def test_equals_the_plain_version(spark):
    out = infill.fill_in_middle(spark.createDataFrame(rows(), SCHEMA))
    got = [(r["doc_id"], r["text"] or "", r["fim_units"], r["fim_form"], r["fim_prefix_chars"], r["fim_middle_chars"], r["fim_output"]) for r in out.collect()]
    want = [(i, t or "", *plain(i, t)) for i, t, *_ in rows()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert {r[3] for r in got} == {"plain", "psm", "spm"}
    back = out.select(F.coalesce("text", F.lit("")).alias("a"), infill.restored(F.col("fim_output"), F.col("fim_form")).alias("b"))
    assert back.where("NOT a <=> b").isEmpty()


@pytest.mark.parametrize("empty", [False, True])
def test_query_equals_duckdb(spark, tmp_path, empty):
    df = spark.createDataFrame([] if empty else rows(), SCHEMA)
    for c in ("fim_units", "n", "form", "fim_lines"):
        df = df.withColumn(c, F.lit("clash"))
    df.coalesce(2).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    cur = con.execute(infill.OP13_SQL)
    names = [c[0] for c in cur.description]
    out = infill.op13_fill_in_middle(spark, str(tmp_path))
    assert sorted(map(str, cur.fetchall())) == sorted(str(tuple(r[c] for c in names)) for r in out.collect())
    assert sorted(names) == sorted(out.columns)
    plan = out._jdf.queryExecution().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_rates_and_clashing_columns(spark):
    df = spark.createDataFrame([(i, f"a\nb\n{i}") for i in range(400)], "doc_id long, text string").withColumn("fim_form", F.lit("mine"))
    forms = lambda **k: {r[0]: r[1] for r in infill.fill_in_middle(df, **k).groupBy("fim_form").count().collect()}
    assert forms(rate=0) == {"plain": 400} and set(forms(spm=100)) == {"spm"} and set(forms(spm=0)) == {"psm"}
    some = forms(rate=50, spm=50)
    assert 150 < some["plain"] < 250 and 60 < some["spm"] < 140
    assert infill.fill_in_middle(df).columns == ["doc_id", "text", "fim_units", "fim_form", "fim_prefix_chars", "fim_middle_chars", "fim_output"]


@pytest.mark.parametrize("marks", [("<P>", "<P>", ""), ("ab", "ba", "x"), ("aa", "b", "c"), ("<P>", "P>", "<M>")])
def test_marks_that_overlap_are_refused(spark, marks):
    df = spark.createDataFrame([(1, "t")], "doc_id long, text string")
    with pytest.raises(ValueError, match="told apart"):
        infill.fill_in_middle(df, sentinels=marks)


def test_other_marks_restore(spark):
    marks = ("[PRE]", "{suf|", "$M^")
    df = spark.createDataFrame([(i, f"x{i}\n$M\n[PRE\n{i}|\n") for i in range(50)], "doc_id long, text string")
    out = infill.fill_in_middle(df, sentinels=marks)
    assert out.where(infill.restored(F.col("fim_output"), F.col("fim_form"), marks) != F.col("text")).isEmpty()
