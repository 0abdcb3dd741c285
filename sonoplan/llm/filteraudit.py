"""What document filters take from one another, by the multilinear extension of their union.

Every document fails a set of filters, its mask. Per part of the corpus the counts by mask c
give the removal polynomial f(x) = sum over masks m of c[m] (1 - prod over i in m of (1 - x_i)):
at a corner of the cube it is the number of documents that a set of filters removes, in any
order. A filter's Shapley value is the integral of its partial derivative along the diagonal,
and with coefficients a[S] that is the sum of a[S] / |S| over the sets S with the filter: exact
rationals, which the number of orders makes whole.

Documents are reduced to counts by Spark; polynomials have 2^filters coefficients per part.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from functools import lru_cache
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, table

_OUT = "part string, filter_order string, step int, kept bigint, removed bigint, redundant bigint, unique_fails bigint, good_lost bigint, toxic_lost bigint, shapley bigint"


def polynomial(counts: np.ndarray) -> np.ndarray:
    """Coefficients a[S] of the removal polynomial, S as a bit set, from counts by mask."""
    up = np.array(counts, np.int64)
    sets = np.arange(len(up))
    for bit in 1 << np.arange(len(up).bit_length() - 1):  # counts of the masks that hold S
        up[sets & bit == 0] += up[sets & bit != 0]
    a = np.where(np.bitwise_count(sets) % 2 == 1, up, -up)
    a[0] = 0
    return a


def corners(a: np.ndarray) -> np.ndarray:
    """The polynomial's values at all corners, by the bit set of the coordinates that are 1."""
    v = a.copy()
    sets = np.arange(len(v))
    for bit in 1 << np.arange(len(v).bit_length() - 1):
        v[sets & bit != 0] += v[sets & bit == 0]
    return v


def shapley(a: np.ndarray, i: int) -> Fraction:
    """The integral of the derivative by x_i from (0, ..., 0) to (1, ..., 1)."""
    return sum((Fraction(int(a[s]), s.bit_count()) for s in range(len(a)) if s >> i & 1), Fraction(0))


@lru_cache(maxsize=8)
def _steps(letters: str) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Of every step of every order: the order, the step, its filter, the set of filters before."""
    rows = [("".join(letters[i] for i in o), k, o[k], sum(1 << i for i in o[:k])) for o in permutations(range(len(letters))) for k in range(len(letters))]
    names, *rest = zip(*rows)
    return list(names), *(np.array(x, np.int64) for x in rest)


def interactions(counts: DataFrame, letters: str) -> DataFrame:
    """For every part, order of the filters and step, what the step's filter does to the documents.

    ``counts``: part, mask (bit i: fails the filter of letter i), n, good, toxic; masks of a part may
    repeat and add up. A part has at most 2^filters of them here, whatever the corpus.
    """
    per = counts.groupBy("part", "mask").agg(*[F.sum(c).cast("bigint").alias(c) for c in ("n", "good", "toxic")])
    per = per.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("c"))
    size = 1 << len(letters)
    names = [f.split()[0] for f in _OUT.split(", ")]

    def play(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        orders, step, own, before = _steps(letters)
        after = before | 1 << own
        for b in batches:
            for part, masks in zip(b.column(0), b.column(1)):
                c = np.zeros((3, size), np.int64)
                for m in masks.as_py():
                    c[:, m["mask"]] += (m["n"], m["good"], m["toxic"])
                a = polynomial(c[0])
                lost = [corners(a), *(corners(polynomial(x)) for x in c[1:])]  # what each set of filters removes
                gone, good, toxic = (v[after] - v[before] for v in lost)
                alone = lost[0][1 << own]
                value = [shapley(a, i) * factorial(len(letters)) for i in range(len(letters))]
                assert all(x.denominator == 1 for x in value)
                whole = np.array([int(x) for x in value], np.int64)[own]
                unique = lost[0][-1] - lost[0][size - 1 & ~(1 << own)]
                columns = [c[0].sum() - lost[0][after], gone, alone - gone, unique, good, toxic, whole]
                yield pa.RecordBatch.from_arrays([pa.array([part.as_py()] * len(orders)), pa.array(orders), pa.array((step + 1).astype(np.int32)), *(pa.array(x.astype(np.int64)) for x in columns)], names=names)

    return per.mapInArrow(play, _OUT)


def failure_counts(docs: DataFrame, labels: DataFrame, fails: list[Column], part: Column) -> DataFrame:
    """part, mask, n, good, toxic: documents by the filters they fail, in the order of ``fails`` and, as
    one more filter after these, by being a copy of the text of a smaller id.

    ``fails`` read ``text``, in which null has become empty, and must depend on it alone. Equal texts
    (by 128 bits of a hash) meet as counts only. A null id is smaller than none and has no smaller id.
    Labels of an id that repeats count if any says so; labels of null ids count for none.
    """
    mask = sum((F.when(x, 1 << i).otherwise(0) for i, x in enumerate(fails)), F.lit(0))
    rows = docs.select(F.col("doc_id").alias("id"), part.alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.select("id", "part", mask.cast("int").alias("mask"), F.substring(F.unhex(F.sha2("text", 256)), 1, 16).alias("key"))
    # Rows that repeat in all of this become one before anything is joined.
    rows = rows.groupBy("id", "part", "mask", "key").agg(F.count(F.lit(1)).alias("n"))
    said = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    rows = rows.where("id IS NOT NULL").join(said, "id", "left").unionByName(rows.where("id IS NULL"), allowMissingColumns=True)
    rows = rows.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("good", "toxic")})
    named = F.col("id").isNotNull()
    per = rows.groupBy("key", "part", "mask", "good", "toxic").agg(
        F.sum("n").alias("n"), F.sum(F.when(named, F.col("n")).otherwise(0)).alias("named"), F.min(F.when(named, F.struct("id", "n"))).alias("first")
    )
    # A text has few rows left: parts and labels that its copies have.
    least = F.min("first.id").over(W.partitionBy("key"))
    copies = F.col("named") - F.when(F.col("first.id") == F.col("least"), F.col("first.n")).otherwise(0)
    per = per.withColumn("least", least).withColumn("copies", copies)
    both = F.array(F.struct("mask", (F.col("n") - F.col("copies")).alias("n")), F.struct(F.col("mask").bitwiseOR(F.lit(1 << len(fails))).alias("mask"), F.col("copies").alias("n")))
    out = per.select("part", "good", "toxic", F.explode(both).alias("x")).select("part", "good", "toxic", "x.mask", "x.n")
    return out.groupBy("part", "mask").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic"))


def text_filters(least_words: int = 200, distinct_percent: int = 50, capital_percent: int = 3, marks: str = "[#$%&*|]") -> list[Column]:
    """Failure conditions of a text: too few words, too many that repeat, too many capitals, odd signs."""
    text = F.col("text")
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    return [F.size(words) < least_words, F.size(F.array_distinct(words)) * 100 < F.size(words) * distinct_percent, capitals * 100 > F.length(text) * capital_percent, text.rlike(marks)]


def audit(docs: DataFrame, labels: DataFrame, part: Column | None = None, letters: str = "ABCDE", **limits) -> DataFrame:
    """``interactions`` of the four text filters and of copies, per part (by default lang, null: empty).

    A null text is empty: it has no words (A), nothing that repeats, and equals other empty texts.
    Repeated rows count each, very long texts are read whole, other columns are not read. Each part
    that occurs has all rows, zeros included; an empty table has none.
    """
    own = F.coalesce("lang", F.lit("")) if part is None else part
    return interactions(failure_counts(docs, labels, text_filters(**limits), own), letters)


def op11_filter_audit(spark, sf_dir):
    """One row per language, order of the five filters and step, over all documents and labels.

    Nulls, empty and very long texts, ties, repeated rows, clashing columns, empty tables: as in audit
    and failure_counts.
    """
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


OP11_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS least FROM documents),
l AS (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
m AS (SELECT part, (len(w) < 200)::INT + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::INT + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t))::INT
  + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * coalesce(d.doc_id > least, false)::INT AS mask, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic FROM d LEFT JOIN l ON d.doc_id = l.doc_id),
c AS (SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM m GROUP BY part, mask),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS letter, unnest([1, 2, 4, 8, 16]) AS bit),
o AS (SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits FROM f a, f b, f c, f d, f e WHERE a.bit | b.bit | c.bit | d.bit | e.bit = 31),
s AS (SELECT filter_order, step, bits[step] AS bit, coalesce(list_sum(bits[1:step - 1]), 0)::INT AS before FROM o, range(1, 6) r(step)),
x AS (SELECT part, filter_order, step, bit, coalesce(sum(n) FILTER (mask & (before | bit) = 0), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (mask & before = 0 AND mask & bit <> 0), 0)::BIGINT AS removed,
  coalesce(sum(n) FILTER (mask & before <> 0 AND mask & bit <> 0), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (mask = bit), 0)::BIGINT AS unique_fails,
  coalesce(sum(good) FILTER (mask & before = 0 AND mask & bit <> 0), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (mask & before = 0 AND mask & bit <> 0), 0)::BIGINT AS toxic_lost
  FROM c, s GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, step::INT AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM x
"""
