"""Token counts: an exact histogram of encoded lengths and what follows from it.

Documents are encoded whole with a public vocabulary (a file; its path is a parameter).
Every task reduces its documents to (length, number of documents); Spark sums these. Sums
from the long end give totals, quantiles and truncated totals for every context limit
without reading a document again.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from decimal import Decimal
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pre-tokenisation pattern that belongs to the byte-level vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str = PATTERN):
    """The encoder of a rank file (base64 token, rank), once per worker."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


#: Fixed value: white space as the pattern knows it. Runs of so many would exhaust its backtracking.
LONG_RUN = 1000
_RUN = re.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{%d,}" % LONG_RUN)


def n_tokens(encoding, text: str) -> int:
    """Number of tokens of a text. Long runs of white space are cut out as the pattern would cut them:
    whole at the end of the text, else but for their last sign, with which the next piece begins."""
    n = at = 0
    for m in _RUN.finditer(text):
        end = m.end() - (m.end() < len(text))
        n += len(encoding.encode_ordinary(text[at : m.start()])) + len(encoding._encode_single_piece(text[m.start() : end]))
        at = end
    return n + len(encoding.encode_ordinary(text[at:]))


def token_lengths(docs: DataFrame, vocabulary: str = VOCABULARY, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and n_tokens of every document; a null text has 0 tokens."""

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = encoder(vocabulary)
        for b in batches:
            n = pa.array([n_tokens(encoding, t.as_py()) if t.is_valid else 0 for t in b.column(len(keep))], pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], n], names=[*keep, "n_tokens"])

    kinds = dict(docs.dtypes)
    return docs.select(*keep, "text").mapInArrow(lengths, ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "n_tokens bigint"]))


def length_histogram(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(n_tokens, n_docs), exact over all documents; pre-aggregated batch by batch.

    A null or empty text has 0 tokens, a very long one is encoded whole (also one of blanks alone),
    repeated rows count each.
    Other columns are not read. Empty table: empty result.
    """

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = encoder(vocabulary)
        for b in batches:
            size, n = np.unique([n_tokens(encoding, t.as_py()) if t.is_valid else 0 for t in b.column(0)], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(size, pa.int64()), pa.array(n, pa.int64())], names=["n_tokens", "n_docs"])

    part = docs.select("text").mapInArrow(counts, "n_tokens bigint, n_docs bigint")
    return part.groupBy("n_tokens").agg(F.sum("n_docs").alias("n_docs"))


def limit_table(histogram: DataFrame) -> DataFrame:
    """For each length that occurs, taken as context limit, what a corpus cut at it has.

    docs_over: documents longer than the limit; quantile: share of documents not longer;
    tokens_over: tokens of documents longer than the limit; cut_total: tokens left when each
    document is cut at the limit. Between two lengths cut_total grows by docs_over of the
    lower one per token, so every limit can be answered. One row per distinct length; an empty
    histogram gives none.
    """
    longer = W.orderBy(F.col("n_tokens").desc()).rowsBetween(W.unboundedPreceding, -1)
    every = W.partitionBy(F.lit(0))
    tokens = F.col("n_tokens") * F.col("n_docs")
    out = histogram.select(
        "n_tokens", "n_docs",
        F.coalesce(F.sum("n_docs").over(longer), F.lit(0)).alias("docs_over"),
        F.coalesce(F.sum(tokens).over(longer), F.lit(0)).alias("tokens_over"),
        F.sum("n_docs").over(every).alias("total_docs"), F.sum(tokens).over(every).alias("total_tokens"),
    )
    return out.withColumn("cut_total", F.col("total_tokens") - F.col("tokens_over") + F.col("docs_over") * F.col("n_tokens")).withColumn(
        "quantile", (F.col("total_docs") - F.col("docs_over")) / F.col("total_docs")
    )


def cut_total(limits: DataFrame, limit: int) -> DataFrame:
    """Tokens left at any context limit, from a limit table: one row (limit, cut_total)."""
    low = limits.where(F.col("n_tokens") <= limit).agg(F.max_by(F.col("cut_total") + F.col("docs_over") * (limit - F.col("n_tokens")), "n_tokens").alias("a"))
    return low.crossJoin(F.broadcast(limits.agg(F.max("total_docs").alias("n")))).select(
        F.lit(limit).cast("long").alias("limit"), F.coalesce("a", F.col("n") * limit, F.lit(0)).cast("long").alias("cut_total")
    )


def quantile(limits: DataFrame, q: float) -> DataFrame:
    """The least length that a share ``q`` of the documents doesn't exceed: one row (q, n_tokens), null
    for an empty table."""
    # Whole documents against an exact decimal: no rounding decides.
    wanted = F.ceil(F.lit(Decimal(str(q))) * F.col("total_docs").cast("decimal(20,0)"))
    return limits.where(F.col("total_docs") - F.col("docs_over") >= wanted).agg(F.min("n_tokens").alias("n_tokens")).select(F.lit(q).alias("q"), "n_tokens")


def op4_token_counts(spark, sf_dir):
    """The limit table of all documents, by the vocabulary that ``spark.sonoplan.vocabulary`` names.

    Nulls, empty and very long texts, repeated rows, empty tables: as in length_histogram.
    """
    from .common import table

    named = spark.conf.get("spark.sonoplan.vocabulary", VOCABULARY)
    return limit_table(length_histogram(table(spark, sf_dir, "documents"), named))
