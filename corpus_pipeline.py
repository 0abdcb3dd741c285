"""The corpus pipeline: five filters and rewrites over ``documents``, each one stage.

Every stage gets all that its predecessor kept, as a Parquet table read again, and all but
the last return the columns of documents.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sonoplan.llm.common import free_name, shared_dir, table
from sonoplan.llm.decontaminate import drop_leaks
from sonoplan.llm.jaccard import keep_one
from sonoplan.llm.language import LEAST_NOISE, UNKNOWN, fold, lettered, predict, train_on
from sonoplan.llm.linededup import dedup_lines
from sonoplan.llm.mixing import mix_sources


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that the network reads as one of the languages it learned.

    It rejects what is null or has no letter (``und``), and what it finds to be noise for a share of
    LEAST_NOISE or more. Without labels to learn from there is no network: then all texts with a
    letter stay. Empty and very long texts, ties, repeated rows and extra columns: as in predict;
    every row is judged alone. Empty table: empty result.
    """
    net = train_on(docs, fold(F.col("doc_id"), 5) != 0)
    if net is None:
        return lettered(docs)
    names = tuple(free_name(docs.columns, n) for n in ("stage_lang", "stage_score", "stage_noise"))
    found = predict(docs, net, tuple(docs.columns), names)
    return found.where((F.col(names[0]) != UNKNOWN) & (F.col(names[2]) < LEAST_NOISE)).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops recurring line templates, and the documents of which only blanks are left thereby.

    n_chars follows the text. Null, empty and very long texts, ties, repeated rows, clashing columns
    and empty tables: as in dedup_lines; a null or blank text loses nothing and stays.
    """
    out = dedup_lines(docs)
    out = out.where((F.col("ld_dropped") == 0) | F.col("text").rlike(r"\S")).select(*docs.columns)
    return out.withColumn("n_chars", F.length("text").cast("bigint")) if "n_chars" in docs.columns else out


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates: five-word shingles, similarity 0.8 or more.

    Null, empty and very long texts, ties, repeated rows, clashing columns and empty tables: as in
    keep_one.
    """
    return keep_one(docs, shingle=5, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a benchmark item, edited or not.

    Null, empty and very long texts, ties, repeated rows, clashing columns and empty tables: as in
    drop_leaks.
    """
    return drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats documents so that sources meet their target weights; adds mix_copy.

    Null, empty and very long texts, ties, repeated rows, clashing columns and empty tables: as in
    mix_plan; a document without words is taken as often as others of its source.
    """
    return mix_sources(docs)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("language_7", language),
    ("line_dedup_8", line_dedup),
    ("near_duplicates_3", near_duplicates),
    ("decontaminate_10", decontaminate),
    ("mix_2", mix),
]

#: Language identification is not expressible in SQL; tests/llm holds a plain version of each stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; every stage but the last is written and read again."""
    docs = table(spark, sf_dir, "documents")
    base = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{base}/{k}-{name}")
            docs = spark.read.parquet(f"{base}/{k}-{name}")
        if 0 < k < len(STAGES) - 1:  # the stage before has been read to its end
            gone = spark._jvm.org.apache.hadoop.fs.Path(f"{base}/{k - 1}-{STAGES[k - 1][0]}")
            gone.getFileSystem(spark._jsc.hadoopConfiguration()).delete(gone, True)
    return docs
