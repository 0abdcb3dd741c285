"""Small helpers that every operator of this subpackage uses."""

from __future__ import annotations

import math
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; a local one only where none is named (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    fresh = getattr(shared_dir, "local", None)
    if fresh is None:
        fresh = shared_dir.local = tempfile.mkdtemp(prefix="ckpt-")
    return fresh


def cut(df: DataFrame) -> DataFrame:
    """Materialises a result in the shared folder and cuts its lineage (survives lost executors)."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def input_bytes(df: DataFrame) -> int:
    """Bytes of the files that a DataFrame scans; sources of unknown size don't count (all unknown: 0)."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    return sum(s for s in sizes if s < 1 << 60)


def parts_for(df: DataFrame, bytes_each: int, least: int = 12) -> int:
    """Number of partitions so that each holds about ``bytes_each`` of the input.

    A source that reports no size (an RDD, a JDBC table) is measured by a pass over its texts.
    """
    return max(least, -(-(input_bytes(df) or text_bytes(df)) // bytes_each))


def text_bytes(df: DataFrame) -> int:
    """Bytes of all texts, by a pass over them: a file of copies may hold many times its own size."""
    return df.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"))).first()[0] or 0


def chunks_for(size: int, bytes_each: int, most: int = 64 << 20, least: int = 12) -> int:
    """Number of chunks of a corpus of ``size`` that exchange arrays with as many buckets. A chunk has
    ``bytes_each`` and grows with the square root of the corpus, so that an array keeps some entries
    (8 MB up to 1.6 TB, 64 MB at 100 TB)."""
    return max(least, -(-size // max(bytes_each, min(most, math.isqrt(40 * size)))))


def in_chunks(df: DataFrame, chunks: int) -> DataFrame:
    """Rows of ``df`` (doc_id, text, ...) dealt to chunks by id, text and the partition they come from:
    rows that repeat an id, lack one, or are equal in all spread like others."""
    chunk = F.pmod(F.xxhash64("doc_id", "text", F.spark_partition_id()), F.lit(chunks)).cast("int")
    return df.withColumn("chunk", chunk).repartition(chunks, "chunk")


def free_name(columns: list[str], wish: str) -> str:
    """``wish``, with underscores after it until no column is called so (case doesn't count)."""
    taken = {c.lower() for c in columns}
    while wish.lower() in taken:
        wish += "_"
    return wish


def n_words(text: Column) -> Column:
    """Number of words of a text (null: 0)."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def text_key(id_col: Column, text: Column) -> Column:
    """Row key of 128 bits (binary) that tolerates null and repeated ids: equal keys mean equal (id, text)."""
    held = F.concat(F.coalesce(id_col.cast("string"), F.lit("")), F.when(text.isNull(), "-").otherwise("+"), F.coalesce(text, F.lit("")))
    return F.unhex(F.md5(held.cast("binary")))
