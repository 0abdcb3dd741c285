"""Nearest rows of every row: block products that leave k rows per row and tile.

All pairs are met, as a library's own similarity asks, but never written: rows are dealt to
blocks of BLOCK_BYTES, every two blocks are one tile, and of a tile's products each row of its
left block keeps the k best. What is exchanged grows with the rows times the number of blocks,
what a task holds does not grow at all, and a lost tile is computed again alone.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import vectors
from .derive import matrix_of

#: Bytes of a block of vectors, tiles at least (if there are rows for them), and bytes of products at once.
BLOCK_BYTES, LEAST_BLOCKS, PRODUCT_BYTES = 32 << 20, 4, 32 << 20
#: Cosines are ranked after rounding, so that ties don't depend on how a product was summed.
TIE_DIGITS = 9


def best_of(a: np.ndarray, a_ids: np.ndarray, b: np.ndarray, b_ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of a, id, cosine) of the k best of b for every row of unit vectors; ties to the smaller id; never its own id."""
    order = np.argsort(b_ids, kind="stable")
    b, b_ids = b[order], b_ids[order]
    step = max(1, PRODUCT_BYTES // (8 * max(1, len(b))))
    rows, ids, cosines = [], [], []
    for low in range(0, len(a), step):
        s = np.round(np.clip(a[low : low + step] @ b.T, -1, 1), TIE_DIGITS) + 0.0
        s[a_ids[low : low + step, None] == b_ids] = -np.inf
        if k < s.shape[1]:
            least = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k, None]
            # Of those equal to the k-th the first are taken: columns are in the order of ids.
            over, level = s > least, s == least
            keep = over | (level & (np.cumsum(level, 1) <= k - over.sum(1, keepdims=True)))
        else:
            keep = np.ones(s.shape, bool)
        i, j = np.nonzero(keep & np.isfinite(s))
        rows.append(i + low), ids.append(b_ids[j]), cosines.append(s[i, j])
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return np.concatenate(rows), np.concatenate(ids), np.concatenate(cosines)


def nearest_rows(rows: DataFrame, k: int) -> DataFrame:
    """The k rows of largest cosine of every row: id, rank (from 1), other, score; ties to the smaller id.

    ``rows``: id (unique), v. Rows of another size are not compared; null vectors and such with null or
    non-finite components take no part; a zero vector has cosine 0 with all. The result is exact.
    """
    if k < 1:
        raise ValueError("k must be 1 or more")
    fine = F.col("v").isNotNull() & F.forall("v", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) != float("inf")), F.lit(False)))
    own = rows.where(fine).select(F.col("id").cast("bigint").alias("id"), vectors.unit(F.col("v").cast("array<double>")).alias("v"), F.size("v").alias("d"))
    size = own.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("d").cast("double")).alias("d")).first()
    blocks = max(min(LEAST_BLOCKS, size["n"]), -int(-8 * (size["d"] or 0) // BLOCK_BYTES), 1)
    block, every = F.pmod(F.xxhash64("id"), F.lit(blocks)), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<bigint>"))
    left = own.select("id", "v", "d", block.alias("i"), every.alias("j"))
    right = own.select(F.col("id").alias("b_id"), F.col("v").alias("b_v"), F.col("d").alias("b_d"), every.alias("b_i"), block.alias("b_j"))

    def tile(a: pa.Table, b: pa.Table) -> pa.Table:
        at, ids, cosines = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        mine = a.column("id").to_numpy()
        if a.num_rows and b.num_rows:
            x, y = matrix_of(_whole(a.column("v"))), matrix_of(_whole(b.column("b_v")))
            at, ids, cosines = best_of(x, mine, y, b.column("b_id").to_numpy(), k)
        return pa.table({"id": pa.array(mine[at], pa.int64()), "other": pa.array(ids, pa.int64()), "score": pa.array(cosines, pa.float64())})

    found = left.groupBy("d", "i", "j").cogroup(right.groupBy("b_d", "b_i", "b_j")).applyInArrow(tile, "id bigint, other bigint, score double")
    rank = F.row_number().over(W.partitionBy("id").orderBy(F.col("score").desc(), "other"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("id", "rank", "other", "score")


def _whole(column: pa.ChunkedArray) -> pa.Array:
    joined = column.combine_chunks()
    return pa.concat_arrays(joined.chunks) if isinstance(joined, pa.ChunkedArray) else joined


def nearest_tracks(aggregates: DataFrame, model: str, k: int = 10) -> DataFrame:
    """The k tracks of largest centroid cosine of every track of a model: track_id, rank, other, score."""
    mine = aggregates.where(F.col("model") == model).select(F.col("track_id").alias("id"), "v")
    return nearest_rows(mine, k).withColumnRenamed("id", "track_id")
