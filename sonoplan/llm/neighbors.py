"""Nearest neighbours of stated queries by a block matrix join in int8.

Queries and candidates are dealt to blocks, and every pair of blocks is one tile. In a tile
the vectors are quantised to int8 codes and multiplied as matrices; from what the codes miss
(the norm of the remainder, known per vector) Cauchy-Schwarz bounds the error of each product,

    |q.x - s_q s_x c_q.c_x| <= |s_q c_q| |x - s_x c_x| + |q - s_q c_q| |x|.

A pair whose upper bound is under the query's k-th best score so far, or under the k-th
largest lower bound, is out. The pairs left are computed from the vectors themselves in double
precision, summed in the order of the components, and the tiles' sorted lists are merged by a
heap per query. The result is exact.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import table
from .textcore import release

#: Bytes of a block's vectors, as floats of 4 bytes.
QUERY_BLOCK, BASE_BLOCK = 8 << 20, 32 << 20
#: Tiles at least, so that small inputs use all cores too.
LEAST_TILES = 24
#: Rows multiplied at once.
QUERY_ROWS, BASE_ROWS = 512, 2048
#: Numbers gathered at once for the exact products.
GATHER = 2 << 20


def usable(v: Column) -> Column:
    """Vectors that take part: not null, no null or non-finite component, not all zero."""
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return v.isNotNull() & F.coalesce(fine, F.lit(False)) & F.exists(v, lambda x: x != 0)


class Codes:
    """int8 codes of vectors with their scales, and the norms that bound what codes miss."""

    def __init__(self, x: np.ndarray) -> None:
        top = np.abs(x).max(1, initial=0)
        with np.errstate(over="ignore", invalid="ignore"):
            self.scale = np.where(top > 0, top / 127, 1)
            self.codes = np.rint(x / np.where(self.scale > 0, self.scale, 1)[:, None]).astype(np.int8)
            held = self.codes * self.scale[:, None]
            self.rest, self.held, self.norm = (np.sqrt((a * a).sum(1)) for a in (x - held, held, x))


def code_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact products of int8 codes, all with all: sums of 1024 terms are whole in float32."""
    out = 0.0
    for k in range(0, a.shape[1], 1024):
        out = out + (a[:, k : k + 1024].astype(np.float32) @ b[:, k : k + 1024].astype(np.float32).T).astype(np.float64)
    return out


def exact_products(q: np.ndarray, x: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """q[i].x[j] of pairs, summed one component after the other (equal vectors give equal scores)."""
    out = np.zeros(len(i))
    some = max(1, GATHER // max(1, q.shape[1]))
    for k in range(0, len(i), some):
        a, b = q[i[k : k + some]], x[j[k : k + some]]
        for c in range(q.shape[1]):
            out[k : k + some] += a[:, c] * b[:, c]
    return out


def tile_best(q: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, id, score) of each query's k best in a tile, by score and then the smaller id."""
    row, found, score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    cq, least = Codes(q), np.full(len(q), -np.inf)  # least: the k-th best so far, where there are k
    for at in range(0, len(x), BASE_ROWS):
        xs = x[at : at + BASE_ROWS]
        cx, left, right = Codes(xs), [], []
        for low in range(0, len(q), QUERY_ROWS):
            s = slice(low, low + QUERY_ROWS)
            with np.errstate(over="ignore", invalid="ignore"):
                near = code_products(cq.codes[s], cx.codes) * cq.scale[s, None] * cx.scale
                # The last term is for the rounding of these lines themselves.
                miss = cq.held[s, None] * cx.rest + cq.rest[s, None] * cx.norm + 1e-9 * cq.norm[s, None] * cx.norm
                bar = least[s]
                if len(xs) >= k:
                    under = near - miss
                    under[np.isnan(under)] = -np.inf
                    bar = np.maximum(bar, np.partition(under, len(xs) - k, axis=1)[:, len(xs) - k])
                out = near + miss < bar[:, None]  # a bound that overflows keeps its pair
            i, j = np.nonzero(~out)
            left.append(i + low), right.append(j)
        i, j = np.concatenate(left), np.concatenate(right)
        row, found, score = np.concatenate([row, i]), np.concatenate([found, ids[at + j]]), np.concatenate([score, exact_products(q, xs, i, j)])
        order = np.lexsort((found, -score, row))
        first = np.searchsorted(row[order], row[order])  # of sorted rows: where their query begins
        order = order[np.arange(len(order)) - first < k]
        row, found, score = row[order], found[order], score[order]
        full = np.flatnonzero(np.bincount(row, minlength=len(q)) == k)
        least[full] = score[np.searchsorted(row, full, side="right") - 1]
    return row, found, score


def _matrices(t: pa.Table) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Rows and vectors of a table's ``v`` by their number of components."""
    lists = t.column("v").combine_chunks()
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    offsets = lists.offsets.to_numpy().astype(np.int64)
    flat = lists.values.to_numpy(zero_copy_only=False).astype(np.float64)
    size = np.diff(offsets)
    out = {}
    for d in np.unique(size):
        rows = np.flatnonzero(size == d)
        out[int(d)] = rows, flat[offsets[rows][:, None] + np.arange(d)]
    return out


_LISTS = "query binary, query_id bigint, own double, ids array<bigint>, scores array<double>"


def _tile(k: int):
    names = [f.split()[0] for f in _LISTS.split(", ")]

    def run(queries: pa.Table, base: pa.Table) -> pa.Table:
        left, right, out = _matrices(queries), _matrices(base), []
        ids, key, query_id = base.column("id").to_numpy(), queries.column("query").combine_chunks(), queries.column("id").to_numpy()
        for d in left.keys() & right.keys():
            (qr, q), (xr, x) = left[d], right[d]
            row, found, score = tile_best(q, x, ids[xr], k)
            ends = np.searchsorted(row, np.arange(len(q) + 1)).astype(np.int32)
            own = exact_products(q, q, np.arange(len(q)), np.arange(len(q)))
            lists = (pa.ListArray.from_arrays(pa.array(ends), pa.array(c)) for c in (found, score))
            out.append(pa.table([key.take(pa.array(qr)), pa.array(query_id[qr]), pa.array(own), *lists], names=names))
        release()
        empty = pa.table([pa.array([], t) for t in (pa.binary(), pa.int64(), pa.float64(), pa.list_(pa.int64()), pa.list_(pa.float64()))], names=names)
        return pa.concat_tables(out) if out else empty

    return run


def _merged(k: int, own_out: bool):
    """Rows (query_id, rank, id, score) of lists that come sorted by query."""
    names = ["query_id", "rank", "id", "score"]

    def ranks(query_id: int, own: float, best: list[tuple[float, int]]) -> list[tuple[int, int, int, float]]:
        if own_out:
            mine = (-own, query_id)
            if mine in best:  # rows that equal it in id and score are as good as it
                best.remove(mine)
        return [(query_id, r, i, -s) for r, (s, i) in enumerate(best[:k], 1)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, best = None, []
        for b in batches:
            out = []
            for key, query_id, own, ids, scores in zip(*(c.to_pylist() for c in b.columns)):
                if last is None or key != last[0]:
                    if last is not None:
                        out += ranks(*last[1:], best)
                    last, best = (key, query_id, own), []
                merged = heapq.merge(best, zip((-s for s in scores), ids))
                best = [x for x, _ in zip(merged, range(k + own_out))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 4, (pa.int64(), pa.int32(), pa.int64(), pa.float64()))], names=names)
        if last is not None:
            out = ranks(*last[1:], best)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 4, (pa.int64(), pa.int32(), pa.int64(), pa.float64()))], names=names)

    return run


def nearest(base: DataFrame, is_query: Column, k: int = 20) -> DataFrame:
    """query_id, rank, id, score: for every query the k other rows of the largest inner product.

    ``base``: id bigint, v array<float or double>; queries are its rows for which ``is_query`` holds.
    Ties go to the smaller id. Vectors that are null, zero or hold null or non-finite components, and
    rows without an id, take no part; vectors of different length never meet. Rows that repeat an id
    are candidates each; a query's own row is left out once, and rows equal in id and vector are one
    query. With fewer candidates than k a query has all. No queries or empty table: empty result.

    Of candidates with equal vectors only the k + 1 of least id can be in a list, so copies, however
    many, leave no more than these. Blocks have a fixed size, queries go to every block of candidates.
    """
    rows = base.select(F.col("id").cast("bigint").alias("id"), "v", is_query.alias("asks")).where(F.col("id").isNotNull() & usable(F.col("v")))
    n, asked, wide = rows.agg(F.count(F.lit(1)), F.sum(F.col("asks").cast("long")), F.max(F.size("v"))).first()
    wide = 4 * (wide or 1)
    query_blocks, base_blocks = (max(1, -(-(x or 0) * wide // most)) for x, most in ((asked, QUERY_BLOCK), (n, BASE_BLOCK)))
    base_blocks = max(base_blocks, -(-LEAST_TILES // query_blocks))
    tiles = query_blocks * base_blocks

    # The hash comes first, so that few vectors are compared by component.
    copies = W.partitionBy("h", "v").orderBy("id")
    kept = rows.select("id", "v", F.xxhash64("v").alias("h")).withColumn("copy", F.row_number().over(copies)).where(F.col("copy") <= k + 1)
    block = F.pmod(F.xxhash64("id", "h", "copy"), F.lit(base_blocks))
    kept = kept.select("id", "v", block.alias("block")).withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))
    kept = kept.select("id", "v", (F.col("q") * base_blocks + F.col("block")).cast("int").alias("tile"))

    asks = rows.where("asks").select("id", "v").dropDuplicates(["id", "v"])
    asks = asks.withColumn("query", F.unhex(F.md5(F.concat_ws(",", F.col("id").cast("string"), F.col("v").cast("array<string>")))))
    mine = F.pmod(F.xxhash64("query"), F.lit(query_blocks)) * base_blocks
    asks = asks.withColumn("block", mine).withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(base_blocks - 1))))
    asks = asks.select("query", "id", "v", (F.col("block") + F.col("x")).cast("int").alias("tile"))

    by = lambda df: df.repartition(tiles, "tile").groupBy("tile")
    lists = by(asks).cogroup(by(kept)).applyInArrow(_tile(k + 1), _LISTS)
    return lists.repartition("query").sortWithinPartitions("query").mapInArrow(_merged(k, True), "query_id bigint, rank int, id bigint, score double")


def op12_nearest(spark, sf_dir):
    """query_id, rank, vec_id, score: the 20 nearest of every vector whose id is divisible by 20.

    Unusable vectors, ties, repeated rows and ids, other columns, empty tables: as in nearest.
    """
    base = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return nearest(base, F.col("id") % 20 == 0).select("query_id", "rank", F.col("id").alias("vec_id"), "score")


OP12_SQL = r"""
WITH e AS (SELECT row_number() OVER () AS r, vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
u AS (SELECT * FROM e WHERE len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
a AS (SELECT min(r) AS r, vec_id, v FROM u WHERE vec_id % 20 = 0 GROUP BY vec_id, v),
s AS (SELECT q.r, q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v) AS score FROM a q JOIN u c ON q.r <> c.r AND len(q.v) = len(c.v)),
o AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INT AS rank, vec_id, score FROM o WHERE rank <= 20
"""
