"""Vector arithmetic as Column expressions over array columns (doubles inside), and grouped means."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def doubles(v: Column | str) -> Column:
    return _c(v).cast("array<double>")


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column | str) -> Column:
    return F.sqrt(dot(v, v))


def unit(v: Column | str) -> Column:
    """v / |v|; the zero vector where the norm is zero or not finite."""
    v, n = _c(v), norm(v)
    good = (n > 0) & (n < float("inf"))
    return F.when(good, F.transform(v, lambda x: x / n)).otherwise(F.transform(v, lambda x: F.lit(0.0)))


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine in [-1, 1]; 0 for a zero norm, an empty vector or unequal sizes."""
    n = norm(a) * norm(b)
    fits = (F.size(_c(a)) == F.size(_c(b))) & (n > 0)
    return F.when(fits, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / n))).otherwise(0.0)


def unit_cost(a: Column | str, b: Column | str) -> Column:
    """1 - cosine of vectors that are unit or zero, in [0, 2]; a zero vector costs 1."""
    return F.greatest(F.lit(0.0), F.least(F.lit(2.0), 1 - dot(a, b)))


def scale(v: Column | str, weights: Column | str) -> Column:
    """Components times the root of their weights; unchanged where sizes differ or weights are null."""
    v, w = _c(v), _c(weights)
    return F.when(w.isNotNull() & (F.size(v) == F.size(w)), F.zip_with(v, w, lambda x, y: x * F.sqrt(y))).otherwise(v)


def component(v: Column | str, k: int) -> Column:
    """Component k, from 0; null outside."""
    return F.get(_c(v), F.lit(k))


def partial_sums(df: DataFrame, keys: list[str], v: str = "v") -> DataFrame:
    """``keys``, n and the component-wise sum of the vectors: one row per Arrow batch, group and
    vector size. Hundreds of components per vector leave a batch as one array per group, not as
    hundreds of rows per vector."""
    kinds = dict(df.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            b = b.filter(pc.is_valid(b.column(len(keys))))
            if not b.num_rows:
                continue
            code = np.zeros(b.num_rows, np.int64)
            for c in b.columns[:-1]:
                d = c.dictionary_encode(null_encoding="encode")
                code = code * len(d.dictionary) + d.indices.to_numpy()
            x = b.column(len(keys))
            off, flat = x.offsets.to_numpy(), x.values.to_numpy(zero_copy_only=False)
            size = np.diff(off)
            first, n, sums = [], [], []
            for dim in np.unique(size):
                own = np.flatnonzero(size == dim)
                group, rep, back, count = np.unique(code[own], return_index=True, return_inverse=True, return_counts=True)
                order = np.argsort(back, kind="stable")
                rows = flat[off[own[order]][:, None] + np.arange(dim)]
                first += own[rep].tolist()
                n += count.tolist()
                sums += list(np.add.reduceat(rows, np.cumsum(count) - count, axis=0)) if dim else [np.zeros(0)] * len(group)
            at = pa.array(first)
            yield pa.RecordBatch.from_arrays([*(c.take(at) for c in b.columns[:-1]), pa.array(n, pa.int64()), pa.array(sums, pa.list_(pa.float64()))], names=[*keys, "n", "sum"])

    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "n bigint, sum array<double>"])
    return df.select(*keys, doubles(v).alias("v")).mapInArrow(run, schema)


def average(df: DataFrame, keys: list[str], v: str = "v", out: str = "mean") -> DataFrame:
    """Component-wise mean per group, in component order, from partial sums."""
    long = partial_sums(df, keys, v).select(*keys, "n", F.posexplode("sum").alias("pos", "x"))
    long = long.groupBy(*keys, "pos").agg((F.sum("x") / F.sum("n")).alias("x"))
    got = long.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("pos", "x"))).alias("z"))
    return got.select(*keys, F.transform("z", lambda z: z["x"]).alias(out))


def softmax(values: Column | str, factor: float = 100.0) -> Column:
    """Softmax of factor * values, shifted by the maximum."""
    v = _c(values)
    e = F.transform(v, lambda x: F.exp(factor * (x - F.array_max(v))))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda s, y: s + y))
