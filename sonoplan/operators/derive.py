"""Derived datasets: standardised vectors, learned weights, PCA, t-SNE and UMAP.

Raw vectors stay as they are; what is derived is a view or a new table, so that a fit never
depends on earlier ones.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import vectors

FLAT = 1e-9
TSNE_MOST, UMAP_MOST = 15_000, 200_000
#: Vectors that t-SNE and UMAP fit on the driver.
WHOLE_MOST = 2000
#: Landmarks whose places weigh in for a vector that is no landmark, and bytes of distances at once.
PLACED_BY, PLACE_BYTES = 8, 32 << 20


def matrix_of(column: pa.Array) -> np.ndarray:
    """Vectors of one size as a matrix, without a Python object per component."""
    flat = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _largest(rows: DataFrame) -> tuple[DataFrame, list[float] | None]:
    """(the vectors of the largest size, one of them)."""
    best = rows.where("v IS NOT NULL").agg(F.max(F.struct(F.size("v").alias("d"), F.col("v"))).alias("m")).first()["m"]
    return (rows.limit(0), None) if best is None else (rows.where(F.size("v") == best["d"]), best["v"])


def component_stats(rows: DataFrame) -> DataFrame:
    """pos, mean, std (population) and n of every component, over the vectors of the largest size.

    A task sends one row: sums and sums of squares of the distances from one stated vector, so
    that equal components have no deviation at all.
    """
    own, pivot = _largest(rows)
    at = np.array(pivot or [], np.float64)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, q = 0, np.zeros(len(at)), np.zeros(len(at))
        for b in batches:
            if b.num_rows:
                x = matrix_of(b.column(0)) - at
                n, s, q = n + len(x), s + x.sum(0), q + (x * x).sum(0)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([s]), pa.array([q])], names=["n", "s", "q"])

    sent = own.select("v").mapInArrow(part, "n bigint, s array<double>, q array<double>")
    each = sent.select("n", F.posexplode(F.arrays_zip("s", "q")).alias("pos", "z")).groupBy("pos").agg(F.sum("n").alias("n"), F.sum("z.s").alias("s"), F.sum("z.q").alias("q"))
    base = F.get(F.array(*map(F.lit, at.tolist())) if len(at) else F.array().cast("array<double>"), F.col("pos"))
    var = F.greatest(F.lit(0.0), F.col("q") / F.col("n") - F.pow(F.col("s") / F.col("n"), F.lit(2.0)))
    return each.select("pos", (base + F.col("s") / F.col("n")).alias("mean"), F.sqrt(var).alias("std"), "n")


def zscore(rows: DataFrame, flat: float = FLAT) -> DataFrame:
    """Vectors with every component standardised; flat components become 0; others sizes drop out.

    Fewer than two vectors stay as they are. The statistics are one row of two arrays.
    """
    s = component_stats(rows).agg(F.sort_array(F.collect_list(F.struct("pos", "mean", "std"))).alias("z"), F.max("n").alias("n"))
    s = F.broadcast(s.select("n", F.col("z")["mean"].alias("mean"), F.transform("z", lambda z: F.when(z["std"] < flat, 1.0).otherwise(z["std"])).alias("std")))
    out = rows.crossJoin(s).where(F.size("v") == F.size("mean"))
    z = F.zip_with(F.zip_with("v", "mean", lambda x, m: x - m), "std", lambda x, d: x / d)
    return out.withColumn("v", F.when(F.col("n") < 2, F.col("v")).otherwise(z)).drop("n", "mean", "std")


def standardize(rows: DataFrame) -> DataFrame:
    """As zscore, but only an exactly constant component divides by 1."""
    return zscore(rows, np.nextafter(0, 1))


def learn_weights(pairs: DataFrame, aggregates: DataFrame, l2: float | None = None) -> DataFrame:
    """Weights (component_index, weight; mean 1) under which paired tracks agree best.

    c is the mean squared difference of a component over the pairs of unit centroids; the
    weights minimise sum(w c) + l2 |w|^2 on the simplex. Its solution is a water level: with c
    sorted, level = (2 l2 + prefix sum) / k for the largest k whose c is below the level.
    Pairs of a track with itself, without centroids or with a zero one don't count.
    """
    p = pairs.where("track_a != track_b").select(F.least("track_a", "track_b").alias("a"), F.greatest("track_a", "track_b").alias("b")).distinct()
    u = aggregates.where(vectors.norm("v") > 0).select("track_id", vectors.unit("v").alias("v"))
    both = p.join(u.select(F.col("track_id").alias("a"), F.col("v").alias("x")), "a").join(u.select(F.col("track_id").alias("b"), F.col("v").alias("y")), "b").where(F.size("x") == F.size("y"))
    gap = F.zip_with("x", "y", lambda x, y: (x - y) * (x - y))
    c = both.select(F.posexplode(gap).alias("component_index", "g")).groupBy("component_index").agg(F.avg("g").alias("c"))
    every = W.partitionBy(F.lit(0))  # one row per component
    l2_col = F.greatest(F.avg("c").over(every) / 2, F.lit(1e-12)) if l2 is None else F.lit(float(l2))
    run = W.orderBy("c", "component_index").rowsBetween(W.unboundedPreceding, 0)
    c = c.select("component_index", "c", l2_col.alias("l2"), F.sum("c").over(run).alias("sum"), F.row_number().over(W.orderBy("c", "component_index")).alias("k"), F.count(F.lit(1)).over(every).alias("dim"))
    level = (2 * F.col("l2") + F.col("sum")) / F.col("k")
    c = c.withColumn("level", F.max_by(F.when(level > F.col("c"), level), F.when(level > F.col("c"), F.col("k"))).over(every))
    w = F.greatest(F.lit(0.0), (F.col("level") - F.col("c")) / (2 * F.col("l2")))
    return c.select("component_index", (w * F.col("dim")).alias("weight"))


def moments(rows: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """Count, sum and sum of outer products of the vectors of the largest size, in one pass over them.

    Each task sends the rows of one (d, d) block; these are summed by row in the cluster.
    """
    own, pivot = _largest(rows)
    if pivot is None:
        raise ValueError("there are no vectors to reduce")
    d = len(pivot)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, n = np.zeros((d + 1, d + 1)), 0
        for b in batches:
            if b.num_rows:
                x = np.pad(matrix_of(b.column(0)), ((0, 0), (0, 1)), constant_values=1.0)
                block, n = block + x.T @ x, n + len(x)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(d + 1)), pa.array(list(block))], names=["k", "x"])

    def add(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        return pa.table({"k": [key[0].as_py()], "x": [matrix_of(t.column("x").combine_chunks()).sum(0).tolist()]})

    got = own.select("v").mapInArrow(part, "k bigint, x array<double>").groupBy("k").applyInArrow(add, "k bigint, x array<double>")
    block = np.array([r["x"] for r in sorted(got.collect(), key=lambda r: r["k"])])  # d + 1 rows
    return round(block[d, d]), block[d, :d], block[:d, :d]


def pca(rows: DataFrame, k: int) -> tuple[DataFrame, list[float]]:
    """(rows with ``v`` projected on the first k centred components, their shares of the variance).

    The largest loading of each component is positive, so that repeated fits agree.
    """
    n, s, ss = moments(rows)
    mean = s / n
    values, axes = np.linalg.eigh(ss / n - np.outer(mean, mean))
    order = np.argsort(-values)[: max(1, min(k, len(s), n))]
    values, axes = np.maximum(values, 0), axes[:, order]
    axes = axes * np.sign(axes[np.abs(axes).argmax(0), np.arange(axes.shape[1])])
    total = values.sum()
    if total <= 1e-18:
        axes, shares = np.zeros_like(axes), [0.0] * len(order)
    else:
        shares = (values[order] / total).tolist()

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.schema.get_field_index("v")
            x = matrix_of(b.column(at)).reshape(b.num_rows, len(mean))
            flat = ((x - mean) @ axes).ravel()
            v = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1) * axes.shape[1], pa.int32()), pa.array(flat))
            yield b.set_column(at, pa.field("v", v.type), v)

    # Vectors of other sizes have no place on these axes.
    return rows.where(F.size("v") == len(mean)).mapInArrow(project, rows.schema), shares


def _matrix(rows: DataFrame, most: int, what: str) -> tuple[list[int], np.ndarray]:
    """The vectors on the driver, by chunk id, behind a check of their number."""
    n = rows.limit(most + 1).count()
    if n > most:
        raise ValueError(f"{what} takes at most {most} vectors")
    if n < 4:
        raise ValueError(f"{what} needs 4 vectors")
    got = rows.select("chunk_id", "v").orderBy("chunk_id").collect()
    return [r[0] for r in got], np.array([r[1] for r in got], np.float64)


def _standard(x: np.ndarray) -> np.ndarray:
    std = x.std(0)
    return (x - x.mean(0)) / np.where(std == 0, 1, std)


def _principal(x: np.ndarray, k: int) -> np.ndarray:
    u, s, _ = np.linalg.svd(x - x.mean(0), full_matrices=False)
    return u[:, :k] * s[:k]


def _neighbours(x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices and distances of the k nearest other rows, in blocks."""
    sq, idx, dist = (x * x).sum(1), [], []
    for a in range(0, len(x), 1024):
        d = np.maximum(sq[a : a + 1024, None] + sq[None] - 2 * x[a : a + 1024] @ x.T, 0)
        d[np.arange(len(d)), a + np.arange(len(d))] = np.inf
        near = np.argpartition(d, k - 1, 1)[:, :k]
        v = np.take_along_axis(d, near, 1)
        o = np.argsort(v, 1, kind="stable")
        idx.append(np.take_along_axis(near, o, 1))
        dist.append(np.sqrt(np.take_along_axis(v, o, 1)))
    return np.concatenate(idx), np.concatenate(dist)


def tsne(rows: DataFrame, k: int = 2, perplexity: float = 30.0, steps: int = 300, landmarks: int | None = None, limited: bool = True) -> DataFrame:
    """t-SNE (van der Maaten and Hinton 2008), for TSNE_MOST vectors at most unless ``limited`` is false, or by landmarks."""
    if not 1 <= k <= 3:
        raise ValueError("t-SNE gives 1 to 3 components")
    spread = lambda: layout.tsne(rows, k, perplexity, steps)
    return _laid_out(rows, TSNE_MOST, "t-SNE", landmarks, lambda x: _tsne(x, k, perplexity, steps), spread, limited)


def perplexed(dist: np.ndarray, perplexity: float) -> np.ndarray:
    """Shares of each row's neighbours, whose distances are ascending, at the bandwidth of that perplexity."""
    n = len(dist)
    lo, hi, beta = np.zeros(n), np.full(n, np.inf), np.ones(n)
    for _ in range(60):
        p = np.exp(-beta[:, None] * (dist**2 - dist[:, :1] ** 2))
        p /= p.sum(1, keepdims=True)
        high = -(p * np.log(np.maximum(p, 1e-300))).sum(1) > np.log(perplexity)
        lo, hi = np.where(high, beta, lo), np.where(high, hi, beta)
        beta = np.where(np.isinf(hi), beta * 2, (lo + hi) / 2)
    return p


def _tsne(x: np.ndarray, k: int, perplexity: float, steps: int) -> np.ndarray:
    n = len(x)
    perplexity = min(perplexity, max(5.0, (n - 1) / 4), n - 1.5)
    near = min(n - 1, int(3 * perplexity) + 1)
    idx, dist = _neighbours(x, near)
    p = perplexed(dist, perplexity)
    big = np.zeros((n, n), np.float32)
    np.put_along_axis(big, idx, p.astype(np.float32), 1)
    big = np.maximum((big + big.T) / (2 * n), 1e-12)
    y = _principal(x, k)
    y = np.pad(y, ((0, 0), (0, k - y.shape[1]))) / max(y[:, 0].std(), 1e-12) * 1e-2
    move, gain, rate = np.zeros_like(y), np.ones_like(y), max(n / 48, 50)
    for t in range(steps):
        q = 1 / (1 + np.maximum((y * y).sum(1)[:, None] + (y * y).sum(1)[None] - 2 * y @ y.T, 0))
        np.fill_diagonal(q, 0)
        w = (big * (12 if t < 100 else 1) - q / q.sum()) * q
        grad = 4 * (w.sum(1)[:, None] * y - w @ y)
        gain = np.maximum(np.where(np.sign(grad) != np.sign(move), gain + 0.2, gain * 0.8), 0.01)
        move = (0.5 if t < 100 else 0.8) * move - rate * gain * grad
        y = y + move
    return y


def umap(rows: DataFrame, k: int = 2, n_neighbors: int = 15, min_dist: float = 0.1, steps: int = 200, landmarks: int | None = None, limited: bool = True) -> DataFrame:
    """UMAP (McInnes et al. 2018), for UMAP_MOST vectors at most unless ``limited`` is false, or by landmarks."""
    if not 1 <= k <= 32 or n_neighbors < 2 or not 0 <= min_dist <= 1:
        raise ValueError("UMAP gives 1 to 32 components from 2 neighbours or more, min_dist 0 to 1")
    spread = lambda: layout.umap(rows, k, n_neighbors, min_dist, steps)
    return _laid_out(rows, UMAP_MOST, "UMAP", landmarks, lambda x: _umap(x, k, n_neighbors, min_dist, steps), spread, limited)


def fuzzy(dist: np.ndarray) -> np.ndarray:
    """Memberships of each row's neighbours, whose distances are ascending; they sum to log2 of their number."""
    n, near = dist.shape
    rho, want = dist[:, 0], np.log2(near)
    lo, hi, sigma = np.zeros(n), np.full(n, np.inf), np.ones(n)
    for _ in range(64):
        total = np.exp(-np.maximum(dist - rho[:, None], 0) / sigma[:, None]).sum(1)
        lo, hi = np.where(total > want, lo, sigma), np.where(total > want, sigma, hi)
        sigma = np.where(np.isinf(hi), sigma * 2, (lo + hi) / 2)
    return np.exp(-np.maximum(dist - rho[:, None], 0) / np.maximum(sigma, 1e-12)[:, None])


def curve(min_dist: float) -> tuple[float, float]:
    """a, b of the low-dimensional curve, by least squares on a grid."""
    grid = np.linspace(0, 3, 300)[1:]
    shape = np.where(grid <= min_dist, 1, np.exp(-(grid - min_dist)))
    return min(((a, b) for a in np.linspace(0.3, 6, 60) for b in np.linspace(0.4, 1.6, 40)), key=lambda c: ((1 / (1 + c[0] * grid ** (2 * c[1])) - shape) ** 2).sum())


def _umap(x: np.ndarray, k: int, n_neighbors: int, min_dist: float, steps: int) -> np.ndarray:
    n = len(x)
    near = min(n_neighbors, n - 1)
    idx, dist = _neighbours(x, near)
    w = fuzzy(dist)
    a_of, b_of = np.repeat(np.arange(n), near), idx.ravel()
    key = np.concatenate([a_of * n + b_of, b_of * n + a_of])
    pair, back = np.unique(key, return_inverse=True)
    p = np.zeros((len(pair), 2))
    np.maximum.at(p[:, 0], back[: n * near], w.ravel())
    np.maximum.at(p[:, 1], back[n * near :], w.ravel())
    weight = p.sum(1) - p.prod(1)
    head, tail = pair // n, pair % n
    a, b = curve(min_dist)
    rng = np.random.default_rng(0)
    y = _principal(x, k)
    y = np.pad(y, ((0, 0), (0, k - y.shape[1]))) / max(np.abs(y).max(), 1e-12) * 10 + rng.normal(0, 1e-4, (n, k))
    for t in range(steps):
        alpha = 1 - t / steps
        on = rng.random(len(head)) < weight / weight.max()
        i, j = head[on], tail[on]
        d = y[i] - y[j]
        r = (d * d).sum(1)
        pull = np.where(r > 0, -2 * a * b * np.maximum(r, 1e-12) ** (b - 1) / (1 + a * np.maximum(r, 1e-12) ** b), 0)
        step = np.zeros_like(y)
        np.add.at(step, i, np.clip(pull[:, None] * d, -4, 4))
        for _ in range(5):
            o = rng.integers(0, n, len(i))
            d = y[i] - y[o]
            r = (d * d).sum(1)
            push = np.where(i != o, 2 * b / ((0.001 + r) * (1 + a * np.maximum(r, 1e-12) ** b)), 0)
            np.add.at(step, i, np.clip(push[:, None] * d, -4, 4))
        y = y + alpha * step / max(1.0, near / 4)
    return y


def _laid_out(rows: DataFrame, most: int, what: str, landmarks: int | None, fit: Callable[[np.ndarray], np.ndarray], spread: Callable[[], DataFrame], limited: bool) -> DataFrame:
    """(chunk_id, v) by a layout that is fitted to all vectors together.

    Without ``landmarks`` all vectors are fitted: up to WHOLE_MOST on the driver, more in the cluster (see
    ``layout``); more than ``most`` are refused unless ``limited`` is false.
    With them it is fitted to that many vectors of the largest size (``most`` at most, those of least
    hashed chunk_id, so reruns agree), and every other vector is placed where it is stored: at the mean
    of its PLACED_BY nearest landmarks, by one over the squared distance. A vector equal to a landmark
    lies on it; null vectors and those of other sizes have no place.
    """
    if landmarks is None:
        n = rows.limit(most + 1).count()
        if limited and n > most:
            raise ValueError(f"{what} takes at most {most} vectors")
        if n > WHOLE_MOST:
            return spread()
        ids, x = _matrix(rows, most, what)
        return _placed(rows, ids, fit(_standard(x)))
    if not 4 <= landmarks <= most:
        raise ValueError(f"{what} takes 4 to {most} landmarks")
    own, pivot = _largest(rows)
    _, x = _matrix(own.orderBy(F.xxhash64("chunk_id"), "chunk_id").limit(landmarks), most, what)
    mean, std = x.mean(0), np.where(x.std(0) == 0, 1, x.std(0))
    z = (x - mean) / std
    y = fit(z)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, PLACE_BYTES // (8 * max(len(z), PLACED_BY * z.shape[1])))
        for b in batches:
            if not b.num_rows:
                continue
            v = (matrix_of(b.column(1)) - mean) / std
            at = np.concatenate([_placed_by(v[low : low + step], z, y) for low in range(0, len(v), step)])
            ends = pa.array(np.arange(len(at) + 1) * at.shape[1], pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(ends, pa.array(at.ravel()))], names=["chunk_id", "v"])

    return own.select(F.col("chunk_id").cast("bigint").alias("chunk_id"), "v").mapInArrow(place, "chunk_id bigint, v array<double>")


def _placed_by(v: np.ndarray, z: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Places of rows v among landmarks z, which lie at y."""
    k = min(PLACED_BY, len(z))
    d = (v * v).sum(1)[:, None] + (z * z).sum(1) - 2 * v @ z.T
    near = np.argpartition(d, k - 1, 1)[:, :k]
    d = ((v[:, None] - z[near]) ** 2).sum(2)  # of the few, without what the products lose
    w = 1 / np.maximum(d, 1e-300)
    w = np.where((d == 0).any(1, keepdims=True), d == 0, w / w.max(1, keepdims=True))
    return (w[:, :, None] * y[near]).sum(1) / w.sum(1, keepdims=True)


def _placed(rows: DataFrame, ids: list[int], y: np.ndarray) -> DataFrame:
    return rows.sparkSession.createDataFrame([(i, [float(c) for c in v]) for i, v in zip(ids, y)], "chunk_id bigint, v array<double>")


def reduce_rows(rows: DataFrame, method: str, k: int, **options) -> tuple[DataFrame, list[float]]:
    """Any reduction by name: (chunk_id, v) and the explained shares (empty but for PCA)."""
    if method == "pca":
        if rows.limit(4).count() < 4:
            raise ValueError("a reduction needs 4 vectors")
        out, shares = pca(rows.select("chunk_id", "v"), k)
        return out, shares
    if method in ("tsne", "umap"):
        return {"tsne": tsne, "umap": umap}[method](rows, k, **options), []
    raise ValueError(f"unknown reduction {method!r}")


from . import layout  # noqa: E402  (it uses what is above)
