"""Density-based noise flags, song by song: reach rule, HDBSCAN and OPTICS in numpy.

A song's chunks are the unit: one Arrow group per song, and songs are spread over the cluster.
Files over 20 minutes are not analysed by default, but may be: nothing here holds a song's
matrix of distances. Distances come in blocks of BLOCK_BYTES; what stays is the song's vectors
and, for each chunk, its LISTED nearest ones.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import reads
from .derive import matrix_of

LEAST_VECTORS, MOST_VECTORS, LEAST_TRACK_CHUNKS = 20, 1_000_000, 6
NEIGHBOURS, REACH_FACTOR = 4, 2.0
#: Bytes of a block of distances (some five such arrays exist at once), and nearest chunks kept per chunk.
BLOCK_BYTES, LISTED = 32 << 20, 32


def knn_reach(rows: DataFrame) -> DataFrame:
    """track_id, chunk_id, reach: mean distance to the nearest ``NEIGHBOURS`` chunks of the song.

    ``rows``: track_id, chunk_id, v of one dataset; a song of one chunk, or of vectors of several
    sizes, has no reach.
    """

    def song(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        x = _vectors(t)
        if x is None or len(x) < 2:
            t, reach = t.slice(0, 0), []
        else:
            reach = reach_of(unit_rows(x))
        return pa.table({"track_id": t.column("track_id"), "chunk_id": t.column("chunk_id"), "reach": pa.array(reach, pa.float64())})

    return rows.select("track_id", "chunk_id", "v").groupBy("track_id").applyInArrow(song, "track_id bigint, chunk_id bigint, reach double")


def reach_outliers(rows: DataFrame) -> DataFrame:
    """knn_reach with ratio (to the song's median) and outlier (ratio over ``REACH_FACTOR``)."""
    reach = knn_reach(rows)
    mid = reach.groupBy("track_id").agg(F.median("reach").alias("median"))
    ratio = F.when(F.col("median") > 0, F.col("reach") / F.col("median")).otherwise(0.0)
    return reach.join(mid, "track_id").select("track_id", "chunk_id", "reach", ratio.alias("ratio"), (ratio > REACH_FACTOR).alias("outlier"))


# --- numpy, one song at a time -----------------------------------------------------------


def _vectors(t: pa.Table) -> np.ndarray | None:
    """A song's vectors as a matrix; None if one is null or they differ in size."""
    v = t.column("v").combine_chunks()
    v = pa.concat_arrays(v.chunks) if isinstance(v, pa.ChunkedArray) else v
    return None if v.null_count or pc.count_distinct(pc.list_value_length(v)).as_py() != 1 else matrix_of(v)


def on_grid(x: np.ndarray) -> np.ndarray:
    """x rounded to a share 2^-b of its largest component, b some 21 to 25 by the number of components.

    Products of such numbers sum without rounding, so a distance is the same in any block, equal
    rows are at 0 and ties are ties.
    """
    top = np.abs(x[np.isfinite(x)]).max(initial=0)
    if top == 0:
        return x
    bits = (51 - int(np.ceil(np.log2(max(1, x.shape[1]))))) // 2
    unit = 2.0 ** (np.ceil(np.log2(top)) - bits)
    return np.rint(x / unit) * unit


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of the rows of a to those of b, both on one grid."""
    d = a @ b.T
    d *= -2
    d += (a * a).sum(1)[:, None]
    d += (b * b).sum(1)
    return np.sqrt(d, out=d)


def nearest(x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and distances of the k nearest other rows of each row (all others, if fewer), nearest first."""
    n, k = len(x), min(k, len(x) - 1)
    at, far = np.zeros((n, k), np.int64), np.zeros((n, k))
    if k < 1:
        return at, far
    step = max(1, BLOCK_BYTES // (8 * n))
    for low in range(0, n, step):
        d = distances(x[low : low + step], x)
        own = np.arange(len(d))
        d[own, low + own] = np.inf
        near = np.argpartition(d, k - 1, 1)[:, :k]
        v = np.take_along_axis(d, near, 1)
        o = np.lexsort((near, v))
        at[low : low + step], far[low : low + step] = np.take_along_axis(near, o, 1), np.take_along_axis(v, o, 1)
    return at, far


def grow(x: np.ndarray, near: tuple[np.ndarray, np.ndarray], core: np.ndarray, mutual: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, parent, reach): from row 0 on, always the row of least reach from those taken, as Prim does.

    The reach of j from i is the largest of their distance, the core distance of i and, if
    ``mutual``, that of j. A row that is taken reaches those of its list at once. What isn't
    listed is no nearer than the list's end, so the row waits with the others until the next row
    would be as far as that; then all that wait meet the rows left, in blocks. The result is that of a full
    matrix, ties included; memory is in proportion to the rows.
    """
    at, far = near
    n = len(x)
    end = np.maximum(core, far[:, -1]) if at.shape[1] < n - 1 else np.full(n, np.inf)
    reach, left = np.full(n, 1e300), np.ones(n, bool)  # taken rows: inf in reach, as they are out of the choice
    order, rank, parent, final = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64), np.full(n, np.inf)
    waiting, bar = [], np.inf

    def meet() -> None:
        rest = np.flatnonzero(left)
        step = max(1, BLOCK_BYTES // (8 * len(rest)))
        for low in range(0, len(waiting), step):
            rows = np.array(waiting[low : low + step])  # in the order taken
            w = np.maximum(distances(x[rows], x[rest]), core[rows, None])
            if mutual:
                np.maximum(w, core[rest], out=w)
            first = w.argmin(0)
            value, by = w[first, np.arange(len(rest))], rows[first]
            better = (value < reach[rest]) | ((value == reach[rest]) & (rank[by] < rank[parent[rest]]))
            reach[rest[better]], parent[rest[better]] = value[better], by[better]

    for t in range(n):
        i = int(reach.argmin())
        if reach[i] >= bar:
            meet()
            waiting, bar = [], np.inf
            i = int(reach.argmin())
        order[t], rank[i], left[i] = i, t, False
        final[i] = reach[i] if t else np.inf
        reach[i] = np.inf
        j = at[i]
        w = np.maximum(far[i], core[i])
        if mutual:
            w = np.maximum(w, core[j])
        better = left[j] & (w < reach[j])
        reach[j[better]], parent[j[better]] = w[better], i
        if end[i] < np.inf:
            waiting.append(i)
            bar = min(bar, end[i])
    return order, parent, final


def unit_rows(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, n, out=np.zeros_like(x), where=n > 0)


def reach_of(x: np.ndarray, at: np.ndarray | None = None) -> np.ndarray:
    """Mean distance to the nearest NEIGHBOURS rows, as they are; ``at``: twice as many candidates or more."""
    at = nearest(on_grid(x), 2 * NEIGHBOURS)[0] if at is None else at[:, : 2 * NEIGHBOURS]
    d = np.stack([np.linalg.norm(x - x[at[:, c]], axis=1) for c in range(at.shape[1])], 1)
    return np.sort(d, 1)[:, :NEIGHBOURS].mean(1)


def reach_rule(reach: np.ndarray) -> np.ndarray:
    mid = np.median(reach)
    return reach > REACH_FACTOR * mid if mid > 0 else np.zeros(len(reach), bool)


def _core(near: tuple[np.ndarray, np.ndarray], min_samples: int) -> np.ndarray:
    """Distance to the ``min_samples``-th nearest row, the row itself among them."""
    far = near[1]
    return far[:, min(min_samples - 2, far.shape[1] - 1)] if min_samples > 1 else np.zeros(len(far))


def hdbscan_labels(x: np.ndarray, min_cluster_size: int, min_samples: int = 1, near: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """HDBSCAN (Campello et al. 2013): excess-of-mass clusters, the root not among them; -1 is noise."""
    n = len(x)
    if n < 2:
        return np.full(n, -1)
    x = on_grid(x)
    near = near or nearest(x, max(LISTED, min_samples))
    order, parent, reach = grow(x, near, _core(near, min_samples), mutual=True)
    edges = sorted(zip(reach[order[1:]].tolist(), parent[order[1:]].tolist(), order[1:].tolist()))
    # Single linkage, as a binary tree over points 0..n-1 and merges n..2n-2.
    top, kids, size, height = list(range(n)), {}, {i: 1 for i in range(n)}, {}

    def root(i: int) -> int:
        while top[i] != i:
            top[i] = top[top[i]]
            i = top[i]
        return i

    for w, a, b in edges:
        a, b, new = root(a), root(b), len(top)
        top.append(new)
        top[a] = top[b] = new
        kids[new], size[new], height[new] = (a, b), size[a] + size[b], w

    def points(node: int) -> list[int]:
        out, todo = [], [node]
        while todo:
            t = todo.pop()
            out += [t] if t < n else []
            todo += kids.get(t, ())
        return out

    # Condense: a split counts if both sides reach the least size; else points fall out.
    lam = lambda h: 1 / h if h > 0 else np.inf
    birth, stability, children, members = {0: 0.0}, {0: 0.0}, {0: []}, {0: []}
    todo = [(2 * n - 2, 0)]
    while todo:
        node, c = todo.pop()
        if node < n:
            continue
        a, b = kids[node]
        at = lam(height[node])
        big = [k for k in (a, b) if size[k] >= min_cluster_size]
        gain = 0.0 if at == birth[c] else (at - birth[c] if np.isfinite(at) else 1e300)
        if len(big) == 2:
            stability[c] += gain * size[node]
            for k in big:
                new = len(birth)
                birth[new], stability[new], children[new], members[new] = at, 0.0, [], []
                children[c].append(new)
                todo.append((k, new))
            continue
        for k in (a, b):
            if k in big:
                todo.append((k, c))
            else:
                fallen = points(k)
                members[c] += fallen
                stability[c] += gain * len(fallen)
    chosen: dict[int, bool] = {}
    for c in sorted(birth, reverse=True):
        below = sum(stability[k] for k in children[c])
        chosen[c] = c != 0 and not (children[c] and below > stability[c])
        if not chosen[c] and c:
            stability[c] = below
    labels, next_label, todo = np.full(n, -1), 0, [0]
    while todo:
        c = todo.pop()
        if not chosen[c]:
            todo += children[c]
            continue
        inside, deep = [], [c]
        while deep:
            k = deep.pop()
            inside += members[k]
            deep += children[k]
        labels[inside], next_label = next_label, next_label + 1
    return labels


def optics_labels(x: np.ndarray, eps: float, min_samples: int, near: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """OPTICS ordering (Ankerst et al. 1999), clusters cut out as DBSCAN would at ``eps``."""
    n = len(x)
    if n < 2:
        return np.full(n, -1)
    x = on_grid(x)
    near = near or nearest(x, max(LISTED, min_samples))
    core = _core(near, min_samples)
    order, _, reach = grow(x, near, core, mutual=False)
    labels, now = np.full(n, -1), -1
    for i in order:
        if reach[i] > eps:
            if core[i] <= eps:
                now += 1
                labels[i] = now
        else:
            labels[i] = now
    return labels


def noise_of(x: np.ndarray, method: str) -> np.ndarray:
    """Noise of one song: unlabelled by the clustering and an outlier by reach."""
    n = len(x)
    x = unit_rows(x)
    near = nearest(on_grid(x), LISTED)
    reach = reach_of(x, near[0])
    if method == "hdbscan":
        labels = hdbscan_labels(x, max(3, min(5, n - 2)), near=near)
    elif method == "optics":
        labels = optics_labels(x, 2 * float(np.median(reach)), max(2, min(3, n - 2)), near)
    else:
        raise ValueError(f"unknown noise method {method!r}")
    return (labels == -1) & reach_rule(reach)


def song_flags(rows: DataFrame, method: str) -> DataFrame:
    """track_id, chunk_id, noise for every chunk of every song (short songs have none)."""

    def song(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        x = _vectors(t)
        flags = np.zeros(t.num_rows, bool) if x is None or len(x) < LEAST_TRACK_CHUNKS else noise_of(x, method)
        return pa.table({"track_id": t.column("track_id"), "chunk_id": t.column("chunk_id"), "noise": pa.array(flags)})

    return rows.select("track_id", "chunk_id", "v").groupBy("track_id").applyInArrow(song, "track_id bigint, chunk_id bigint, noise boolean")


def fit(rows: DataFrame, dataset: str, method: str, most: int | None = MOST_VECTORS) -> DataFrame:
    """Full fit of a dataset: its flags as (dataset, method, chunk_id).

    More than ``most`` vectors are refused, as an interactive user would wait long; None takes any
    number, since songs are fitted one by one.
    """
    n = rows.count()
    if n < LEAST_VECTORS:
        raise ValueError(f"{dataset} has {n} vectors; {LEAST_VECTORS} are needed")
    if most is not None and n > most:
        raise ValueError(f"{dataset} has {n} vectors; at most {most} are fitted by default")
    return song_flags(rows, method).where("noise").select(F.lit(dataset).alias("dataset"), F.lit(method).alias("method"), "chunk_id")


def refit(rows: DataFrame, kept: DataFrame, track_ids: Sequence[int] | DataFrame, method: str) -> DataFrame:
    """Flags (chunk_id) after fitting only some tracks: theirs anew, the others' as kept; flags of
    chunks that no longer exist go."""
    ids = track_ids if isinstance(track_ids, DataFrame) else rows.sparkSession.createDataFrame([(int(t),) for t in track_ids], "track_id bigint")
    part = rows.join(F.broadcast(ids) if not isinstance(track_ids, DataFrame) else ids, "track_id", "left_semi")
    alive = kept.join(rows.select("chunk_id"), "chunk_id", "left_semi")
    return reads.merge_flags(alive, part.select("chunk_id"), song_flags(part, method).where("noise"))


def pending(rows: DataFrame, stored: DataFrame) -> DataFrame:
    """Tracks of a dataset (models and reductions alike) whose chunks or vectors changed since the run."""
    return reads.pending_tracks(stored, reads.signatures(rows), LEAST_TRACK_CHUNKS)
