"""t-SNE and UMAP of any number of vectors: vectors and their graph stay in the cluster.

Nearest vectors come from block products, as in ``nearest``: a tile leaves k per row, packed, and tiles
are merged LEFT rows at a time. Weights are those of the exact methods. The graph is kept as one packed
row per LEFT vectors. Every step of the descent is a job over it: places (k numbers a vector, the model
of this fit) are broadcast, and each task returns what its edges do to its own rows. The driver holds
places, speeds and gains, never vectors or edges. t-SNE's repulsion is that of all pairs, interpolated
on a grid (Linderman et al. 2019) beside the job, so a step grows with the vectors.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import derive, reads
from .nearest import BLOCK_BYTES, LEAST_BLOCKS, PRODUCT_BYTES, _whole

#: Rows of a packed part of the lists and of the graph.
LEFT = 1024
#: Least cells a side of the grid, nodes of each, and nodes of the grid at most (cells widen beyond). Cells
#: have 0.4 of a unit where the grid has so many nodes at most, else 0.8.
CELLS, NODES, GRID_MOST, GRID_FINE = 50, 3, 1 << 22, 450_000
#: Cells a side that transforms are fast for.
SMOOTH = sorted(2**a * 3**b * 5**c for a in range(22) for b in range(14) for c in range(10) if 2**a * 3**b * 5**c <= GRID_MOST)
#: Rows and columns of a block of products, columns that bound what a row's k-th distance can be, and rows
#: under that bound at most; of a row that has more, as of many equal ones, all are measured.
ROWS, COLUMNS, SAMPLE, UNDER = 256, 2048, 8192, 2048
#: Distances measured at once.
MEASURED = 1 << 16


def indexed(rows: DataFrame) -> tuple[DataFrame, int]:
    """(idx from 0 in the order of chunk_id, chunk_id, standardised v; kept on the executors, their number)."""
    own = rows.where("v IS NOT NULL").select(F.col("chunk_id").cast("bigint").alias("chunk_id"), "v")
    z = reads.numbered(derive.standardize(own), "chunk_id", "idx").select("idx", "chunk_id", "v").persist(StorageLevel.MEMORY_AND_DISK)
    return z, z.count()


class Finder:
    """The nearest of the rows of y: products of single precision leave the few that can be among them (by
    the bound of their rounding), and these are measured in double precision."""

    def __init__(self, y: np.ndarray) -> None:
        self.y, sq = y, (y * y).sum(1)
        self.most = float(np.sqrt(sq.max()))
        wide = -(-len(y) // 8) * 8
        self.right = np.zeros((wide, y.shape[1] + 2), np.float32)
        self.right[: len(y), :-2], self.right[:, -2], self.right[: len(y), -1], self.right[len(y) :, -1] = y, 1, sq, np.inf
        self.sample = self.right[: len(y) : max(1, len(y) // SAMPLE)]
        self.products, self.under = np.empty(ROWS * COLUMNS, np.float32), np.empty(ROWS * COLUMNS, bool)

    def __call__(self, x: np.ndarray, place: np.ndarray, at: np.ndarray, to: np.ndarray, few: int) -> tuple[np.ndarray, np.ndarray]:
        """(places in y, squared distances) of each row's ``few`` nearest but itself; inf if it has fewer."""
        rows, sq = len(x), (x * x).sum(1)
        itself = np.where(to[np.minimum(place, len(to) - 1)] == at, place, -1)
        left = np.empty((rows, x.shape[1] + 2), np.float32)
        left[:, :-2], left[:, -2], left[:, -1] = -2 * x, sq, 1
        slack = (x.shape[1] + 8) * 2.0**-23 * (np.sqrt(sq) + self.most) ** 2
        share = few * len(self.sample) / len(self.y)
        nth = int(share + 4 * np.sqrt(share) + 5)
        bound = np.full(rows, np.inf)
        if nth < len(self.sample):
            bound = np.partition(left @ self.sample.T, nth, 1)[:, nth].astype(np.float64) + slack
        limit = (bound + slack).astype(np.float32)
        limit = np.nextafter(limit, np.float32(np.inf))[:, None]
        found = []
        for low in range(0, len(self.right), COLUMNS) if np.isfinite(bound).all() else ():
            right = self.right[low : low + COLUMNS]
            shape = rows, len(right)
            got = np.matmul(left, right.T, out=self.products[: rows * len(right)].reshape(shape))
            under = np.less_equal(got, limit, out=self.under[: got.size].reshape(shape)).ravel()
            eight = np.flatnonzero(under.view(np.uint64))  # few are under the limit
            which, bit = np.nonzero(under.reshape(-1, 8)[eight])
            i, j = np.divmod(eight[which] * 8 + bit, len(right))
            found.append((i.astype(np.uint16), j + low))
            if sum(len(c) for c, _ in found) > rows * UNDER:
                found = []
                break
        i, j = (np.concatenate(c) for c in zip(*found)) if found else (np.zeros(0, np.uint16), np.zeros(0, np.int64))
        order = np.argsort(i, kind="stable")
        i, j = i[order], j[order]
        keep = (j != itself[i]) & (np.bincount(i, minlength=rows) <= UNDER)[i]
        i, j = i[keep], j[keep]
        d = np.concatenate([np.zeros(0), *(((x[i[c : c + MEASURED]] - self.y[j[c : c + MEASURED]]) ** 2).sum(1) for c in range(0, len(i), MEASURED))])
        enough = np.bincount(i, d <= bound[i], rows) >= few
        count = np.bincount(i, minlength=rows)
        near, far = np.zeros((rows, max(few, count.max())), np.int64), np.full((rows, max(few, count.max())), np.inf)
        slot = np.arange(len(i)) - (np.cumsum(count) - count)[i]
        near[i, slot], far[i, slot] = j, d
        best = np.argpartition(far, few - 1, 1)[:, :few]
        near, far = np.take_along_axis(near, best, 1), np.take_along_axis(far, best, 1)
        rest, step = np.flatnonzero(~enough), max(1, PRODUCT_BYTES // (8 * len(self.y)))
        for r in (rest[low : low + step] for low in range(0, len(rest), step)):
            d = np.maximum(sq[r, None] + (self.y * self.y).sum(1) - 2 * x[r] @ self.y.T, 0)
            d[itself[r, None] == np.arange(len(self.y))] = np.inf
            near[r] = np.argpartition(d, few - 1, 1)[:, :few]
            far[r] = np.take_along_axis(d, near[r], 1)
        return near, far


def near_lists(z: DataFrame, n: int, d: int, k: int) -> DataFrame:
    """piece (LEFT rows from piece * LEFT on), others, far: per tile the k nearest others of each row and
    their squared distances, packed as (rows, k); -1 and inf where a tile has fewer."""
    each = min(BLOCK_BYTES // (8 * d), -(-n // LEAST_BLOCKS))
    each = max(1, -(-each // LEFT)) * LEFT
    blocks = -(-n // each)
    block, every = F.floor(F.col("idx") / each), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<bigint>"))
    left = z.select("idx", "v", block.alias("i"), every.alias("j"))
    right = z.select(F.col("idx").alias("b_idx"), F.col("v").alias("b_v"), every.alias("b_i"), block.alias("b_j"))

    def tile(a: pa.Table, b: pa.Table) -> pa.Table:
        def side(t: pa.Table, idx: str, v: str) -> tuple[np.ndarray, np.ndarray]:
            at, x = t.column(idx).to_numpy(), derive.matrix_of(_whole(t.column(v)))
            order = np.argsort(at)
            return at[order], x[order]

        (at, x), (to, y) = side(a, "idx", "v"), side(b, "b_idx", "b_v")
        find, out = Finder(y), []
        for low in range(0, len(at), LEFT):
            mine = slice(low, min(low + LEFT, len(at)))
            others, far = np.full((mine.stop - low, k), -1, np.int64), np.full((mine.stop - low, k), np.inf)
            few = min(k, len(to))
            for s in range(low, mine.stop, ROWS):
                some = slice(s, min(s + ROWS, mine.stop))
                own = slice(s - low, some.stop - low)
                near, far[own, :few] = find(x[some], np.searchsorted(to, at[some]), at[some], to, few)
                others[own, :few] = to[near]
            out.append((int(at[low]) // LEFT, others.tobytes(), far.tobytes()))
        piece, others, far = zip(*out)
        return pa.table({"piece": pa.array(piece, pa.int64()), "others": pa.array(others, pa.binary()), "far": pa.array(far, pa.binary())})

    return left.groupBy("i", "j").cogroup(right.groupBy("b_i", "b_j")).applyInArrow(tile, "piece bigint, others binary, far binary")


def graph(lists: DataFrame, k: int, weigh: Callable[[np.ndarray], np.ndarray], union: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> RDD:
    """(piece, edges of each row, tails, weights) as packed arrays: ``weigh`` gives the weights of a row's distances
    (ascending), ``union`` joins the one or two that a pair has from both its ends. Kept on the executors."""

    def edges(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        unpack = lambda name, kind: np.concatenate([np.frombuffer(x.as_buffer(), kind).reshape(-1, k) for x in t.column(name)], 1)
        others, far = unpack("others", np.int64), unpack("far", np.float64)
        order = np.lexsort((others, far), axis=1)[:, :k]
        others, w = np.take_along_axis(others, order, 1).ravel(), weigh(np.sqrt(np.take_along_axis(far, order, 1))).ravel()
        piece = key[0].as_py()
        head = piece * LEFT + np.repeat(np.arange(len(far)), k)
        order = np.argsort(others // LEFT, kind="stable")  # from the other end: a row for each of their parts
        there = others[order] // LEFT
        first = np.flatnonzero(np.diff(there, prepend=-1))
        out = [(piece, head, others, w)]
        out += [(int(there[a]), others[order[a:b]], head[order[a:b]], w[order[a:b]]) for a, b in zip(first, np.append(first[1:], len(there)))]
        return pa.table({"piece": pa.array([o[0] for o in out], pa.int64()), **{c: pa.array([o[n].tobytes() for o in out], pa.binary()) for n, c in enumerate(("head", "tail", "w"), 1)}})

    def pack(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        head, tail, w = (np.concatenate([np.frombuffer(x.as_buffer(), kind) for x in t.column(c)]) for c, kind in (("head", np.int64), ("tail", np.int64), ("w", np.float64)))
        order = np.lexsort((tail, head))
        head, tail, w = head[order], tail[order], w[order]
        first = np.flatnonzero(np.append(True, (np.diff(head) != 0) | (np.diff(tail) != 0)))
        w = union(w, first).astype(np.float32)
        packed = (np.bincount(head[first] % LEFT).astype(np.int32).tobytes(), tail[first].astype(np.int32).tobytes(), w.tobytes())
        return pa.table({"piece": pa.array([key[0].as_py()], pa.int64()), **{c: pa.array([x], pa.binary()) for c, x in zip(("each", "tail", "w"), packed)}})

    sent = lists.groupBy("piece").applyInArrow(edges, "piece bigint, head binary, tail binary, w binary")
    packed = sent.groupBy("piece").applyInArrow(pack, "piece bigint, each binary, tail binary, w binary")
    pieces = lists.sparkSession.sparkContext.defaultParallelism
    kept = packed.repartition(2 * pieces).rdd.map(lambda r: (r["piece"], bytes(r["each"]), bytes(r["tail"]), bytes(r["w"])))
    return kept.persist(StorageLevel.MEMORY_AND_DISK)


def _edges(part: tuple) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """(first row, edges of each row, their tails, weights); every row has its nearest."""
    return part[0] * LEFT, np.frombuffer(part[1], np.int32), np.frombuffer(part[2], np.int32), np.frombuffer(part[3], np.float32).astype(np.float64)


def _summed(at: np.ndarray, x: np.ndarray, rows: int) -> np.ndarray:
    return np.stack([np.bincount(at, c, rows) for c in x.T], 1)


def start(z: DataFrame, n: int, k: int) -> np.ndarray:
    """First principal components of all rows, by idx; missing ones are 0."""
    out, _ = derive.pca(z.select("idx", "v"), k)

    def pack(batches):
        for b in batches:
            if b.num_rows:
                x = np.asarray(derive.matrix_of(b.column(1)), np.float64)
                yield pa.RecordBatch.from_arrays([pa.array([b.column(0).to_numpy().astype(np.int64).tobytes()]), pa.array([x.tobytes()])], names=["idx", "x"])

    y = np.zeros((n, k))
    for r in out.select("idx", "v").mapInArrow(pack, "idx binary, x binary").toLocalIterator():
        at = np.frombuffer(r["idx"], np.int64)
        x = np.frombuffer(r["x"], np.float64).reshape(len(at), -1)
        y[at, : x.shape[1]] = x
    return y


def step(kept: RDD, sent: object, move: Callable[[tuple, object], np.ndarray], y: np.ndarray) -> np.ndarray:
    """``move`` of every part of the graph, by idx."""
    share = kept.context.broadcast(sent)
    out = np.zeros_like(y)
    for low, x in kept.map(lambda part: (part[0] * LEFT, move(part, share.value))).collect():
        out[low : low + len(x)] = x
    share.destroy()
    return out


class Repulsion:
    """Sums over all places y_j of q and q^2 (y_i - y_j), q = 1 / (1 + |y_i - y_j|^2), by a grid."""

    def __init__(self, y: np.ndarray) -> None:
        k = y.shape[1]
        self.low = y.min(0)
        span = max(float((y.max(0) - self.low).max()), 1e-9)
        most = GRID_MOST ** (1 / k) // NODES
        fine = min(2.5 * span, GRID_FINE ** (1 / k) // NODES)
        wanted = min(max(CELLS, np.ceil(fine), np.ceil(1.25 * span)), most)
        self.cells = next((c for c in SMOOTH if wanted <= c <= most), int(most))
        self.side = span / self.cells
        n, gap = self.cells * NODES, self.side / NODES
        charge = np.zeros(n**k)
        for at, w in self._nodes(y):
            charge += np.bincount(at, w, n**k)
        r = np.arange(2 * n) * gap
        r[n:] -= 2 * n * gap
        r[n] = 0  # no two nodes are so far apart
        r = np.ix_(*[r] * k)
        q = 1 / (1 + sum(x * x for x in r))
        axes = tuple(range(k))
        turn = lambda x: np.fft.rfftn(x, [2 * n] * k, axes)

        def back(x: np.ndarray) -> np.ndarray:
            for a in axes[:-1]:
                x = np.fft.ifft(x, axis=a)[(slice(None),) * a + (slice(0, n),)]
            return np.fft.irfft(x, 2 * n)[..., :n].ravel()

        charge = turn(charge.reshape([n] * k))
        # The transform of real numbers is one half; all but its two sides count twice.
        power = (charge.real**2 + charge.imag**2) * turn(q).real
        #: Sum of q over all ordered pairs of different places.
        self.total = max(float(2 * power.sum() - power[..., 0].sum() - power[..., -1].sum()) / (2 * n) ** k - len(y), 1e-12)
        q *= q
        #: Sum of q^2 (y_i - y_j) at every node.
        self.field = [back(charge * turn(q * x)) for x in r]

    def _nodes(self, y: np.ndarray):
        """(node, weight) of every place, for each of the nodes that it lies among."""
        u = (y - self.low) / self.side
        cell = np.clip(np.floor(u).astype(np.int64), 0, self.cells - 1)
        u -= cell
        p = (np.arange(NODES) + 0.5) / NODES
        w = [np.prod([(u - p[o]) / (p[m] - p[o]) for o in range(NODES) if o != m], axis=0) for m in range(NODES)]
        for nodes in product(range(NODES), repeat=y.shape[1]):
            at, weight = np.zeros(len(y), np.int64), np.ones(len(y))
            for a, m in enumerate(nodes):
                at, weight = at * (self.cells * NODES) + cell[:, a] * NODES + m, weight * w[m][:, a]
            yield at, weight

    def push(self, y: np.ndarray) -> np.ndarray:
        """Sum of q^2 (y_i - y_j) over all j."""
        got = np.zeros((y.shape[1], len(y)))
        for at, w in self._nodes(y):
            for out, field in zip(got, self.field):
                out += field[at] * w
        return got.T


def tsne_pull(part: tuple, y: list[np.ndarray], more: float) -> np.ndarray:
    """What a part's edges add to the gradient; ``y`` has an array per component."""
    low, each, tail, p = _edges(part)
    first = np.cumsum(each) - each
    d = [np.repeat(c[low : low + len(each)], each) - c[tail] for c in y]
    w = more * p / (1 + sum(c * c for c in d))
    return np.stack([np.add.reduceat(w * c, first) for c in d], 1)


def pushed(y: np.ndarray) -> np.ndarray:
    far = Repulsion(y)
    return far.push(y) / far.total


def tsne(rows: DataFrame, k: int, perplexity: float, steps: int) -> DataFrame:
    z, n = indexed(rows)
    perplexity = min(perplexity, max(5.0, (n - 1) / 4), n - 1.5)
    near = min(n - 1, int(3 * perplexity) + 1)
    union = lambda w, first: np.add.reduceat(w, first) / (2 * n)
    kept = graph(near_lists(z, n, _size(z), near), near, lambda d: derive.perplexed(d, perplexity), union)
    y = start(z, n, k)
    y = y / max(y[:, 0].std(), 1e-12) * 1e-2
    move, gain, rate = np.zeros_like(y), np.ones_like(y), max(n / 48, 50)
    with ThreadPoolExecutor(1) as aside:
        for t in range(steps):
            more = 12.0 if t < 100 else 1.0
            push = aside.submit(pushed, y)  # while the job runs
            pull = step(kept, list(np.ascontiguousarray(y.T)), lambda part, sent, more=more: tsne_pull(part, sent, more), y)
            grad = 4 * (pull - push.result())
            gain = np.maximum(np.where(np.sign(grad) != np.sign(move), gain + 0.2, gain * 0.8), 0.01)
            move = (0.5 if t < 100 else 0.8) * move - rate * gain * grad
            y = y + move
    return _placed(z, kept, y)


def umap_move(part: tuple, y: np.ndarray, t: int, a: float, b: float) -> np.ndarray:
    """Pulls along the edges drawn for this step, and five pushes from others for each."""
    low, each, tail, w = _edges(part)
    head = np.repeat(np.arange(len(each)), each)
    rng = np.random.default_rng([t, low])
    mine = y[low : low + LEFT]
    on = rng.random(len(head)) < w  # a row's nearest has weight 1
    i = head[on]
    d = mine[i] - y[tail[on]]
    r = (d * d).sum(1)
    pull = np.where(r > 0, -2 * a * b * np.maximum(r, 1e-12) ** (b - 1) / (1 + a * np.maximum(r, 1e-12) ** b), 0)
    out = _summed(i, np.clip(pull[:, None] * d, -4, 4), len(mine))
    for _ in range(5):
        o = rng.integers(0, len(y), len(i))
        d = mine[i] - y[o]
        r = (d * d).sum(1)
        push = np.where(i + low != o, 2 * b / ((0.001 + r) * (1 + a * np.maximum(r, 1e-12) ** b)), 0)
        out += _summed(i, np.clip(push[:, None] * d, -4, 4), len(mine))
    return out


def umap(rows: DataFrame, k: int, n_neighbors: int, min_dist: float, steps: int) -> DataFrame:
    z, n = indexed(rows)
    near = min(n_neighbors, n - 1)
    union = lambda w, first: 1 - np.multiply.reduceat(1 - w, first)
    kept = graph(near_lists(z, n, _size(z), near), near, derive.fuzzy, union)
    a, b = derive.curve(min_dist)
    y = start(z, n, k)
    y = y / max(np.abs(y).max(), 1e-12) * 10 + np.random.default_rng(0).normal(0, 1e-4, (n, k))
    for t in range(steps):
        y = y + (1 - t / steps) / max(1.0, near / 4) * step(kept, y, lambda part, y, t=t: umap_move(part, y, t, a, b), y)
    return _placed(z, kept, y)


def _size(z: DataFrame) -> int:
    return z.select(F.size("v")).first()[0]


def _placed(z: DataFrame, kept: RDD, y: np.ndarray) -> DataFrame:
    """(chunk_id, v) where the ids are; vectors and graph are released."""
    ids = z.select("idx", "chunk_id").persist(StorageLevel.MEMORY_AND_DISK)
    ids.count()
    kept.unpersist()
    z.unpersist()
    at = z.sparkSession.sparkContext.broadcast(y)

    def place(batches):
        for b in batches:
            v = at.value[b.column(0).to_numpy()]
            ends = pa.array(np.arange(len(v) + 1) * v.shape[1], pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(1), pa.ListArray.from_arrays(ends, pa.array(v.ravel()))], names=["chunk_id", "v"])

    return ids.mapInArrow(place, "chunk_id bigint, v array<double>")
