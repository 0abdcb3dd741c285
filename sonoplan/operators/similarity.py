"""Searches: rank tracks by similarity to a seed track or to several.

Seeds and references are stated, bounded sets (one track, at most a few hundred): their
vectors travel with the plan, and every other chunk is met by them where it is stored.
All scans keep only the columns and models they need; metadata joins after the top k. Sets of
chunks meet the seed's as matrix products over Arrow batches (vectors have hundreds of
components, for which array expressions are far slower); everything else is expressions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalars, vectors
from ..plans.library import Library
from ..schema import Dataset, algorithm_of
from . import reads
from .derive import matrix_of

#: Cosines are compared after rounding, so that equal objectives stay ties in any engine.
TIE_DIGITS = 9


def centroids(track_vectors: DataFrame) -> DataFrame:
    """Unit mean vector of each (track, model): track_id, model, v; zero where the mean is zero."""
    return vectors.average(track_vectors, ["track_id", "model"]).select("track_id", "model", vectors.unit("mean").alias("v"))


def weight_vectors(weights: DataFrame) -> DataFrame:
    """One array of weights per model."""
    z = weights.groupBy("model").agg(F.sort_array(F.collect_list(F.struct("component_index", "weight"))).alias("z"))
    return z.select("model", F.transform("z", lambda z: z["weight"]).alias("w"))


def weighted(rows: DataFrame, weights: DataFrame | None) -> DataFrame:
    """``v`` scaled by the roots of its model's learned weights, where there are any."""
    if weights is None:
        return rows
    w = F.broadcast(weight_vectors(weights))  # a row per model
    return rows.join(w, "model", "left").withColumn("v", vectors.scale("v", "w")).drop("w")


def top(scores: DataFrame, lib: Library, seed: int | None, method: str, limit: int) -> DataFrame:
    """The best ``max(1, limit)`` by score, then track id; metadata after that; the seed first at 1."""
    k = max(1, int(limit))
    best = scores.orderBy(F.col("score").desc(), "track_id").limit(k).withColumn("ord", F.lit(1))
    if seed is not None:
        best = best.unionByName(lib.spark.range(1).select(F.lit(seed).cast("bigint").alias("track_id"), F.lit(1.0).alias("score"), F.lit(0).alias("ord")))
    out = best.join(lib.tracks.select("track_id", "path", "filename", "artist", "title"), "track_id")
    return out.select("track_id", "path", "filename", "artist", "title", "score", F.lit(method).alias("method"), "ord").orderBy("ord", F.col("score").desc(), "track_id").drop("ord")


def centroid_scores(aggregates: DataFrame, seed: int, model: str, weights: DataFrame | None = None) -> DataFrame:
    """Cosine of every other track's centroid to the seed's; other sizes are skipped."""
    c = aggregates.where(F.col("model") == model).select("track_id", "model", "v")
    c = weighted(c, weights if Dataset(model).weighted else None)
    own = F.broadcast(c.where(F.col("track_id") == seed).select(F.col("v").alias("s")))
    rest = c.where(F.col("track_id") != seed).crossJoin(own).where(F.size("v") == F.size("s"))  # one seed row
    return rest.select("track_id", vectors.cosine("v", "s").alias("score"))


def centroid_matrix(aggregates: DataFrame, model: str) -> DataFrame:
    """Cosines of all pairs of tracks (a < b) of a model, for libraries of a stated size.

    The left side is dealt out and the right side broadcast only under the engine's own size
    threshold; otherwise the pairs are formed block by block by hash of both ids.
    """
    c = aggregates.where(F.col("model") == model).select("track_id", vectors.unit("v").alias("v"))
    blocks = 8
    a = c.select(F.col("track_id").alias("a"), F.col("v").alias("x")).withColumn("i", F.pmod("a", F.lit(blocks))).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    b = c.select(F.col("track_id").alias("b"), F.col("v").alias("y")).withColumn("j", F.pmod("b", F.lit(blocks))).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    return a.join(b, ["i", "j"]).where("a < b").select("a", "b", vectors.dot("x", "y").alias("score"))


def _among(column: str, tracks: int | Sequence[int]) -> Column:
    return F.col(column).isin([tracks] if isinstance(tracks, int) else list(tracks))


def objectives(track_vectors: DataFrame, aggregates: DataFrame, tracks: int | Sequence[int]) -> DataFrame:
    """Cosine of each chunk of a track (or of several) to the track's centroid, one value per model of
    the track in the order of names; -1 where the chunk lacks the model: track_id, chunk_id, objectives."""
    own = track_vectors.where(_among("track_id", tracks))
    c = aggregates.where(_among("track_id", tracks)).select("track_id", "model", F.col("v").alias("c"))
    cos = own.join(c, ["track_id", "model"]).select("track_id", "chunk_id", "model", F.round(vectors.cosine("v", "c"), TIE_DIGITS).alias("o"))
    names = cos.groupBy("track_id").agg(F.array_sort(F.collect_set("model")).alias("names"))
    per = cos.groupBy("track_id", "chunk_id").agg(F.map_from_entries(F.collect_list(F.struct("model", "o"))).alias("m")).join(names, "track_id")
    return per.select("track_id", "chunk_id", F.transform("names", lambda n: F.coalesce(F.element_at("m", n), F.lit(-1.0))).alias("objectives"))


def pareto_surface(points: DataFrame) -> DataFrame:
    """Points (chunk_id, objectives) that no other of their track dominates: as good in all, better in
    one. Ties stay. Without a track_id all points are one track's; ragged ones count as -inf where they end.
    """
    low = F.lit(float("-inf"))
    track = F.col("track_id") if "track_id" in points.columns else F.lit(0)
    points = points.withColumn("_t", track)
    both = points.select(F.col("_t").alias("_o"), F.col("objectives").alias("p"))
    pair = lambda f: F.forall(F.zip_with("p", "objectives", lambda x, y: F.struct(F.coalesce(x, low).alias("x"), F.coalesce(y, low).alias("y"))), f)
    better = pair(lambda z: z["x"] >= z["y"]) & ~pair(lambda z: z["x"] <= z["y"])
    return points.join(both, (F.col("_t") == F.col("_o")) & better, "left_anti").drop("_t")


def surface_single(track_vectors: DataFrame, aggregates: DataFrame, tracks: int | Sequence[int], model: str) -> DataFrame:
    """Chunks of a track (or of several) that are nearest to its centroid in one model, with their cosine."""
    own = track_vectors.where(_among("track_id", tracks) & (F.col("model") == model))
    c = aggregates.where(_among("track_id", tracks) & (F.col("model") == model)).select("track_id", F.col("v").alias("c"))
    cos = own.join(c, "track_id").select("track_id", "chunk_id", F.round(vectors.cosine("v", "c"), TIE_DIGITS).alias("score"))
    return cos.withColumn("r", F.rank().over(W.partitionBy("track_id").orderBy(F.col("score").desc()))).where("r = 1").select("chunk_id", "score")


#: Unit vectors of a track: per model (size, matrix) for each size that occurs.
Matrices = dict[str, list[tuple[int, np.ndarray]]]


def seed_matrices(rows: DataFrame, seeds: Sequence[int]) -> dict[int, Matrices]:
    """Unit vectors of stated tracks on the driver, read in one pass."""
    by: dict[int, dict[str, dict[int, list]]] = {}
    own = rows.where(_among("track_id", seeds)).select("track_id", "model", vectors.unit("v").alias("v"), "chunk_id")
    for b in own.orderBy("track_id", "model", "chunk_id").toArrow().to_batches():
        off, flat = b.column("v").offsets.to_numpy(), b.column("v").values.to_numpy(zero_copy_only=False)
        track, model, size = b.column("track_id").to_numpy(), np.array(b.column("model").to_pylist(), object), np.diff(off)
        ends = np.flatnonzero((np.diff(track, append=track[-1:] + 1) != 0) | np.append(model[1:] != model[:-1], True)) + 1 if len(track) else []
        for low, end in zip([0, *ends], ends):
            for d in np.unique(size[low:end]).tolist():
                k = low + np.flatnonzero(size[low:end] == d)
                by.setdefault(int(track[low]), {}).setdefault(model[low], {}).setdefault(d, []).append(flat[off[k][:, None] + np.arange(d)])
    return {t: {m: [(d, np.concatenate(v).astype(np.float64)) for d, v in sorted(sizes.items())] for m, sizes in models.items()} for t, models in by.items()}


_MET = "seed bigint, track_id bigint, model string, n bigint, low double, misfit boolean, best array<double>"
#: Seed vectors of several seeds that go together; bytes of cosines at once, and of rows that leave together.
MEET_COLUMNS, MEET_BYTES = 1024, 16 << 20


def _groups(own: dict[int, Matrices], model: str) -> Iterator[list[tuple[int, list[tuple[int, np.ndarray]]]]]:
    """The seeds that have a model, so many at once that their vectors stay under MEET_COLUMNS."""
    group, width = [], 0
    for seed, models in own.items():
        if parts := models.get(model):
            size = sum(len(s) for _, s in parts)
            if group and width + size > MEET_COLUMNS:
                yield group
                group, width = [], 0
            group.append((seed, parts))
            width += size
    if group:
        yield group


def _meet(rows: DataFrame, own: dict[int, Matrices]) -> DataFrame:
    """Cosines of all chunks with the seeds' vectors, block by block as matrix products of MEET_BYTES.

    A row per batch, seed, track and model: n chunks, ``low`` the sum of their least costs, ``best``
    the highest cosine that each seed vector meets, ``misfit`` if some sizes differ (those
    cosines are 0). What leaves a batch doesn't grow with its pairs.
    """
    names = sorted({m for models in own.values() for m in models})

    def sent(out: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*out)) or [()] * 7
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.float64(), pa.bool_(), pa.list_(pa.float64()))
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=[f.split()[0] for f in _MET.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            track, model = b.column(0).to_numpy(), np.array(b.column(1).to_pylist(), object)
            off = b.column(2).offsets.to_numpy()
            flat = b.column(2).values.to_numpy(zero_copy_only=False)
            out, held = [], 0
            for m in names:
                mine = np.flatnonzero(model == m)
                if not len(mine):
                    continue
                mine = mine[np.argsort(track[mine], kind="stable")]
                size, tracks = np.diff(off)[mine], track[mine]
                ends = np.flatnonzero(np.diff(tracks, append=tracks[-1] + 1)) + 1
                units: dict[int, tuple[np.ndarray, np.ndarray]] = {}
                for group in _groups(own, m):
                    place, spans = 0, []
                    wide: dict[int, list[tuple[int, int, np.ndarray]]] = {}
                    for g, (seed, parts) in enumerate(group):
                        start = place
                        for d, s in parts:
                            wide.setdefault(d, []).append((g, place, s))
                            place += len(s)
                        spans.append((seed, start, place, np.ones(len(mine), bool) if len(parts) > 1 else size != parts[0][0]))
                    best, high = np.full((len(ends), place), -np.inf), np.full((len(group), len(mine)), -np.inf)
                    step = max(1, MEET_BYTES // (8 * len(mine)))
                    for d, parts in wide.items():
                        if d not in units:
                            k = np.flatnonzero(size == d)
                            v = flat[off[mine[k]][:, None] + np.arange(d)].astype(np.float64)
                            norm = np.linalg.norm(v, axis=1, keepdims=True)
                            units[d] = k, np.divide(v, norm, out=np.zeros_like(v), where=norm > 0)
                        k, v = units[d]
                        theirs = parts[0][2] if len(parts) == 1 else np.concatenate([s for _, _, s in parts])
                        columns = np.concatenate([np.arange(at, at + len(s)) for _, at, s in parts])
                        owner = np.repeat([g for g, _, _ in parts], [len(s) for _, _, s in parts])
                        for low in range(0, len(columns), step):
                            some = slice(low, low + step)
                            cos = v @ theirs[some].T
                            np.clip(cos, -1, 1, out=cos)
                            if len(k) < len(mine):
                                met, cos = cos, np.zeros((len(mine), len(columns[some])))
                                cos[k] = met
                            best[:, columns[some]] = np.maximum.reduceat(cos, np.append(0, ends[:-1]), axis=0)
                            first = np.flatnonzero(np.diff(owner[some], prepend=-1))
                            own_of = owner[some][first]
                            most = cos.max(1)[None] if len(first) == 1 else np.maximum.reduceat(cos, first, axis=1).T
                            high[own_of] = np.maximum(high[own_of], most)
                    begin = 0
                    for t, end in enumerate(ends):
                        for g, (seed, first, last, misfit) in enumerate(spans):
                            out.append((seed, int(tracks[begin]), m, int(end - begin), float((1 - high[g, begin:end]).sum()), bool(misfit[begin:end].any()), best[t, first:last]))
                            held += 8 * (last - first)
                        begin = end
                        if held >= MEET_BYTES:
                            yield sent(out)
                            out, held = [], 0
            yield sent(out)

    mine = rows.where(F.col("model").isin(names)) if names else rows.limit(0)
    return mine.select("track_id", "model", "v").mapInArrow(run, _MET)


def _best_mean(met: DataFrame, value) -> DataFrame:
    """Per seed, track and model the mean over the seed's vectors of what they meet best."""
    best = met.select("seed", "track_id", "model", F.posexplode("best").alias("k", "x")).groupBy("seed", "track_id", "model", "k").agg(F.max("x").alias("x"))
    return best.groupBy("seed", "track_id", "model").agg(F.avg(value(F.col("x"))).alias("x"))


def psvi_scores(rows: DataFrame, seeds: Sequence[int], surface: DataFrame) -> DataFrame:
    """Per seed and candidate: over the common models the mean of (mean over the seed's surface chunks of
    the best cosine any chunk of the candidate reaches). Unequal sizes give 0."""
    own = seed_matrices(rows.where(_among("track_id", seeds)).join(surface.select("chunk_id"), "chunk_id", "left_semi"), seeds)
    met = _meet(rows.where(~_among("track_id", seeds)), own)
    return _best_mean(met, lambda x: x).groupBy("seed", "track_id").agg(F.avg("x").alias("score"))


def chamfer_scores(rows: DataFrame, seeds: Sequence[int]) -> DataFrame:
    """1 / (1 + mean over common models of the chamfer distance); models of unequal size drop out."""
    met = _meet(rows.where(~_among("track_id", seeds)), seed_matrices(rows, seeds))
    key = ["seed", "track_id", "model"]
    mine = met.groupBy(*key).agg((F.sum("low") / F.sum("n")).alias("a"), F.bool_or("misfit").alias("misfit")).where(~F.col("misfit"))
    d = mine.join(_best_mean(met, lambda x: 1 - x), key).groupBy("seed", "track_id").agg(F.avg((F.col("a") + F.col("x")) / 2).alias("d"))
    return d.select("seed", "track_id", (1 / (1 + F.col("d"))).alias("score"))


def unit_matrix(rows: Sequence | np.ndarray) -> np.ndarray:
    """Rows at unit length (zero rows stay); empty or ragged input is refused."""
    if not len(rows) or len({len(r) for r in rows}) != 1 or not len(rows[0]):
        raise ValueError("a set of vectors must be non-empty and of one size")
    a = np.asarray(rows, np.float64)
    n = np.linalg.norm(a, axis=1, keepdims=True)
    return np.divide(a, n, out=np.zeros_like(a), where=n > 0)


def cost_matrix(a: Sequence, b: Sequence) -> np.ndarray:
    return np.clip(1 - unit_matrix(a) @ unit_matrix(b).T, 0, 2)


def chamfer(a: Sequence, b: Sequence) -> float:
    c = cost_matrix(a, b)
    return float((c.min(1).mean() + c.min(0).mean()) / 2)


#: Costs that a transport keeps; those of larger sets are made anew in every round, as strips of so many.
KERNEL_CELLS = 1 << 21


def earth_movers(a: Sequence, b: Sequence, reg: float = 0.05) -> float:
    """Entropic transport cost between uniform masses (Sinkhorn); mean cost if it diverges.

    Costs are met in strips of columns, once a round: a strip's masses follow from the rows', and it adds
    its share to those of the next round. So memory grows with the sets, not with their product."""
    a, b = unit_matrix(a), unit_matrix(b)
    reg = min(max(reg, 0.01), 2.0)
    width = max(1, KERNEL_CELLS // len(a))

    def strip(low: int) -> tuple[slice, np.ndarray, np.ndarray]:
        c = np.clip(1 - a @ b[low : low + width].T, 0, 2)
        return slice(low, low + width), c, np.exp(-c / reg)

    kept = [strip(0)] if width >= len(b) else None
    strips = lambda: kept or map(strip, range(0, len(b), width))
    u, v = np.ones(len(a)), np.ones(len(b))
    with np.errstate(all="ignore"):
        for _ in range(500):
            met = np.zeros(len(a))
            for at, _, k in strips():
                v[at] = 1 / len(b) / (k.T @ u)
                met += k @ v[at]
            new = 1 / len(a) / met
            done = np.abs(new - u).sum() < 1e-9
            u = new
            if done:
                break
        total = sum(float(u @ (k * c) @ v[at]) for at, c, k in strips())
    return total if np.isfinite(total) else sum(float(c.sum()) for _, c, _ in strips()) / (len(a) * len(b))


def emd_scores(rows: DataFrame, seeds: int | Sequence[int], reg: float = 0.05, most: int | None = None) -> DataFrame:
    """As chamfer_scores by earth mover's distance, a candidate and model at a time (Arrow).

    With ``most`` and one seed, only candidates that can be among the ``most`` best are left, and
    transport is solved for these alone: see ``emd_candidates``.
    """
    seeds = [seeds] if isinstance(seeds, int) else list(seeds)
    own = {t: {m: parts for m, parts in models.items() if len(parts) == 1} for t, models in seed_matrices(rows, seeds).items()}
    rest = rows.where(~_among("track_id", seeds))
    score = (1 / (1 + F.col("d"))).alias("score")
    if most is None or len(seeds) != 1:
        return _transport(rest, own, reg).select("seed", "track_id", score)
    first, low = _emd_first(rest, own, reg, most)
    found = [r["track_id"] for r in first]
    d = _transport(rest.join(low.where(~_among("track_id", found)), "track_id", "left_semi"), own, reg)
    return rows.sparkSession.createDataFrame(first, _COSTS).unionByName(d).select("seed", "track_id", score)


_COSTS = "seed bigint, track_id bigint, d double"
#: Costs between two sets from which on their transport is solved by the whole cluster, a job a round; seed
#: vectors of the transports that are solved together; rows of a block of costs; vectors of a stored strip.
LARGE_CELLS, TOGETHER, BLOCK_ROWS, STRIP_ROWS = 1 << 24, 1 << 20, 1024, 1024


def _transport(rest: DataFrame, own: dict[int, Matrices], reg: float) -> DataFrame:
    """Mean over the common models of the transport costs: seed, track_id, d."""
    names = sorted({m for models in own.values() for m in models})
    rest = rest.where(F.col("model").isin(names) if names else F.lit(False)).select("track_id", "model", "v")
    sizes = rest.groupBy("track_id", "model").agg(F.count(F.lit(1)).alias("n"), F.min(F.size("v")).alias("d"), F.max(F.size("v")).alias("most")).where("d = most AND d > 0")
    fits = lambda m, d: [(seed, parts[0][1]) for seed, models in own.items() if (parts := models.get(m)) and parts[0][0] == d]
    widest = {m: max(len(parts[0][1]) for models in own.values() if (parts := models.get(m))) for m in names}
    least = F.element_at(F.create_map(*(F.lit(x) for m in names for x in (m, LARGE_CELLS // max(1, widest[m])))), F.col("model")) if names else F.lit(0)
    large = [(r["track_id"], r["model"], r["n"], r["d"]) for r in sizes.where(F.col("n") > least).collect() if fits(r["model"], r["d"])]

    def distance(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        column = t.column("v").combine_chunks()
        sizes = np.unique(np.diff(column.offsets.to_numpy()))
        theirs = matrix_of(column) if len(sizes) == 1 else None
        found = []
        for seed, models in own.items():
            for d, mine in models.get(key[1].as_py(), ()):
                if theirs is not None and d == sizes[0] > 0:
                    found.append((seed, key[0].as_py(), earth_movers(mine, theirs, reg)))
        seed, track, d = zip(*found) if found else ((), (), ())
        return pa.table({"seed": pa.array(seed, pa.int64()), "track_id": pa.array(track, pa.int64()), "d": pa.array(d, pa.float64())})

    small = rest
    if large:
        spark = rest.sparkSession
        which = F.broadcast(spark.createDataFrame([(t, m) for t, m, _, _ in large], "track_id bigint, model string"))
        small = rest.join(which, ["track_id", "model"], "left_anti")
        apart = [(seed, track, m, n, mine) for track, m, n, d in large for seed, mine in fits(m, d)]
        costs = large_transports(rest.join(which, ["track_id", "model"], "left_semi"), apart, reg)
        solved = spark.createDataFrame([(seed, track, d) for (seed, track, *_), d in zip(apart, costs)], _COSTS)
    d = small.groupBy("track_id", "model").applyInArrow(distance, _COSTS)
    return (d.unionByName(solved) if large else d).groupBy("seed", "track_id").agg(F.avg("d").alias("d"))


class Masses:
    """Logarithms of a seed's masses on their way to those that a round doesn't change.

    Rounds are mixed (Anderson 1965), so that a third of the plain ones is enough, first with costs of single
    precision; the end is judged in double precision as in ``earth_movers``, or where no digit is left."""

    KEPT, COARSE, ROUNDS = 5, 1e-7, 500

    def __init__(self, n: int) -> None:
        self.log, self.plain, self.coarse, self.rounds = np.zeros(n), None, True, 0
        self.at, self.gap, self.steps, self.new = None, np.inf, [], None

    def take(self, met: np.ndarray) -> None:
        """``met``: what the rows meet, of the masses of now."""
        with np.errstate(all="ignore"):
            new = -np.log(len(met) * met)
            u, old = np.exp(new), np.exp(self.log)
        self.rounds += 1
        if not np.isfinite(u).all() or not np.isfinite(new).all():
            if self.plain is not None:  # mixing went too far
                self.log, self.plain, self.at, self.steps = self.plain, None, None, []
            elif self.coarse:
                self.__init__(len(met))
                self.coarse = False
            else:
                self.new = new
            return
        gap, step = float(np.abs(u - old).sum()), new - self.log
        if self.coarse and (gap < self.COARSE * u.sum() or self.rounds > 30):
            self.coarse, self.log, self.plain, self.at, self.gap = False, new, None, None, np.inf
            return
        if not self.coarse and (gap < max(1e-9, 1e-14 * u.sum()) or self.rounds >= self.ROUNDS):
            self.new = new
            return
        if self.at is not None:
            self.steps = [*self.steps, (self.log - self.at[0], step - self.at[1])][-self.KEPT :]
        if gap > 2 * self.gap:
            self.steps = []
        self.at, self.gap, self.plain = (self.log, step), gap, None
        self.log = new
        if self.steps:
            moved, changed = (np.stack(c, 1) for c in zip(*self.steps))
            self.plain = new
            self.log = new - (moved + changed) @ np.linalg.lstsq(changed, step, rcond=None)[0]


def _exponents(mine: np.ndarray, theirs: np.ndarray, reg: float, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """Two matrices whose product is -cost / reg."""
    left = np.hstack([mine / reg, np.full((len(mine), 1), -1 / reg)]).astype(kind)
    return left, np.ascontiguousarray(np.vstack([theirs.T, np.ones((1, len(theirs)))]).astype(kind))


def _strip_round(mine: np.ndarray, theirs: np.ndarray, n: int, reg: float, log: np.ndarray, coarse: bool) -> np.ndarray:
    """What the seed's rows meet of some of a set's n vectors, whose masses follow from the rows'."""
    kind = np.float32 if coarse else np.float64
    left, right = _exponents(mine, theirs, reg, kind)
    width, out = max(1, KERNEL_CELLS // len(mine)), np.zeros(len(mine))
    with np.errstate(all="ignore"):
        u, cells = np.exp(log).astype(kind), np.empty(len(mine) * min(width, len(theirs)), kind)
        for low in range(0, len(theirs), width):
            some = np.ascontiguousarray(right[:, low : low + width])
            k, met = cells[: len(mine) * some.shape[1]].reshape(len(mine), -1), np.zeros(some.shape[1])
            for r in range(0, len(mine), BLOCK_ROWS):
                block = np.matmul(left[r : r + BLOCK_ROWS], some, out=k[r : r + BLOCK_ROWS])
                met += u[r : r + BLOCK_ROWS] @ np.exp(block, out=block)
            out += k @ (1 / n / met).astype(kind)
    return out


def _strip_cost(mine: np.ndarray, theirs: np.ndarray, n: int, reg: float, log: np.ndarray, new: np.ndarray) -> np.ndarray:
    """(cost of the transport to some of a set's n vectors, sum of all costs to them)."""
    left, right = _exponents(mine, theirs, reg, np.float64)
    total, plain = 0.0, 0.0
    with np.errstate(all="ignore"):
        u, fresh = np.exp(log), np.exp(new)
        for low in range(0, len(theirs), BLOCK_ROWS):
            some = np.ascontiguousarray(right[:, low : low + BLOCK_ROWS])
            met, cost = np.zeros(some.shape[1]), np.zeros(some.shape[1])
            for r in range(0, len(mine), BLOCK_ROWS):
                c = left[r : r + BLOCK_ROWS] @ some
                k = np.exp(c)
                c *= -reg
                plain += float(c.sum())
                met += u[r : r + BLOCK_ROWS] @ k
                cost += fresh[r : r + BLOCK_ROWS] @ np.multiply(k, c, out=k)
            total += float(cost @ (1 / n / met))
    return np.array([total, plain])


def large_transports(rows: DataFrame, apart: Sequence[tuple[int, int, str, int, np.ndarray]], reg: float) -> list[float]:
    """Costs of the transports (seed, track_id, model, size of the track's set, the seed's vectors).

    The sets lie in the cluster, in strips dealt out by ranges; every round is a job over them, to which
    the seed's masses are broadcast, and each partition returns one array for a transport that it has part of.
    The driver holds masses, no vectors but the seed's and no costs; TOGETHER bounds them."""
    context = rows.sparkSession.sparkContext
    reg = min(max(reg, 0.01), 2.0)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            code = b.column(0).to_numpy() if b.num_rows else np.zeros(0, np.int64)
            model = np.array(b.column(1).to_pylist(), object)
            for t, m in sorted(set(zip(code.tolist(), model.tolist()))):
                own = np.flatnonzero((code == t) & (model == m))
                for low in range(0, len(own), STRIP_ROWS):
                    v = unit_matrix(matrix_of(b.column(2).take(pa.array(own[low : low + STRIP_ROWS]))))
                    yield pa.RecordBatch.from_arrays([pa.array([t], pa.int64()), pa.array([m]), pa.array([v.shape[1]]), pa.array([v.tobytes()])], names=["track_id", "model", "d", "v"])

    parts = 4 * context.defaultParallelism
    dealt = rows.select("track_id", "model", "v").repartitionByRange(parts, "model", "track_id", F.xxhash64("v"))
    strips = dealt.mapInArrow(pack, "track_id bigint, model string, d bigint, v binary").rdd.map(lambda r: (r["track_id"], r["model"], r["d"], bytes(r["v"])))
    strips.persist(StorageLevel.MEMORY_AND_DISK)
    out: list[float] = []
    while len(out) < len(apart):
        end, size = len(out), 0
        while end < len(apart) and (not size or size + len(apart[end][4]) <= TOGETHER):
            size += len(apart[end][4])
            end += 1
        out += _solved(strips, apart[len(out) : end], reg)
    strips.unpersist()
    return out


def _solved(strips: RDD, apart: Sequence[tuple[int, int, str, int, np.ndarray]], reg: float) -> list[float]:
    seeds = strips.context.broadcast({(seed, m): mine for seed, _, m, _, mine in apart})
    of: dict[tuple[int, str], list[tuple[int, int, int]]] = {}
    for i, (seed, track, m, n, _) in enumerate(apart):
        of.setdefault((track, m), []).append((i, seed, n))

    def summed(f: Callable[..., np.ndarray], given: dict[int, tuple]) -> dict[int, np.ndarray]:
        sent = strips.context.broadcast(given)

        def run(part: Iterator[tuple[int, str, int, bytes]]) -> Iterator[tuple[int, np.ndarray]]:
            got: dict[int, np.ndarray] = {}
            for track, m, d, v in part:
                for i, seed, n in of.get((track, m), ()):
                    if i in sent.value:
                        x = f(seeds.value[seed, m], np.frombuffer(v).reshape(-1, d), n, reg, *sent.value[i])
                        got[i] = got[i] + x if i in got else x
            yield from got.items()

        total: dict[int, np.ndarray] = {}
        for i, x in strips.mapPartitions(run).collect():
            total[i] = total[i] + x if i in total else x
        sent.destroy()
        return total

    masses = [Masses(len(mine)) for *_, mine in apart]
    while open_ := {i: (x.log, x.coarse) for i, x in enumerate(masses) if x.new is None}:
        for i, met in summed(_strip_round, open_).items():
            masses[i].take(met)
    costs = summed(_strip_cost, {i: (x.log, x.new) for i, x in enumerate(masses)})
    seeds.destroy()
    return [float(c[0]) if np.isfinite((c := costs[i])[0]) else float(c[1]) / (n * len(mine)) for i, (*_, n, mine) in enumerate(apart)]


def emd_bounds(rest: DataFrame, own: dict[int, Matrices]) -> DataFrame:
    """What transport costs a seed at least, from block products alone: seed, track_id, low.

    Every vector of the seed sends its whole mass, at no less than its least cost. The mean over the
    models is taken as for the distances themselves.
    """
    met = _meet(rest, own)
    key = ["seed", "track_id", "model"]
    fit = met.groupBy(*key).agg(F.bool_or("misfit").alias("misfit")).where(~F.col("misfit"))
    return fit.join(_best_mean(met, lambda x: 1 - x), key).groupBy("seed", "track_id").agg(F.avg("x").alias("low"))


def emd_candidates(rest: DataFrame, own: dict[int, Matrices], reg: float, most: int) -> DataFrame:
    """track_id of the candidates whose lower bound doesn't exceed the ``most``-th least distance found
    among the ``most`` of least bound: no other can be among the ``most`` best."""
    return _emd_first(rest, own, reg, most)[1]


def _emd_first(rest: DataFrame, own: dict[int, Matrices], reg: float, most: int) -> tuple[list, DataFrame]:
    """(distances of the ``most`` of least bound, the candidates as above)."""
    low = emd_bounds(rest, own).persist(StorageLevel.MEMORY_AND_DISK)  # a row a track, read several times
    first = [r["track_id"] for r in low.orderBy("low", "track_id").limit(most).collect()]
    solved = _transport(rest.where(_among("track_id", first)), own, reg).collect()
    if len(first) < most:
        return solved, low.select("track_id")
    return solved, low.where(F.col("low") <= F.lit(max(r["d"] for r in solved)) + 1e-9).select("track_id")


def _scores(lib: Library, seeds: Sequence[int], dataset: str, algorithm: str, methods: Sequence[str], most: int | None = None) -> DataFrame:
    """Untruncated scores (seed, track_id, score) of all tracks but the seeds, to each seed that has
    vectors, in one pass over the library. ``most``: of one seed, so many best are enough."""
    d = Dataset(dataset)
    rows = lib.track_vectors()
    if d.kind == "reduction":
        r = reads.reduced_rows(lib, d.reduction_id)
        rows = r.select("track_id", "chunk_id", "idx", F.lit(dataset).alias("model"), "v")
    elif d.kind != "auto":
        rows = rows.where(F.col("model") == dataset)
    noise = reads.noise_union(lib.noise, dataset, methods) if methods and lib.noise is not None and d.kind != "text" else None
    clean = rows if noise is None else reads.without_noise(rows, noise)
    of_seeds = lambda df: df.where(_among("track_id", seeds))
    have = lambda df: {r["track_id"] for r in of_seeds(df).select("track_id").distinct().collect()}
    if noise is not None and (wiped := have(rows) - have(clean)):
        raise ValueError(f"noise filtering leaves nothing: every chunk of the seed {min(wiped)} is noise")
    if d.kind == "text" or algorithm == "centroid":
        stored = centroids(clean) if noise is not None else lib.centroids if lib.centroids is not None else centroids(rows)
        return all_centroid_scores(stored, seeds, dataset, lib.weights).where(~_among("track_id", seeds))
    if algorithm == "pareto":
        if d.kind == "auto":  # centroids with the noise, surface without it
            surface = pareto_surface(objectives(clean, centroids(of_seeds(rows)), seeds))
        else:
            surface = surface_single(clean, centroids(of_seeds(clean)), seeds, dataset)
        return psvi_scores(weighted(clean, lib.weights), seeds, surface)
    clean = weighted(clean, lib.weights)
    return chamfer_scores(clean, seeds) if algorithm == "chamfer" else emd_scores(clean, seeds, most=most)


def _named(lib: Library, dataset: str, algorithm: str, methods: Sequence[str], seed: int | None = None) -> tuple[str, str, Sequence[str]]:
    """The dataset, algorithm and noise methods that a search takes; ValueError where it has nothing to go by."""
    algorithm = algorithm_of(algorithm)
    if Dataset(dataset).kind == "text":
        algorithm, methods = "centroid", ()
    if (named := Dataset(dataset)).kind == "reduction":
        if lib.reduced is None or not dataset[4:].isdigit():
            raise ValueError(f"unknown reduction {dataset!r}")
        have = reads.reduced_rows(lib, named.reduction_id).select("track_id", F.lit(dataset).alias("model"))
    else:
        have = lib.centroids.select("track_id", "model") if lib.centroids is not None else reads.track_models(lib)
    if algorithm == "centroid":
        dataset = reads.resolve_dataset(have, seed=seed, wanted=dataset)
        if Dataset(dataset).kind == "text":
            methods = ()
    kind = Dataset(dataset).kind
    if seed is not None and not (algorithm == "centroid" and kind == "model"):  # else it has been seen above
        own = have if kind == "auto" else have.where(F.col("model") == dataset)
        if own.where(F.col("track_id") == seed).isEmpty():
            raise ValueError(f"track {seed} has no vectors in dataset {dataset!r}")
    return dataset, algorithm, methods


def similar_tracks(lib: Library, seed: int, dataset: str = "auto", algorithm: str = "centroid", limit: int = 15, discard_noise: Sequence[str] = ()) -> DataFrame:
    """Tracks most similar to one seed, which comes first: up to limit + 1 rows.

    ``auto`` is a dataset that the seed has; a seed without vectors in the dataset is refused."""
    from ..schema import noise_methods_of

    dataset, algorithm, methods = _named(lib, dataset, algorithm, noise_methods_of(discard_noise), seed)
    scores = _scores(lib, [seed], dataset, algorithm, methods, max(1, int(limit))).select("track_id", "score")
    return top(scores, lib, seed, dataset if algorithm == "centroid" else f"{algorithm}:{dataset}", limit)


def similar_to_all(lib: Library, seeds: Sequence[int], dataset: str = "auto", algorithm: str = "centroid", limit: int = 15, discard_noise: Sequence[str] = ()) -> DataFrame:
    """Tracks similar to all references: geometric mean of the scores to each; references excluded.

    A candidate needs a score to every usable reference; those without vectors are skipped.
    One reference is the plain search; none is refused. All references are met in one pass.
    """
    from ..schema import noise_methods_of

    seeds = list(dict.fromkeys(seeds))
    if not seeds:
        raise ValueError("at least one reference is needed")
    if len(seeds) == 1:
        return similar_tracks(lib, seeds[0], dataset, algorithm, limit, discard_noise)
    dataset, algorithm, methods = _named(lib, dataset, algorithm, noise_methods_of(discard_noise))
    each = _scores(lib, seeds, dataset, algorithm, methods)
    return top(combine(each, seeds), lib, None, dataset if algorithm == "centroid" else f"{algorithm}:{dataset}", limit)


def all_centroid_scores(aggregates: DataFrame, seeds: Sequence[int], model: str, weights: DataFrame | None = None) -> DataFrame:
    """Scores (seed, track_id, score) to several references in one pass over the centroids."""
    c = weighted(aggregates.where(F.col("model") == model).select("track_id", "model", "v"), weights if Dataset(model).weighted else None)
    own = F.broadcast(c.where(F.col("track_id").isin(list(seeds))).select(F.col("track_id").alias("seed"), F.col("v").alias("s")))  # a few hundred rows
    return c.crossJoin(own).where(F.size("v") == F.size("s")).select("seed", "track_id", vectors.cosine("v", "s").alias("score"))


def combine(each: DataFrame, seeds: Sequence[int]) -> DataFrame:
    """Geometric mean over the references that have any score; candidates must have all of these."""
    rest = each.where(~F.col("track_id").isin(list(seeds)))
    usable = rest.agg(F.countDistinct("seed").alias("usable"))
    per = rest.groupBy("track_id").agg(F.countDistinct("seed").alias("n"), scalars.geometric_mean("score").alias("score"))
    return per.crossJoin(F.broadcast(usable)).where("n = usable").select("track_id", "score")  # one row


def playlist_from(results: DataFrame, playlist_id: int) -> DataFrame:
    """Items of a playlist in the order of a search's results (the seed, at score 1, first)."""
    r = F.row_number().over(W.orderBy(F.col("score").desc(), "track_id"))  # a top-k result
    return results.select(F.lit(playlist_id).cast("bigint").alias("playlist_id"), "track_id", r.alias("position"), F.col("score").alias("similarity"))
