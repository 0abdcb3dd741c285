"""Small libraries with hand-computed results."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sonoplan.functions import scalars, signal, vectors
from sonoplan.operators import changes, derive, noise, reads, similarity
from sonoplan.plans.library import Library
from sonoplan.schema import Dataset, algorithm_of, noise_methods_of, split_legacy

TRACKS = "track_id bigint, folder_id bigint, path string, filename string, extension string, artist string, title string, duration_sec double, status string, status_message string"


def library(spark, tracks, reduced=None, tags=None):
    """``tracks``: name -> list of chunks, each a dict model -> vector; ids follow the order."""
    rows, chunks, vecs = [], [], []
    for t, (name, own) in enumerate(tracks.items(), 1):
        rows.append((t, 1, f"/m/{name}.mp3", f"{name}.mp3", "mp3", name, None, 42.0, "analyzed", None))
        for i, by in enumerate(own):
            c = len(chunks) + 1
            chunks.append((c, t, i, 20.0 * i, 20.0 * i + 20))
            vecs += [(c, m, [float(x) for x in v]) for m, v in by.items()]
    return Library(
        spark.createDataFrame(rows, TRACKS),
        spark.createDataFrame(chunks, "chunk_id bigint, track_id bigint, idx int, start_sec double, end_sec double"),
        spark.createDataFrame(vecs, "chunk_id bigint, model string, v array<double>"),
        tags=tags,
        noise=spark.createDataFrame([], "dataset string, method string, chunk_id bigint"),
    )


def clap(*vs):
    return [{"clap": v} for v in vs]


def scores(df):
    return [(r["artist"], round(r["score"], 6)) for r in df.collect()]


@pytest.fixture(scope="module")
def plain(spark):
    return library(spark, {"seed": clap((1, 0), (0, 1)), "close": clap((1, 0.5)), "far": clap((-1, 0)), "mid": clap((0, 1)), "naked": []})


def test_centroid_search(spark, plain):
    assert scores(similarity.similar_tracks(plain, 1, "clap")) == [("seed", 1.0), ("close", 0.948683), ("mid", 0.707107), ("far", -0.707107)]
    assert scores(similarity.similar_tracks(plain, 1, "auto", limit=1)) == [("seed", 1.0), ("close", 0.948683)]
    assert [r["artist"] for r in similarity.similar_tracks(plain, 1, "clap", limit=0).collect()] == ["seed", "close"]


def test_search_for_several_references(spark, plain):
    got = scores(similarity.similar_to_all(plain, [1, 4], "clap"))
    close = math.sqrt(0.948683 * (0.5 / math.sqrt(1.25)))
    assert [g[0] for g in got] == ["close", "far"] and abs(got[0][1] - close) < 1e-5 and got[1][1] == 0
    assert scores(similarity.similar_to_all(plain, [1, 1], "clap")) == scores(similarity.similar_tracks(plain, 1, "clap"))
    assert [g[0] for g in scores(similarity.similar_to_all(plain, [1, 5], "clap"))] == ["close", "mid", "far"]
    with pytest.raises(ValueError):
        similarity.similar_to_all(plain, [])


def test_playlist_keeps_the_seed_first(spark, plain):
    p = similarity.playlist_from(similarity.similar_tracks(plain, 1, "clap", limit=2), 5).orderBy("position").collect()
    assert [(r["position"], r["track_id"], round(r["similarity"], 6)) for r in p] == [(1, 1, 1.0), (2, 2, 0.948683), (3, 4, 0.707107)]


def test_pareto_search_over_all_models(spark):
    lib = library(spark, {
        "seed": [{"clap": c, "mert": m} for c, m in (((1, 0), (1, 1)), ((0, 1), (0, 1)), ((1, 1), (1, 0)))],
        "close": clap((1, 1), (1, 0)), "tricky": clap((1, 0), (0, 1)), "dim3": clap((1, 0, 0)), "mert_only": [{"mert": (1, 1)}, {"mert": (1, 0)}],
        "both": [{"clap": (1, 0), "mert": (1, 1)}], "far": clap((-1, -1)), "naked": [], "hollow": [{}, {}], "l3": [{"openl3": (1, 0, 0, 0)}],
    })
    tv = lib.track_vectors()
    surface = similarity.pareto_surface(similarity.objectives(tv, similarity.centroids(tv.where("track_id = 1")), 1))
    assert sorted(r["chunk_id"] for r in surface.collect()) == [1, 3]
    got = scores(similarity.similar_tracks(lib, 1, "auto", "psvi"))
    assert got == [("seed", 1.0), ("close", 1.0), ("mert_only", 1.0), ("tricky", 0.853553), ("both", 0.853553), ("dim3", 0.0), ("far", -0.853553)]


def test_pareto_objectives_of_missing_models(spark):
    lib = library(spark, {"a": [{"clap": (1, 0), "mert": (0.6, 0.8)}, {"clap": (0, 1)}]})
    tv = lib.track_vectors()
    points = similarity.objectives(tv, similarity.centroids(tv), 1)
    got = {r["chunk_id"]: [round(x, 6) for x in r["objectives"]] for r in points.collect()}
    assert got == {1: [0.707107, 1.0], 2: [0.707107, -1.0]}
    assert [r["chunk_id"] for r in similarity.pareto_surface(points).collect()] == [1]


def test_surface_ties_and_ragged_points(spark):
    p = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.5, 0.0]), (4, [0.0, 2.0]), (5, [1.0])], "chunk_id bigint, objectives array<double>")
    assert sorted(r["chunk_id"] for r in similarity.pareto_surface(p).collect()) == [1, 2, 4]


def test_set_distances():
    e1, e2, e3 = np.eye(3)
    assert similarity.chamfer([e1], [e2]) == 1 and abs(similarity.earth_movers([e1], [e2]) - 1) < 1e-9
    assert similarity.chamfer([e1], [e1, e2]) == similarity.chamfer([e1, e2], [e1]) == 0.25
    assert abs(similarity.earth_movers([e1], [e1, e2]) - 0.5) < 1e-9
    assert similarity.chamfer([e1, e2, e3], [e3, e1, e2]) == 0 and similarity.earth_movers([e1, e2, e3], [e1, e2, e3]) < 0.002
    assert similarity.chamfer([e1 * 0], [e1]) == 1
    assert similarity.cost_matrix([e1 * 3], [-e1])[0, 0] == 2
    for bad in ([], [[1.0], [1.0, 2.0]]):
        with pytest.raises(ValueError):
            similarity.cost_matrix(bad, [e1])


def test_set_distance_search(spark):
    fft = lambda *vs: [{"fft": v} for v in vs]
    lib = library(spark, {"seed": fft((1, 0), (0.98, 0.199)), "near": fft((1, 0)), "far": fft((0, 1)), "mix": fft((1, 0), (0, 1)), "dim": fft((1, 0, 0))})
    d = 1 - 0.98 / math.hypot(0.98, 0.199)
    emd, cha = dict(scores(similarity.similar_tracks(lib, 1, "fft", "emd"))), dict(scores(similarity.similar_tracks(lib, 1, "fft", "chamfer")))
    assert abs(emd["near"] - 1 / (1 + d / 2)) < 0.005 and abs(cha["near"] - 1 / (1 + d / 4)) < 5e-4
    assert abs(emd["mix"] - 1 / 1.4005) < 0.01 and abs(cha["mix"] - 1 / 1.20525) < 5e-4
    assert "dim" not in emd and "dim" not in cha


def test_searches_with_nothing_to_go_by_are_refused(spark, plain):
    for dataset in ("auto", "clap"):
        for algorithm in ("centroid", "pareto", "chamfer", "emd"):
            with pytest.raises(ValueError):
                similarity.similar_tracks(plain, 5, dataset, algorithm)  # a track without vectors
    for dataset in ("mert", "red:x", "ollama:none", "red:1"):
        with pytest.raises(ValueError):
            similarity.similar_tracks(plain, 1, dataset)
    alone = library(spark, {"a": [{"clap": (1, 0), "fft": (1, 0)}], "b": [{"fft": (0, 1)}], "c": [{"fft": (1, 1)}]})
    with pytest.raises(ValueError, match="two analysed tracks"):
        similarity.similar_tracks(alone, 1, "clap")
    got = similarity.similar_tracks(alone, 1, "auto").collect()  # clap comes first, but only the seed has it
    assert {r["method"] for r in got} == {"fft"} and [r["artist"] for r in got] == ["a", "c", "b"]


def test_auto_is_a_dataset_of_the_seed(spark):
    rows = [(1, "clap"), (2, "clap"), (3, "mert"), (4, "mert"), (5, "mert"), (1, "mert"), (3, "ollama:x"), (9, "ollama:x"), (2, "ollama:alone"), (1, "red:1"), (2, "red:1"), (6, "zeta"), (7, "zeta")]
    have = spark.createDataFrame(rows, "track_id bigint, model string")
    assert reads.resolve_dataset(have) == "ollama:x"
    found = {seed: reads.resolve_dataset(have, seed=seed) for seed in (1, 2, 3, 4, 6, 9)}
    assert found == {1: "clap", 2: "clap", 3: "ollama:x", 4: "mert", 6: "zeta", 9: "ollama:x"}
    for seed in (8, 10):
        with pytest.raises(ValueError, match=str(seed)):
            reads.resolve_dataset(have, seed=seed)
    assert reads.resolve_dataset(have, seed=4, wanted="red:1") == "red:1" and reads.resolve_dataset(have, wanted="zeta") == "zeta"
    with pytest.raises(ValueError):
        reads.resolve_dataset(have, seed=4, wanted="clap")


def test_picker_shows_what_is_outdated(spark):
    lib = library(spark, {"a": [{"fft": (1, 0)}, {"fft": (0, 1)}], "b": [{"fft": (1, 1)}]})
    reductions = spark.createDataFrame([(1, "all", "fft"), (2, "less", "fft"), (3, "other", "clap")], "reduction_id bigint, name string, source_model string")
    lib.reduced = spark.createDataFrame([(1, 1, [1.0]), (1, 2, [1.0]), (1, 3, [1.0]), (2, 1, [1.0]), (2, 99, [1.0]), (2, 98, [1.0])], "reduction_id bigint, chunk_id bigint, v array<double>")
    texts = spark.createDataFrame([(1, "ollama:b", [1.0]), (1, "ollama:a", [1.0])], "track_id bigint, model string, v array<double>")
    got = reads.dataset_choices([("clap", "CLAP"), ("fft", "FFT")], lib, similarity.centroids(lib.track_vectors()).unionByName(texts), reductions)
    assert [tuple(r) for r in got.orderBy("place").collect()] == [
        (1, "clap", "CLAP", 0, False, False), (2, "fft", "FFT", 2, True, False), (3, "red:1", "all", 0, True, False), (4, "red:2", "less", 0, True, True),
        (5, "red:3", "other", 0, True, False), (6, "ollama:a", "Description (a)", 1, True, False), (7, "ollama:b", "Description (b)", 1, True, False),
    ]


@pytest.fixture(scope="module")
def crowd(spark):
    rng = np.random.default_rng(3)
    own = lambda k: [{"fft": rng.normal(size=6) + 3 * np.eye(6)[k % 6], **({"clap": rng.normal(size=4) + np.eye(4)[k % 4]} if k % 3 else {})} for _ in range(1 + k % 4)]
    return library(spark, {f"t{k}": own(k) for k in range(60)} | {"odd": [{"fft": (1, 2)}], "mixed": [{"fft": (1, 2)}, {"fft": (1,) * 6}]})


@pytest.mark.parametrize("dataset", ["fft", "auto"])
@pytest.mark.parametrize("algorithm", ["pareto", "chamfer", "emd"])
def test_references_in_one_pass_equal_one_by_one(spark, crowd, monkeypatch, dataset, algorithm):
    seeds = [1, 7, 20, 61, 62, 999]
    monkeypatch.setattr(similarity, "MEET_COLUMNS", 5)  # several groups of seeds
    both = similarity._scores(crowd, seeds, dataset, algorithm, ()).collect()
    every = {(r["seed"], r["track_id"]): r["score"] for r in both}
    assert len(every) == len(both)
    monkeypatch.undo()
    for seed in seeds[:-1]:
        one = {(seed, r["track_id"]): r["score"] for r in similarity._scores(crowd, [seed], dataset, algorithm, ()).collect() if r["track_id"] not in seeds}
        mine = {k: v for k, v in every.items() if k[0] == seed}
        assert one.keys() == mine.keys() and all(abs(one[k] - mine[k]) < 1e-9 for k in one)
    assert not any(k[0] == 999 for k in every)


@pytest.mark.parametrize("dataset", ["fft", "auto"])
def test_few_transports_give_the_same_best(spark, crowd, dataset):
    rows = crowd.track_vectors() if dataset == "auto" else crowd.track_vectors().where("model = 'fft'")
    for seed in (2, 5, 11):
        full = {r["track_id"]: r["score"] for r in similarity.emd_scores(rows, seed).collect()}
        own = {t: {m: p for m, p in x.items() if len(p) == 1} for t, x in similarity.seed_matrices(rows, [seed]).items()}
        rest = rows.where(F.col("track_id") != seed)
        low = {r["track_id"]: r["low"] for r in similarity.emd_bounds(rest, own).collect()}
        assert low.keys() == full.keys() and all(low[t] <= 1 / full[t] - 1 + 1e-9 for t in full)
        solved = similarity.emd_candidates(rest, own, 0.05, 5).count()
        assert 5 <= solved < len(full) * 0.7
        best = lambda x: sorted(((-round(v, 9), k) for k, v in x.items()))[:5]
        pruned = {r["track_id"]: r["score"] for r in similarity.emd_scores(rows, seed, most=5).collect()}
        assert len(pruned) == solved and best(pruned) == best(full)


def test_numbers_without_one_task(spark):
    rows = spark.createDataFrame([(int(x), f"k{x}") for x in np.random.default_rng(0).permutation(1000) * 7 - 500], "x bigint, name string").repartition(3)
    out = reads.numbered(rows, "x", "place")
    assert [(r["x"], r["place"]) for r in out.orderBy("x").collect()] == [(7 * k - 500, k) for k in range(1000)]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and "hashpartitioning(_bucket" in plan
    for n in (0, 1, 2):
        assert sorted(r["place"] for r in reads.numbered(rows.limit(n), "x", "place").collect()) == list(range(n))
    assert sorted(r["place"] for r in reads.numbered(rows, "x", "place", 1).collect()) == list(range(1000))


@pytest.fixture(scope="module")
def junk(spark):
    rng = np.random.default_rng(7)
    e = np.eye(8)
    near = lambda k, n: [{"fft": e[k] + rng.normal(0, 0.02, 8)} for _ in range(n)]
    return library(spark, {"seed": near(0, 12) + [{"fft": e[k]} for k in (2, 2, 3, 3)], "cand_a": near(0, 10), "cand_c": near(1, 10), "tiny": near(0, 2) + [{"fft": e[5]}]})


@pytest.mark.parametrize("method", ["hdbscan", "optics"])
def test_planted_junk_is_noise(spark, junk, method):
    rows = junk.track_vectors().where("model = 'fft'")
    assert rows.count() == 39
    assert sorted(r["chunk_id"] for r in noise.fit(rows, "fft", method).collect()) == [13, 14, 15, 16]


@pytest.mark.parametrize("algorithm", ["centroid", "psvi", "chamfer", "emd"])
def test_filtering_raises_the_true_match(spark, junk, algorithm):
    junk.noise = noise.fit(junk.track_vectors(), "fft", "hdbscan")
    before = dict(scores(similarity.similar_tracks(junk, 1, "fft", algorithm)))
    after = dict(scores(similarity.similar_tracks(junk, 1, "fft", algorithm, discard_noise=["hdbscan"])))
    assert after["cand_a"] > before["cand_a"] - 1e-9 and (algorithm == "psvi" or after["cand_a"] > before["cand_a"])


def test_hdbscan_keeps_a_wide_small_cluster_and_drops_strays():
    rng = np.random.default_rng(1)
    a, b = rng.normal(0, 0.01, (20, 2)), rng.normal(0, 0.3, (6, 2)) + (10, 0)
    stray = np.array([[5.0, 9.0], [-7.0, -8.0]])
    labels = noise.hdbscan_labels(np.concatenate([a, b, stray]), 5)
    assert len(set(labels[:20])) == 1 and labels[0] >= 0 and len(set(labels[20:26])) == 1 and labels[20] not in (-1, labels[0])
    assert list(labels[26:]) == [-1, -1]


def test_optics_finds_what_dbscan_would():
    x = np.array([[0.0], [0.1], [0.2], [5.0], [5.1], [5.2], [20.0]])
    assert list(noise.optics_labels(x, 0.5, 2)) == [0, 0, 0, 1, 1, 1, -1]


def test_incremental_noise(spark, junk):
    rows = junk.track_vectors()
    sig = reads.signatures(rows)
    assert noise.pending(rows, sig).count() == 0
    assert {r["track_id"] for r in noise.pending(rows, sig.where("track_id != 2")).collect()} == {2}
    other = sig.withColumn("vector_sum", F.when(F.col("track_id") == 3, F.col("vector_sum") + 1).otherwise(F.col("vector_sum")))
    assert {r["track_id"] for r in noise.pending(rows, other).collect()} == {3}
    kept = spark.createDataFrame([(1,), (20,), (999,)], "chunk_id bigint")
    assert {r["chunk_id"] for r in noise.refit(rows, kept, [1], "hdbscan").collect()} == {13, 14, 15, 16, 20}
    with pytest.raises(ValueError):
        noise.fit(rows.limit(5), "fft", "hdbscan")


def test_learned_weights(spark):
    rng = np.random.default_rng(11)
    rows, pairs = [], []
    for p in range(25):
        base = rng.normal(0, 1, 40) * 0.05
        for s in (0, 1):
            v = base + np.concatenate([rng.normal(0, 0.02, 5), rng.normal(0, 3, 35)])
            rows.append((2 * p + s, "m", v.tolist()))
        pairs.append((p, 2 * p, 2 * p + 1))
    c = spark.createDataFrame(rows, "track_id bigint, model string, v array<double>")
    w = [r["weight"] for r in derive.learn_weights(spark.createDataFrame(pairs, "pair_id bigint, track_a bigint, track_b bigint"), c).orderBy("component_index").collect()]
    assert abs(np.mean(w) - 1) < 1e-9 and set(np.argsort(w)[-5:]) == set(range(5)) and max(w[5:]) == 0
    same = spark.createDataFrame([(1, "m", [1.0, 2.0, 3.0, 4.0]), (2, "m", [1.0, 2.0, 3.0, 4.0]), (3, "m", [0.0] * 4)], "track_id bigint, model string, v array<double>")
    p = spark.createDataFrame([(1, 1, 2), (2, 1, 3), (3, 1, 1), (4, 1, 9)], "pair_id bigint, track_a bigint, track_b bigint")
    assert [round(r["weight"], 9) for r in derive.learn_weights(p, same).collect()] == [1.0] * 4
    v = spark.createDataFrame([([3.0, 4.0], [4.0, 1.0], [1.0])], "v array<double>, w array<double>, u array<double>")
    assert v.select(vectors.scale("v", "w"), vectors.scale("v", "u")).first()[:] == ([6.0, 4.0], [3.0, 4.0])


def test_standardised_vectors(spark):
    lib = library(spark, {"a": [{"m": (10, 100, 5)}, {"m": (12, 100, 5)}], "b": [{"m": (8, 104, 5)}, {"m": (10, 96, 5)}]})
    z = derive.zscore(lib.track_vectors())
    s = derive.component_stats(z).orderBy("pos").collect()
    assert [round(r["mean"], 9) for r in s] == [0, 0, 0] and [round(r["std"], 9) for r in s] == [1, 1, 0]
    assert all(abs(r["n"] - 1) < 1e-9 for r in similarity.centroids(z).select(vectors.norm("v").alias("n")).collect())
    one = library(spark, {"a": [{"m": (3, 4)}]})
    assert derive.zscore(one.track_vectors()).first()["v"] == [3.0, 4.0]


def test_reduction_and_its_searches(spark):
    lib = library(spark, {"seed": [{"fft": v} for v in ((1, 0, 0, 0), (0.9, 0.1, 0, 0))], "close": [{"fft": v} for v in ((0.95, 0.05, 0, 0), (0.85, 0.1, 0.05, 0))], "far": [{"fft": v} for v in ((-1, 0, 0, 0), (-0.9, 0, 0.1, 0))]})
    out, shares = derive.reduce_rows(lib.vectors, "pca", 3)
    assert out.count() == 6 and shares == sorted(shares, reverse=True) and sum(shares) <= 1 + 1e-9 and all(len(r["v"]) == 3 for r in out.collect())
    lib.reduced = out.select(F.lit(7).cast("bigint").alias("reduction_id"), "chunk_id", "v")
    got = similarity.similar_tracks(lib, 1, "red:7").collect()
    assert [r["artist"] for r in got] == ["seed", "close", "far"] and got[0]["method"] == "red:7"
    lib.reduced = lib.reduced.where("chunk_id != 1")
    assert reads.reduction_staleness(lib, 7, "fft").first()[:] == (5, 6, True)
    flat, shares = derive.pca(spark.createDataFrame([(i, [1.0, 2.0]) for i in range(5)], "chunk_id bigint, v array<double>"), 2)
    assert shares == [0.0, 0.0] and all(x == 0 for r in flat.collect() for x in r["v"])
    with pytest.raises(ValueError):
        derive.reduce_rows(lib.vectors, "magic", 2)


@pytest.mark.parametrize("method", ["tsne", "umap"])
def test_layouts_keep_clusters_apart(spark, method):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(0, 0.1, (30, 8)), rng.normal(3, 0.1, (30, 8))])
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "chunk_id bigint, v array<double>")
    y = np.array([r["v"] for r in getattr(derive, method)(rows, 2).orderBy("chunk_id").collect()])
    assert np.isfinite(y).all()
    a, b = y[:30], y[30:]
    spread = max(np.linalg.norm(a - a.mean(0), axis=1).mean(), np.linalg.norm(b - b.mean(0), axis=1).mean())
    assert np.linalg.norm(a.mean(0) - b.mean(0)) > 2 * spread


def test_spectrum_features():
    rate, t = 48_000, np.arange(480_000) / 48_000
    f = signal.chunk_features(0.3 * np.sin(2 * np.pi * 440 * t), rate, 10.0)
    assert len(signal.feature_names()) == 40 == len(f)
    assert abs(f[36] * 24_000 - 440) < 2 and abs(f[37] * 24_000 - 440) < 5 and f[38] < 0.25 and f[39] >= 0.5
    rms = [f[6 * k + 4] for k in range(6)]
    assert rms.index(max(rms)) == 2 and all(rms[2] > 5 * x for k, x in enumerate(rms) if k != 2)
    assert not signal.feature_vector(np.zeros(48_000), rate).any() and len(signal.feature_vector(np.zeros(0), rate)) == 40
    assert abs(np.linalg.norm(signal.feature_vector(np.sin(t[:4800]), rate)) - 1) < 1e-6
    assert signal.hurst(np.arange(200.0)) > 0.85 and signal.hurst([1.0] * 100) == signal.hurst([1, 2]) == 0.5


def test_moments_and_entropy(spark):
    df = spark.createDataFrame([([0.0, 1.0, 2.0, 3.0], [1.0] * 8)], "x array<double>, y array<double>")
    m, e = df.select(signal.moment_stats("x"), scalars.entropy_bits("y")).first()
    assert (m["mean"], m["skew"]) == (1.5, 0.0) and abs(e - 3) < 1e-12


def test_chunk_plan(spark):
    def plan(n, rate, sec, overlap):
        return [(c["idx"], c["start_sec"], c["end_sec"]) for c in spark.range(1).select(signal.chunk_plan(F.lit(n), F.lit(rate), sec, overlap).alias("p")).first()["p"]]

    assert plan(20_000, 8_000, 1.0, 50.0) == [(0, 0.0, 1.0), (1, 0.5, 1.5), (2, 1.0, 2.0), (3, 1.5, 2.5)]
    assert plan(4_000, 8_000, 1.0, 50.0) == [(0, 0.0, 0.5)] and plan(0, 8_000, 1.0, 50.0) == []
    assert plan(17_000, 8_000, 1.0, 0.0) == [(0, 0.0, 1.0), (1, 1.0, 2.125)]
    with pytest.raises(ValueError):
        signal.chunk_plan(F.lit(1), F.lit(1), 0.0)


@pytest.mark.parametrize(("n", "overlap", "want"), [(210, 50, [0, 50, 110]), (100, 50, [0]), (40, 10, [0]), (260, 0, [0, 100, 160]), (300, 0, [0, 100, 200])])
def test_window_starts(spark, n, overlap, want):
    assert spark.range(1).select(signal.window_starts(F.lit(n), 100, overlap)).first()[0] == want


def test_cross_model_points(spark):
    arange = lambda k: tuple(np.arange(4) + k)
    lib = library(spark, {"a": [{"fft": arange(0), "mert": (0.5, -0.5, 1)}, {"fft": arange(1), "mert": (0.5, -0.5, 1)}], "b": [{"fft": arange(100)}, {"fft": arange(101)}]})
    assert reads.vector_rows(lib).count() == 6
    assert sorted(r[:] for r in reads.cross_model_points(lib, "fft", 1, "mert", 0).select("x", "y").collect()) == [(1.0, 0.5), (2.0, 0.5)]
    assert reads.joint_vectors(lib, ["fft", "mert"]).select(F.size("v")).distinct().collect()[0][0] == 7


def test_tags_and_counts(spark):
    lib = library(spark, {"a": [{"clap": (1, 0), "mert": (1, 0)}, {"clap": (0, 1)}], "none": []})
    lib.tags = spark.createDataFrame([(1, "clap", "pop", 0.91), (1, "clap", "rock", 0.05), (2, "clap", "jazz", 0.5), (2, "clap", "pop", 0.33), (2, "mert", "ambient", 0.7)], "chunk_id bigint, model string, text string, score double")
    assert [(r["text"], r["idx"]) for r in reads.track_tags(lib, 1).collect()] == [("pop", 0), ("ambient", 1), ("jazz", 1), ("pop", 1), ("rock", 0)]
    assert {(r["track_id"], r["model"]): r["n"] for r in reads.model_counts(lib).collect()} == {(1, "clap"): 2, (1, "mert"): 1}
    assert reads.track_description(lib, 2).first()["description"] == "Music tags: pop, ambient"
    assert reads.chunks_for_tracks(lib, []).count() == 0 and reads.chunks_for_tracks(lib, None).count() == 2


def test_clear_analysis(spark):
    lib = library(spark, {"a": clap((1, 0)), "b": clap((0, 1))})
    tables = {"tracks": lib.tracks, "chunks": lib.chunks, "vectors": lib.vectors, "playlists": spark.createDataFrame([(1, 1)], "playlist_id bigint, seed_track_id bigint")}
    out = changes.clear_analysis(tables, 1)
    assert [(r["track_id"], r["status"]) for r in out["tracks"].orderBy("track_id").collect()] == [(1, "new"), (2, "analyzed")]
    assert [r["track_id"] for r in out["chunks"].collect()] == [2] and out["vectors"].count() == 1
    gone = changes.remove_tracks(tables, lib.tracks.where("track_id = 1"))
    assert gone["tracks"].count() == 1 and gone["playlists"].first()["seed_track_id"] is None


def test_settings_and_pairs(spark):
    s = spark.createDataFrame([("a", "1")], "key string, value string")
    s = changes.put_setting(changes.save_text_models(s, ["x", "y"]), "a", "2")
    assert changes.get_setting(s, "a") == "2" and changes.get_setting(s, "b", "d") == "d" and changes.text_models(s) == ["x", "y"]
    assert changes.text_models(changes.put_setting(s, "ollama_models", "{broken")) == []
    p = changes.add_pair(changes.add_pair(spark.createDataFrame([], "pair_id bigint, track_a bigint, track_b bigint"), 2, 1), 1, 2)
    assert [r[:] for r in p.collect()] == [(1, 1, 2)]
    with pytest.raises(ValueError):
        changes.add_pair(p, 3, 3)


def test_names():
    assert (Dataset("red:4").kind, Dataset("red:4").reduction_id, Dataset("ollama:x").kind, Dataset("auto").kind, Dataset("fft").weighted, Dataset("red:4").weighted) == ("reduction", 4, "text", "auto", True, False)
    assert algorithm_of("psvi") == "pareto" and split_legacy("emd") == ("auto", "emd") and split_legacy("clap") == ("clap", "centroid")
    assert noise_methods_of(["optics", "optics", "hdbscan"]) == ("optics", "hdbscan")
    for f, x in ((algorithm_of, "x"), (noise_methods_of, ["x"])):
        with pytest.raises(ValueError):
            f(x)


def test_formats(spark):
    df = spark.createDataFrame([(None, None, " ?? "), (59.5, 500, "A b/c é"), (3725.0, 1536, "x"), (600.0, 3 << 30, "")], "s double, n bigint, name string")
    got = df.select(scalars.format_duration("s"), scalars.format_size("n"), scalars.slug("name")).collect()
    assert [tuple(r) for r in got] == [("?", "?", "playlist"), ("01:00", "500 B", "A_b_c_é"), ("1:02:05", "1.5 KB", "x"), ("10:00", "3.0 GB", "playlist")]


def test_large_sets_are_solved_in_strips_by_the_cluster(spark, crowd, monkeypatch):
    """Round by round over all partitions, and no set goes through one task; the costs are those of the plain rounds."""
    rows = crowd.track_vectors().where("track_id < 14").repartition(2).persist()
    scores = lambda df: {(r["seed"], r["track_id"]): r["score"] for r in df.collect()}
    plain = scores(similarity.emd_scores(rows, [8, 12]))
    monkeypatch.setattr(similarity, "LARGE_CELLS", 4)
    monkeypatch.setattr(similarity, "STRIP_ROWS", 2)
    monkeypatch.setattr(similarity, "earth_movers", lambda a, b, reg: 1 / 0 if len(a) * len(b) > 4 else float(similarity.cost_matrix(a, b).mean()))
    got = scores(similarity.emd_scores(rows, [8, 12]))
    assert got.keys() == plain.keys() and len(got) > 10
    assert all(abs(got[k] - plain[k]) < 1e-6 for k in got)  # plain rounds end 1e-7 before their limit where they are slow
    monkeypatch.setattr(similarity, "TOGETHER", 12)  # several groups of transports
    few = scores(similarity.emd_scores(rows, 8, most=4))
    best = lambda x: [k for _, k in sorted((-v, k) for k, v in x.items() if k[0] == 8 and k[1] != 12)[:3]]
    assert best(few) == best(plain)
    rows.unpersist()


@pytest.mark.parametrize("reg", [0.01, 0.05, 0.5])
@pytest.mark.parametrize("kind", ["plain", "clusters", "opposite", "copies", "zero"])
def test_mixed_rounds_end_where_plain_ones_do(kind, reg):
    rng = np.random.default_rng(2)
    a, b = rng.normal(size=(90, 5)), rng.normal(size=(70, 5))
    if kind == "clusters":
        a, b = a * 0.1 + np.eye(5)[rng.integers(0, 5, 90)], b * 0.1 + np.eye(5)[rng.integers(0, 2, 70)]
    elif kind == "opposite":
        a, b = np.abs(a), -np.abs(b)
    elif kind == "copies":
        a[:40], b[:30] = a[0], a[0]
    elif kind == "zero":
        a[:5], b[:2] = 0, 0
    mine, theirs, masses = similarity.unit_matrix(a), similarity.unit_matrix(b), similarity.Masses(len(a))
    while masses.new is None:
        masses.take(sum(similarity._strip_round(mine, x, len(b), reg, masses.log, masses.coarse) for x in (theirs[:33], theirs[33:])))
    got = similarity._strip_cost(mine, theirs, len(b), reg, masses.log, masses.new)
    c = similarity.cost_matrix(a, b)
    k, u = np.exp(-c / reg), np.ones(len(a))
    for _ in range(20_000):  # plain rounds to their end
        v = 1 / len(b) / (k.T @ u)
        u, old = 1 / len(a) / (k @ v), u
        if np.abs(u - old).sum() < 1e-14 * u.sum():
            break
    assert abs(got[0] - u @ (k * c) @ v) < 1e-8 and abs(got[1] - c.sum()) < 1e-9
    if reg > 0.01:
        assert abs(got[0] - similarity.earth_movers(a, b, reg)) < 1e-8
