"""Sets of many vectors: costs are met in strips, with the results of whole matrices."""

import tracemalloc

import numpy as np
import pytest

from sonoplan.operators import similarity


def whole_transport(a, b, reg=0.05):
    c = similarity.cost_matrix(a, b)
    k, u = np.exp(-c / reg), np.ones(len(c))
    for _ in range(500):
        v = 1 / len(b) / (k.T @ u)
        new = 1 / len(a) / (k @ v)
        done, u = np.abs(new - u).sum() < 1e-9, new
        if done:
            break
    return float((u[:, None] * k * v * c).sum())


@pytest.mark.parametrize("cells", [1, 500, 1 << 21])
def test_transport_in_strips(monkeypatch, cells):
    rng = np.random.default_rng(9)
    monkeypatch.setattr(similarity, "KERNEL_CELLS", cells)
    for n, m in ((1, 1), (1, 40), (40, 1), (37, 61)):
        a, b = rng.normal(size=(n, 6)), rng.normal(size=(m, 6))
        assert abs(similarity.earth_movers(a, b) - whole_transport(a, b)) < 1e-9


def test_transport_holds_no_matrix():
    rng = np.random.default_rng(10)
    a, b = rng.normal(size=(3000, 16)), rng.normal(size=(3000, 16))
    tracemalloc.start()
    similarity.earth_movers(a, b)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 120 << 20  # a matrix has 72 MB, and there were four


@pytest.mark.parametrize("most", [1, 16 << 20])
def test_chamfer_in_strips(spark, monkeypatch, most):
    """Tracks, models and sizes mixed, two seeds of which one has more vectors than a strip."""
    rng = np.random.default_rng(11)
    monkeypatch.setattr(similarity, "MEET_BYTES", most)
    sets = {(t, m): rng.normal(size=(n, d)) for t, m, n, d in [(1, "a", 30, 4), (1, "b", 3, 5), (2, "a", 2, 4), (3, "a", 9, 4), (3, "b", 4, 5), (4, "a", 5, 3), (4, "b", 2, 5), (5, "a", 1, 4)]}
    rows = [(t, m, v.tolist()) for (t, m), x in sets.items() for v in x]
    df = spark.createDataFrame([(t, i, m, v) for i, (t, m, v) in enumerate(rows)], "track_id bigint, chunk_id bigint, model string, v array<double>").repartition(3)
    got = {(r["seed"], r["track_id"]): r["score"] for r in similarity.chamfer_scores(df, [1, 2]).collect()}
    want = {}
    for seed in (1, 2):
        for t in (3, 4, 5):
            d = [similarity.chamfer(sets[seed, m], sets[t, m]) for m in "ab" if (seed, m) in sets and (t, m) in sets and sets[seed, m].shape[1] == sets[t, m].shape[1]]
            if d:
                want[seed, t] = 1 / (1 + np.mean(d))
    assert got.keys() == want.keys() and all(abs(got[x] - want[x]) < 1e-9 for x in want)
