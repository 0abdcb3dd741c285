"""Layouts by landmarks: every vector has a place, next to those it resembles."""

import numpy as np
import pytest

from sonoplan.operators import derive


@pytest.fixture(scope="module")
def clusters(spark):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(c, 0.1, (150, 6)) for c in (0, 3, 6)])
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [1.0, 2.0])]
    return x, spark.createDataFrame(rows, "chunk_id bigint, v array<double>").repartition(5)


@pytest.mark.parametrize("method", ["tsne", "umap"])
def test_all_vectors_lie_with_their_cluster(clusters, method):
    x, rows = clusters
    got = {r["chunk_id"]: r["v"] for r in derive.reduce_rows(rows, method, 2, landmarks=60)[0].collect()}
    assert sorted(got) == list(range(len(x)))  # null vectors and other sizes have no place
    y = np.array([got[i] for i in range(len(x))]).reshape(3, 150, 2)
    assert np.isfinite(y).all()
    centre = np.median(y, axis=1)
    near = np.linalg.norm(y[:, :, None] - centre[None, None], axis=3).argmin(2)
    assert (near == np.arange(3)[:, None]).mean() > 0.98
    again = {r["chunk_id"]: r["v"] for r in derive.reduce_rows(rows.repartition(2), method, 2, landmarks=60)[0].collect()}
    assert again.keys() == got.keys() and all(np.allclose(again[i], got[i]) for i in got)


def test_placing_equals_the_plain_mean():
    rng = np.random.default_rng(8)
    z, y, v = rng.normal(size=(40, 5)), rng.normal(size=(40, 2)), rng.normal(size=(30, 5))
    v[3], v[4] = z[7], z[0]
    z[9], v[5] = z[8], z[8]  # two landmarks at one point: halfway between their places
    at = derive._placed_by(v, z, y)
    assert np.allclose(at[3], y[7]) and np.allclose(at[4], y[0]) and np.allclose(at[5], (y[8] + y[9]) / 2)
    for i in (0, 1, 2, 10, 29):
        d = ((z - v[i]) ** 2).sum(1)
        some = np.argsort(d)[: derive.PLACED_BY]
        assert np.allclose(at[i], (y[some] / d[some, None]).sum(0) / (1 / d[some]).sum())


def test_limits(clusters, monkeypatch):
    _, rows = clusters
    for wrong in (3, derive.TSNE_MOST + 1):
        with pytest.raises(ValueError):
            derive.tsne(rows, landmarks=wrong)
    monkeypatch.setattr(derive, "TSNE_MOST", 100)  # more vectors than are fitted at once
    whole = rows.where("chunk_id < 900")
    with pytest.raises(ValueError):
        derive.tsne(whole)
    assert derive.tsne(whole, landmarks=50, steps=20).count() == 450
    with pytest.raises(ValueError):
        derive.tsne(rows.limit(0), landmarks=50)
