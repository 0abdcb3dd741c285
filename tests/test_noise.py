"""Noise of long songs: the growth from lists and blocks against full matrices, and its memory."""

import tracemalloc

import numpy as np
import pytest

from sonoplan.operators import noise


def full_growth(x, core, mutual):
    """Prim's order on the full matrix: (order, parent, reach)."""
    d = np.maximum(noise.distances(x, x), core[:, None])
    if mutual:
        d = np.maximum(d, core[None])
    n = len(x)
    reach, parent, left, order = np.full(n, np.inf), np.zeros(n, int), np.ones(n, bool), []
    for _ in range(n):
        i = min(np.flatnonzero(left), key=lambda j: (reach[j], j))
        order.append(i)
        left[i] = False
        for j in np.flatnonzero(left & (d[i] < reach)):
            reach[j], parent[j] = d[i, j], i
    return order, parent, reach


def songs():
    rng = np.random.default_rng(5)
    yield "scattered", rng.normal(size=(300, 6))
    yield "clustered", np.concatenate([rng.normal(c, s, (70, 4)) for c, s in ((0, 0.1), (3, 0.5), (6, 0.02), (9, 1.0))])
    yield "ties", rng.integers(0, 4, (250, 3)).astype(float)
    yield "equal", np.repeat(rng.normal(size=(5, 8)), [90, 60, 2, 1, 40], 0)
    yield "line", np.arange(200.0)[:, None]
    yield "few", rng.normal(size=(7, 3))


@pytest.mark.parametrize("listed", [1, 3, 32])
@pytest.mark.parametrize("rows", [1, 17, 4096])
def test_growth_equals_that_of_a_full_matrix(monkeypatch, listed, rows):
    for name, x in songs():
        monkeypatch.setattr(noise, "BLOCK_BYTES", rows * 8 * len(x))
        x = noise.on_grid(x)
        near = noise.nearest(x, listed)
        for samples in (1, 2, 4):
            core = np.sort(noise.distances(x, x), 1)[:, samples - 1]
            for mutual in (True, False):
                order, parent, reach = noise.grow(x, near, core, mutual)
                want_order, want_parent, want_reach = full_growth(x, core, mutual)
                note = (name, samples, mutual)
                assert list(order) == list(want_order) and list(parent[1:]) == list(want_parent[1:]), note
                assert list(reach[1:]) == list(want_reach[1:]), note


def test_distances_on_the_grid_are_exact():
    x = noise.on_grid(np.random.default_rng(9).normal(size=(200, 512)))
    assert (noise.on_grid(x) == x).all() and not noise.on_grid(np.zeros((2, 3))).any()
    whole = noise.distances(x, x)
    assert not np.diag(whole).any() and (whole == whole.T).all()
    assert all((noise.distances(x[i : i + k], x)[0] == whole[i]).all() for i in range(150) for k in (1, 7, 50))


def test_nearest_and_core():
    x = np.array([[0.0], [1.0], [3.0], [7.0]])
    at, far = noise.nearest(x, 9)
    assert at.tolist() == [[1, 2, 3], [0, 2, 3], [1, 0, 3], [2, 1, 0]] and far[0].tolist() == [1, 3, 7]
    assert noise._core((at, far), 1).tolist() == [0, 0, 0, 0] and noise._core((at, far), 3).tolist() == [3, 2, 3, 6]
    assert noise.nearest(x[:1], 3)[0].shape == (1, 0)


@pytest.mark.parametrize("method", ["hdbscan", "optics"])
def test_labels_do_not_depend_on_blocks_or_lists(monkeypatch, method):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(c, 0.05, (60, 5)) for c in np.eye(5)] + [rng.normal(size=(12, 5))])
    whole = noise.noise_of(x, method)
    assert whole[300:].any() and whole[:300].mean() < 0.05
    monkeypatch.setattr(noise, "BLOCK_BYTES", 8 * len(x) * 5)
    monkeypatch.setattr(noise, "LISTED", 2 * noise.NEIGHBOURS)
    assert (noise.noise_of(x, method) == whole).all()


@pytest.mark.parametrize("method", ["hdbscan", "optics"])
def test_memory_is_in_proportion_to_the_chunks(monkeypatch, method):
    monkeypatch.setattr(noise, "BLOCK_BYTES", 2 << 20)
    rng = np.random.default_rng(3)
    n, d = 6000, 16  # the full matrix: 288 MB, of which four were held at once
    x = np.concatenate([rng.normal(c, 0.1, (n // d, d)) for c in np.eye(d) * 3])
    tracemalloc.start()
    noise.noise_of(x, method)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 6 * (2 << 20) + len(x) * (4 * 8 * d + 40 * noise.LISTED + 1200), peak


def test_ragged_null_and_short_songs_have_no_flags(spark):
    rows = [(1, k, [float(k), 1.0]) for k in range(7)] + [(2, 10 + k, [1.0] * (2 + k % 2)) for k in range(8)]
    rows += [(3, 30, None), (3, 31, [1.0, 0.0])] + [(4, 40, [1.0, 2.0])] + [(5, 50 + k, [0.0, 0.0]) for k in range(6)]
    t = spark.createDataFrame(rows, "track_id bigint, chunk_id bigint, v array<double>")
    for method in ("hdbscan", "optics"):
        got = {r["chunk_id"]: r["noise"] for r in noise.song_flags(t, method).collect()}
        assert len(got) == len(rows) and not any(got[r[1]] for r in rows if r[0] != 1)
    reach = {r["track_id"] for r in noise.knn_reach(t).collect()}
    assert reach == {1, 5}
