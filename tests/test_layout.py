"""t-SNE and UMAP in the cluster: the lists, the grid and the layouts of more vectors than the driver fits."""

import numpy as np
import pytest

from sonoplan.operators import derive, layout


def test_grid_equals_the_sums_over_all_pairs():
    rng = np.random.default_rng(5)
    for k, spread in ((1, 0.01), (2, 0.01), (2, 12.0), (3, 2.0)):
        y = rng.normal(0, spread, (300, k))
        d = y[:, None] - y[None]
        q = 1 / (1 + (d * d).sum(2))
        far = layout.Repulsion(y)
        assert abs(far.total - (q.sum() - len(y))) < 1e-2 * q.sum()
        exact = (q[:, :, None] ** 2 * d).sum(1)
        assert np.abs(far.push(y) - exact).max() < 2e-2 * np.abs(exact).max()


def test_lists_equal_brute_force(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(2500, 5))  # three packed parts
    z = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "idx bigint, v array<double>").repartition(3)
    d = ((x[:, None] - x[None]) ** 2).sum(2)
    np.fill_diagonal(d, np.inf)
    want = np.argsort(d, 1)[:, :4]
    best = {}
    for r in layout.near_lists(z, len(x), 5, 4).collect():
        others, far = (np.frombuffer(r[c], t).reshape(-1, 4) for c, t in (("others", np.int64), ("far", np.float64)))
        for i in range(len(others)):
            best.setdefault(r["piece"] * layout.LEFT + i, []).extend(zip(far[i], others[i]))
    assert sorted(best) == list(range(len(x)))
    assert all({o for _, o in sorted(best[i])[:4]} == set(want[i]) for i in best)


@pytest.mark.parametrize("method", ["tsne", "umap"])
def test_more_vectors_than_the_driver_takes(spark, monkeypatch, method):
    """All vectors are fitted, none of them on the driver, and any number is taken where no limit is asked for."""
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(c, 0.1, (450, 6)) for c in (0, 3, 6)])
    rows = spark.createDataFrame([(7 * i, v.tolist()) for i, v in enumerate(x)] + [(3, None)], "chunk_id bigint, v array<double>").repartition(5)
    monkeypatch.setattr(derive, "WHOLE_MOST", 100)
    monkeypatch.setattr(derive, f"{method.upper()}_MOST", 200)
    monkeypatch.setattr(derive, "_matrix", None)  # what brings vectors to the driver
    with pytest.raises(ValueError):
        getattr(derive, method)(rows)
    got = {r["chunk_id"]: r["v"] for r in getattr(derive, method)(rows, 2, steps=120, limited=False).collect()}
    assert sorted(got) == [7 * i for i in range(len(x))]
    y = np.array([got[7 * i] for i in range(len(x))]).reshape(3, 450, 2)
    assert np.isfinite(y).all()
    centre = np.median(y, axis=1)
    near = np.linalg.norm(y[:, :, None] - centre[None, None], axis=3).argmin(2)
    assert (near == np.arange(3)[:, None]).mean() > 0.98


@pytest.mark.parametrize("kind", ["plain", "ordered", "copies", "equal", "far"])
def test_few_are_measured_and_none_is_missed(kind):
    """The lists are those of all distances, also where the sample misleads or the rows are alike."""
    rng = np.random.default_rng(8)
    y = rng.normal(size=(20_000, 8))
    if kind == "ordered":
        y = y[np.argsort(y[:, 0])]
        y[::2] += 50  # what the sample takes lies elsewhere
    elif kind == "copies":
        y[:9000] = y[0]
    elif kind == "equal":
        y[:] = 1.5
    elif kind == "far":
        y[7] *= 1e6
    to = np.arange(len(y)) * 3
    rows = np.array([0, 1, 2, 7, 8999, 9000, 15_001, 19_999])
    near, far = layout.Finder(y)(y[rows], rows, to[rows], to, 40)
    for r, i, got in zip(rows, near, far):
        d = ((y[r] - y) ** 2).sum(1)
        d[r] = np.inf
        assert r not in i and len(set(i)) == 40
        assert np.allclose(np.sort(got), np.sort(d)[:40], atol=1e-9 * (y[r] @ y[r] + 1)) and np.allclose(d[i], got, atol=1e-9 * (y[r] @ y[r] + 1))


def test_push_of_the_grid_is_near_the_exact_one():
    y = np.random.default_rng(1).normal(0, 14, (3000, 2))
    d = y[:, None] - y[None]
    exact = ((1 / (1 + (d * d).sum(2)))[:, :, None] ** 2 * d).sum(1)
    error = layout.Repulsion(y).push(y) - exact
    assert np.sqrt((error**2).sum() / (exact**2).sum()) < 7e-3  # 8.7e-3 when places were multiplied after the interpolation


def test_an_edge_of_the_graph_is_ten_bytes_at_most(spark):
    """What every step of the descent reads; and the parts hold every edge from both ends."""
    x = np.random.default_rng(9).normal(size=(2100, 5))
    z = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "idx bigint, v array<double>").repartition(3)
    kept = layout.graph(layout.near_lists(z, len(x), 5, 20), 20, lambda d: np.exp(-d), np.add.reduceat)
    parts = sorted(kept.collect())
    kept.unpersist()
    edges = {}
    for part in parts:
        low, each, tail, w = layout._edges(part)
        edges |= {(low + h, t): p for h, t, p in zip(np.repeat(np.arange(len(each)), each).tolist(), tail.tolist(), w.tolist())}
    assert all(edges[b, a] == p for (a, b), p in edges.items())
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    own = {(a, b): np.exp(-d[a, b]) for a in range(len(x)) for b in np.argsort(d[a])[:20].tolist()}
    want = {k: own.get(k, 0) + own.get(k[::-1], 0) for k in own.keys() | {k[::-1] for k in own}}
    assert edges.keys() == want.keys() and all(abs(edges[k] - want[k]) < 1e-6 for k in want)
    assert sum(len(x) for part in parts for x in part[1:]) < 10 * len(edges)
