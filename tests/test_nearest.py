"""Nearest rows by block products against all pairs."""

import numpy as np
import pytest

from sonoplan.operators import nearest


def plain(rows, k):
    """Ranks by all pairs: {id: [(other, score)]}."""
    out = {}
    for i, v in rows:
        if v is None or not np.isfinite(np.array(v, float)).all():
            continue
        found = []
        for j, w in rows:
            if j != i and w is not None and len(w) == len(v) and np.isfinite(np.array(w, float)).all():
                n = np.linalg.norm(v) * np.linalg.norm(w)
                found.append((-round(float(np.dot(v, w) / n), 9) + 0.0 if n else 0.0, j))
        out[i] = [(j, -s) for s, j in sorted(found)[:k]]
    return {i: f for i, f in out.items() if f}


def got(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["id"], r["rank"])):
        out.setdefault(r["id"], []).append((r["other"], r["score"]))
        assert r["rank"] == len(out[r["id"]])
    return out


def same(a, b):
    assert a.keys() == b.keys()
    for i in a:
        assert [o for o, _ in a[i]] == [o for o, _ in b[i]], i
        assert np.allclose([s for _, s in a[i]], [s for _, s in b[i]], atol=2e-9)


@pytest.mark.parametrize("block_bytes", [1 << 9, 1 << 25])
@pytest.mark.parametrize("k", [1, 7, 500])
def test_equals_all_pairs(spark, monkeypatch, block_bytes, k):
    monkeypatch.setattr(nearest, "BLOCK_BYTES", block_bytes)
    rng = np.random.default_rng(k)
    rows = [(i * 3, v.tolist()) for i, v in enumerate(rng.integers(-2, 3, (60, 4)).astype(float))]  # many ties, zero vectors
    rows += [(1000 + i, v.tolist()) for i, v in enumerate(rng.normal(size=(20, 6)))]
    rows += [(2000, None), (2001, [float("nan"), 1.0, 1.0, 1.0]), (2002, [1.0]), (2003, [])]
    df = spark.createDataFrame(rows, "id bigint, v array<double>")
    same(got(nearest.nearest_rows(df, k)), plain([r for r in rows if r[1] != []], k))


def test_null_components_empty_tables_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, [1.0, None], 0), (2, [1.0, 2.0], 1), (3, [2.0, 4.0], 2)], "id bigint, v array<double>, d int")
    assert [tuple(r) for r in nearest.nearest_rows(df, 3).orderBy("id").collect()] == [(2, 1, 3, 1.0), (3, 1, 2, 1.0)]
    assert nearest.nearest_rows(df.limit(0), 3).collect() == []
    with pytest.raises(ValueError):
        nearest.nearest_rows(df, 0)


def test_a_tile_leaves_no_more_than_k_rows_a_row():
    x = np.ones((400, 3)) / np.sqrt(3)  # all equal: every product is a tie
    ids = np.arange(400)
    at, other, score = nearest.best_of(x, ids, x, ids, 4)
    assert len(at) == 1600 and set(other) == {0, 1, 2, 3, 4} and (score == 1).all()
    assert other[at == 2].tolist() == [0, 1, 3, 4]
