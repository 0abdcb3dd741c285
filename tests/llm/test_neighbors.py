"""The block matrix join against DuckDB and all pairs, with ties, copies and odd vectors."""

from __future__ import annotations

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from sonoplan.llm import neighbors

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def rows():
    rng = np.random.default_rng(4)
    one = rng.normal(size=24).astype(np.float32)
    out = []
    for i in range(700):
        v = rng.normal(size=24)
        if i % 3 == 1:
            v = one  # a third of all rows are equal
        elif i % 7 == 2:
            v = one + rng.normal(size=24) * 1e-6  # and some differ by less than a code
        elif i % 11 == 0:
            v = v * 10.0 ** rng.integers(-20, 18)
        out.append((i, [float(x) for x in np.asarray(v, np.float32)], 0))
    out += [(700, None, 0), (720, [], 0), (740, [0.0] * 24, 0), (760, [1.0] * 23 + [None], 0), (780, [1.0] * 23 + [float("nan")], 0), (800, [1.0] * 23 + [float("inf")], 0), (None, [1.0] * 24, 0)]
    out += [(820, [1.0, 2.0, 3.0], 0), (821, [3.0, 2.0, 1.0], 0), (840, [-1.0] * 5, 0), (40, out[40][1], 0), (40, out[40][1], 1), (60, out[7][1], 0), (-20, out[41][1], 0), (41, out[40][1], 0)]
    return out


def by_duckdb(folder):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{folder}/embeddings.parquet/*.parquet'")
    cur = con.execute(neighbors.OP12_SQL)
    assert [c[0] for c in cur.description] == ["query_id", "rank", "vec_id", "score"]
    return sorted(cur.fetchall())


@pytest.mark.parametrize("some", ["all", "none", "few", "no queries"])
def test_equals_duckdb(spark, tmp_path, monkeypatch, some):
    monkeypatch.setattr(neighbors, "QUERY_BLOCK", 24 * 4 * 16)  # several blocks of either side
    monkeypatch.setattr(neighbors, "BASE_BLOCK", 24 * 4 * 90)
    data = {"all": rows(), "none": [], "few": rows()[:9], "no queries": [r for r in rows() if r[0] is None or r[0] % 20]}[some]
    df = spark.createDataFrame(data, SCHEMA)
    for c in ("id", "v", "tile", "query", "h"):
        df = df.withColumn(c, F.lit("clash"))
    df.repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    out = neighbors.op12_nearest(spark, str(tmp_path))
    got = sorted(tuple(r) for r in out.collect())
    assert got == by_duckdb(tmp_path)
    assert dict(out.dtypes) == {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "double"}
    assert bool(got) == (some in ("all", "few"))


@pytest.mark.parametrize("d", [3, 64, 1500])
def test_a_tile_is_exact(d):
    rng = np.random.default_rng(d)
    q, x = rng.normal(size=(40, d)), rng.normal(size=(5000, d)) * np.exp(rng.normal(size=(5000, 1)))
    x[100:900] = x[99]  # ties
    x[900:1300] = x[99] + rng.normal(size=(400, d)) * 1e-7
    ids = rng.permutation(5000)
    row, found, score = neighbors.tile_best(q, x, ids, 7)
    for i in range(len(q)):
        every = sum(q[i, c] * x[:, c] for c in range(d))
        best = np.lexsort((ids, -every))[:7]
        assert (found[row == i] == ids[best]).all() and (score[row == i] == every[best]).all()


def test_codes_bound_every_product():
    rng = np.random.default_rng(9)
    a, b = (rng.normal(size=(60, 33)) * 10.0 ** rng.integers(-30, 30, size=(60, 1)) for _ in range(2))
    ca, cb = neighbors.Codes(a), neighbors.Codes(b)
    assert (neighbors.code_products(ca.codes, cb.codes) == ca.codes.astype(int) @ cb.codes.astype(int).T).all()
    near = neighbors.code_products(ca.codes, cb.codes) * ca.scale[:, None] * cb.scale
    miss = ca.held[:, None] * cb.rest + ca.rest[:, None] * cb.norm
    assert (np.abs(a @ b.T - near) <= miss * (1 + 1e-9)).all()
    assert (miss < 0.05 * ca.norm[:, None] * cb.norm).all()


def test_vectors_beyond_the_range_of_squares():
    big = np.full((30, 4), 1e200)
    big[::2] *= -1
    row, found, score = neighbors.tile_best(big[:2], big, np.arange(30), 3)
    assert list(found) == [0, 2, 4, 1, 3, 5] and np.isinf(score).all()


def test_few_pairs_are_computed_in_double(monkeypatch):
    rng = np.random.default_rng(1)
    q, x, seen = rng.normal(size=(50, 64)), rng.normal(size=(20_000, 64)), []
    exact = neighbors.exact_products
    monkeypatch.setattr(neighbors, "exact_products", lambda q, x, i, j: seen.append(len(i)) or exact(q, x, i, j))
    neighbors.tile_best(q, x, np.arange(20_000), 21)
    assert sum(seen) < 0.02 * 50 * 20_000
