import math
import random
from collections import Counter

import numpy as np
import pytest

from dialoom.llm import whitening
from dialoom.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<float>, label int, x string, dim string, v string"


def plain(rows):
    """x, n, S, covariance and eigenpairs by exact sums and a library eigensolver."""
    x = {i: [math.floor(64.0 * float(np.float32(c))) + 1_000_000 for c in v] for i, v in rows}
    fit = sorted({tuple(v) for v in x.values()})
    n, s = len(fit), [sum(c) for c in zip(*fit)]
    y = np.array([[(n * c - t) / n for c, t in zip(v, s)] for v in fit])
    e, u = np.linalg.eigh(y.T @ y / n)
    return x, n, s, e[::-1], u[:, ::-1], y


def compare(got, rows, components, scale=1e-8):
    x, n, s, e, u, y = plain(rows)
    k = min(components, int((e > e[0] * 1e-12).sum()))
    assert Counter((r.vec_id, r.component) for r in got) == Counter((i, c) for i, _ in rows for c in range(1, k + 1))
    by = {(r.vec_id, r.component): r for r in got}
    for c in range(1, k + 1):
        mine = np.array([by[i, c].whitened for i in x])
        want = np.array([[(n * a - t) / n for a, t in zip(v, s)] for v in x.values()]) @ u[:, c - 1] / np.sqrt(e[c - 1])
        want = want if abs(mine - want).max() < abs(mine + want).max() else -want
        assert np.allclose(mine, want, atol=scale)
    for r in got:
        assert r.n == n and r.deviation == sum((n * a - t) ** 2 for a, t in zip(x[r.vec_id], s))
        assert abs(r.explained - e[r.component - 1] / e.sum()) < 1e-10 and 0 <= r.identity_error < 1e-9


def table(rng, n=200, d=12):
    mix = np.random.default_rng(4).normal(size=(d, d)) * np.geomspace(3, 0.1, d)
    return [(i, [float(np.float32(v)) for v in mix @ [rng.gauss(0, 1) for _ in range(d)]]) for i in range(n)]


def test_factors():
    rng = np.random.default_rng(2)
    for d, r in ((1, 1), (2, 2), (9, 9), (9, 4), (40, 40), (7, 0)):
        b = rng.normal(size=(d, r)) * np.geomspace(1, 1e-5, max(r, 1))[:r] if r else np.zeros((d, 1))
        a = b @ b.T
        l = whitening.pivoted_cholesky(a)
        assert l.shape[1] <= max(r, 0) or r == 0 and l.shape[1] == 0
        assert np.allclose(l @ l.T, a, atol=1e-13)
        if l.shape[1]:
            e, u = whitening.jacobi(l)
            want = np.linalg.eigvalsh(a)[::-1][: len(e)]
            assert np.allclose(e, want, rtol=1e-6, atol=1e-15) and np.allclose(u.T @ u, np.eye(len(e)), atol=1e-12)
            assert np.allclose(u * e @ u.T, a, atol=1e-13)


def test_packed_vectors_come_back_and_equal_ones_are_equal():
    x = np.array([[1_000_000, 999_999], [1_000_000 + 40_000, 0], [2**46, -5], [1_000_000, 999_999]])
    cells = whitening.pack(x)
    assert whitening.unpack(cells).tolist() == x.tolist() and cells[0] == cells[3] and len(set(cells)) == 3


def test_whitening_equals_a_plain_eigensolver(spark):
    rows = table(random.Random(1))
    rows += [(1000 + i, rows[7][1]) for i in range(90)]                      # copies of one vector
    full = [(i, v, 1, "x", "d", "v") for i, v in rows]
    odd = [(2000, None), (2001, [1.0, None] + [0.0] * 10), (2002, [float("nan")] + [0.0] * 11), (2003, [float("inf")] + [0.0] * 11),
           (2004, []), (2005, [1.0, 2.0]), (2006, [1e30] * 12)]
    df = spark.createDataFrame(full + [(i, v, None, None, None, None) for i, v in odd], SCHEMA).repartition(5)
    compare(whitening.whitened(df, components=5).collect(), rows, 5)
    compare(whitening.whitened(df, components=50).collect(), rows, 50, 1e-6)


def test_few_and_flat_tables(spark):
    make = lambda rows: spark.createDataFrame([(i, v, 1, "", "", "") for i, v in rows], SCHEMA)
    assert whitening.whitened(make([])).count() == 0 and whitening.whitened(make([])).columns[0] == "vec_id"
    assert whitening.whitened(make([(1, [1.0, 2.0]), (2, [1.0, 2.0])])).count() == 0
    flat = [(i, [float(i), 2.0 * i, 3.0]) for i in range(10)]                # rank one
    got = whitening.whitened(make(flat)).collect()
    assert {r.component for r in got} == {1}
    compare(got, flat, 16)
    twice = [(1, [0.0, 1.0]), (1, [0.0, 1.0]), (None, [5.0, 1.0])]           # repeated and missing ids
    assert Counter(r.vec_id for r in whitening.whitened(make(twice)).collect()) == {1: 2, None: 1}


def test_wide_values_keep_exact_deviations(spark):
    rng = random.Random(9)
    rows = [(i, [rng.uniform(-1, 1) * 2.0**18, rng.uniform(-1, 1)]) for i in range(60)]
    df = spark.createDataFrame([(i, v, 1, "", "", "") for i, v in rows], SCHEMA)
    x, n, s, *_ = plain(rows)
    for r in whitening.whitened(df).collect():
        assert r.deviation == sum((n * a - t) ** 2 for a, t in zip(x[r.vec_id], s))
    far = rows + [(99, [2.0**39, 0.0])]
    df = spark.createDataFrame([(i, v, 1, "", "", "") for i, v in far], SCHEMA)
    assert {r.deviation for r in whitening.whitened(df).collect() if r.vec_id == 99} == {None}


def test_query_over_a_whole_table(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    got = QUERIES["op12_embedding_whitening"](spark, SF).collect()
    assert len(got) == 16 * len(rows)
    compare(got, rows, 16)


@pytest.mark.parametrize("columns", [3, 4, 9])
def test_every_pair_of_columns_meets(columns):
    l = np.random.default_rng(columns).normal(size=(12, columns))
    e, u = whitening.jacobi(l)
    assert np.allclose(u.T @ u, np.eye(columns), atol=1e-13) and np.allclose(sorted(e), sorted(np.linalg.svd(l)[1] ** 2))
