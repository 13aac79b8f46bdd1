import numpy as np
import pytest

from fieldloom.operators import estimators as E
from fieldloom.operators import sparse
from fieldloom.operators import spectral as S
from test_spectral import ring, tall, vectors


def never(*_, **__):
    raise AssertionError("a plan of joins for each product")


@pytest.mark.parametrize("most", [2_500_000, 0])
def test_solves_equal_numpy_beyond_the_dense_bound(spark, monkeypatch, most):
    monkeypatch.setattr(E, "SOLVE_NODES", 5)
    monkeypatch.setattr(sparse, "ENTRIES", most)
    if most:
        monkeypatch.setattr(E, "conjugate_gradients", never)
    n = 40
    a = ring(n) + np.eye(n)
    b = np.random.default_rng(2).normal(size=(3, n)) * [[1.0], [1e-6], [0.0]]
    b[1, 7:] = 0
    rows = [(t, i, float(b[t, i])) for t in range(3) for i in range(n) if b[t, i] or t == 2] + [(0, 3, None), (0, 999, 5.0), (1, 2, 1e-6), (1, 2, -1e-6)]
    got = {(r.t, r.node): r.z for r in E.solve_field(spark.createDataFrame(rows, "t long, node long, z double"), [(1.0, tall(spark, a))]).collect()}
    want = np.linalg.solve(a, b.T).T
    assert len(got) == 3 * n and all(abs(got[t, i] - want[t, i]) <= 1e-9 * max(np.abs(want[t]).max(), 1e-30) for t, i in got)


def test_resistances_equal_numpy_beyond_the_dense_bound(spark, monkeypatch):
    monkeypatch.setattr(E, "SOLVE_NODES", 5)
    monkeypatch.setattr(E, "conjugate_gradients", never)
    n = 30
    a = ring(n)
    g = np.linalg.pinv(a)
    for at in (None, [0, 4, 9, 77], [3, 8]):
        own = range(n) if at is None else [x for x in at if x < n]
        got = {(r.a, r.b): r.r for r in E.resistances(tall(spark, a), at).collect()}
        assert set(got) == {(x, y) for x in own for y in own if x > y}
        assert all(np.isclose(r, g[x, x] + g[y, y] - 2 * g[x, y], rtol=1e-9) for (x, y), r in got.items())


@pytest.mark.parametrize("which", ["smallest", "largest"])
@pytest.mark.parametrize("part", [50_000, 7])
def test_eigenpairs_equal_numpy_with_the_matrix_in_the_tasks(spark, monkeypatch, which, part):
    monkeypatch.setattr(S, "DENSE_NODES", 10)
    monkeypatch.setattr(S, "PART", part)
    monkeypatch.setattr(S, "filtered", never)
    n, k = 60, 4
    a = ring(n, 5)
    a[:30, 30:] = a[30:, :30] = 0  # two parts, so the least value comes twice
    a -= np.diag(a.sum(1))
    values = np.linalg.eigvalsh(a)
    values = values[:k] if which == "smallest" else values[::-1][:k]
    own, basis = S.eigenpairs(tall(spark, a), k, which)
    v = vectors(basis, n, k)
    assert np.allclose(own, values, atol=1e-8) and np.allclose(v.T @ v, np.eye(k), atol=1e-7)
    assert np.abs(a @ v - v * own).max() < 1e-6


@pytest.mark.parametrize("neighbours", [40, 5, 0])
def test_counts_below_need_no_eigenvalues(spark, monkeypatch, neighbours):
    n = 50
    a = ring(n, 6)
    a[7, 7] = 1.0  # a pivot of 0 at the bound 1
    values, bounds = np.linalg.eigvalsh(a), [-1.0, 0.3, 1.0, 2.5, 99.0]
    monkeypatch.setattr(S, "DENSE_NODES", 10)
    monkeypatch.setattr(S, "NEIGHBOURS", neighbours)
    with monkeypatch.context() as m:
        m.setattr(S, "eigenpairs", never)
        assert S.counts_below(tall(spark, a), bounds) == [int((values < b).sum()) for b in bounds]
    monkeypatch.setattr(S, "DENSE_NODES", 2_000)
    assert S.counts_below(tall(spark, a), bounds) == [int((values < b).sum()) for b in bounds]


def test_counts_below_of_a_dense_part(monkeypatch):
    """Nodes of some fifty neighbours are eliminated, so that a small rest is left."""
    monkeypatch.setattr(S, "CORE", 8)
    n = 55
    a = np.random.default_rng(12).normal(size=(n, n))
    a = a + a.T + 40 * np.diag(np.where(np.arange(n) % 3, 1.0, -1.0))
    held = sparse.Held(np.arange(n), np.arange(n), [((np.arange(n) + s) % n, a[np.arange(n), (np.arange(n) + s) % n]) for s in range(n)], np.diag(a).copy())
    assert S.negative_pivots(held, 0.3) == int((np.linalg.eigvalsh(a) < 0.3).sum())
