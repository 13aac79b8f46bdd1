import numpy as np
import pytest

from fieldloom.operators import spectral as S


def ring(n, seed=1):
    """A weighted ring with chords: a Laplacian with eigenvalues apart from each other."""
    rng = np.random.default_rng(seed)
    w = np.zeros((n, n))
    for i in range(n):
        for j in {(i + 1) % n, (i + 7) % n}:
            w[i, j] = w[j, i] = rng.uniform(0.5, 2)
    return np.diag(w.sum(1)) - w


def tall(spark, a):
    return spark.createDataFrame([(int(i), int(j), float(a[i, j])) for i, j in zip(*np.nonzero(a), strict=True)], "i long, j long, value double")


def vectors(basis, n, k):
    out = np.zeros((n, k))
    for r in basis.collect():
        out[r.node, r.k] = r.b
    return out


@pytest.mark.parametrize("which", ["smallest", "largest"])
def test_eigenpairs_equal_numpy(spark, monkeypatch, which):
    n, k = 30, 2
    a = ring(n)
    values, v = np.linalg.eigh(a)
    values, v = (values[:k], v[:, :k]) if which == "smallest" else (values[::-1][:k], v[:, ::-1][:, :k])
    found = [S.eigenpairs(tall(spark, a), k, which)]
    if which == "smallest":
        monkeypatch.setattr(S, "DENSE_NODES", 10)
        monkeypatch.setattr(S, "DEGREE", 20)
        monkeypatch.setattr(S, "CHAIN", 7)
        found.append(S.eigenpairs(tall(spark, a), k, which, close=1e-7))
    for own, basis in found:
        got = vectors(basis, n, k)
        assert np.allclose(own, values, atol=1e-7)
        assert np.allclose(got.T @ got, np.eye(k), atol=1e-7), got.T @ got
        assert np.allclose(np.abs((got * v).sum(0)), 1, atol=1e-6)


def test_few_nodes_repeats_and_none(spark, monkeypatch):
    m = spark.createDataFrame([(1, 1, 1.0), (1, 1, 1.0), (2, 2, 5.0)], "i long, j long, value double")
    values, basis = S.eigenpairs(m, 9)
    assert values.tolist() == [2.0, 5.0] and basis.count() == 4
    assert S.eigenpairs(m.limit(0), 3)[1].count() == 0


def test_energy_is_that_of_the_field(spark, monkeypatch):
    n = 16
    a = ring(n, 3)
    full = np.random.default_rng(4).normal(size=(3, n)) + 2.0
    field = spark.createDataFrame([(t, i, float(full[t, i])) for t in range(3) for i in range(n)] + [(0, 999, 50.0)], "t long, node long, z double")
    _, v = np.linalg.eigh(a)
    c = full @ v
    keep = np.cumsum(c**2, 1) / (c**2).sum(1, keepdims=True) <= 0.9
    want = (c * keep) @ v.T
    found = [S.energy_filter(field, tall(spark, a), 0.9).collect()]
    monkeypatch.setattr(S, "DENSE_NODES", 5)  # modes are then added until every time has its share
    found.append(S.energy_filter(field, tall(spark, a), 0.9, first=10).collect())
    for rows in found:
        assert len(rows) == 3 * n and all(abs(r.z - want[r.t, r.node]) < 1e-5 for r in rows)


def principal(full, k):
    centred = full - full.mean(0)
    values, v = np.linalg.eigh(centred.T @ centred / len(full))
    return values[::-1][:k], v[:, ::-1][:, :k]


@pytest.mark.parametrize("times", [1000, 3])
def test_principal_vectors_equal_numpy(spark, monkeypatch, times):
    monkeypatch.setattr(S, "TIMES", times)  # beyond it the covariance is an operator
    rng = np.random.default_rng(5)
    full = rng.normal(size=(12, 5)) @ (np.diag([9, 4, 2, 0.3, 0.1]) @ rng.normal(size=(5, 30)))
    full[rng.random(full.shape) < 0.03] = 0
    rows = [(t, i, float(full[t, i])) for t in range(12) for i in range(30) if full[t, i]]
    rows = rows[1:] + [(*rows[0][:2], rows[0][2] / 2)] * 2 + [(0, 3, None)]
    values, basis = S.principal_vectors(spark.createDataFrame(rows, "t long, node long, z double"), 3, close=1e-7)
    want_values, want = principal(full, 3)
    got = vectors(basis, 30, 3)
    assert np.allclose(values, want_values, rtol=1e-6)
    assert np.allclose(np.abs((got * want).sum(0)), 1, atol=1e-6) and np.allclose(got.T @ got, np.eye(3), atol=1e-6)
    assert (got[np.abs(got).argmax(0), range(3)] > 0).all()


def test_principal_vectors_of_little(spark):
    empty = spark.createDataFrame([], "t long, node long, z double")
    assert len(S.principal_vectors(empty, 2)[0]) == 0 and S.principal_vectors(empty, 2)[1].count() == 0
    still = spark.createDataFrame([(t, i, 1.0) for t in range(3) for i in range(4)], "t long, node long, z double")
    assert S.principal_vectors(still, 2)[1].count() == 0
    line = spark.createDataFrame([(t, i, float(t * (i + 1))) for t in range(3) for i in range(4)], "t long, node long, z double")
    assert len(S.principal_vectors(line, 3)[0]) == 1
