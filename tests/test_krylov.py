import numpy as np

from fieldloom.operators import sparse
from fieldloom.operators import spectral as S

from test_spectral import ring, tall


def test_energy_filter_without_modes(spark, monkeypatch):
    n = 90
    a = ring(n, 7) * 1e3
    full = np.random.default_rng(8).normal(size=(4, n)) + 1.0
    full[1, ::3] = 0  # nodes without a value
    full[3] = 0  # a time without energy
    rows = [(t, i, float(full[t, i])) for t in range(4) for i in range(n) if full[t, i] or t == 3]
    rows = rows[1:] + [(0, 0, float(full[0, 0]) / 2)] * 2 + [(0, 999, 50.0), (2, 5, None)]
    field = spark.createDataFrame(rows, "t long, node long, z double")
    c = full @ np.linalg.eigh(a)[1]
    keep = np.cumsum(c**2, 1) <= 0.7 * (c**2).sum(1, keepdims=True)
    want = (c * keep) @ np.linalg.eigh(a)[1].T

    def never(*args):
        raise AssertionError("modes were asked for")

    monkeypatch.setattr(S, "DENSE_NODES", 10)
    with monkeypatch.context() as m:
        m.setattr(S, "eigenbasis", never)
        found = S.energy_filter(field, tall(spark, a), 0.7).collect()
    assert {(r.t, r.node) for r in found} == {(t, i) for t in range(3) for i in range(n)} and len(found) == 3 * n
    assert max(abs(r.z - want[r.t, r.node]) for r in found) < 1e-8


def test_no_energy_kept_gives_no_rows_and_other_matrices_keep_their_modes(spark, monkeypatch):
    n = 16
    a = ring(n, 3)
    field = spark.createDataFrame([(0, i, 1.0) for i in range(n)] + [(1, i, float(i % 5)) for i in range(n)], "t long, node long, z double")
    monkeypatch.setattr(S, "DENSE_NODES", 5)
    found = {(r.t, r.node): r.z for r in S.energy_filter(field, tall(spark, a), 0.9).collect()}
    assert {t for t, _ in found} == {1}  # all of time 0 is on the first mode, more than its share
    monkeypatch.setattr(sparse, "ENTRIES", 0)
    other = {(r.t, r.node): r.z for r in S.energy_filter(field, tall(spark, a), 0.9, first=10).collect()}
    assert other.keys() == found.keys() and all(abs(z - found[k]) < 1e-5 for k, z in other.items())
