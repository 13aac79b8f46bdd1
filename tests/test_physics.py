import numpy as np
import pytest

from fieldloom.operators import estimators as E
from fieldloom.operators import physics as M


def world(spark, seed=2, offset=0.0):
    """A street of 12 nodes with chords, sources at 8 times, and what five sensors see of a field with known parameters."""
    rng = np.random.default_rng(seed)
    n, times, k = 12, 8, np.zeros((12, 12))
    for i in range(n):
        for j in {(i + 1) % n, (i + 5) % n}:
            k[i, j] = k[j, i] = -rng.uniform(0.5, 2)
    k -= np.diag(k.sum(1))
    m = np.diag(rng.uniform(0.5, 1.5, n))
    q = rng.gamma(1.0, 1.0, (times, n, 2)) * (rng.random((times, n, 2)) < 0.6)
    z = np.linalg.solve(3.0 * k + m, (q @ [0.5, 2.0]).T).T + offset
    tall = lambda a: spark.createDataFrame([(int(i), int(j), float(a[i, j])) for i, j in zip(*np.nonzero(a), strict=True)], "i long, j long, value double")
    source = spark.createDataFrame([(t, i, *map(float, q[t, i])) for t in range(times) for i in range(n) if q[t, i].any()], "t long, node long, a double, b double")
    seen = spark.createDataFrame([(t, i, float(z[t, i])) for t in range(times) for i in (0, 2, 5, 7, 10)] + [(0, 1, None)], "t long, node long, z double")
    return k, m, q, z, source, tall(k), tall(m), seen


@pytest.mark.parametrize("offset", [0.0, 4.0])
def test_planted_parameters_are_found(spark, offset):
    k, m, q, z, source, stiffness, mass, seen = world(spark, offset=offset)
    e = M.CalibratedField(source, ("a", "b"), stiffness, mass, average=False, offset=bool(offset), start=1.0, steps=15)
    found = {r.term: r.value for r in e.fit(seen).collect()}
    assert np.allclose([found[x] for x in ("diffusion", "a", "b", "offset")], [3.0, 0.5, 2.0, offset], rtol=2e-2, atol=1e-3) and found["loss"] < 1e-5
    exact = spark.createDataFrame([("diffusion", 3.0), ("a", 0.5), ("b", 2.0), ("offset", offset)], M.TABLE)
    own = e.predict(exact, seen).collect()
    assert len(own) == 96 and all(abs(r.estimate - z[r.t, r.node]) < 1e-9 for r in own)


def test_loss_and_slope_equal_dense_numpy(spark, monkeypatch):
    k, m, q, z, source, stiffness, mass, seen = world(spark)
    noisy = np.random.default_rng(3).normal(0, 0.2, z.shape) + z
    at = (0, 2, 5, 7, 10)
    mean = noisy[:, at].mean(1, keepdims=True)
    rows = spark.createDataFrame([(t, i, float(noisy[t, i])) for t in range(8) for i in at], "t long, node long, z double")

    def loss(d):
        fields = np.stack([np.linalg.solve(d * k + m, q[:, :, c].T).T for c in range(2)], axis=2)[:, at].reshape(-1, 2)
        y = (noisy[:, at] - mean).ravel()
        w = np.linalg.lstsq(fields, y, rcond=None)[0]
        return ((fields @ w - y) ** 2).mean(), w

    e = M.CalibratedField(source, ("a", "b"), stiffness, mass, positive=False)
    f, slope, w = e.loss_and_slope(rows, 2.0)
    assert np.isclose(f, loss(2.0)[0]) and np.allclose(w, loss(2.0)[1])
    assert np.isclose(slope, (loss(2.001)[0] - loss(1.999)[0]) / 0.002, rtol=1e-3)


def test_no_sensors_and_the_mean_is_added_back(spark):
    k, m, q, z, source, stiffness, mass, seen = world(spark)
    e = M.CalibratedField(source, ("a", "b"), stiffness, mass, steps=1)
    assert {r.term: r.value for r in e.fit(seen.limit(0)).collect()}["loss"] == float("inf")
    flat = spark.createDataFrame([("diffusion", 1.0), ("a", 0.0), ("b", 0.0), ("offset", 0.0)], M.TABLE)
    got = {r.t: r.estimate for r in e.predict(flat, seen.where("t = 3")).collect()}
    assert set(got) == {3} and np.isclose(got[3], z[3, [0, 2, 5, 7, 10]].mean())
    assert M.identity(stiffness).count() == 12 and E is not None
