import numpy as np
import pytest

from fieldloom.operators import kernels

KERNELS = [lambda d: np.exp(-5 * d), lambda d: np.exp(-d * d / 0.02), lambda d: 1 / (d + 0.2), lambda d: np.exp(-d / 0.02)]


@pytest.mark.parametrize("leaf", [20, 10_000])
def test_sums_by_cells_are_those_over_all_pairs(spark, monkeypatch, leaf):
    monkeypatch.setattr(kernels, "LEAF", leaf)
    rng = np.random.default_rng(4)
    xy = np.vstack([rng.normal(size=(900, 2)) * 0.12, np.tile([[0.3, 0.1]], (100, 1))])
    z = rng.integers(0, 10, size=len(xy)).astype(float)
    at = rng.normal(size=(300, 2)) * 0.15
    points = spark.createDataFrame([(k, float(a), float(b)) for k, (a, b) in enumerate(at)] + [(-1, None, 0.0)], "id long, x double, y double")
    nodes = spark.createDataFrame([(k, float(a), float(b), float(c)) for k, ((a, b), c) in enumerate(zip(xy, z, strict=True))] + [(-1, float("nan"), 0.0, 1.0)], "id long, x double, y double, z double")
    got = {(r.id, r.k): (r.weights, r.sums) for r in kernels.kernel_sums(points, nodes, KERNELS).collect()}
    d = np.sqrt(((at[:, None] - xy[None]) ** 2).sum(2))
    assert len(got) == 4 * len(at)
    for k, kernel in enumerate(KERNELS):
        w = kernel(d)
        want, found = np.stack([w.sum(1), w @ z], axis=1), np.array([got[i, k] for i in range(len(at))])
        error = np.abs(found / want - 1).max()
        print(k, error)
        assert error < 1e-11
