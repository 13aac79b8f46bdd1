"""Kernel sums of counts by time, held against numpy and the plan of joins."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldloom.operators import counted, spatial


def made(n, m, width, seed, far=False):
    rng = np.random.default_rng(seed)
    x, y = rng.normal(0, 0.2, (2, n))
    px, py = rng.normal(0, 0.2, (2, m))
    if far:
        x[0], y[0], px[0], py[0] = 40.0, -3.0, -30.0, 25.0
    dense = np.where(rng.random((n, width)) < 0.1, rng.integers(1, 5, (n, width)), 0).astype(float)
    rows, columns = np.nonzero(dense)
    low, high = min(x.min(), y.min(), px.min(), py.min()), max(x.max(), y.max(), px.max(), py.max())
    box = (low, low, (high - low) * (1 + 1e-9))
    starts = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=n))])
    return counted.Counts(x, y, starts, columns, dense[rows, columns], width, box, counted.depth_of(x, y, box)), px, py, dense


@pytest.mark.parametrize("kernel", [lambda d: np.exp(-5 * d), lambda d: 1 / (d + 0.1), lambda d: (d <= 0.3).astype(float), lambda d: np.exp(-3000 * d)])
@pytest.mark.parametrize("far", [False, True])
def test_sums_equal_those_of_all_pairs(monkeypatch, kernel, far):
    monkeypatch.setattr(counted, "LEAF", 20)
    monkeypatch.setattr(counted, "DENSE", 3000)
    monkeypatch.setattr(counted, "WIDE", 170)
    c, px, py, dense = made(900, 2500, 30, 1, far)
    assert c.depth >= 3
    want = kernel(np.sqrt((px[:, None] - c.x) ** 2 + (py[:, None] - c.y) ** 2)) @ dense
    assert np.allclose(c.sums(px, py, kernel), want, rtol=1e-8, atol=0)


def test_far_pixels_are_summed_at_grids(monkeypatch):
    monkeypatch.setattr(counted, "LEAF", 20)
    c, px, py, _ = made(900, 20_000, 30, 2)
    met = []
    c.sums(px, py, lambda d: met.append(d.size) or np.exp(-5 * d))
    assert sum(met) < 0.6 * 900 * 20_000


def test_features_equal_the_joined(spark, monkeypatch):
    rng = np.random.default_rng(3)
    points = spark.createDataFrame([(5 * i, float(a), float(b)) for i, (a, b) in enumerate(rng.normal(0, 0.2, (60, 2)))], "id long, x double, y double")
    nodes = spark.createDataFrame([(7 * i, float(a), float(b)) for i, (a, b) in enumerate(rng.normal(0, 0.2, (40, 2)))], "id long, x double, y double")
    seen = spark.createDataFrame([(int(t), 7 * int(i), int(c)) for t, i, c in zip(rng.integers(0, 9, 300), rng.integers(0, 40, 300), rng.integers(0, 5, 300), strict=True)] + [(77, 0, 2)], "t long, id long, colour int").join(nodes, "id")
    kernel, smooth = lambda d: F.exp(-5.0 * d), lambda d: np.exp(-5.0 * d)
    rows = lambda df: {(r.point, r.t): (r.green, r.red) for r in df.collect()}
    for normalise in (True, False):
        want = rows(spatial.kernel_features(points, seen, kernel, {"green": 1, "red": 4}, normalise))
        with monkeypatch.context() as m:
            m.setattr(spatial, "MANY_POINTS", 10)
            m.setattr(spatial, "CELL_POINTS", 4)
            m.setattr(counted, "LEAF", 3)
            m.setattr(spatial, "_weighted_counts", None)
            got = rows(spatial.kernel_features(points, seen, kernel, {"green": 1, "red": 4}, normalise, smooth=smooth))
        assert set(got) == set(want) and all(np.allclose(got[k], want[k], rtol=1e-9, atol=1e-12) for k in want)
