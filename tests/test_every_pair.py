"""What needs every pair of many places, held against numpy and the plans of joins."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldloom.operators import spatial


def places(spark, n, seed, z=True):
    rng = np.random.default_rng(seed)
    a = np.round(rng.normal(0, 0.12, (n, 2)), 2)  # many ties, and distances that equal the radius
    rows = [(7 * i + 3, float(x), float(y), float(i % 9)) for i, (x, y) in enumerate(a)]
    df = spark.createDataFrame(rows, "id long, x double, y double, z double")
    return df if z else df.drop("z")


def joined(*_, **__):
    raise AssertionError("a row for a pair")



def test_distance_stats_without_rows_for_pairs(spark, monkeypatch):
    for n in (1, 2, 5, 240):
        p = places(spark, n, n, z=False)
        pairs = spatial.all_pairs(p, p).where("id_a <> id_b").groupBy("id_a").agg(F.min("d"), F.avg("d"), F.median("d")).collect()
        with monkeypatch.context() as m:
            m.setattr(spatial, "all_pairs", joined)
            m.setattr(spatial, "DISTANCES", 1000)
            got = {r[0]: tuple(r)[1:] for r in spatial.distance_stats(p).collect()}
        want = {r[0]: tuple(r)[1:] for r in pairs}
        assert set(got) == set(want) and all(np.allclose(got[k], want[k], atol=1e-12) for k in want)


def test_running_means_without_rows_for_pairs(spark, monkeypatch):
    a, b = places(spark, 20, 1, z=False), places(spark, 90, 2)
    monkeypatch.setattr(spatial, "HELD_ROWS", 0)
    want = spatial.running_means(a, b).collect()
    monkeypatch.setattr(spatial, "HELD_ROWS", 1000)
    monkeypatch.setattr(spatial, "all_pairs", joined)
    assert sorted(spatial.running_means(a, b).collect()) == sorted(want)


@pytest.mark.parametrize("radius", [0.1, 0.005, 3.0])
def test_disc_means_without_rows_for_pairs(spark, monkeypatch, radius):
    a, b = places(spark, 150, 3, z=False), places(spark, 400, 4)
    a = a.unionByName(spark.createDataFrame([(1, 50.0, 0.0), (2, 0.0, -50.0)], "id long, x double, y double"))
    x, y, u, v, z = (np.array([r[c] for r in df.collect()]) for df, c in ((a, "x"), (a, "y"), (b, "x"), (b, "y"), (b, "z")))
    inside = np.sqrt((x[:, None] - u) ** 2 + (y[:, None] - v) ** 2) <= radius
    monkeypatch.setattr(spatial, "all_pairs", joined)
    got = {r.id: r.estimate for r in spatial.disc_mean(a, b, radius).collect()}
    for r, own in zip(a.collect(), inside, strict=True):
        assert got[r.id] is None if not own.any() else abs(got[r.id] - z[own].mean()) < 1e-9
    monkeypatch.undo()
    gaps = b.unionByName(spark.createDataFrame([(-1, None, 0.0, 5.0), (-2, 0.0, 0.0, None)], b.schema))
    assert spatial.disc_mean(a, gaps, radius).count() == 152


def test_kernel_features_without_rows_for_pairs(spark, monkeypatch):
    points, nodes = places(spark, 30, 5, z=False), places(spark, 40, 6, z=False)
    rng = np.random.default_rng(7)
    seen = spark.createDataFrame([(int(t), 7 * int(i) + 3, int(c)) for t, i, c in zip(rng.integers(0, 9, 300), rng.integers(0, 40, 300), rng.integers(0, 5, 300), strict=True)], "t long, id long, colour int").join(nodes, "id")
    kernel = lambda d: F.exp(-5.0 * d)
    for normalise in (True, False):
        want = {(r.point, r.t): (r.green, r.red) for r in spatial.kernel_features(points, seen, kernel, {"green": 1, "red": 4}, normalise).collect()}
        with monkeypatch.context() as m:
            m.setattr(spatial, "all_pairs", joined)
            m.setattr(spatial, "COUNTS", 25)
            got = {(r.point, r.t): (r.green, r.red) for r in spatial.kernel_features(points, seen, kernel, {"green": 1, "red": 4}, normalise, smooth=lambda d: np.exp(-5.0 * d)).collect()}
        assert set(got) == set(want) and all(np.allclose(got[k], want[k], atol=1e-12) for k in want)


def test_large_pairs_are_not_dealt_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(spatial, "SMALL_SIDE", 5)
    p = places(spark, 12, 8, z=False)
    pairs = spatial.all_pairs(p, p)
    assert "CartesianProduct" not in pairs._jdf.queryExecution().executedPlan().toString() and pairs.count() == 144
