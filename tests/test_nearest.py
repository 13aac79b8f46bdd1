import numpy as np
from fieldloom.operators import spatial


def test_nearest_by_dense_cells_is_that_of_all_pairs(spark, monkeypatch):
    """Many nodes at one place, clusters and points far off; a point met all nodes of cells of a given size."""
    monkeypatch.setattr(spatial, "FEW", 1)
    rng = np.random.default_rng(5)
    xy = np.vstack([rng.normal(size=(300, 2)) * 0.001, rng.uniform(-1, 1, size=(300, 2)), np.tile([[0.25, 0.5]], (200, 1))])
    nodes = spark.createDataFrame([(int(k), float(a), float(b)) for k, (a, b) in enumerate(xy)], "id long, x double, y double")
    at = np.vstack([xy[::7] + 0.0005, rng.uniform(-2, 2, size=(60, 2)), [[0.25, 0.5], [3.0, -4.0]]])
    points = spark.createDataFrame([(int(k), float(a), float(b)) for k, (a, b) in enumerate(at)], "id long, x double, y double")
    d = np.sqrt(((at[:, None] - xy[None]) ** 2).sum(2))
    met, own = [], spatial._nearest_of
    monkeypatch.setattr(spatial, "_nearest_of", lambda pairs, p: (met.append(pairs.count()), own(pairs, p))[1])
    got = {r.id: (r.nearest, r.d) for r in spatial.nearest(points, nodes, 0.5).collect()}
    assert all(got[k][0] == d[k].argmin() and abs(got[k][1] - d[k].min()) < 1e-12 for k in range(len(at)))
    assert met[0] < 40 * len(at)
    got = {r.id: r.nearest for r in spatial.nearest(points, nodes).collect()}
    assert all(got[k] == d[k].argmin() for k in range(len(at)))


def test_nearest_of_long_edges_is_that_of_all_pairs(spark, monkeypatch):
    """Upright, level, long, far and pointlike edges."""
    monkeypatch.setattr(spatial, "FEW", 1)
    rng = np.random.default_rng(6)
    ab = np.hstack([rng.uniform(-1, 1, size=(150, 2)), rng.uniform(-1, 1, size=(150, 2))])
    ab = np.vstack([ab, [[0.1, -1, 0.1, 1], [-1, 0.2, 1, 0.2], [0.5, 0.5, 0.5, 0.5], [-50, 3, 60, 4], [0.3, -90, 0.3000000001, 90]]])
    edges = spark.createDataFrame([(k, k + 1, *map(float, r)) for k, r in enumerate(ab)], "u long, v long, ax double, ay double, bx double, by double")
    at = np.vstack([rng.uniform(-1.5, 1.5, size=(120, 2)), [[40.0, 10.0], [0.5, 0.5]]])
    points = spark.createDataFrame([(k, float(a), float(b)) for k, (a, b) in enumerate(at)], "id long, x double, y double")
    got = {r.id: (r.u, r.d) for r in spatial.nearest_edge(points, edges).collect()}
    own = ab[None, :, 2:] - ab[None, :, :2]
    k = np.clip(((at[:, None] - ab[None, :, :2]) * own).sum(2) / np.maximum((own**2).sum(2), 1e-300), 0, 1)
    d = np.sqrt(((ab[None, :, :2] + k[..., None] * own - at[:, None]) ** 2).sum(2))
    assert len(got) == len(at) and all(abs(got[i][1] - d[i].min()) < 1e-9 and d[i, got[i][0]] < d[i].min() + 1e-9 for i in range(len(at)))
