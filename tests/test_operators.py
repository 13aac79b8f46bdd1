import math

import numpy as np
from pyspark.sql import functions as F

from fieldloom.functions import scalars as S
from fieldloom.operators import estimators as E
from fieldloom.operators import evaluate, graph, linalg, perceptron, runs, spatial, traffic
from fieldloom.operators import panel as P

PATH = [(1, 2, 2.0, 1.0), (2, 3, 4.0, 2.0)]


def path(spark):
    return spark.createDataFrame(PATH, "u long, v long, length double, lanes double")


def matrix(df):
    return {(r.i, r.j): round(r.value, 9) for r in df.collect()}


def test_leave_one_out(spark):
    p = spark.createDataFrame([(0, "A", 10.0), (0, "B", 20.0), (0, "C", 60.0), (1, "A", 5.0), (2, "A", None), (2, "B", 4.0), (2, "C", 6.0)], "t long, station string, z double")
    got = {(r.t, r.station): r.estimate for r in P.leave_one_out_mean(p).collect()}
    assert got == {(0, "A"): 40, (0, "B"): 35, (0, "C"): 15, (1, "A"): None, (2, "A"): 5, (2, "B"): 6, (2, "C"): 4}


def test_kriging_and_blue_values():
    k = lambda d: np.exp(-d)
    w = E.kriging_weights(np.array([[0, 1.0], [1, 0]]), np.array([0.25, 0.75]), k, 0.1)
    assert np.allclose(w, [0.7436874, 0.2563126], atol=1e-6) and abs(w @ [10, 20] - 12.563126) < 1e-5
    b = E.blue_weights(np.array([[1, 0.5], [0.5, 1]]), np.array([0.8, 0.4]))
    assert np.allclose(b, [0.8, 0.0]) and abs(15 + b @ (np.array([12, 19]) - [10, 20]) - 16.6) < 1e-9


def test_graph_matrices_of_a_path(spark):
    e = path(spark)
    assert {r.node: r.degree for r in graph.weighted_degree(e).collect()} == {1: 2, 2: 10, 3: 8}
    assert matrix(graph.mass_matrix(e)) == {(1, 2): round(1 / 3, 9), (2, 1): round(1 / 3, 9), (2, 3): round(2 / 3, 9), (3, 2): round(2 / 3, 9), (1, 1): round(2 / 3, 9), (2, 2): 2, (3, 3): round(4 / 3, 9)}
    assert matrix(graph.random_walk_matrix(e)) == {(1, 2): 0.5, (2, 1): 1, (2, 3): 1, (3, 2): 0.5, (1, 1): -1, (2, 2): -1, (3, 3): -1}
    lap = matrix(graph.laplacian(e, F.lit(1.0)))
    assert lap[2, 2] == 2 and lap[1, 2] == -1 and (1, 3) not in lap


def test_node_source(spark):
    q = spark.createDataFrame([(0, 1, 2, 3, 0, 0, 0), (0, 2, 3, 5, 0, 0, 0)], "t long, u long, v long, green long, yellow long, red long, dark_red long")
    got = {r.node: r.green for r in traffic.node_source(q, path(spark)).collect()}
    assert got == {1: 1.5, 2: 2.3, 3: 2.5}


def test_parallel_reversed_and_incomplete_edges(spark):
    rows = [(1, 2, 5.0, 1.0), (2, 1, 3.0, 1.0), (1, 1, 1.0, 1.0), (1, 2, 3.0, 2.0)]
    e = spark.createDataFrame(rows, "u long, v long, length double, lanes double")
    assert [tuple(r) for r in graph.simple_edges(e).collect()] == [(1, 2, 3.0, 2.0)]
    try:
        graph.simple_edges(e.withColumn("lanes", F.lit(None).cast("double")))
        raise AssertionError
    except ValueError:
        pass
    lists = spark.createDataFrame([(1, 2, 5.0, ["2", "3"], ["primary", "x"]), (2, 3, 5.0, None, ["primary"]), (3, 4, 1.0, None, None)], "u long, v long, length double, lanes array<string>, highway array<string>")
    assert {r.u: r.lanes for r in graph.impute_lanes(lists).collect()} == {1: 5, 2: 5, 3: 1}


def test_hops_components_and_propagation(spark):
    e = spark.createDataFrame([(k, k + 1, 1.0, 1.0) for k in range(1, 5)] + [(10, 11, 1.0, 1.0)], "u long, v long, length double, lanes double")
    got = {(r.source, r.node): r.depth for r in graph.k_hop(e, spark.createDataFrame([(1,)], "node long"), 3).collect()}
    assert got == {(1, 1): 0, (1, 2): 1, (1, 3): 2, (1, 4): 3}
    assert sorted(r.node for r in graph.largest_component(e).collect()) == [1, 2, 3, 4, 5]
    f = spark.createDataFrame([(1, 1.0), (2, 0.0), (99, 7.0)], "node long, f double")
    one = spark.createDataFrame([(1, 2, 1.0)], "u long, v long, weight double")
    got = {r.node: r.f for r in graph.label_propagation(one, f, 2, 0.5, 0.5).collect()}
    assert got == {1: 0.75, 2: 0.25, 99: 3.5}


def test_mercator_kernels_and_time(spark):
    r = spark.range(1)
    x, y = S.mercator(F.lit(48.8580073), F.lit(2.3342828))
    lat, lon = S.inverse_mercator(x, y)
    a = r.select(x.alias("x"), y.alias("y"), lat.alias("lat"), lon.alias("lon")).first()
    assert abs(a.x - 129.659934) < 1e-5 and abs(a.y - 88.069750) < 1e-5 and abs(a.lat - 48.8580073) < 1e-9 and abs(a.lon - 2.3342828) < 1e-9
    t = F.expr("timestamp_ntz'2024-01-06 10:44:31'")
    b = r.select(S.floor_minutes(t).alias("f"), S.seconds_of(F.expr("timestamp_ntz'2024-01-06 09:30:00'")).alias("w"), *[c.alias(k) for k, c in S.week_features(t).items()]).first()
    assert b.f == b.w and (b.weekday, b.weekend) == (5, 1)
    c = spark.createDataFrame([(99, 214, 104), (100, 215, 105), (101, 214, 104), (0, 0, 0)], "r int, g int, b int").select(S.colour_class(F.col("r"), F.col("g"), F.col("b")).alias("c")).collect()
    assert [x.c for x in c] == [1, 1, 0, 0]
    d = spark.createDataFrame([(float("nan"),), (1.0,)], "x double").agg(F.avg(S.null_if_nan(F.col("x"))).alias("m")).first()
    assert d.m == 1.0


def test_nearest_ties_and_cells(spark):
    nodes = spark.createDataFrame([(5, 1.0, 0.0), (3, -1.0, 0.0), (9, 30.0, 30.0)], "id long, x double, y double")
    points = spark.createDataFrame([(1, 0.0, 0.0), (2, 25.0, 29.0), (4, -100.0, 3.0)], "id long, x double, y double")
    want = {1: 3, 2: 9, 4: 3}
    assert {r.id: r.nearest for r in spatial.nearest(points, nodes).collect()} == want
    small = spatial.SMALL_SIDE
    try:
        spatial.SMALL_SIDE = 1
        assert {r.id: r.nearest for r in spatial.nearest(points, nodes, 0.5).collect()} == want
    finally:
        spatial.SMALL_SIDE = small


def test_metrics_and_quantiles(spark):
    p = spark.createDataFrame([("m", "s", k, float(e), float(t)) for k, (e, t) in enumerate([(1, 2), (2, 2), (4, 3)])] + [("m", "s", 9, None, 1.0)], "model string, station string, t long, estimate double, truth double")
    r = evaluate.metrics(p).first()
    assert (r.n, r.mb, r.medianse) == (3, 0.0, 1.0) and abs(r.rmse - math.sqrt(2 / 3)) < 1e-12 and abs(r.coe - (1 - 2 / (4 / 3))) < 1e-9
    past = spark.createDataFrame([(k, "a", float(k)) for k in range(4)], "t long, station string, z double")
    now = spark.createDataFrame([(10, "a", 2.0), (11, "a", 2.5), (12, "a", -1.0)], "t long, station string, z double")
    assert {r.t: r.rank for r in P.past_quantile_rank(past, now).collect()} == {10: 0.5, 11: 0.75, 12: 0.0}


def test_small_numerics():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 3))
    y = x @ [2.0, 0.0, -1.0] + 0.01 * rng.normal(size=200)
    g, m = x.T @ x, x.T @ y
    assert np.allclose(linalg.lasso(g, m, 200, 0.0), np.linalg.solve(g, m), atol=1e-6)
    w = linalg.lasso(g, m, 200, 0.5)
    grad = (m - g @ w) / 200
    assert np.all(np.abs(grad) <= 0.5 + 1e-6) and np.allclose(grad[w != 0], 0.5 * np.sign(w[w != 0]), atol=1e-5)
    assert (linalg.nonnegative(g, m) >= 0).all() and linalg.nonnegative(g, m)[2] == 0
    c = np.array([[2.0, 0.3], [0.3, 1.0]])
    s = linalg.simplex_weights(c)
    assert abs(s.sum() - 1) < 1e-12 and all(s @ c @ s <= v @ c @ v + 1e-12 for v in ([0.2, 0.8], [0.4, 0.6], [1, 0]))
    lap = np.array([[1.0, -1, 0], [-1, 2, -1], [0, -1, 1]])
    p = perceptron.Perceptron(steps=800).fit(x, np.tanh(x[:, 0]))
    assert np.mean((p.predict(x) - np.tanh(x[:, 0])) ** 2) < 0.05


def test_solves_and_projection(spark):
    e = path(spark)
    source = spark.createDataFrame([(0, 1, 1.0), (0, 3, 2.0), (1, 2, 1.0)], "t long, node long, z double")
    nodes, lap = graph.dense(graph.laplacian(e, F.lit(1.0)))
    got = {(r.t, r.node): r.z for r in E.soft_diffusion(source, graph.laplacian(e, F.lit(1.0)), 0.5, 2.0).collect()}
    want = np.linalg.solve(2 * lap + 0.5 * np.eye(3), [1.0, 0, 2.0])
    assert np.allclose([got[0, n] for n in nodes], want)
    basis = E.basis_table(spark, nodes, linalg.modes(lap, 2))
    field = {(r.t, r.node): r.z for r in E.project(source, basis).collect()}
    b = linalg.modes(lap, 2)
    assert np.allclose([field[0, n] for n in nodes], b @ b.T @ [1.0, 0, 2.0])


def test_estimators_recover_a_linear_panel(spark):
    rows = [(t, s, 10 * k + math.sin(t / 3) * (k + 1)) for t in range(60) for k, s in enumerate("abc")]
    p = spark.createDataFrame(rows, "t long, station string, z double")
    past, future = p.where("t < 40"), p.where("t >= 40")
    for e in (E.BLUE(), E.SnapshotPCA(1)):
        assert e.evaluate(past, future).where("estimate is null").count() == 0
    blue = evaluate.metrics(E.BLUE(1e-6).evaluate(past, future)).collect()
    assert len(blue) == 3 and all(r.cor > 0.999 for r in blue)
    weights = E.ensemble_weights(E.SnapshotMean().evaluate(past, future).unionByName(E.BLUE(1e-6).evaluate(past, future).withColumn("model", F.lit("b"))), "mse")
    assert abs(sum(weights.values()) - 1) < 1e-9


def test_batch_queries_have_sql_and_names_match(spark):
    import __spark_entry__

    queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 100
    assert __spark_entry__.entry(spark).count() > 0


def test_nested_ensemble_has_all_stations(spark, monkeypatch):
    rng = np.random.default_rng(0)
    rows = [(m, f"s{k}", t, None if (m, k, t) == ("a", 2, 1) else float(v + rng.normal(0, sd)), float(v)) for k in range(5) for t in range(6) for v in (rng.normal(),) for m, sd in (("a", 0.2), ("b", 0.5), ("c", 1.0))]
    p = spark.createDataFrame(rows, "model string, station string, t long, estimate double, truth double")
    monkeypatch.setattr(E, "MAX_STATIONS", 3)
    for how in ("mse", "blue", "regression"):
        got = {(r.station, r.t): r.estimate for r in E.nested_ensemble(p, how).collect()}
        want = {(r.station, r.t): r.estimate for k in range(5) for r in E.ensemble(p.where(f"station = 's{k}'"), E.ensemble_weights(p.where(f"station <> 's{k}'"), how)).collect()}
        assert len(got) == 30 and got.keys() == want.keys() and got["s2", 1] is None
        assert all(abs(got[k] - v) < 1e-6 for k, v in want.items() if v is not None)


def test_conjugate_gradients_equal_the_inverse(spark, monkeypatch):
    rng = np.random.default_rng(3)
    edges = spark.createDataFrame([(k, k + 1, float(rng.uniform(1, 9)), 1.0) for k in range(12)] + [(0, 7, 2.0, 1.0), (3, 11, 5.0, 1.0)], "u long, v long, length double, lanes double")
    source = spark.createDataFrame([(t, n, float(rng.normal())) for t in range(3) for n in range(0, 13, 2)] + [(1, 99, 7.0), (1, 2, None)], "t long, node long, z double")
    terms = lambda: (source, graph.diffusion_matrix(edges), graph.mass_matrix(edges), 3.0, 1.0)
    want = {(r.t, r.node): r.z for r in E.screened_poisson(*terms()).collect()}
    monkeypatch.setattr(E, "SOLVE_NODES", 3)
    got = {(r.t, r.node): r.z for r in E.screened_poisson(*terms()).collect()}
    assert len(want) == 39 and got.keys() == want.keys() and all(abs(got[k] - v) < 1e-8 for k, v in want.items())


def test_edge_resistances_by_sketches(spark, monkeypatch):
    """Against the pseudo-inverse; and with conjugate gradients in place of the inverse."""
    rng, n = np.random.default_rng(6), 14
    rows = [(i, j, float(rng.uniform(0.5, 2))) for i in range(n) for j in {(i + 1) % n, (i + 5) % n} if i < j]
    lap = np.zeros((n, n))
    for i, j, w in rows:
        lap[[i, j], [i, j]] += w
        lap[[i, j], [j, i]] -= w
    p = np.linalg.pinv(lap)
    edges = spark.createDataFrame(rows, "u long, v long, w double")
    got = E.edge_resistances(edges, F.col("w"), 2000).collect()
    assert len(got) == len(rows) and all(abs(r.r / (p[r.u, r.u] + p[r.v, r.v] - 2 * p[r.u, r.v]) - 1) < 0.12 for r in got)
    tall = spark.createDataFrame([(int(i), int(j), float(lap[i, j])) for i, j in zip(*np.nonzero(lap), strict=True)], "i long, j long, value double")
    monkeypatch.setattr(E, "SOLVE_NODES", 5)
    some = E.resistances(tall, [0, 3, 9, 99]).collect()
    assert len(some) == 3 and all(abs(r.r - (p[r.a, r.a] + p[r.b, r.b] - 2 * p[r.a, r.b])) < 1e-6 for r in some)


def test_resistances_between_some_nodes(spark):
    lap = graph.laplacian(path(spark), 1 / F.col("length"))
    assert {(r.a, r.b): round(r.r, 9) for r in E.resistances(lap).collect()} == {(2, 1): 2.0, (3, 1): 6.0, (3, 2): 4.0}
    assert {(r.a, r.b): round(r.r, 9) for r in E.resistances(lap, [1, 3]).collect()} == {(3, 1): 6.0}


def test_nearest_by_cells_with_places_missing(spark):
    rng = np.random.default_rng(5)
    xy = lambda n, k: [(k + i, float(x), float(y)) for i, (x, y) in enumerate(rng.uniform(-3, 3, (n, 2)))]
    lost = [(900, None, 1.0), (901, 1.0, float("nan"))]
    points = spark.createDataFrame(xy(60, 0) + lost, "id long, x double, y double")
    nodes = spark.createDataFrame(xy(40, 100) + lost, "id long, x double, y double")
    a, b = ({r.id: (r.nearest, r.d) for r in spatial.nearest(points, nodes, 0.05, cells=c).collect()} for c in (False, True))
    assert a == b and len(a) == 62 and a[900] == a[901] == (None, None) and a[0][0] is not None
    ends = [(u, u + 1, *p, *q) for u, (p, q) in enumerate(zip(rng.uniform(-3, 3, (30, 2)).tolist(), rng.uniform(-3, 3, (30, 2)).tolist(), strict=True))] + [(77, 78, None, 0.0, 0.0, 0.0)]
    edges = spark.createDataFrame(ends, "u long, v long, ax double, ay double, bx double, by double")
    a, b = ({r.id: (r.u, r.v, r.d) for r in spatial.nearest_edge(points, edges, 0.1, cells=c).collect()} for c in (False, True))
    assert a == b and len(a) == 62 and a[901] == (None, None, None)
    assert spatial.nearest(points, nodes.limit(0), 1.0).where("nearest is null").count() == spatial.nearest_edge(points, edges.limit(0)).where("u is null").count() == 62


def test_a_whole_raster_of_pixels(spark):
    """800 by 1,000 pixels and 1,000 points: the cut kernel by cells, and all pixels for a few points."""
    pixels = spark.range(800_000).select("id", (F.col("id") % 1000).cast("double").alias("x"), F.floor(F.col("id") / 1000).cast("double").alias("y"), F.lit(0).alias("t"), (F.col("id") % 5).cast("int").alias("colour"))
    points = spark.range(1000).select("id", (F.col("id") * 0.9 + 20).alias("x"), (F.col("id") * 0.7 + 20).alias("y"))
    near = spatial.kernel_features(points, pixels, lambda d: S.KERNELS["gaussian"](d, 2.0), {"green": 1}, cut=8.0)
    assert near.count() == 1000
    few = points.where("id in (0, 500, 999)")
    every = {r.point: r.green for r in spatial.kernel_features(few, pixels, lambda d: S.KERNELS["gaussian"](d, 2.0), {"green": 1}).collect()}
    cut = {r.point: r.green for r in near.where("point in (0, 500, 999)").collect()}
    assert all(abs(every[k] - cut[k]) < 0.02 for k in every)


def test_lasso_penalty_is_the_best_of_a_slow_search(spark):
    rng = np.random.default_rng(6)
    rows = [(t, s, float(a), float(b), float(2 * a - 0.01 * b + rng.normal(0, 0.4))) for t in range(25) for s in "abc" for a, b in [rng.normal(size=2)]]
    panel = spark.createDataFrame([(t, s, z) for t, s, _, _, z in rows], "t long, station string, z double")
    features = spark.createDataFrame([(t, s, a, b) for t, s, a, b, _ in rows], "t long, station string, f0 double, f1 double")
    e = E.Regression(features, ("f0", "f1"), "lasso", residual=False)
    found = {r.term: r for r in e.fit(panel).collect()}
    x, y, who = np.array([r[2:4] for r in rows]), np.array([r[4] for r in rows]), np.array([r[1] for r in rows])

    def fitted(keep, alpha):
        mx, my = x[keep].mean(0), y[keep].mean()
        w = linalg.lasso((x[keep] - mx).T @ (x[keep] - mx), (x[keep] - mx).T @ (y[keep] - my), keep.sum(), alpha)
        return w, my - w @ mx

    every = np.ones(len(y), dtype=bool)
    grid = linalg.lasso_grid((x - x.mean(0)).T @ (y - y.mean()), len(y), 30)
    losses = [sum(((y[who == s] - x[who == s] @ w - b) ** 2).sum() for s in "abc" for w, b in [fitted(who != s, a)]) for a in grid]
    best = grid[int(np.argmin(losses))]
    w, b = fitted(every, best)
    assert np.isclose(found["_p0"].alpha, best) and np.allclose([found[k].weight for k in ("_p0", "_p1", "intercept")], [*w, b], atol=1e-6)


def _small_panel(spark):
    rng = np.random.default_rng(8)
    rows = [(t, s, float(a), float(b), float(a - b + rng.normal(0, 0.1))) for t in range(12) for s in "abcd" for a, b in [rng.normal(size=2)]]
    panel = spark.createDataFrame([(t, s, z) for t, s, _, _, z in rows], "t long, station string, z double")
    return panel, spark.createDataFrame([(t, s, a, b) for t, s, a, b, _ in rows], "t long, station string, f0 double, f1 double")


def test_models_are_kept_and_a_run_is_taken_up_again(spark, tmp_path):
    panel, features = _small_panel(spark)
    past, future = panel.where("t < 8"), panel.where("t >= 8")
    regression = lambda kind, **more: E.Regression(features, ("f0", "f1"), kind, **more)
    models = {
        "ridge": regression("ridge"), "perceptron": regression("perceptron"), "forest": regression("forest", grid={"maxDepth": (1, 2), "numTrees": (5,)}),
        "blue": E.SnapshotBLUE(), "both": E.Sequence([E.SnapshotMean(), regression("linear", residual=False)]),
    }
    folder = str(tmp_path / "run")
    rows = lambda df: sorted((r.model, r.station, r.t, round(r.estimate, 9)) for r in df.collect())
    first = runs.run_models(models, past, future, folder)
    got = rows(first)
    assert len(got) == 5 * 16 and first.where("seconds <= 0").isEmpty()
    for name, e in models.items():
        direct = e.predict(e.fit(past), future)
        assert sorted((name, r.fold, r.t, round(r.estimate, 9)) for r in direct.collect()) == [x for x in got if x[0] == name]

    class Never(E.Estimator):
        def fit(self, past):
            raise AssertionError("fitted again")

        def predict(self, parameters, panel):
            raise AssertionError("predicted again")

    assert rows(runs.run_models(dict.fromkeys(models, Never()), past, future, folder)) == got
    weights = E.ensemble_weights(sinks_read(spark, folder, ["ridge", "blue"]), "mse")  # models read again can be stacked
    assert set(weights) == {"ridge", "blue"} and abs(sum(weights.values()) - 1) < 1e-9


def sinks_read(spark, folder, names):
    return spark.read.parquet(*[f"{folder}/{n}/predictions" for n in names])


def test_projected_features_and_their_number(spark):
    """Against dense numpy: a field of 5 times and 4 nodes, some missing, on 3 orthonormal vectors."""
    rng = np.random.default_rng(9)
    full, b = rng.normal(size=(5, 4)), np.linalg.qr(rng.normal(size=(4, 3)))[0]
    full[1, 2] = full[4, 0] = 0
    source = spark.createDataFrame([(t, n, float(full[t, n])) for t in range(5) for n in range(4) if full[t, n]], "t long, node long, f0 double")
    basis = spark.createDataFrame([(n, k, float(b[n, k])) for n in range(4) for k in range(3)], "node long, k long, b double")
    panel = spark.createDataFrame([(t, str(n), float(rng.normal())) for t in range(5) for n in range(4)], "t long, station string, z double")
    z = np.array([r.z for r in panel.orderBy("t", "station").collect()]).reshape(5, 4)
    base, errors, mean = (z.sum(1, keepdims=True) - z) / 3, [], full.mean(0)
    for size in (1, 2, 3):
        want = (full - mean) @ b[:, :size] @ b[:, :size].T + mean
        e = E.ProjectedRegression(source, basis, ("f0",), 3, kind="linear")
        got = {(r.t, int(r.station)): r.f0 for r in e.features(size).collect()}
        assert len(got) == 20 and all(abs(got[t, n] - want[t, n]) < 1e-9 for t in range(5) for n in range(4))
        x, y = want.ravel(), (z - base).ravel()
        slope = np.polyfit(x, y, 1)
        errors.append(((np.polyval(slope, x) - y) ** 2).mean())
    found = e.fit(panel)
    assert found.first()["size"] == 1 + int(np.argmin(errors))
    own = e.predict(found, panel).collect()
    assert len(own) == 20 and abs(np.mean([(r.estimate - z[r.t, int(r.fold)]) ** 2 for r in own]) - min(errors)) < 1e-9


def test_differences_count_repeats(spark):
    a, b = spark.createDataFrame([(1, "x"), (1, "x"), (2, None)], "i int, s string"), spark.createDataFrame([("x", 1), (None, 2), ("y", 3)], "s string, i int")
    assert tuple(P.differences(a, b).first()) == (1, 1) and tuple(P.differences(a, a.limit(3)).first()) == (0, 0) and tuple(P.differences(a.limit(0), b).first()) == (0, 3)
    assert [r.place for r in P.in_order(a, "s", ["z", "x"]).collect()] == [2, 2, None]
    assert P.in_order(a, "s", []).where("place is not null").isEmpty()


def test_a_sequence_puts_a_line_through_each_step(spark):
    panel, features = _small_panel(spark)
    for against in ("left", "values"):
        e = E.Sequence([E.SnapshotMean(), E.Regression(features, ("f0", "f1"), "linear", residual=False)], against)
        found = e.fit(panel)
        z = {(r.t, r.station): r.z for r in panel.collect()}
        keys = sorted(z)
        base = np.array([np.mean([z[t, o] for o in "abcd" if o != s]) for t, s in keys])
        y = np.array([z[k] for k in keys])
        slope, intercept = np.polyfit(base, y, 1)
        assert np.allclose(tuple(found[1].first()), (slope, intercept))
        f = {(r.t, r.station): (r.f0, r.f1, 1.0) for r in features.collect()}
        x, left = np.array([f[k] for k in keys]), y - intercept - slope * base
        second = x @ np.linalg.lstsq(x, left, rcond=None)[0]
        line = np.polyfit(second, left if against == "left" else y, 1)
        assert np.allclose(tuple(found[3].first()), line)
        got = {(r.t, r.fold): r.estimate for r in e.predict(found, panel).collect()}
        assert np.allclose([got[k] for k in keys], intercept + slope * base + np.polyval(line, second))
    flat = E.Sequence([E.GlobalMean()], "values")
    one = spark.createDataFrame([(t, s, 3.0) for t in range(3) for s in "ab"], "t long, station string, z double")
    assert {r.estimate for r in flat.predict(flat.fit(one), one).collect()} == {3.0}
