import numpy as np
import pytest

from fieldloom.operators import estimators as E
from fieldloom.operators import forest


def rows_of(n=240, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3))
    y = np.where(x[:, 0] > 0.2, 2.0, -1.0) + np.where(x[:, 1] > 0, 0.5, 0) + rng.normal(0, 0.05, n)
    return [(k // 6, "abcdef"[k % 6], *map(float, x[k]), float(y[k])) for k in range(n)]


def frames(spark, rows, parts):
    panel = spark.createDataFrame([(r[0], r[1], r[5]) for r in rows], "t long, station string, z double").repartition(parts)
    return panel, spark.createDataFrame([r[:5] for r in rows], "t long, station string, f0 double, f1 double, f2 double").repartition(parts)


@pytest.mark.parametrize("grid", [{}, {"maxDepth": (1, 2), "numTrees": (4, 8)}])
def test_the_same_rows_give_the_same_forest_under_any_partitioning(spark, grid):
    rows, found = rows_of(), []
    for parts, order in ((1, 1), (3, -1), (8, 1)):
        panel, features = frames(spark, rows[::order], parts)
        e = E.Regression(features, ("f0", "f1", "f2"), "forest", residual=False, grid=grid)
        found.append(sorted(tuple(r) for r in e.fit(panel).collect()))
    assert found[0] == found[1] == found[2] and len(found[0]) > 10
    own = e.predict(spark.createDataFrame(found[0], forest.TABLE), panel)
    errors = own.join(panel.withColumnRenamed("station", "fold"), ["fold", "t"]).selectExpr("avg(pow(estimate - z, 2)) e", "var_pop(z) v").first()
    assert errors.e < 0.6 * errors.v


def brute(x, y, keys, cuts, trees, depth, share, seed):
    """The same forest grown node by node over all rows in memory."""
    scale = 2.0 ** (np.ceil(np.log2(np.abs(y).max())) - forest.SCALE_BITS)
    whole = np.rint(y / scale)
    take = int(np.ceil(share * x.shape[1]))
    out = []
    for tree in range(trees):
        w = forest.draws(keys, tree, seed)

        def grown(node, on, w=w, tree=tree):
            if not w[on].sum():
                return
            mean = (w[on] * whole[on]).sum() / w[on].sum() * scale
            order = np.argsort(forest._mixed(np.arange(x.shape[1]), np.full(x.shape[1], node), np.full(x.shape[1], tree), np.full(x.shape[1], seed)), kind="stable")
            best = None
            if node < 1 << depth:
                for k in sorted(order[:take]):
                    for cut in cuts[k]:
                        left, right = on[x[on, k] < cut], on[x[on, k] >= cut]
                        if w[left].sum() and w[right].sum():
                            gain = sum((w[s] * whole[s]).sum() ** 2 / w[s].sum() for s in (left, right))
                            if best is None or gain > best[0] + 1e-6:
                                best = (gain, k, cut, left, right)
            if best and best[0] > (w[on] * whole[on]).sum() ** 2 / w[on].sum() * (1 + 1e-12) + 1e-6:
                out.append((tree, node, int(best[1]), round(float(best[2]), 9), round(mean, 9)))
                grown(2 * node, best[3])
                grown(2 * node + 1, best[4])
            else:
                out.append((tree, node, -1, 0.0, round(mean, 9)))

        grown(1, np.arange(len(x)))
    return sorted(out)


def test_equals_trees_grown_in_memory(spark, monkeypatch):
    monkeypatch.setattr(forest, "CELLS", 3 * forest.BINS)  # a tree at a time
    rows = rows_of(150, seed=5)
    df = spark.createDataFrame([(k * 7919, 0, r[5], *r[2:5]) for k, r in enumerate(rows)], "_key long, _group int, _y double, a double, b double, c double").repartition(4)
    x, y = np.array([r[2:5] for r in rows]), np.array([r[5] for r in rows])
    cuts = forest.cuts_of(df, ["a", "b", "c"])
    assert all(len(c) > 20 and (np.diff(c) > 0).all() for c in cuts)
    got = forest.grow(df, ["a", "b", "c"], 3, 2, 0.5, 9)[0]
    assert sorted((t, n, f, round(c, 9), round(v, 9)) for t, n, f, c, v in got.rows()) == brute(x, y, np.arange(150) * 7919, cuts, 3, 2, 0.5, 9)


def test_the_settings_with_the_least_error_of_the_groups_left_out(spark):
    rows = rows_of(180, seed=6)
    df = spark.createDataFrame([(k, k % 3, r[5], *r[2:5]) for k, r in enumerate(rows)], "_key long, _group int, _y double, a double, b double, c double")
    names, settings = ["a", "b", "c"], [(t, d) for t in (1, 6) for d in (0, 1, 3)]
    forests = forest.grow(df, names, 6, 3, 1.0, 2, folds=3)
    losses = forest.rated(df, names, forests[1:], settings)
    x, y = np.array([r[2:5] for r in rows]), np.array([r[5] for r in rows])
    for (t, d), loss in zip(settings, losses, strict=True):
        want = 0.0
        for g in range(3):
            alone = forest.grow(df.where(f"_group <> {g}"), names, t, d, 1.0, 2)[0] if d and (t, d) == (6, 3) else forests[1 + g].part(t, d)
            on = np.arange(180) % 3 == g
            want += ((alone.predict(x[on]) - y[on]) ** 2).sum()
        if (t, d) != (6, 3):
            assert np.isclose(loss, want)
    best = forest.fit(df, names, {"numTrees": (1, 6), "maxDepth": (0, 1, 3)}, share=1.0, seed=2, folds=3)
    assert best.feature.shape[0] == settings[int(np.argmin(losses))][0]
    with pytest.raises(ValueError):
        forest.fit(df, names, {"impurity": ("variance",)})


def test_no_rows_constant_features_and_one_row(spark):
    panel, features = frames(spark, [(0, "a", 1.0, 1.0, 1.0, 5.0)], 1)
    e = E.Regression(features, ("f0", "f1"), "forest", residual=False)
    assert [tuple(r) for r in e.fit(panel.limit(0)).collect()] == [(0, 1, -1, 0.0, 0.0)]
    own = e.predict(e.fit(panel), panel).first()
    assert 0 <= own.estimate <= 5.0 + 1e-5
