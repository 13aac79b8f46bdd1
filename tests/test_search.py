import numpy as np
from pyspark.sql import functions as F

from fieldloom.operators import estimators as E
from fieldloom.operators import search as S

BOUNDS = {"a": (-2.0, 4.0), "b": (0.0, 10.0)}


def valley(x, y):
    """A curved valley with its least value 0 at (1, 4)."""
    return (x - 1) ** 2 + 5 * (y - 3 - x * x) ** 2


def losses(spark):
    return S.Losses(spark, BOUNDS, lambda c: c.select("candidate", (F.pow(F.col("a") - 1, 2) + 5 * F.pow(F.col("b") - 3 - F.col("a") * F.col("a"), 2)).alias("loss")))


def test_searches_find_the_least_value(spark):
    grid = S.uniform(losses(spark), 31)
    assert grid.loss < 0.3 and len(grid.tried) == 31**2
    assert S.random(losses(spark), 400, seed=2).loss < 1.0
    own = losses(spark)
    assert S.evolution(own, population=10, generations=35, seed=3).loss < 1e-2 and all(-2 <= p["a"] <= 4 and 0 <= p["b"] <= 10 for p, _ in own.tried)
    assert S.surrogate(losses(spark), first=12, rounds=6, at_once=5).loss < 0.5


def test_descent_reaches_the_least_value_and_stays_inside_bounds():
    slope = lambda p: (valley(p["a"], p["b"]), {"a": 2 * (p["a"] - 1) - 20 * p["a"] * (p["b"] - 3 - p["a"] ** 2), "b": 10 * (p["b"] - 3 - p["a"] ** 2)})
    found = S.descend(BOUNDS, slope, {"a": -1.5, "b": 9.0}, steps=80)
    assert found.loss < 1e-8 and abs(found.best["a"] - 1) < 1e-4
    narrow = {"a": (-2.0, 0.5), "b": (0.0, 2.0)}
    found = S.descend(narrow, slope, steps=80)
    want = min(valley(a, b) for a in np.linspace(-2, 0.5, 501) for b in np.linspace(0, 2, 201))
    assert found.loss <= want + 1e-6 and all(narrow[k][0] <= v <= narrow[k][1] for p, _ in found.tried for k, v in p.items())


def test_no_finite_loss(spark):
    own = S.Losses(spark, BOUNDS, lambda c: c.select("candidate", F.lit(None).cast("double").alias("loss")))
    assert S.random(own, 3).loss == np.inf and len(own.tried) == 3
    nowhere = S.Losses(spark, BOUNDS, lambda c: c.limit(0).select("candidate", F.lit(0.0).alias("loss")))
    assert S.evolution(nowhere, generations=2).loss == np.inf


def test_kernel_rate_and_its_slope(spark):
    """A field with a known decay: the losses of all candidates come from one plan, and the slope is theirs."""
    rng = np.random.default_rng(5)
    xy = rng.uniform(0, 1, (6, 2))
    d = np.sqrt(((xy[:, None] - xy[None]) ** 2).sum(2))
    z = rng.multivariate_normal(np.zeros(6), np.exp(-4 * d), 40)
    positions = spark.createDataFrame([(str(k), *map(float, p)) for k, p in enumerate(xy)], "station string, x double, y double")
    panel = spark.createDataFrame([(t, str(k), float(z[t, k])) for t in range(40) for k in range(6)] + [(0, "9", None)], "t long, station string, z double")

    def loss(rate):
        w = np.exp(-rate * d) * (1 - np.eye(6))
        return (((z @ w.T) / w.sum(1) - z) ** 2).mean()

    own = S.Losses(spark, {"rate": (0.1, 50.0)}, E.kernel_losses(positions, panel))
    rates = [0.5, 3.0, 20.0]
    assert np.allclose(own(np.array(rates)[:, None]), [loss(r) for r in rates])
    slope = E.kernel_gradient(positions, panel)
    f, g = slope({"rate": 3.0})
    assert np.isclose(f, loss(3.0)) and np.isclose(g["rate"], (loss(3.001) - loss(2.999)) / 0.002, rtol=1e-3)
    best = min(loss(r) for r in np.geomspace(0.1, 50, 2000))
    assert S.descend({"rate": (0.1, 50.0)}, slope, {"rate": 1.0}, steps=20).loss < best + 1e-5
    assert S.evolution(own, population=8, generations=15).loss < best + 1e-4
