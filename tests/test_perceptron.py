import numpy as np
import pytest

from fieldloom.operators import perceptron as M


def data(n=300):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(n, 2)) * [3, 0.5] + [1, -2]
    return x, np.sin(x[:, 0]) + x[:, 1] ** 2 + rng.normal(0, 0.05, n)


@pytest.mark.parametrize("parts", [1, 20])
def test_gradients_of_all_tasks_give_the_fit_in_memory(spark, monkeypatch, parts):
    x, y = data()
    df = spark.createDataFrame([(*map(float, a), float(b)) for a, b in zip(x, y, strict=True)] + [(1.0, None, 2.0)], "a double, b double, y double")
    small = lambda: M.Perceptron(hidden=(5,), steps=12, rate=0.05)
    want = small().fit(x, y)
    assert np.allclose(M.fit(df, small()).predict(x), want.predict(x), atol=1e-9)
    monkeypatch.setattr(M, "IN_MEMORY", 10)
    monkeypatch.setattr(M, "LANES", 3)
    got = M.fit(df.repartition(parts), small())
    assert np.allclose(got.predict(x), want.predict(x), atol=1e-6)
    assert np.allclose(M.Perceptron.of(got.rows()).predict(x), got.predict(x))


def test_gradient_equals_finite_differences_and_it_learns():
    x, y = data(40)
    p = M.Perceptron(hidden=(3, 2)).begin(x.mean(0), x.std(0), y.mean(), y.std())
    g, at = p.gradient(x, y), 0
    loss = lambda: 0.5 * (((p.predict(x) - y) / p.sy) ** 2).sum()
    for layer in p.w:
        for w in layer:
            flat = w.reshape(-1)
            for k in range(0, w.size, 3):
                kept, flat[k] = flat[k], flat[k] + 1e-5
                up = loss()
                flat[k] = kept - 1e-5
                down, flat[k] = loss(), kept
                assert abs(g[at + k] - (up - down) / 2e-5) < 1e-4
            at += w.size
    x, y = data()
    assert ((M.Perceptron().fit(x, y).predict(x) - y) ** 2).mean() < 0.2 * y.var()


def test_no_rows_and_a_constant_input(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 4.0)], "a double, y double")
    assert np.isfinite(M.fit(df.limit(0)).predict(np.ones((1, 1)))).all()
    assert abs(M.fit(df).predict(np.ones((1, 1)))[0] - 3) < 0.2
