import time

import numpy as np

from fieldloom.operators import linalg


def test_many_systems_are_those_one_by_one():
    rng = np.random.default_rng(8)
    x = rng.normal(size=(40, 60, 5)) + rng.normal(size=(40, 60, 1))
    y = x[:, :, 0] - 0.5 * x[:, :, 3] + rng.normal(size=(40, 60))
    g, m, n = np.einsum("sri,srj->sij", x, x), np.einsum("sri,sr->si", x, y), np.full(40, 60.0)
    g[3, 2], g[3, :, 2], m[3, 2] = 0.0, 0.0, 0.0
    for positive in (False, True):
        got = linalg.lasso_each(g, m, n, 0.2, positive)
        assert np.allclose(got, [linalg.lasso(a, b, 60.0, 0.2, positive) for a, b in zip(g, m, strict=True)], rtol=0, atol=1e-9)


def test_ten_thousand_systems_take_seconds():
    rng = np.random.default_rng(9)
    x = rng.normal(size=(10_000, 12, 8))
    g, m = np.einsum("sri,srj->sij", x, x) + np.eye(8), np.einsum("sri,sr->si", x, rng.normal(size=(10_000, 12)))
    start = time.process_time()
    linalg.lasso_each(g, m, np.full(10_000, 12.0), 0.05)
    assert time.process_time() - start < 20


def test_alike_columns_take_few_sweeps():
    rng = np.random.default_rng(10)
    x = rng.normal(size=(60, 1)) + 1e-2 * rng.normal(size=(30, 60, 6))
    g, m, n = np.einsum("sri,srj->sij", x, x), np.einsum("sri,sr->si", x, x[:, :, 0] - x[:, :, 1] + x[:, :, 2]), np.full(30, 60.0)
    for positive in (False, True):
        w = linalg.lasso_each(g, m, n, 1e-6, positive, sweeps=200)
        slope = (m - np.einsum("skl,sl->sk", g, w)) / 60
        assert np.allclose(np.where(w != 0, slope - 1e-6 * np.sign(w), 0), 0, atol=1e-11)
        assert ((slope if positive else np.abs(slope)) <= 1e-6 + 1e-11).all()
