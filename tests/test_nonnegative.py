import numpy as np

from fieldloom.operators import linalg


def test_columns_that_are_nearly_alike_get_the_exact_weights():
    """Coordinate descent stopped far from the best here."""
    rng = np.random.default_rng(3)
    base = 50 + rng.normal(size=(2000, 1))
    x = base + 0.01 * rng.normal(size=(2000, 4))
    y = x @ [0.9, 0.0, 0.3, -0.2] + 0.001 * rng.normal(size=2000)
    gram, moment = x.T @ x, x.T @ y
    w = linalg.nonnegative(gram, moment)
    slope = (moment - gram @ w) / np.diag(gram)
    assert (w >= 0).all() and (slope[w == 0] <= 1e-9).all() and np.abs(slope[w > 0]).max() <= 1e-9
    on = w > 0
    assert on.any() and np.allclose(w[on], np.linalg.solve(gram[np.ix_(on, on)], moment[on]), rtol=0, atol=1e-6)


def test_columns_without_values_get_no_weight():
    assert linalg.nonnegative(np.diag([2.0, 0.0, 4.0]), np.array([1.0, 0.0, -1.0])).tolist() == [0.5, 0.0, 0.0]
    assert linalg.nonnegative(np.zeros((0, 0)), np.zeros(0)).tolist() == []
