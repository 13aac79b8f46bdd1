"""Small dense numerics in numpy. Sizes are numbers of stations, features or basis vectors, never of rows."""

from __future__ import annotations

import numpy as np

#: Sweeps of coordinate descent between two tries to solve for a lasso's weights at once.
EXACT = 10


def solve(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a x = b, by least squares where a is singular."""
    try:
        return np.linalg.solve(a, b)
    except np.linalg.LinAlgError:
        return np.linalg.lstsq(a, b, rcond=None)[0]


def ridge(gram: np.ndarray, moment: np.ndarray, alpha: float = 1.0) -> np.ndarray:
    """Weights of a ridge regression without intercept from X'X and X'y."""
    return solve(gram + alpha * np.eye(len(gram)), moment)


def nonnegative(gram: np.ndarray, moment: np.ndarray, close: float = 1e-12) -> np.ndarray:
    """Nonnegative least squares from X'X and X'y, by active sets: the weights above 0 are solved exactly, however alike their columns are."""
    size = np.sqrt(np.diag(gram).clip(0.0))
    on = size > 0
    g, m = gram[np.ix_(on, on)] / np.outer(size[on], size[on]), moment[on] / size[on]
    w, free = np.zeros(len(m)), np.zeros(len(m), dtype=bool)
    least = close * np.abs(m).max(initial=0.0)
    banned = np.zeros(len(m), dtype=bool)
    for _ in range(30 * (len(m) + 1)):
        slope = np.where(free | banned, -np.inf, m - g @ w)
        if not len(m) or slope.max() <= least:
            break
        new = int(slope.argmax())
        free[new] = True
        first = True
        while free.any():
            z = np.zeros(len(m))
            z[free] = solve(g[np.ix_(free, free)], m[free])
            if first and z[new] <= 0:  # rounding alone let it in
                free[new], banned[new] = False, True
                break
            first = False
            below = free & (z <= 0)
            if not below.any():
                w, banned[:] = z, False
                break
            part = (w[below] / (w[below] - z[below])).min()
            w = np.where(free, w + part * (z - w), 0.0)
            free &= w > close * np.abs(w).max()
            w[~free] = 0.0
    out = np.zeros(len(gram))
    out[on] = w / size[on]
    return out


def lasso(gram: np.ndarray, moment: np.ndarray, n: float, alpha: float, positive: bool = False, sweeps: int = 5000, close: float = 1e-10) -> np.ndarray:
    """Minimises |y - X w|^2 / (2 n) + alpha |w|_1 from X'X and X'y of centred data, by coordinate descent."""
    w = np.zeros(len(gram))
    for _ in range(sweeps):
        before = w.copy()
        for k in range(len(w)):
            if gram[k, k] > 0:
                rho = moment[k] - gram[k] @ w + gram[k, k] * w[k]
                w[k] = (max(rho - n * alpha, 0.0) if positive else np.sign(rho) * max(abs(rho) - n * alpha, 0.0)) / gram[k, k]
        if np.abs(w - before).max(initial=0.0) <= close * max(1.0, np.abs(w).max(initial=0.0)):
            break
    return w


def lasso_each(grams: np.ndarray, moments: np.ndarray, n: np.ndarray, alpha: float, positive: bool = False, sweeps: int = 5000, close: float = 1e-10, start: np.ndarray | None = None) -> np.ndarray:
    """lasso of many systems (system, k, k), (system, k) and n by system, a coordinate of all that are not done at a time.

    Every EXACT sweeps the weights that are not 0 are solved for, and taken as far towards that as they keep their signs;
    a system whose solution meets the conditions is done.
    """
    out, left = np.zeros(moments.shape) if start is None else start.copy(), np.arange(len(moments))
    for sweep in range(1, sweeps + 1):
        g, m, w = grams[left], moments[left], out[left]
        before = w.copy()
        for k in range(w.shape[1]):
            d = g[:, k, k]
            rho = m[:, k] - np.einsum("sk,sk->s", g[:, k], w) + d * w[:, k]
            new = np.maximum(rho - n[left] * alpha, 0.0) if positive else np.sign(rho) * np.maximum(np.abs(rho) - n[left] * alpha, 0.0)
            w[:, k] = np.where(d > 0, new / np.where(d > 0, d, 1.0), w[:, k])
        open = np.abs(w - before).max(axis=1, initial=0.0) > close * np.maximum(1.0, np.abs(w).max(axis=1, initial=0.0))
        if sweep % EXACT == 0 and open.any():
            at = np.flatnonzero(open)
            for _ in range(w.shape[1]):  # a weight less each time
                w[at], done, more = _on_support(g[at], m[at], w[at], n[left][at] * alpha, positive)
                open[at[done]] = False
                at = at[more]
                if not len(at):
                    break
        out[left] = w
        left = left[open]
        if not len(left):
            break
    return out


def _on_support(g: np.ndarray, m: np.ndarray, w: np.ndarray, penalty: np.ndarray, positive: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights nearer to those with the others at 0 and signs kept, whether they are a lasso's solution, and whether one more became 0."""
    size = np.sqrt(np.einsum("skk->sk", g).clip(0.0))
    scale = np.where(size > 0, size, 1.0)
    g, m, sign, penalty = g / (scale[:, :, None] * scale[:, None, :]), m / scale, np.sign(w), penalty[:, None] / scale
    on = sign != 0
    try:
        found = np.linalg.solve(np.where(on[:, :, None] & on[:, None, :], g, np.eye(w.shape[1])), np.where(on, m - penalty * sign, 0.0)[:, :, None])[:, :, 0]
    except np.linalg.LinAlgError:
        return w, np.zeros(len(w), bool), np.zeros(len(w), bool)
    found = np.where(on, found, 0.0)
    slope = m - np.einsum("skl,sl->sk", g, found)
    near = 1e-9 * (np.abs(m).max(axis=1, initial=0.0)[:, None] + penalty)
    off = (slope if positive else np.abs(slope)) <= penalty + near
    solved = np.where(on, np.abs(slope - penalty * sign) <= near, True).all(axis=1)
    kept = np.sign(found) == sign
    done = solved & np.where(on, kept, off | (size == 0)).all(axis=1)
    now = w * scale
    part = np.where(kept, 1.0, np.divide(now, now - found, out=np.ones_like(now), where=~kept))
    step = np.where(solved, part.min(axis=1, initial=1.0), 0.0)[:, None]
    moved = np.where(~kept & (part <= step), 0.0, now + step * (found - now))
    return moved / scale, done, solved & ~kept.all(axis=1)


def lasso_grid(moment: np.ndarray, n: float, size: int = 100, span: float = 1e-3) -> np.ndarray:
    """Penalties from the least that gives no weight at all down to span times it."""
    top = np.abs(moment).max(initial=0.0) / n
    return top * np.logspace(0, np.log10(span), size) if top > 0 else np.zeros(1)


def principal(covariance: np.ndarray, k: int) -> np.ndarray:
    """The k leading eigenvectors as columns, each with its largest entry positive."""
    _, v = np.linalg.eigh(covariance)
    v = v[:, ::-1][:, :k]
    return v * np.where(v[np.abs(v).argmax(axis=0), np.arange(v.shape[1])] < 0, -1, 1)


def modes(matrix: np.ndarray, k: int, which: str = "smallest") -> np.ndarray:
    """k eigenvectors of a symmetric matrix as columns, from either end of the spectrum."""
    _, v = np.linalg.eigh((matrix + matrix.T) / 2)
    return v[:, :k] if which == "smallest" else v[:, ::-1][:, :k]


def orthonormal(basis: np.ndarray) -> np.ndarray:
    return np.linalg.qr(basis)[0]


def reduced(basis: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """B' M B."""
    return basis.T @ matrix @ basis


def simplex_weights(covariance: np.ndarray) -> np.ndarray:
    """Weights that sum to 1 with the least variance."""
    x = solve(covariance, np.ones(len(covariance)))
    return x / x.sum() if abs(x.sum()) > 1e-12 else np.full(len(x), 1 / len(x))


def polynomial_terms(n: int, degree: int) -> list[tuple[int, ...]]:
    """Exponent tuples as index lists: the constant, then by degree in lexicographic order."""
    from itertools import combinations_with_replacement

    return [c for d in range(degree + 1) for c in combinations_with_replacement(range(n), d)]
