"""Parameters with the least loss, where a loss is a Spark plan over a panel.

Candidates are rows of a small table that a plan crosses with the panel, so a whole generation is one job however many
candidates it has: evaluate gets (candidate, one column a parameter) and gives (candidate, loss). What comes back is one
number a candidate. The searches keep a few numbers on the driver: the distribution that the next generation is drawn
from, or the last steps and gradients.

uniform and loguniform try a grid, random draws, evolution adapts a normal distribution's mean, step and covariance to
the better half (CMA-ES), surrogate fits a Gaussian process to what is known and tries where improvement is likeliest,
descend uses gradients, which a plan can give beside the loss in one aggregate (limited-memory BFGS inside bounds).
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession

Bounds = dict[str, tuple[float, float]]


@dataclass
class Found:
    """The best parameters, their loss, and all that were tried, in order."""

    best: dict[str, float]
    loss: float
    tried: list[tuple[dict[str, float], float]] = field(default_factory=list)


class Losses:
    """Losses of points (rows of parameters), a plan for each call; remembers them. A loss that is null or NaN counts as infinite."""

    def __init__(self, spark: SparkSession, bounds: Bounds, evaluate: Callable[[DataFrame], DataFrame]):
        self.spark, self.names, self.evaluate = spark, list(bounds), evaluate
        self.low, self.high = (np.array([b[k] for b in bounds.values()], dtype=float) for k in (0, 1))
        self.tried: list[tuple[dict[str, float], float]] = []

    def __call__(self, points: np.ndarray) -> np.ndarray:
        rows = [(k, *map(float, p)) for k, p in enumerate(points)]
        table = self.spark.createDataFrame(rows, ", ".join(["candidate int", *(f"`{n}` double" for n in self.names)]))
        out = np.full(len(rows), math.inf)
        for r in self.evaluate(table).select("candidate", "loss").collect():
            out[r.candidate] = math.inf if r.loss is None or math.isnan(r.loss) else r.loss
        self.tried += [(dict(zip(self.names, r[1:], strict=True)), float(x)) for r, x in zip(rows, out, strict=True)]
        return out

    def found(self) -> Found:
        best = min(self.tried, key=lambda x: x[1])
        return Found(*best, self.tried)


def uniform(losses: Losses, n: int, log: bool = False) -> Found:
    """n steps along each parameter, all combinations: n to the number of parameters rows of one plan."""
    space = (lambda a, b: np.geomspace(a, b, n)) if log else (lambda a, b: np.linspace(a, b, n))
    axes = np.meshgrid(*(space(a, b) for a, b in zip(losses.low, losses.high, strict=True)), indexing="ij")
    losses(np.stack([x.ravel() for x in axes], axis=1))
    return losses.found()


def random(losses: Losses, n: int, seed: int = 0) -> Found:
    losses(np.random.default_rng(seed).uniform(losses.low, losses.high, (n, len(losses.names))))
    return losses.found()


def evolution(losses: Losses, start: dict[str, float] | None = None, step: float = 0.3, population: int | None = None, generations: int = 40, close: float = 1e-8, seed: int = 0) -> Found:
    """CMA-ES in units of the bounds' widths; draws outside the bounds are set to them. Ends when the step is below close."""
    width, k = losses.high - losses.low, len(losses.names)
    mean = np.full(k, 0.5) if start is None else (np.array([start[n] for n in losses.names]) - losses.low) / width
    lam = population or 4 + int(3 * math.log(k)) + 2
    mu = lam // 2
    w = np.log(mu + 0.5) - np.log(np.arange(1, mu + 1))
    w /= w.sum()
    eff = 1 / (w**2).sum()
    c_step, c_path = (eff + 2) / (k + eff + 5), (4 + eff / k) / (k + 4 + 2 * eff / k)
    c_one = 2 / ((k + 1.3) ** 2 + eff)
    c_mu = min(1 - c_one, 2 * (eff - 2 + 1 / eff) / ((k + 2) ** 2 + eff))
    damp = 1 + 2 * max(0.0, math.sqrt((eff - 1) / (k + 1)) - 1) + c_step
    expected = math.sqrt(k) * (1 - 1 / (4 * k) + 1 / (21 * k * k))
    cov, p_step, p_cov, rng = np.eye(k), np.zeros(k), np.zeros(k), np.random.default_rng(seed)
    for g in range(1, generations + 1):
        e, b = np.linalg.eigh((cov + cov.T) / 2)
        e = np.sqrt(np.maximum(e, 1e-20))
        y = (rng.normal(size=(lam, k)) * e) @ b.T
        x = np.clip(mean + step * y, 0, 1)
        y = (x - mean) / step
        order = np.argsort(losses(losses.low + x * width), kind="stable")[:mu]
        move = w @ y[order]
        mean = mean + step * move
        p_step = (1 - c_step) * p_step + math.sqrt(c_step * (2 - c_step) * eff) * (b @ ((b.T @ move) / e))
        size = float(np.linalg.norm(p_step))
        still = size / math.sqrt(1 - (1 - c_step) ** (2 * g)) < (1.4 + 2 / (k + 1)) * expected
        p_cov = (1 - c_path) * p_cov + still * math.sqrt(c_path * (2 - c_path) * eff) * move
        cov = (1 - c_one - c_mu) * cov + c_one * (np.outer(p_cov, p_cov) + (not still) * c_path * (2 - c_path) * cov) + c_mu * (y[order].T * w) @ y[order]
        step *= math.exp(min(1.0, c_step / damp * (size / expected - 1)))
        if step * math.sqrt(max(np.diag(cov).max(), 0)) < close:
            break
    return losses.found()


def surrogate(losses: Losses, first: int = 8, rounds: int = 10, at_once: int = 4, seed: int = 0) -> Found:
    """Bayesian search: after first draws, each round tries the at_once points where a Gaussian process expects most improvement."""
    rng, k = np.random.default_rng(seed), len(losses.names)
    width = losses.high - losses.low
    x = rng.uniform(size=(first, k))
    y = losses(losses.low + x * width)
    kernel = lambda a, b: np.exp(-0.5 * ((a[:, None, :] - b[None, :, :]) ** 2).sum(2) / (0.2 * 0.2 * k))
    for _ in range(rounds):
        for _ in range(at_once):  # a point that is chosen counts as known with the expected loss until it is tried
            known = np.where(np.isfinite(y), y, np.nanmax(y[np.isfinite(y)], initial=0.0))
            z = (known - known.mean()) / (known.std() or 1.0)
            pool = np.vstack([rng.uniform(size=(500, k)), np.clip(x[np.argmin(known)] + rng.normal(0, 0.03, (200, k)), 0, 1)])
            cross = kernel(pool, x)
            solved = np.linalg.solve(kernel(x, x) + 1e-6 * np.eye(len(x)), np.column_stack([z, cross.T]))
            mean, sd = cross @ solved[:, 0], np.sqrt(np.maximum(1 - (cross * solved[:, 1:].T).sum(1), 1e-12))
            u = (z.min() - mean) / sd
            gain = sd * (u * 0.5 * (1 + np.array([math.erf(v / math.sqrt(2)) for v in u])) + np.exp(-u * u / 2) / math.sqrt(2 * math.pi))
            best = int(np.argmax(gain))
            x, y = np.vstack([x, pool[best]]), np.append(known, known.mean() + mean[best] * (known.std() or 1.0))
        y[-at_once:] = losses(losses.low + x[-at_once:] * width)
    return losses.found()


def descend(bounds: Bounds, gradient: Callable[[dict[str, float]], tuple[float, dict[str, float]]], start: dict[str, float] | None = None, steps: int = 50, held: int = 8, close: float = 1e-8) -> Found:
    """Limited-memory BFGS inside bounds: gradient(parameters) runs one plan and gives (loss, its slope in each parameter).

    Parameters at a bound whose slope points outside stay there; the others move along the two-loop direction, cut off at
    the bounds and shortened until the loss falls enough. Ends when no free slope is above close of the loss a width.
    """
    names = list(bounds)
    low, high = (np.array([bounds[n][k] for n in names], dtype=float) for k in (0, 1))
    width, tried = high - low, []

    def at(x: np.ndarray) -> tuple[float, np.ndarray]:
        own = {n: float(v) for n, v in zip(names, low + x * width, strict=True)}
        f, g = gradient(own)
        tried.append((own, float(f)))
        return float(f), np.array([g[n] for n in names], dtype=float) * width

    x = np.full(len(names), 0.5) if start is None else np.clip((np.array([start[n] for n in names]) - low) / width, 0, 1)
    f, g = at(x)
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        free = ~((x <= 0) & (g > 0) | (x >= 1) & (g < 0))
        if not free.any() or np.abs(g[free]).max() <= close * max(1.0, abs(f)):
            break
        q, back = np.where(free, g, 0.0), []
        for s, y in reversed(pairs):
            a = (s @ q) / (s @ y)
            back.append(a)
            q = q - a * y
        q = q * ((pairs[-1][0] @ pairs[-1][1]) / (pairs[-1][1] @ pairs[-1][1]) if pairs else 0.1 / max(np.abs(g).max(), 1e-300))
        for (s, y), a in zip(pairs, reversed(back), strict=True):
            q = q + s * (a - (y @ q) / (s @ y))
        way = np.where(free, -q, 0.0)
        if way @ g >= 0:
            way, pairs = np.where(free, -g, 0.0) * (0.1 / np.abs(g[free]).max()), []
        length, moved = 1.0, False
        for _ in range(25):
            after = np.clip(x + length * way, 0, 1)
            if (after == x).all():
                break
            f_after, g_after = at(after)
            if f_after <= f + 1e-4 * (g @ (after - x)):
                moved = True
                break
            length /= 3
        if not moved:
            if not pairs:
                break
            pairs = []  # the directions known no longer hold; try the slope alone
            continue
        s, y = after - x, g_after - g
        if s @ y > 1e-12 * (y @ y):
            pairs = [*pairs, (s, y)][-held:]
        x, f, g = after, f_after, g_after
    best = min(tried, key=lambda r: r[1])
    return Found(*best, tried)
