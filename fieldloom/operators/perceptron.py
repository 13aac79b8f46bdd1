"""A regressor with logistic hidden layers, learned over all rows by full-batch Adam.

A step needs the sum of the rows' gradients, a few hundred numbers, whatever the number of rows: tasks add up their Arrow
batches' gradients, LANES tasks add up the tasks', and the driver moves the weights. Up to IN_MEMORY rows the same steps
run on the driver; both give the same weights but for the rounding of sums.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import checkpointed

IN_MEMORY, LANES = 50_000, 16
TABLE = "part string, layer int, row int, values array<double>"


class Perceptron:
    """Layers of weights with their offsets; inputs and values are standardised."""

    def __init__(self, hidden: tuple[int, ...] = (20, 20), steps: int = 400, rate: float = 0.01, seed: int = 0):
        self.hidden, self.steps, self.rate, self.seed = hidden, steps, rate, seed

    def begin(self, mx: np.ndarray, sx: np.ndarray, my: float, sy: float) -> Perceptron:
        rng = np.random.default_rng(self.seed)
        self.mx, self.sx, self.my, self.sy = mx, np.where(sx > 0, sx, 1), my, sy or 1.0
        sizes = (len(mx), *self.hidden, 1)
        self.w = [[rng.normal(0, a**-0.5, (a, b)), np.zeros(b)] for a, b in zip(sizes[:-1], sizes[1:], strict=True)]
        size = sum(p.size for layer in self.w for p in layer)
        self.m, self.v, self.t = np.zeros(size), np.zeros(size), 0
        return self

    def gradient(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """The gradient of half the square error, summed over the rows (not yet standardised), flat."""
        acts = self._acts((x - self.mx) / self.sx)
        d, out = acts[-1] - ((y - self.my) / self.sy)[:, None], []
        for k in range(len(self.w) - 1, -1, -1):
            out += [d.sum(0), acts[k].T @ d]
            if k:
                d = (d @ self.w[k][0].T) * acts[k] * (1 - acts[k])
        return np.concatenate([g.ravel() for g in out[::-1]])

    def step(self, g: np.ndarray) -> None:
        """One step of Adam along the mean gradient."""
        self.t += 1
        self.m = 0.9 * self.m + 0.1 * g
        self.v = 0.999 * self.v + 0.001 * g * g
        move, at = self.rate * (self.m / (1 - 0.9**self.t)) / (np.sqrt(self.v / (1 - 0.999**self.t)) + 1e-8), 0
        for layer in self.w:
            for i, p in enumerate(layer):
                layer[i] = p - move[at : at + p.size].reshape(p.shape)
                at += p.size

    def fit(self, x: np.ndarray, y: np.ndarray) -> Perceptron:
        self.begin(x.mean(0), x.std(0), y.mean(), y.std())
        for _ in range(self.steps):
            self.step(self.gradient(x, y) / len(y))
        return self

    def _acts(self, x: np.ndarray) -> list[np.ndarray]:
        acts = [x]
        for k, (w, b) in enumerate(self.w):
            z = acts[-1] @ w + b
            acts.append(z if k == len(self.w) - 1 else 1 / (1 + np.exp(-z)))
        return acts

    def rows(self) -> list[tuple]:
        """What was learned, as rows (part, layer, row, values)."""
        scale = [("x", 0, 0, self.mx.tolist()), ("x", 0, 1, self.sx.tolist()), ("y", 0, 0, [float(self.my), float(self.sy)])]
        return scale + [("w", k, i, line.tolist()) for k, (w, b) in enumerate(self.w) for i, line in enumerate([*w, b])]

    @classmethod
    def of(cls, rows: list[tuple]) -> Perceptron:
        """The perceptron of these rows, in any order; a layer's last row is its offsets."""
        own, out = {(part, k, i): np.array(v) for part, k, i, v in rows}, cls()
        out.mx, out.sx = own["x", 0, 0], own["x", 0, 1]
        out.my, out.sy = own["y", 0, 0]
        layers = [[own["w", k, i] for i in sorted(i for part, j, i in own if (part, j) == ("w", k))] for k in sorted({k for part, k, _ in own if part == "w"})]
        out.w = [[np.array(x[:-1]), x[-1]] for x in layers]
        return out

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self._acts((x - self.mx) / self.sx)[-1][:, 0] * self.sy + self.my


def _summed(rows: DataFrame, model: Perceptron) -> np.ndarray:
    """The gradient over all rows."""
    columns, size = len(rows.columns), len(model.m)

    def tasks(batches):
        total = np.zeros(size)
        for b in batches:
            x = np.stack([np.asarray(c, dtype=float) for c in b.columns], axis=1)
            total += model.gradient(x[:, : columns - 1], x[:, columns - 1])
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId() % LANES], pa.int32()), pa.array([total.tobytes()])], ["lane", "g"])

    def lanes(batches):
        total = np.zeros(size)
        for b in batches:
            for g in b.column(1).to_pylist():
                total += np.frombuffer(g)
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([total.tobytes()])], ["lane", "g"])

    parts = rows.mapInArrow(tasks, "lane int, g binary")
    if rows.rdd.getNumPartitions() > LANES:
        parts = parts.repartition(LANES, "lane").mapInArrow(lanes, "lane int, g binary")
    return sum((np.frombuffer(r.g) for r in parts.collect()), np.zeros(size))


def fit(frame: DataFrame, model: Perceptron | None = None) -> Perceptron:
    """A perceptron over all rows of frame; its last column is the value, the others are inputs; rows with a null are left out."""
    model, (*inputs, value) = model or Perceptron(), frame.columns
    rows = checkpointed(frame.na.drop())
    n = rows.count()
    if n <= IN_MEMORY:
        held = rows.toPandas().to_numpy(dtype=float).reshape(n, len(frame.columns))
        return model.fit(held[:, :-1], held[:, -1]) if n else model.begin(np.zeros(len(inputs)), np.ones(len(inputs)), 0.0, 1.0)
    facts = rows.agg(*[f(c).alias(f"{k}{i}") for i, c in enumerate([*inputs, value]) for k, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    own = lambda k: np.array([facts[f"{k}{i}"] for i in range(len(inputs))])
    model.begin(own("m"), own("s"), facts[f"m{len(inputs)}"], facts[f"s{len(inputs)}"])
    for _ in range(model.steps):
        model.step(_summed(rows, model) / n)
    return model
