"""A random forest whose trees depend on the rows and not on where they lie.

All trees grow together, a level in one pass: a task adds up weights and values by (tree, node, feature, bin), the sums of
a tree meet in one task, which finds the best splits of its nodes, and only the splits come to the driver. A row's weight
in a tree is a Poisson draw from a hash of (tree, row key), and a node's features come from a hash of (tree, node), so
there is no generator that rows are drawn from in order. Values are scaled to integers of 20 bits, so sums are exact and
do not depend on their order: any partitioning gives the same forest.

Settings are compared by cross-validation without more fits: a forest of fewer or shallower trees is a part of the larger
one (inner nodes keep their means), and the forests of all folds grow in the same passes, each leaving out its group.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import checkpointed

BINS, FINE, SCALE_BITS = 32, 4096, 20
#: Cells (tree, node, feature, bin) of which a task holds the sums; with more, the trees are done in several passes.
CELLS = 1_000_000
U = np.uint64
_POISSON = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(12)])


def _mixed(*parts) -> np.ndarray:
    x = U(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        for p in parts:
            x = (x ^ np.asarray(p).astype(np.int64).view(U)) * U(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> U(29))) * U(0x94D049BB133111EB)
            x = x ^ (x >> U(32))
    return x


def draws(keys: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """How often each row is in the tree's sample: Poisson with mean 1, by the row's key."""
    return np.searchsorted(_POISSON, (_mixed(keys, tree, seed) >> U(11)) * 2.0**-53).astype(np.int64)


@dataclass
class Trees:
    """Splits by tree and node (children of n are 2n and 2n + 1, the root is 1); feature -1: none. value: mean of the node."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray

    @classmethod
    def empty(cls, trees: int, depth: int) -> Trees:
        shape = (trees, 2 << depth)
        return cls(np.full(shape, -1, dtype=np.int32), np.zeros(shape), np.zeros(shape))

    def nodes(self, x: np.ndarray, tree: int, depth: int) -> list[np.ndarray]:
        """The node of each row of x at every depth; a row stays at a node without a split."""
        at, rows = np.ones(len(x), dtype=np.int64), np.arange(len(x))
        out = [at]
        for _ in range(depth):
            f = self.feature[tree, at]
            right = x[rows, np.maximum(f, 0)] >= self.cut[tree, at]
            at = np.where(f < 0, at, 2 * at + right)
            out.append(at)
        return out

    def predict(self, x: np.ndarray) -> np.ndarray:
        depth = int(math.log2(self.feature.shape[1])) - 1
        total = np.zeros(len(x))
        for tree in range(len(self.feature)):
            total += self.value[tree, self.nodes(x, tree, depth)[-1]]
        return total / len(self.feature)

    def part(self, trees: int, depth: int) -> Trees:
        """The first trees, cut off below this depth."""
        out = Trees(self.feature[:trees, : 2 << depth].copy(), self.cut[:trees, : 2 << depth], self.value[:trees, : 2 << depth])
        out.feature[:, 1 << depth :] = -1
        return out

    def rows(self) -> list[tuple[int, int, int, float, float]]:
        kept = [(t, n) for t in range(len(self.feature)) for n in range(1, self.feature.shape[1]) if n == 1 or self.feature[t, n // 2] >= 0]
        return [(t, n, int(self.feature[t, n]), float(self.cut[t, n]), float(self.value[t, n])) for t, n in kept]

    @classmethod
    def of(cls, rows) -> Trees:
        rows = list(rows)
        depth = max(int(math.log2(r[1])) for r in rows)
        out = cls.empty(1 + max(r[0] for r in rows), depth)
        for t, n, f, c, v in rows:
            out.feature[t, n], out.cut[t, n], out.value[t, n] = f, c, v
        return out


TABLE = "tree int, node int, feature int, cut double, value double"


def _matrix(batch: pa.RecordBatch, first: int) -> np.ndarray:
    return np.stack([np.asarray(c, dtype=float) for c in batch.columns[first:]], axis=1)


def cuts_of(frame: DataFrame, names: list[str]) -> list[np.ndarray]:
    """Up to BINS - 1 cuts of each feature at its quantiles, from a histogram of FINE bins over all rows."""
    ends = frame.agg(*[f(n).alias(f"{k}{n}") for n in names for k, f in (("l", F.min), ("h", F.max))]).first()
    low = np.array([ends[f"l{n}"] for n in names], dtype=float)
    wide = np.array([ends[f"h{n}"] for n in names], dtype=float) - low

    def run(batches):
        counts = np.zeros((len(names), FINE), dtype=np.int64)
        for b in batches:
            at = np.clip((_matrix(b, 0) - low) / np.where(wide > 0, wide, 1) * FINE, 0, FINE - 1).astype(np.int64)
            for k in range(len(names)):
                counts[k] += np.bincount(at[:, k], minlength=FINE)
        k, at = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(at, pa.int32()), pa.array(counts[k, at])], ["f", "at", "n"])

    found = frame.select(*names).mapInArrow(run, "f int, at int, n long").groupBy("f", "at").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros((len(names), FINE), dtype=np.int64)
    for r in found:
        counts[r.f, r.at] = r.n
    out = []
    for k in range(len(names)):
        upto = np.cumsum(counts[k])
        edges = np.unique(np.searchsorted(upto, upto[-1] * np.arange(1, BINS) / BINS))
        out.append(low[k] + (edges[edges < FINE - 1] + 1) / FINE * wide[k] if wide[k] > 0 else np.zeros(0))
    return out


def _best(w: np.ndarray, s: np.ndarray, allowed: np.ndarray):
    """The best split of a node from sums [feature, bin]: (feature, place of the cut, left w and s, right w and s); None without gain."""
    wl, sl = np.cumsum(w, axis=1)[:, :-1], np.cumsum(s, axis=1)[:, :-1]
    total_w, total_s = int(w[0].sum()), int(s[0].sum())
    wr, sr = total_w - wl, total_s - sl
    ok = (wl > 0) & (wr > 0) & allowed[:, None]
    if not ok.any():
        return None
    f = lambda x: x.astype(float)
    gain = np.where(ok, f(sl) ** 2 / np.maximum(wl, 1) + f(sr) ** 2 / np.maximum(wr, 1), -np.inf)
    k, at = np.unravel_index(int(np.argmax(gain)), gain.shape)
    if gain[k, at] <= float(total_s) ** 2 / total_w * (1 + 1e-12) + 1e-6:
        return None
    return int(k), int(at), int(wl[k, at]), int(sl[k, at]), int(wr[k, at]), int(sr[k, at])


def grow(frame: DataFrame, names: list[str], trees: int, depth: int, share: float, seed: int, folds: int = 0) -> list[Trees]:
    """Forests over frame (_key long, _y double, _group int, names): one over all rows, then one without each group.

    A node looks at ceil(share of the features). A forest of no rows predicts 0.
    """
    cuts = cuts_of(frame, names)
    top = frame.agg(F.max(F.abs("_y"))).first()[0] or 1.0
    scale = 2.0 ** (math.ceil(math.log2(top)) - SCALE_BITS)
    ready = checkpointed(frame.select("_key", "_group", F.rint(F.col("_y") / scale).cast("long").alias("_y"), *names))
    n_forests, features = folds + 1, len(names)
    every = Trees.empty(n_forests * trees, depth)
    take = max(1, math.ceil(share * features))

    def level(d: int, chosen: list[int]):
        first, width = 1 << d, 1 << d

        def sums(batches):
            w, s = (np.zeros((len(chosen), width * features * BINS), dtype=np.int64) for _ in range(2))
            for b in batches:
                key, group, y = (np.asarray(b.column(k)) for k in range(3))
                x = _matrix(b, 3)
                bins = np.stack([np.searchsorted(c, x[:, k], side="right") for k, c in enumerate(cuts)], axis=1)
                for place, tree in enumerate(chosen):
                    left_out = tree // trees - 1
                    weight = np.where(group == left_out, 0, draws(key, tree % trees, seed))
                    at = every.nodes(x, tree, d)[-1] - first
                    on = np.flatnonzero((at >= 0) & (weight > 0))
                    for k in range(features):
                        cell = (at[on] * features + k) * BINS + bins[on, k]
                        w[place] += np.bincount(cell, weight[on], w.shape[1]).astype(np.int64)
                        s[place] += np.bincount(cell, weight[on] * y[on], w.shape[1]).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(chosen, pa.int32()), pa.array([x.tobytes() for x in w]), pa.array([x.tobytes() for x in s])], ["tree", "w", "s"])

        def splits(batches):
            now, w, s = None, None, None

            def found():
                cells = w.reshape(width, features, BINS), s.reshape(width, features, BINS)
                for node in range(width):
                    if not (own := cells[0][node][0].sum()):
                        continue
                    order = np.argsort(_mixed(np.arange(features), np.full(features, first + node), np.full(features, now % trees), np.full(features, seed)), kind="stable")
                    allowed = np.isin(np.arange(features), order[:take])
                    best = _best(cells[0][node], cells[1][node], allowed)
                    yield (now, first + node, int(own), int(cells[1][node][0].sum()), *(best or (-1, 0, 0, 0, 0, 0)))

            def batch(rows):
                return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(10)], list("abcdefghij"))

            for b in batches:
                for tree, wb, sb in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    if tree != now:
                        if now is not None:
                            yield batch(list(found()))
                        now, w, s = tree, np.zeros(width * features * BINS, dtype=np.int64), np.zeros(width * features * BINS, dtype=np.int64)
                    w += np.frombuffer(wb, dtype=np.int64)
                    s += np.frombuffer(sb, dtype=np.int64)
            if now is not None:
                yield batch(list(found()))

        parts = ready.mapInArrow(sums, "tree int, w binary, s binary").repartition("tree").sortWithinPartitions("tree")
        return parts.mapInArrow(splits, ", ".join(f"{c} long" for c in "abcdefghij")).collect()

    unit = scale
    for d in range(depth):
        at_once = max(1, CELLS // ((1 << d) * features * BINS))
        for k in range(0, len(every.feature), at_once):
            chosen = [t for t in range(k, min(k + at_once, len(every.feature))) if d == 0 or (every.feature[t, 1 << (d - 1) : 1 << d] >= 0).any()]
            for tree, node, w, s, feature, at, wl, sl, wr, sr in level(d, chosen) if chosen else ():
                every.value[tree, node] = s / w * unit
                if feature >= 0:
                    every.feature[tree, node], every.cut[tree, node] = feature, cuts[feature][at]
                    every.value[tree, 2 * node], every.value[tree, 2 * node + 1] = sl / wl * unit, sr / wr * unit
    return [Trees(every.feature[k * trees : (k + 1) * trees], every.cut[k * trees : (k + 1) * trees], every.value[k * trees : (k + 1) * trees]) for k in range(n_forests)]


def rated(frame: DataFrame, names: list[str], forests: list[Trees], settings: list[tuple[int, int]]) -> list[float]:
    """The summed square error of each setting (trees, depth) over frame, each row by the forest that left its group out."""
    depth = max(d for _, d in settings)

    def run(batches):
        loss = np.zeros(len(settings))
        for b in batches:
            y, group, x = np.asarray(b.column(0)), np.asarray(b.column(1)), _matrix(b, 2)
            for g, own in enumerate(forests):
                on = np.flatnonzero(group == g)
                if not len(on):
                    continue
                by_depth = np.zeros((depth + 1, len(own.feature), len(on)))
                for tree in range(len(own.feature)):
                    for d, at in enumerate(own.nodes(x[on], tree, depth)):
                        by_depth[d, tree] = own.value[tree, at]
                for k, (t, d) in enumerate(settings):
                    loss[k] += ((by_depth[d, :t].mean(axis=0) - y[on]) ** 2).sum()
        yield pa.RecordBatch.from_arrays([pa.array(range(len(settings)), pa.int32()), pa.array(loss)], ["k", "loss"])

    found = frame.select("_y", "_group", *names).mapInArrow(run, "k int, loss double").groupBy("k").agg(F.sum("loss").alias("loss")).collect()
    out = [math.inf] * len(settings)
    for r in found:
        out[r.k] = r.loss
    return out


def fit(frame: DataFrame, names: list[str], grid: dict[str, tuple], trees: int = 50, depth: int = 3, share: float = 1 / 3, seed: int = 1, folds: int = 5) -> Trees:
    """A forest over frame (_key, _y, _group, names). grid: values of numTrees and maxDepth to choose from by the groups 0 to folds - 1; of equals the first."""
    if unknown := set(grid) - {"numTrees", "maxDepth"}:
        raise ValueError(f"no such settings of a forest: {sorted(unknown)}")
    settings = [(t, d) for t in grid.get("numTrees", (trees,)) for d in grid.get("maxDepth", (depth,))]
    forests = grow(frame, names, max(t for t, _ in settings), max(d for _, d in settings), share, seed, folds if grid else 0)
    best = settings[int(np.argmin(rated(frame, names, forests[1:], settings)))] if grid else settings[0]
    return forests[0].part(*best)
