"""Sparse symmetric matrices of few entries, held whole by the workers while right sides and vectors are dealt over tasks.

A street graph has a handful of entries a node, so the matrix is small where its fields (times by nodes) and its pairs
(nodes by nodes) are large. Up to ENTRIES entries a matrix is broadcast, some 30 MB, and each task solves for its own
right sides or filters its own vectors; products then need no join and no shuffle. Beyond, matrices stay tables.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import checkpointed

ENTRIES = 2_500_000
#: Numbers of a block of right sides that a task solves at once (times a few for its working vectors); rows it gives at once.
BLOCK, ROWS = 2_000_000, 200_000


@dataclass
class Held:
    """Rows by falling number of entries, slot by slot: slot s has the s-th entry of each of the first rows that have one."""

    nodes: np.ndarray  # in rising order
    order: np.ndarray  # the node of each row, as its place in nodes
    slots: list[tuple[np.ndarray, np.ndarray]]  # columns (as rows' numbers) and values
    diagonal: np.ndarray

    def product(self, x: np.ndarray) -> np.ndarray:
        y = np.zeros_like(x)
        for columns, values in self.slots:
            y[: len(columns)] += values[:, None] * x[columns]
        return y

    def sizes_beside(self) -> np.ndarray:
        """Of each row, the sizes of the entries off the diagonal."""
        out = np.zeros(len(self.nodes))
        for columns, values in self.slots:
            out[: len(columns)] += np.abs(values)
        return out - np.abs(self.diagonal)

    def rows_of(self, nodes: np.ndarray) -> np.ndarray:
        """The row of each node, -1 for a node that the matrix lacks."""
        at = np.searchsorted(self.nodes, nodes).clip(0, len(self.nodes) - 1)
        place = np.empty(len(self.nodes), np.int64)
        place[self.order] = np.arange(len(self.order))
        return np.where(self.nodes[at] == nodes, place[at], -1)

    def solve(self, b: np.ndarray, close: float = 1e-12, rounds: int = 50_000) -> np.ndarray:
        """z with matrix z = b (nodes by right sides), by diagonally scaled conjugate gradients; columns that are done leave."""
        out, own = np.zeros_like(b), np.arange(b.shape[1])
        d, r, z = self.diagonal[:, None], b.copy(), np.zeros_like(b)
        p = r / d
        old, enough = (r * p).sum(0), close * close * (b * b).sum(0)
        for _ in range(rounds):
            done = (r * r).sum(0) <= enough
            if done.any():
                out[:, own[done]] = z[:, done]
                left = ~done
                own, r, z, p, old, enough = own[left], r[:, left], z[:, left], p[:, left], old[left], enough[left]
            if not len(own):
                return out
            q = self.product(p)
            a = old / (p * q).sum(0)
            z += a * p
            r -= a * q
            q = r / d
            new = (r * q).sum(0)
            p *= new / old
            p += q
            old = new
        raise RuntimeError(f"not solved after {rounds} steps")


def hold(matrix: DataFrame) -> Held | None:
    """A checkpointed tall matrix whose entries are summed already; None if it has more than ENTRIES, or nodes that aren't numbers."""
    if dict(matrix.dtypes)["i"] not in ("int", "bigint") or not 0 < matrix.limit(ENTRIES + 1).count() <= ENTRIES:
        return None
    table = matrix.select("i", "j", "value").toArrow()
    i, j, value = (table.column(c).to_numpy() for c in ("i", "j", "value"))
    nodes, i = np.unique(i, return_inverse=True)
    j = np.searchsorted(nodes, j)
    n = np.bincount(i, minlength=len(nodes))
    order = np.argsort(-n, kind="stable")
    row = np.empty(len(nodes), np.int64)
    row[order] = np.arange(len(nodes))
    i, j = row[i], row[j].astype(np.int32)
    by = np.argsort(i, kind="stable")
    i, j, value = i[by], j[by], value[by].astype(float)
    starts = np.concatenate([[0], np.cumsum(n[order])[:-1]])
    slot = np.arange(len(i)) - starts[i]
    by = np.argsort(slot, kind="stable")
    ends = np.cumsum(np.bincount(slot))
    slots = [(j[own], value[own]) for own in np.split(by, ends[:-1])]
    diagonal = np.zeros(len(nodes))
    diagonal[i[i == j]] = value[i == j]
    return Held(nodes, order, slots, diagonal)


def dealt(df: DataFrame, n: int) -> DataFrame:
    """n rows of about the same work over at least as many tasks as run at once, if there are so many rows."""
    at_once = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(1, min(n, max(2 * at_once, math.ceil(n / 64)))))


def solved(source: DataFrame, held: Held, lower: bool = False) -> DataFrame:
    """(t, node, z) with matrix z = source for all t of (t, node, z); with lower, for nodes up to t alone."""
    shared = source.sparkSession.sparkContext.broadcast(held)
    kind = source.schema["t"].dataType.simpleString(), source.schema["node"].dataType.simpleString()

    def run(frames):
        import pandas as pd

        m = shared.value
        n = len(m.nodes)
        wide, long = max(1, min(64, BLOCK // n)), max(1, ROWS // n)
        back = np.empty(n, np.int64)
        back[m.order] = np.arange(n)
        for df in frames:
            for a in range(0, len(df), wide):
                times, lists = df["t"].to_numpy()[a : a + wide], df["own"][a : a + wide]
                b = np.zeros((n, len(times)))
                for column, own in enumerate(lists):
                    rows, z = m.rows_of(np.array([x["node"] for x in own])), np.array([x["z"] for x in own])
                    np.add.at(b[:, column], rows[rows >= 0], z[rows >= 0])
                z = m.solve(b)[back]
                for c in range(0, len(times), long):
                    t = times[c : c + long]
                    own = pd.DataFrame({"t": np.repeat(t, n), "node": np.tile(m.nodes, len(t)), "z": z[:, c : c + long].T.ravel()})
                    yield own[own["node"] <= own["t"]] if lower else own

    by_time = checkpointed(source.where("z is not null").groupBy("t").agg(F.collect_list(F.struct("node", "z")).alias("own")))
    return dealt(by_time, by_time.count()).mapInPandas(run, f"t {kind[0]}, node {kind[1]}, z double")
