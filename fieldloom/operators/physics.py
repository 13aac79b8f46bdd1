"""A diffusing field calibrated at sensors: (diffusion * K + M) z = sum over c of weight_c * q_c, plus a mean and an offset.

Scaling both sides leaves the field as it is, so the absorption in front of the mass matrix M is 1 and the diffusion is the
share of the two. For a diffusion the fields of all sources are solved at once (the matrix's other side is just longer), and
weights and offset are the least squares at the sensors: a Gram matrix of a few columns. What is left is one number, found
by descent. Its slope takes one more solve, the adjoint: with r the residuals at the sensors and (diffusion * K + M) a = r,
the loss falls by 2 * a' K z for each unit of diffusion (the weights are at their best, so their own change counts for
nothing). Solves are those of solve_field, so nothing here bounds nodes or times.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import linalg, search, spectral
from .components import checkpointed
from .estimators import solve_field

OFFSET = "offset"
TABLE = "term string, value double"


@dataclass
class CalibratedField:
    """fit gives (term, value): diffusion, a weight for each source, offset, loss; predict the field at all nodes.

    source is (t long, node, names), 0 where a row is missing. stiffness and mass are symmetric tall matrices whose sum is
    positive. bounds are those of the diffusion, searched on a logarithmic scale from start in so many steps. With
    average, values are taken less their mean over the sensors at the time, which is added back; with offset a constant
    is fitted too; with positive, no weight is below 0.
    """

    source: DataFrame
    names: tuple[str, ...]
    stiffness: DataFrame
    mass: DataFrame
    bounds: tuple[float, float] = (1e-3, 1e3)
    start: float = 1.0
    steps: int = 12
    average: bool = True
    offset: bool = False
    positive: bool = True

    def fields(self, diffusion: float) -> DataFrame:
        """(t, node, names): each source's own field. One solve, with time and source in one number."""
        n = len(self.names)
        at = F.col("t") * n
        long = self.source.select("node", F.explode(F.array(*[F.struct((at + k).alias("t"), F.coalesce(c, F.lit(0.0)).cast("double").alias("z")) for k, c in enumerate(self.names)])).alias("s"))
        own = solve_field(long.select("s.t", "node", "s.z").where("z <> 0"), [(diffusion, self.stiffness), (1.0, self.mass)])
        which = F.pmod("t", F.lit(n))
        wide = own.groupBy(F.floor(F.col("t") / n).alias("t"), "node")
        return checkpointed(wide.agg(*[F.coalesce(F.sum(F.when(which == k, F.col("z"))), F.lit(0.0)).alias(c) for k, c in enumerate(self.names)]))

    def _centred(self, observed: DataFrame) -> DataFrame:
        """(t, node, y, mean) of the sensors' values."""
        own = observed.where("z is not null")
        if not self.average:
            return own.select("t", "node", F.col("z").alias("y"), F.lit(0.0).alias("mean"))
        mean = own.groupBy("t").agg(F.avg("z").alias("mean"))
        return own.join(mean, "t").select("t", "node", (F.col("z") - F.col("mean")).alias("y"), "mean")

    def _weights(self, seen: DataFrame) -> tuple[np.ndarray, float, int]:
        """Weights of the sources (and the offset, last), the mean square error, and the number of values."""
        columns = [*self.names, *(["one"] if self.offset else []), "y"]
        n = seen.count()
        if not n:
            return np.zeros(len(columns) - 1), math.inf, 0
        g = spectral.gram(seen.withColumn("one", F.lit(1.0)), columns)
        k = len(self.names)
        if self.positive and self.offset:  # the offset has any sign: it goes out by centring on the ones
            inner, moment = g[:k, :k] - np.outer(g[:k, k], g[:k, k]) / n, g[:k, -1] - g[:k, k] * g[k, -1] / n
            w = linalg.nonnegative(inner, moment)
            w = np.append(w, (g[k, -1] - g[k, :k] @ w) / n)
        else:
            w = linalg.nonnegative(g[:-1, :-1], g[:-1, -1]) if self.positive else linalg.solve(g[:-1, :-1], g[:-1, -1])
        c = np.append(-w, 1.0)
        return w, float(c @ g @ c) / n, n

    def at_sensors(self, observed: DataFrame, diffusion: float, fields: DataFrame | None = None) -> DataFrame:
        fields = self.fields(diffusion) if fields is None else fields
        zero = {c: 0.0 for c in self.names}
        return checkpointed(self._centred(observed).join(fields, ["t", "node"], "left").na.fill(zero).select("t", "node", "y", *self.names))

    def loss_and_slope(self, observed: DataFrame, diffusion: float) -> tuple[float, float, np.ndarray]:
        """The mean square error at the best weights, its slope in the diffusion by the adjoint, and the weights."""
        fields = self.fields(diffusion)
        seen = self.at_sensors(observed, diffusion, fields)
        w, loss, n = self._weights(seen)
        if not n:
            return math.inf, 0.0, w
        total = sum((F.col(c) * float(v) for c, v in zip(self.names, w, strict=False)), F.lit(0.0))
        left = seen.select("t", "node", (total + float(w[-1] if self.offset else 0.0) - F.col("y")).alias("z"))
        adjoint = solve_field(left, [(diffusion, self.stiffness), (1.0, self.mass)])
        z = fields.select("t", F.col("node").alias("j"), total.alias("z"))
        image = self.stiffness.join(z, "j").groupBy("t", F.col("i").alias("node")).agg(F.sum(F.col("value") * F.col("z")).alias("_k"))
        slope = adjoint.join(image, ["t", "node"]).agg(F.sum(F.col("z") * F.col("_k")).alias("s")).first().s or 0.0
        return loss, -2 * slope / n, w

    def fit(self, past: DataFrame) -> DataFrame:
        """past is (t, node, z) at the sensors."""
        observed, weights = checkpointed(past), {}

        def gradient(p: dict[str, float]) -> tuple[float, dict[str, float]]:
            diffusion = math.exp(p["log"])
            loss, slope, w = self.loss_and_slope(observed, diffusion)
            weights[p["log"]] = w
            return loss, {"log": slope * diffusion}

        found = search.descend({"log": (math.log(self.bounds[0]), math.log(self.bounds[1]))}, gradient, {"log": math.log(self.start)}, self.steps, close=1e-7)
        w = weights[found.best["log"]]
        rows = [("diffusion", math.exp(found.best["log"])), *zip(self.names, map(float, w), strict=False), (OFFSET, float(w[-1]) if self.offset else 0.0), ("loss", found.loss)]
        return past.sparkSession.createDataFrame(rows, TABLE)

    def predict(self, parameters: DataFrame, observed: DataFrame) -> DataFrame:
        """(t, node, estimate) at all nodes and the source's times, from the sensors (t, node, z) of the same times; without average they are not needed."""
        p = {r.term: r.value for r in parameters.collect()}  # a row for each source, and three
        total = sum((F.col(c) * p[c] for c in self.names), F.lit(p[OFFSET]))
        out = self.fields(p["diffusion"]).select("t", "node", total.alias("estimate"))
        if not self.average:
            return out
        mean = observed.where("z is not null").groupBy("t").agg(F.avg("z").alias("mean"))
        return out.join(mean, "t").select("t", "node", (F.col("estimate") + F.col("mean")).alias("estimate"))


def identity(matrix: DataFrame) -> DataFrame:
    """The identity over a tall matrix's nodes."""
    return matrix.select("i").distinct().select("i", F.col("i").alias("j"), F.lit(1.0).alias("value"))
