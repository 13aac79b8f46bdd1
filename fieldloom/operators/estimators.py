"""Estimators of a field at places without a sensor.

Contract: fit(past) learns from a panel (t, station, z) and gives a table of parameters with a column fold (the held-out
station); predict(parameters, panel) gives (fold, t, estimate) for all folds in one plan. Most estimators are linear in
the values of the other stations: their parameters are (fold, station, weight, centre, offset), and predict is a join
with a sum. Matrices over stations are aggregated by Spark and solved in numpy; stations are counted first.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import elimination, forest, linalg, perceptron, sparse, spectral
from . import panel as P
from .components import checkpointed

#: Stations whose matrices come to the driver.
MAX_STATIONS = 500
#: Nodes of a matrix that is inverted on the driver and broadcast.
SOLVE_NODES = 2_000
#: Nodes whose numbers are broadcast.
BROADCAST_NODES = 500_000
#: Patterns of missing stations whose weights a task of SnapshotBLUE keeps.
MAX_PATTERNS = 10_000
#: Stations whose sums are left out in turn on the driver; of which a task takes the sums at once.
HELD_STATIONS, LOSS_ROWS = 2_000, 5_000
#: Times of a panel whose values by station (14 MB for 60,000 and 30) are broadcast.
MAX_TIMES = 100
LINEAR = "fold string, station string, weight double, centre double, offset double"


def station_list(panel: DataFrame) -> list[str]:
    found = [r[0] for r in panel.select("station").distinct().orderBy("station").limit(MAX_STATIONS + 1).collect()]
    if len(found) > MAX_STATIONS:
        raise ValueError(f"more than {MAX_STATIONS} stations")
    return found


@dataclass
class Moments:
    """Means, deviations, correlations and mean products of stations, from one aggregate over pairs of stations at a time."""

    stations: list[str]
    mean: np.ndarray
    sd: np.ndarray
    variance: np.ndarray
    corr: np.ndarray
    product: np.ndarray  # mean of z_a * z_b over the times that both have
    count: np.ndarray


def moments(panel: DataFrame) -> Moments:
    names = station_list(panel)
    own = panel.where("z is not null")
    a, b = own.select("t", F.col("station").alias("a"), F.col("z").alias("x")), own.select("t", F.col("station").alias("b"), F.col("z").alias("y"))
    rows = a.join(b, "t").where("a <= b").groupBy("a", "b").agg(F.corr("x", "y").alias("c"), F.avg(F.col("x") * F.col("y")).alias("p"), F.count(F.lit(1)).alias("n"), F.avg("x").alias("m"), F.stddev_pop("x").alias("s"), F.var_samp("x").alias("v")).collect()
    k, at = len(names), {s: i for i, s in enumerate(names)}
    out = Moments(names, np.zeros(k), np.ones(k), np.ones(k), np.eye(k), np.zeros((k, k)), np.zeros((k, k)))
    for r in rows:
        i, j = at[r["a"]], at[r["b"]]
        c = r["c"] if r["c"] is not None and not math.isnan(r["c"]) else 0.0
        out.corr[i, j] = out.corr[j, i] = 1.0 if i == j else c
        out.product[i, j] = out.product[j, i] = r["p"]
        out.count[i, j] = out.count[j, i] = r["n"]
        if i == j:
            out.mean[i], out.sd[i], out.variance[i] = r["m"], r["s"] or 1.0, r["v"] or 1.0
    return out


def linear_table(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame([(f, s, float(w), float(c), float(o)) for f, s, w, c, o in rows], LINEAR)


def predict_linear(parameters: DataFrame, panel: DataFrame, missing: str = "null") -> DataFrame:
    """offset + sum weight * (z - centre) over the fold's stations.

    missing "null": no estimate where one of them has no value; "rescale": the sum over those that have, times their
    number over the number that have (the offset is not rescaled).
    """
    own = panel.where("z is not null").join(F.broadcast(parameters), "station")
    sums = own.groupBy("fold", "t").agg(F.sum(F.col("weight") * (F.col("z") - F.col("centre"))).alias("_s"), F.count(F.lit(1)).alias("_n"), F.first("offset").alias("_o"))
    sizes = parameters.groupBy("fold").agg(F.count(F.lit(1)).alias("_m"))
    out = sums.join(F.broadcast(sizes), "fold")
    estimate = F.when(F.col("_n") == F.col("_m"), F.col("_o") + F.col("_s")) if missing == "null" else F.col("_o") + F.col("_s") * F.col("_m") / F.col("_n")
    return out.select("fold", "t", estimate.alias("estimate"))


def with_truth(predictions: DataFrame, panel: DataFrame, model: str) -> DataFrame:
    """(model, station, t, estimate, truth) of the held-out stations."""
    truth = panel.select(F.col("station").alias("fold"), "t", F.col("z").alias("truth"))
    return predictions.join(truth, ["fold", "t"]).select(F.lit(model).alias("model"), F.col("fold").alias("station"), "t", "estimate", "truth")


class Estimator:
    """fit and predict; is_bound marks those that use the target's own past, so they bound what is possible."""

    is_bound = False

    def fit(self, past: DataFrame) -> DataFrame:
        raise NotImplementedError

    def predict(self, parameters: DataFrame, panel: DataFrame) -> DataFrame:
        return predict_linear(parameters, panel)

    def evaluate(self, past: DataFrame, future: DataFrame) -> DataFrame:
        return with_truth(self.predict(self.fit(past), future), future, type(self).__name__)


@dataclass
class SnapshotMean(Estimator):
    """Mean or median of the other stations at each time."""

    how: str = "mean"

    def fit(self, past: DataFrame) -> DataFrame:
        return past.select(F.col("station").alias("fold")).distinct()

    def predict(self, parameters: DataFrame, panel: DataFrame) -> DataFrame:
        if self.how == "mean":
            return P.leave_one_out_mean(panel).join(F.broadcast(parameters), F.col("station") == F.col("fold")).select("fold", "t", "estimate")
        others = P.leave_one_out_folds(panel, parameters.select(F.col("fold").alias("station")))
        return others.groupBy("fold", "t").agg(F.median("z").alias("estimate"))


@dataclass
class GlobalMean(Estimator):
    how: str = "mean"

    def fit(self, past: DataFrame) -> DataFrame:
        folds = P.leave_one_out_folds(past, past.select("station").distinct())
        return folds.groupBy("fold").agg((F.avg("z") if self.how == "mean" else F.median("z")).alias("estimate"))

    def predict(self, parameters: DataFrame, panel: DataFrame) -> DataFrame:
        return panel.select("t").distinct().join(F.broadcast(parameters)).select("fold", "t", "estimate")


@dataclass
class SnapshotQuantile(Estimator):
    """The median of the others' quantiles in their own past, read back in each one's past, averaged."""

    def fit(self, past: DataFrame) -> DataFrame:
        w = Window.partitionBy("station").orderBy("z", "t")
        return past.where("z is not null").select("station", "z", "t", (F.row_number().over(w) - 1).alias("k"), F.count(F.lit(1)).over(Window.partitionBy("station")).alias("n"))

    def predict(self, parameters: DataFrame, panel: DataFrame) -> DataFrame:
        ranks = P.past_quantile_rank(parameters.select("t", "station", "z"), panel)
        q = P.leave_one_out_folds(ranks, panel.select("station").distinct()).groupBy("fold", "t").agg(F.median("rank").alias("q"))
        sizes = parameters.select("station", "n").distinct()
        want = q.join(F.broadcast(sizes), F.col("fold") != F.col("station")).withColumn("at", F.col("q") * (F.col("n") - 1))
        ends = want.select("fold", "t", "station", "at", F.explode(F.array(F.floor("at"), F.ceil("at"))).alias("k"))
        values = ends.join(parameters.select("station", "k", "z"), ["station", "k"])
        weight = F.when(F.floor("at") == F.ceil("at"), 0.5).otherwise(1 - F.abs(F.col("at") - F.col("k")))
        return values.groupBy("fold", "t", "station").agg(F.sum(weight * F.col("z")).alias("z")).groupBy("fold", "t").agg(F.avg("z").alias("estimate"))


@dataclass
class SnapshotPCA(Estimator):
    """The others' values, standardised and rebuilt from n components, averaged: linear in the values."""

    n: int = 2

    def fit(self, past: DataFrame) -> DataFrame:
        m, rows = moments(past), []
        for k, fold in enumerate(m.stations):
            own = [i for i in range(len(m.stations)) if i != k]
            v = linalg.principal(m.corr[np.ix_(own, own)], self.n)
            w = (m.sd[own] @ (v @ v.T)) / m.sd[own] / len(own)
            rows += [(fold, m.stations[i], x, m.mean[i], m.mean[own].mean()) for i, x in zip(own, w, strict=True)]
        return linear_table(past.sparkSession, rows)


@dataclass
class SnapshotBLUE(Estimator):
    """Each of the others is predicted from the rest by ridge on correlations; the predictions are averaged.

    Times are grouped by which stations have a value: weights are solved once for each such pattern in a task.
    """

    alpha: float = 1.0

    def fit(self, past: DataFrame) -> DataFrame:
        m = moments(past)
        rows = [(a, b, float(m.corr[i, j]), float(m.mean[i]), float(m.sd[i])) for i, a in enumerate(m.stations) for j, b in enumerate(m.stations)]
        return past.sparkSession.createDataFrame(rows, "fold string, station string, corr double, mean double, sd double")

    def predict(self, parameters: DataFrame, panel: DataFrame) -> DataFrame:
        rows, alpha = parameters.orderBy("fold", "station").toPandas(), self.alpha  # stations squared, counted by fit
        own = rows.drop_duplicates("fold")
        at = {s: i for i, s in enumerate(own["fold"])}
        corr, mean, sd = rows["corr"].to_numpy().reshape(len(at), len(at)), own["mean"].to_numpy(), own["sd"].to_numpy()

        def run(frames):
            import pandas as pd

            solved: dict = {}
            for df in frames:
                out = []
                if len(solved) > MAX_PATTERNS:
                    solved.clear()
                for t, names, values in zip(df["t"], df["names"], df["values"], strict=True):
                    held = [(at[s], v) for s, v in zip(names, values, strict=True) if s in at]
                    for fold, f in at.items():
                        own = tuple(i for i, _ in held if i != f)
                        if len(own) < 2:
                            continue
                        if own not in solved:
                            c = corr[np.ix_(own, own)]
                            total = np.zeros(len(own))
                            for j, target in enumerate(own):
                                rest = [i for i in range(len(own)) if i != j]
                                total[rest] += linalg.ridge(c[np.ix_(rest, rest)], c[rest, j], alpha) * sd[target]
                            solved[own] = total / sd[list(own)] / len(own)
                        z = np.array([v for i, v in held if i != f])
                        out.append((fold, t, float(mean[list(own)].mean() + solved[own] @ (z - mean[list(own)]))))
                yield pd.DataFrame(out, columns=["fold", "t", "estimate"])

        rows = panel.where("z is not null").groupBy("t").agg(F.sort_array(F.collect_list(F.struct("station", "z"))).alias("r"))
        kind = panel.schema["t"].dataType.simpleString()
        return rows.select("t", F.col("r.station").alias("names"), F.col("r.z").alias("values")).mapInPandas(run, f"fold string, t {kind}, estimate double")


@dataclass
class SnapshotWeighted(Estimator):
    """Weights that regress the mean square error of the held-out station on the others, nonnegative or not, scaled up for missing ones."""

    positive: bool = True
    is_bound = True

    def fit(self, past: DataFrame) -> DataFrame:
        m, rows = moments(past), []
        for k, fold in enumerate(m.stations):
            own = [i for i in range(len(m.stations)) if i != k]
            gram, moment = m.product[np.ix_(own, own)], m.product[own, k]
            w = linalg.nonnegative(gram, moment) if self.positive else linalg.solve(gram, moment)
            rows += [(fold, m.stations[i], x, 0.0, 0.0) for i, x in zip(own, w, strict=True)]
        return linear_table(past.sparkSession, rows)

    def predict(self, parameters: DataFrame, panel: DataFrame) -> DataFrame:
        return predict_linear(parameters, panel, "rescale")


@dataclass
class InverseVariance(Estimator):
    """Others weighted by the inverse of their past variance, over those that have a value."""

    def fit(self, past: DataFrame) -> DataFrame:
        return past.groupBy("station").agg((1 / F.nullif(F.var_samp("z"), F.lit(0.0))).alias("weight")).where("weight is not null")

    def predict(self, parameters: DataFrame, panel: DataFrame) -> DataFrame:
        own = panel.where("z is not null").join(F.broadcast(parameters), "station")
        sums = own.groupBy("t").agg(F.sum(F.col("weight") * F.col("z")).alias("_a"), F.sum("weight").alias("_b"))
        less = own.select(F.col("station").alias("fold"), "t", "z", "weight").join(sums, "t")
        return less.select("fold", "t", ((F.col("_a") - F.col("weight") * F.col("z")) / F.nullif(F.col("_b") - F.col("weight"), F.lit(0.0))).alias("estimate"))


@dataclass
class BLUE(Estimator):
    """Best linear unbiased estimate from correlations with the target's own past: a bound, not a model."""

    distrust: float = 0.0
    is_bound = True

    def fit(self, past: DataFrame) -> DataFrame:
        m, rows = moments(past), []
        for k, fold in enumerate(m.stations):
            own = [i for i in range(len(m.stations)) if i != k]
            w = blue_weights(m.corr[np.ix_(own, own)], m.corr[own, k], self.distrust)
            rows += [(fold, m.stations[i], x, m.mean[i], m.mean[k]) for i, x in zip(own, w, strict=True)]
        return linear_table(past.sparkSession, rows)


def blue_weights(c: np.ndarray, target: np.ndarray, distrust=0.0) -> np.ndarray:
    return linalg.solve(c + np.diag(np.broadcast_to(distrust, len(c))), target)


def kriging_weights(d: np.ndarray, d_target: np.ndarray, kernel: Callable, delta: float, old: bool = False) -> np.ndarray:
    """Weights of stations at distances d among themselves and d_target from the target; they sum to 1 (not for the old form)."""
    k, g = kernel(d), kernel(d_target)
    if old:
        return np.linalg.lstsq(k + delta * np.eye(len(k)), g, rcond=None)[0]
    c = linalg.solve(k * (1 - delta) + delta * np.eye(len(k)), (1 - delta) * g)
    return c / c.sum()


@dataclass
class Kriging(Estimator):
    """z mean + sum of (z - z mean) * (c - 1 / m), c from a kernel of distances; null where a station has no value."""

    positions: dict[str, tuple[float, float]]
    kernel: Callable
    delta: float = 0.0
    old: bool = False

    def fit(self, past: DataFrame) -> DataFrame:
        names = [s for s in station_list(past) if s in self.positions]
        xy = np.array([self.positions[s] for s in names], dtype=float)
        rows = []
        for k, fold in enumerate(names):
            own = [i for i in range(len(names)) if i != k]
            d = np.sqrt(((xy[own][:, None] - xy[own][None]) ** 2).sum(-1))
            w = kriging_weights(d, np.sqrt(((xy[own] - xy[k]) ** 2).sum(-1)), self.kernel, self.delta, self.old)
            rows += [(fold, names[i], x, 0.0, 0.0) for i, x in zip(own, w, strict=True)]
        return linear_table(past.sparkSession, rows)


def fit_kernel(past: DataFrame, positions: DataFrame, kind: str = "gaussian") -> DataFrame:
    """(scale, delta) of a kernel from the regression of log correlation on distance (squared): one aggregate.

    gaussian: scale is sigma = sqrt(abs(1 / slope)); exponential: alpha = -slope; delta = 1 - exp(intercept) within 0..1.
    """
    pairs = P.correlations(past).where("corr > 0")
    a, b = positions.select(F.col("station").alias("a"), F.col("x").alias("_xa"), F.col("y").alias("_ya")), positions.select(F.col("station").alias("b"), F.col("x").alias("_xb"), F.col("y").alias("_yb"))
    d2 = F.pow(F.col("_xa") - F.col("_xb"), 2) + F.pow(F.col("_ya") - F.col("_yb"), 2)
    d = d2 if kind == "gaussian" else F.sqrt(d2)
    fit = pairs.join(a, "a").join(b, "b").agg(F.regr_slope(F.log("corr"), d).alias("_s"), F.regr_intercept(F.log("corr"), d).alias("_i"))
    scale = F.sqrt(F.abs(1 / F.nullif(F.col("_s"), F.lit(0.0)))) if kind == "gaussian" else -F.col("_s")
    return fit.select(scale.alias("scale"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.exp("_i"))).alias("delta"))


@dataclass
class DistanceModel(Estimator):
    """z mean + sum of (z - z mean) * w / sum w with w a kernel of the distance to the target: one plan, no solve."""

    positions: DataFrame
    kernel: Callable

    def fit(self, past: DataFrame) -> DataFrame:
        a = self.positions.select(F.col("station").alias("fold"), F.col("x").alias("_xa"), F.col("y").alias("_ya"))
        pairs = a.join(F.broadcast(self.positions), F.col("fold") != F.col("station"))
        d = F.sqrt(F.pow(F.col("x") - F.col("_xa"), 2) + F.pow(F.col("y") - F.col("_ya"), 2))
        return pairs.select("fold", "station", self.kernel(d).alias("weight"))

    def predict(self, parameters: DataFrame, panel: DataFrame) -> DataFrame:
        own = panel.where("z is not null").join(F.broadcast(parameters), "station")
        return own.groupBy("fold", "t").agg((F.sum(F.col("weight") * F.col("z")) / F.sum("weight")).alias("estimate"))


def kernel_losses(positions: DataFrame, panel: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """evaluate for search: the mean square error of each station's estimate by the others with weights exp(-rate * distance), for every candidate's rate in one plan."""
    pairs = checkpointed(_kernel_pairs(positions, panel))

    def evaluate(candidates: DataFrame) -> DataFrame:
        w = F.exp(-F.col("rate") * F.col("d"))
        own = pairs.join(F.broadcast(candidates)).groupBy("candidate", "fold", "t").agg((F.sum(w * F.col("z")) / F.sum(w)).alias("e"), F.first("truth").alias("truth"))
        return own.groupBy("candidate").agg(F.avg(F.pow(F.col("e") - F.col("truth"), 2)).alias("loss"))

    return evaluate


def kernel_gradient(positions: DataFrame, panel: DataFrame) -> Callable[[dict[str, float]], tuple[float, dict[str, float]]]:
    """The same loss and its slope in the rate, from one aggregate: d/drate of sum(w z) / sum(w) is (e * sum(d w) - sum(d w z)) / sum(w)."""
    pairs = checkpointed(_kernel_pairs(positions, panel))

    def gradient(at: dict[str, float]) -> tuple[float, dict[str, float]]:
        w, d, z = F.exp(-F.lit(at["rate"]) * F.col("d")), F.col("d"), F.col("z")
        own = pairs.groupBy("fold", "t").agg(F.sum(w).alias("s"), F.sum(w * z).alias("sz"), F.sum(d * w).alias("sd"), F.sum(d * w * z).alias("sdz"), F.first("truth").alias("truth"))
        e = F.col("sz") / F.col("s")
        out = own.agg(F.avg(F.pow(e - F.col("truth"), 2)).alias("f"), F.avg(2 * (e - F.col("truth")) * (e * F.col("sd") - F.col("sdz")) / F.col("s")).alias("g")).first()
        return out.f, {"rate": out.g}

    return gradient


def _kernel_pairs(positions: DataFrame, panel: DataFrame) -> DataFrame:
    """(fold, t, truth, z, d): each value with those of the other stations at its time, and their distance."""
    own = panel.where("z is not null").join(positions, "station")
    a = own.select("t", F.col("station").alias("fold"), F.col("z").alias("truth"), F.col("x").alias("_x"), F.col("y").alias("_y"))
    pairs = a.join(own, "t").where("fold <> station")
    return pairs.select("fold", "t", "truth", "z", F.sqrt(F.pow(F.col("x") - F.col("_x"), 2) + F.pow(F.col("y") - F.col("_y"), 2)).alias("d"))


@dataclass
class Regression(Estimator):
    """Regression of a value on features (t, station, f0, f1, ...): normal equations by one aggregate, solved small.

    kind: "linear", "positive", "ridge", "lasso", "positive_lasso" (the penalty by leave-one-station-out over a grid),
    "forest" (see forest; with a grid, numTrees and maxDepth by cross-validation over groups of stations) or "perceptron"
    (over all rows, see perceptron). degree expands features to all monomials. With residual, the value is taken less the
    mean of the others at its time, and the mean is added back. fit gives (term, weight, alpha) with the intercept under
    INTERCEPT, a forest's nodes or a perceptron's layers as rows; nothing is kept in the estimator.
    """

    features: DataFrame
    names: tuple[str, ...]
    kind: str = "lasso"
    degree: int = 1
    residual: bool = True
    alpha: float = 1.0
    grid: dict[str, tuple] = field(default_factory=dict)
    FOLDS, INTERCEPT = 5, "intercept"

    def _terms(self):
        terms = [t for t in linalg.polynomial_terms(len(self.names), self.degree) if t]
        return {f"_p{k}": math_product([F.col(self.names[i]) for i in t]) for k, t in enumerate(terms)}

    def _frame(self, panel: DataFrame) -> DataFrame:
        base = P.leave_one_out_mean(panel) if self.residual else panel.withColumn("estimate", F.lit(0.0))
        x = self.features.na.drop(subset=list(self.names)).withColumns(self._terms())
        return base.where("estimate is not null").join(x, ["t", "station"])

    def fit(self, past: DataFrame):
        terms, frame = list(self._terms()), self._frame(past.where("z is not null")).withColumn("_y", F.col("z") - F.col("estimate"))
        if self.kind == "forest":
            return self._forest(terms, frame)
        if self.kind == "perceptron":
            return past.sparkSession.createDataFrame(perceptron.fit(frame.select(*terms, "_y")).rows(), perceptron.TABLE)
        columns = [*terms, "_y"]
        sums = [F.sum(a).alias(f"s{i}") for i, a in enumerate(columns)] + [F.sum(F.col(a) * F.col(b)).alias(f"p{i}_{j}") for i, a in enumerate(columns) for j, b in enumerate(columns) if i <= j]
        names = ["n", *[f"s{i}" for i in range(len(columns))], *[f"p{i}_{j}" for i in range(len(columns)) for j in range(i, len(columns))]]
        by = frame.groupBy("station").agg(F.count(F.lit(1)).cast("double").alias("n"), *sums).drop("station")
        cross = self.kind in ("lasso", "positive_lasso")
        if cross:
            by = checkpointed(by)  # a row a station stays in the tasks
        total = by.agg(*[F.sum(c).alias(c) for c in names], F.count(F.lit(1)).alias("stations")).first()
        k, positive = len(terms), self.kind == "positive_lasso"
        n, s, q = _sums(np.array([[total[c] or 0.0 for c in names]], dtype=float), k + 1)
        with np.errstate(invalid="ignore"):  # without a row there are no weights
            mean, p = s[0] / n, q[0] - np.outer(s[0], s[0]) / n
        g, m, alpha = p[:k, :k], p[:k, k], self.alpha
        if cross and total["stations"] > 1:
            grid = linalg.lasso_grid(m, n[0], 30)
            alpha = float(grid[int(np.argmin(_left_out_losses(by, names, (n, s, q), grid, positive, total["stations"])))])
        w = {"linear": lambda: linalg.solve(g, m), "positive": lambda: linalg.nonnegative(g, m), "ridge": lambda: linalg.ridge(g, m, alpha)}.get(
            self.kind, lambda: linalg.lasso_each(g[None], m[None], n, alpha, positive)[0]
        )()
        b = mean[k] - w @ mean[:k]
        return past.sparkSession.createDataFrame([(c, float(x), float(alpha)) for c, x in [*zip(terms, w, strict=True), (self.INTERCEPT, b)]], "term string, weight double, alpha double")

    def _forest(self, terms: list[str], frame: DataFrame) -> DataFrame:
        spark, group = frame.sparkSession, F.lit(0)
        if self.grid:  # groups of stations, dealt in their order; by a hash where they are many
            names = [r[0] for r in frame.select("station").distinct().orderBy("station").limit(MAX_STATIONS + 1).collect()]
            if len(names) > MAX_STATIONS:
                group = F.pmod(F.xxhash64("station"), F.lit(self.FOLDS)).cast("int")
            else:
                group = F.element_at(F.create_map(*[F.lit(x) for k, n in enumerate(names) for x in (n, k % self.FOLDS)]), F.col("station"))
        rows = checkpointed(frame.select(F.xxhash64("t", "station").alias("_key"), "_y", group.alias("_group"), *terms))
        if rows.isEmpty():
            return spark.createDataFrame([(0, 1, -1, 0.0, 0.0)], forest.TABLE)
        return spark.createDataFrame(forest.fit(rows, terms, self.grid, folds=self.FOLDS).rows(), forest.TABLE)

    def predict(self, parameters, panel: DataFrame) -> DataFrame:
        frame = self._frame(panel)
        terms = list(self._terms())
        if self.kind in ("forest", "perceptron"):
            model = (forest.Trees if self.kind == "forest" else perceptron.Perceptron).of([tuple(r) for r in parameters.collect()])

            @F.pandas_udf("double")
            def apply(*xs):
                import pandas as pd

                return pd.Series(model.predict(np.column_stack([x.to_numpy() for x in xs])))

            out = frame.withColumn("_e", apply(*terms))
        else:
            out = with_weights(frame, parameters).withColumn("_e", weighted(terms))
        return out.select(F.col("station").alias("fold"), "t", (F.col("estimate") + F.col("_e")).alias("estimate"))


def _sums(rows: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts, sums and sums of products (upper triangle by rows) of width columns, from rows of them side by side."""
    i, j = np.triu_indices(width)
    q = np.empty((len(rows), width, width))
    q[:, i, j] = q[:, j, i] = rows[:, 1 + width :]
    return rows[:, 0], rows[:, 1 : 1 + width], q


def _left_out_losses(by: DataFrame, names: list[str], total: tuple[np.ndarray, np.ndarray, np.ndarray], grid: np.ndarray, positive: bool, stations: int) -> np.ndarray:
    """Square error at the stations by penalty, each with the weights of all others: its sums are what is left of the total.

    Up to HELD_STATIONS are added up on the driver; beyond, tasks add up LOSS_ROWS at a time and give a number a penalty.
    """

    def losses(rows: np.ndarray) -> np.ndarray:
        width = total[1].shape[1]
        k = width - 1
        own_n, own_s, own_q = _sums(rows, width)
        other_n, other_s = total[0] - own_n, total[1] - own_s
        own_n, own_s, own_q, other_n, other_s = (x[other_n > 0] for x in (own_n, own_s, own_q, other_n, other_s))
        mean = other_s / other_n[:, None]
        other_p = total[2] - own_q - other_s[:, :, None] * mean[:, None, :]
        out, w = np.zeros(len(grid)), None
        for at, a in enumerate(grid):
            w = linalg.lasso_each(other_p[:, :k, :k], other_p[:, :k, k], other_n, a, positive=positive, start=w)
            c, b = np.hstack([-w, np.ones((len(w), 1))]), mean[:, k] - (w * mean[:, :k]).sum(1)
            out[at] = (np.einsum("si,sij,sj->s", c, own_q, c) - 2 * b * (c * own_s).sum(1) + own_n * b * b).sum()
        return out

    if stations <= HELD_STATIONS:
        return losses(by.select(names).toPandas().to_numpy(dtype=float))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for a in range(0, batch.num_rows, LOSS_ROWS):
                own = batch.slice(a, LOSS_ROWS)
                found = losses(np.column_stack([own.column(c).to_numpy(zero_copy_only=False) for c in names]).astype(float))
                yield pa.RecordBatch.from_pydict({"at": np.arange(len(grid)), "loss": found})

    tasks = max(1, min(by.sparkSession.sparkContext.defaultParallelism * 4, stations // LOSS_ROWS + 1))
    found = by.repartition(tasks).mapInArrow(run, "at long, loss double").groupBy("at").agg(F.sum("loss").alias("loss")).collect()
    return np.array([r["loss"] for r in sorted(found)])


def with_weights(df: DataFrame, parameters: DataFrame) -> DataFrame:
    """df with a regression's weights as a map, from one broadcast row of as many entries as it has terms."""
    return df.join(F.broadcast(parameters.agg(F.map_from_entries(F.collect_list(F.struct("term", "weight"))).alias("_weights"))))


def weighted(terms: list[str], columns: list[str] | None = None):
    """Intercept and weighted sum of columns (named as the terms, if not given)."""
    w = F.col("_weights")
    return sum((F.col(c) * w[term] for term, c in zip(terms, columns or terms, strict=True)), w[Regression.INTERCEPT])


@dataclass
class ProjectedRegression(Estimator):
    """Regression on colours of a field (t, node, names) that are first projected on a basis (node, k, b), k from 0.

    Each colour is taken less its mean over time at the node (a missing node counts as 0), projected on the first size
    vectors and its mean added back. size None: the number from 1 to most with the least training error, the least of
    equals. A station is a node, its name the node's as text. The parameters are the regression's with a column size.
    """

    source: DataFrame
    basis: DataFrame
    names: tuple[str, ...]
    most: int = 6
    size: int | None = None
    kind: str = "ridge"

    def features(self, size: int) -> DataFrame:
        """(t, station, names) for all nodes of the basis and all times of the source."""
        zero = [F.coalesce(c, F.lit(0.0)).alias(c) for c in self.names]
        times = self.source.select("t").distinct()
        mean = self.source.groupBy("node").agg(*[F.sum(c).alias(f"_s_{c}") for c in self.names]).join(F.broadcast(times.agg(F.count(F.lit(1)).alias("_n"))))
        mean = mean.select("node", *[(F.col(f"_s_{c}") / F.col("_n")).alias(c) for c in self.names])
        basis = self.basis.where(F.col("k") < size)
        of_mean = mean.join(basis, "node").groupBy("k").agg(*[F.sum(F.col(c) * F.col("b")).alias(f"_m_{c}") for c in self.names])
        own = self.source.join(basis, "node").groupBy("t", "k").agg(*[F.sum(F.col(c) * F.col("b")).alias(c) for c in self.names])
        every = times.join(F.broadcast(of_mean)).join(own, ["t", "k"], "left").select("t", "k", *[(F.coalesce(c, F.lit(0.0)) - F.col(f"_m_{c}")).alias(c) for c in self.names])
        back = every.join(basis, "k").groupBy("t", "node").agg(*[F.sum(F.col(c) * F.col("b")).alias(f"_p_{c}") for c in self.names])
        out = back.join(mean.select("node", *zero), "node", "left")
        return out.select("t", F.col("node").cast("string").alias("station"), *[(F.col(f"_p_{c}") + F.coalesce(c, F.lit(0.0))).alias(c) for c in self.names])

    def _regression(self, size: int) -> Regression:
        return Regression(self.features(size), self.names, self.kind)

    def fit(self, past: DataFrame) -> DataFrame:
        best = None
        for size in range(1, self.most + 1) if self.size is None else [self.size]:
            own = self._regression(size)
            found = own.fit(past)
            error = 0.0
            if self.size is None:
                both = with_truth(own.predict(found, past), past, "").where("estimate is not null and truth is not null")
                error = both.agg(F.avg(F.pow(F.col("estimate") - F.col("truth"), 2))).first()[0]
            if best is None or error is not None and error < best[0]:
                best = (math.inf if error is None else error, found.withColumn("size", F.lit(size)))
        return best[1]

    def predict(self, parameters: DataFrame, panel: DataFrame) -> DataFrame:
        return self._regression(parameters.first()["size"]).predict(parameters.drop("size"), panel)


def math_product(columns: list):
    out = F.lit(1.0)
    for c in columns:
        out = out * c
    return out


def project(field: DataFrame, basis: DataFrame) -> DataFrame:
    """(t, node, z) of a field projected on orthonormal basis vectors (node, k, b): two joins with sums."""
    c = field.join(basis, "node").groupBy("t", "k").agg(F.sum(F.col("z") * F.col("b")).alias("c"))
    return c.join(basis, "k").groupBy("t", "node").agg(F.sum(F.col("c") * F.col("b")).alias("z"))


def basis_table(spark: SparkSession, nodes: list, vectors: np.ndarray) -> DataFrame:
    import pyarrow as pa

    n, k = vectors.shape
    return spark.createDataFrame(pa.table({"node": pa.array(nodes).take(pa.array(np.repeat(np.arange(n), k))), "k": np.tile(np.arange(k), n), "b": np.ascontiguousarray(vectors, dtype=float).ravel()}))


def laplacian_basis(matrix: DataFrame, k: int, which: str = "smallest") -> DataFrame:
    """(node, k, b): eigenvectors of a symmetric tall matrix of any size."""
    return spectral.eigenbasis(matrix, k, which)


def pca_basis(field: DataFrame, k: int) -> DataFrame:
    """(node, k, b): leading principal vectors over nodes of a field (t, node, z), never by a matrix of nodes by nodes."""
    return spectral.principal_vectors(field, k)[1]


def combined(terms: list[tuple[float, DataFrame]], identity: float = 0.0) -> DataFrame:
    """The tall matrix (i, j, value) of sum of c * M + identity * I."""
    rows = None
    for c, m in terms:
        own = m.select("i", "j", (F.col("value") * c).alias("value"))
        rows = own if rows is None else rows.unionByName(own)
    if identity:
        rows = rows.unionByName(rows.select("i").distinct().select("i", F.col("i").alias("j"), F.lit(float(identity)).alias("value")))
    return rows.groupBy("i", "j").agg(F.sum("value").alias("value"))


def solve_field(source: DataFrame, terms: list[tuple[float, DataFrame]], identity: float = 0.0) -> DataFrame:
    """(t, node, z) with (sum of c * M + identity * I) z = source for all times; the matrix is symmetric and positive.

    source is (t, node, z); a missing node counts as 0, a node outside the matrix is left out. A matrix of up to
    SOLVE_NODES nodes is inverted once, sent to the executors (32 MB at most) and applied to a time's nodes at a time;
    one of up to sparse.ENTRIES entries is sent as it is and solved in the tasks, which share out the times; a larger one
    stays a table, see conjugate_gradients.
    """
    matrix = checkpointed(combined(terms, identity))
    nodes = [r[0] for r in matrix.select("i").distinct().orderBy("i").limit(SOLVE_NODES + 1).collect()]
    if len(nodes) > SOLVE_NODES:
        held = sparse.hold(matrix)
        return conjugate_gradients(source, matrix) if held is None else sparse.solved(source, held)
    rows, place = matrix.toArrow().to_pydict(), {n: k for k, n in enumerate(nodes)}
    dense = np.zeros((len(nodes), len(nodes)))
    dense[[place[i] for i in rows["i"]], [place[j] for j in rows["j"]]] = rows["value"]
    held = source.sparkSession.sparkContext.broadcast((nodes, np.linalg.inv(dense)))
    kind = source.schema["t"].dataType.simpleString(), source.schema["node"].dataType.simpleString()

    def run(frames):
        import pandas as pd

        nodes, inverse = held.value
        place = {n: k for k, n in enumerate(nodes)}
        for df in frames:
            b = np.zeros((len(df), len(nodes)))
            for row, own in enumerate(df["own"]):
                for x in own:
                    if x["node"] in place:
                        b[row, place[x["node"]]] += x["z"]
            yield pd.DataFrame({"t": df["t"].repeat(len(nodes)), "node": np.tile(np.array(nodes), len(df)), "z": (b @ inverse).ravel()})

    by_time = source.where("z is not null").groupBy("t").agg(F.collect_list(F.struct("node", "z")).alias("own"))
    return by_time.mapInPandas(run, f"t {kind[0]}, node {kind[1]}, z double")


def conjugate_gradients(source: DataFrame, matrix: DataFrame, close: float = 1e-10, rounds: int = 1000, checkpoint_every: int = 5) -> DataFrame:
    """(t, node, z) with matrix z = source, for a symmetric positive tall matrix of any size, by diagonally scaled conjugate gradients.

    A step multiplies by the matrix (a join with a sum) for all times at once; a time's step lengths are sums over its
    nodes, so only one number a time is joined back. Steps end when every time's residual is close times its source, or
    after so many rounds (RuntimeError). Nothing but the times' count that are not done comes to the driver.
    """
    diagonal = matrix.where("i = j").select(F.col("i").alias("node"), F.col("value").alias("_d"))
    off = matrix.select(F.col("j").alias("node"), F.col("i").alias("_to"), "value")
    own = source.where("z is not null").groupBy("t", "node").agg(F.sum("z").alias("b"))
    every = own.select("t").distinct().join(diagonal).join(own, ["t", "node"], "left")
    b = F.coalesce("b", F.lit(0.0))
    now = every.select("t", "node", "_d", F.lit(0.0).alias("z"), b.alias("r"), (b / F.col("_d")).alias("p"))
    sizes = checkpointed(now.groupBy("t").agg(F.sum(F.col("r") * F.col("r")).alias("_size")))
    for k in range(1, rounds + 1):
        now = checkpointed(now) if k % checkpoint_every == 1 else now
        image = now.select("t", "node", "p").join(off, "node").groupBy("t", F.col("_to").alias("node")).agg(F.sum(F.col("value") * F.col("p")).alias("q"))
        both = checkpointed(now.join(image, ["t", "node"]))
        length = both.groupBy("t").agg(F.try_divide(F.sum(F.col("r") * F.col("r") / F.col("_d")), F.sum(F.col("p") * F.col("q"))).alias("_a"), F.sum(F.col("r") * F.col("r") / F.col("_d")).alias("_old"))
        a = F.coalesce("_a", F.lit(0.0))
        moved = both.join(length, "t").select("t", "node", "_d", "p", "_old", (F.col("z") + a * F.col("p")).alias("z"), (F.col("r") - a * F.col("q")).alias("r"))
        moved = checkpointed(moved)
        left = moved.groupBy("t").agg(F.sum(F.col("r") * F.col("r")).alias("_left"), F.sum(F.col("r") * F.col("r") / F.col("_d")).alias("_new"))
        if left.join(sizes, "t").where(F.col("_left") > close * close * F.col("_size")).isEmpty():
            return moved.select("t", "node", "z")
        turn = F.coalesce(F.try_divide("_new", "_old"), F.lit(0.0))
        now = moved.join(left, "t").select("t", "node", "_d", "z", "r", (F.col("r") / F.col("_d") + turn * F.col("p")).alias("p"))
    raise RuntimeError(f"not solved after {rounds} steps")


def resistances(laplacian: DataFrame, at: list | None = None) -> DataFrame:
    """(a, b, r) for a > b: resistance distances between nodes (of at, e.g. stations, or all) of a connected tall Laplacian.

    With the least node grounded the Laplacian is positive, and a unit current into a node gives the potentials g(node, .)
    of all: r(a, b) = g(a, a) + g(b, b) - 2 g(a, b). One solve a node asked for, all of them at once by solve_field, so
    nodes have no limit; of the potentials, those at the nodes asked for with b up to a are kept. A node that the matrix
    lacks is left out. A matrix that leaves a small rest when it is eliminated is solved without steps, see elimination.
    """
    matrix = checkpointed(laplacian)
    nodes = matrix.select(F.col("i").alias("node")).distinct()
    wanted = nodes if at is None else nodes.where(F.col("node").isin(list(at)))
    found = _eliminated(matrix)
    if found is not None:
        kind = matrix.schema["i"].dataType.simpleString()
        return elimination.resistances(found, np.sort(wanted.toArrow().column(0).to_numpy()), matrix.sparkSession, kind)
    return _resistances(matrix, checkpointed(wanted), checkpointed(nodes.agg(F.min("node").alias("node"))))


def _eliminated(matrix: DataFrame) -> elimination.Eliminated | None:
    """The Laplacian without its least node, eliminated."""
    ground = matrix.agg(F.min("i")).first()[0]
    held = sparse.hold(checkpointed(combined([(1.0, matrix.where((F.col("i") != ground) & (F.col("j") != ground)))])))
    return None if held is None else elimination.eliminate(held)


def resistances_and_correlations(laplacian: DataFrame, panel: DataFrame, least: int = 2) -> DataFrame:
    """(a, b, r, corr, n) for a > b: nodes of a connected tall Laplacian that are stations of a panel (t, station, z), with least common times.

    The panel has a row a time and station and few times. In one pass where the Laplacian can be eliminated; else resistances and correlations are joined.
    """
    matrix = checkpointed(laplacian)
    own = checkpointed(panel.where("z is not null").join(matrix.select(F.col("i").alias("station")).distinct(), "station", "left_semi"))
    times = own.select("t").distinct()
    found = _eliminated(matrix) if times.limit(MAX_TIMES + 1).count() <= MAX_TIMES else None
    if found is None:
        c = P.correlations(own, least).select(F.col("b").alias("a"), F.col("a").alias("b"), "corr", "n")
        return resistances(matrix).join(c, ["a", "b"])
    table = own.select("t", "station", "z").toArrow()
    t, station, z = (table.column(c).to_numpy() for c in ("t", "station", "z"))
    nodes, row = np.unique(station, return_inverse=True)
    days, column = np.unique(t, return_inverse=True)
    values = np.full((len(nodes), len(days)), np.nan)
    values[row, column] = z
    return elimination.resistances(found, nodes, matrix.sparkSession, matrix.schema["i"].dataType.simpleString(), values, least)


def _resistances(matrix: DataFrame, wanted: DataFrame, ground: DataFrame) -> DataFrame:
    inner = matrix.join(F.broadcast(ground), matrix["i"] == ground["node"], "left_anti").join(F.broadcast(ground), F.col("j") == ground["node"], "left_anti")
    currents = wanted.join(F.broadcast(ground), "node", "left_anti").select(F.col("node").alias("t"), "node", F.lit(1.0).alias("z"))
    inner = checkpointed(combined([(1.0, inner)]))
    held = sparse.hold(inner) if inner.select("i").distinct().limit(SOLVE_NODES + 1).count() > SOLVE_NODES else None
    g = solve_field(currents, [(1.0, inner)]).where("node <= t") if held is None else sparse.solved(currents, held, lower=True)
    if wanted.count() <= BROADCAST_NODES:
        wanted = F.broadcast(wanted)
    g = checkpointed(g.join(wanted, "node", "left_semi").select(F.col("t").alias("a"), F.col("node").alias("b"), "z"))
    own = checkpointed(g.where("a = b").select(F.col("a").alias("node"), F.col("z").alias("_g")))
    if own.count() <= BROADCAST_NODES:
        own = F.broadcast(own)
    pairs = g.where("a > b").join(own.select(F.col("node").alias("a"), F.col("_g").alias("_a")), "a").join(own.select(F.col("node").alias("b"), F.col("_g").alias("_b")), "b")
    # the ground has potential 0 in all, and is the least node
    first = wanted.join(F.broadcast(ground), "node").select(F.col("node").alias("b"))
    to_ground = own.select(F.col("node").alias("a"), F.col("_g").alias("r")).join(F.broadcast(first))
    return pairs.select("a", "b", (F.col("_a") + F.col("_b") - 2 * F.col("z")).alias("r")).unionByName(to_ground.select("a", "b", "r"))


def edge_resistances(edges: DataFrame, weight, sketches: int = 400, seed: int = 7) -> DataFrame:
    """(u, v, r): the resistance between the ends of each edge, from so many random currents instead of a solve a node.

    Each current puts a hashed sign times the root of an edge's weight on its two ends; the mean square of the potentials'
    differences is the resistance, with a relative deviation of about sqrt(2 / sketches). Edges are those of one connected graph.
    """
    own = checkpointed(edges.select("u", "v", weight.cast("double").alias("w")))
    signs = own.select("u", "v", F.sqrt("w").alias("s"), F.explode(F.sequence(F.lit(0), F.lit(sketches - 1))).alias("t"))
    signs = signs.select("t", "u", "v", F.when(F.xxhash64("u", "v", "t", F.lit(seed)) > 0, F.col("s")).otherwise(-F.col("s")).alias("s"))
    currents = signs.select("t", F.explode(F.array(F.struct(F.col("u").alias("node"), F.col("s").alias("z")), F.struct(F.col("v").alias("node"), (-F.col("s")).alias("z")))).alias("_e")).groupBy("t", "_e.node").agg(F.sum("_e.z").alias("z"))
    both = own.unionByName(own.select(F.col("v").alias("u"), F.col("u").alias("v"), "w"))
    off = both.select(F.col("u").alias("i"), F.col("v").alias("j"), (-F.col("w")).alias("value"))
    laplacian = checkpointed(off.unionByName(both.groupBy(F.col("u").alias("i")).agg(F.sum("w").alias("value")).select("i", F.col("i").alias("j"), "value")))
    ground = checkpointed(laplacian.agg(F.min("i").alias("node")))
    inner = laplacian.join(F.broadcast(ground), F.col("i") == F.col("node"), "left_anti").join(F.broadcast(ground), F.col("j") == F.col("node"), "left_anti")
    z = checkpointed(solve_field(currents.join(F.broadcast(ground), "node", "left_anti"), [(1.0, inner)]))
    ends = own.select("u", "v", F.explode(F.sequence(F.lit(0), F.lit(sketches - 1))).alias("t"))
    at = lambda name: z.select("t", F.col("node").alias(name), F.col("z").alias(f"_{name}"))
    d = F.coalesce("_u", F.lit(0.0)) - F.coalesce("_v", F.lit(0.0))
    return ends.join(at("u"), ["t", "u"], "left").join(at("v"), ["t", "v"], "left").groupBy("u", "v").agg((F.sum(d * d) / sketches).alias("r"))


def screened_poisson(source: DataFrame, diffusion_matrix: DataFrame, mass: DataFrame, diffusion: float, absorption: float) -> DataFrame:
    return solve_field(source, [(diffusion, diffusion_matrix), (absorption, mass)])


def soft_diffusion(source: DataFrame, laplacian: DataFrame, alpha: float, beta: float) -> DataFrame:
    """(beta * L + alpha * I) z = source."""
    return solve_field(source, [(beta, laplacian)], alpha)


def assimilate(source: DataFrame, observed: DataFrame, basis: DataFrame, reduced: np.ndarray, alpha: float, delta: float) -> DataFrame:
    """Reduced-basis assimilation: (alpha * A + (1 - alpha) * Bz'Bz) c = alpha * B' source + (1 - alpha) * Bz' z; delta * B c + source.

    A is the reduced operator (k by k), Bz the basis at the observed nodes; k is small, so each time's solve is one row.
    """
    k = len(reduced)
    seen = observed.where("z is not null").select("t", "node", F.col("z").alias("_z")).join(basis, "node")
    both = seen.alias("a").join(seen.alias("b"), ["t", "node"]).groupBy("t", F.col("a.k").alias("i"), F.col("b.k").alias("j")).agg(F.sum(F.col("a.b") * F.col("b.b")).alias("v"))
    gram = both.groupBy("t").agg(F.collect_list(F.struct("i", "j", "v")).alias("gram"))
    moment = seen.groupBy("t", "k").agg(F.sum(F.col("_z") * F.col("b")).alias("m"))
    src = source.join(basis, "node").groupBy("t", "k").agg(F.sum(F.col("z") * F.col("b")).alias("s"))
    right = src.join(moment, ["t", "k"], "full").groupBy("t").agg(F.collect_list(F.struct("k", (alpha * F.coalesce("s", F.lit(0.0)) + (1 - alpha) * F.coalesce("m", F.lit(0.0))).alias("v"))).alias("right"))

    def run(frames):
        import pandas as pd

        for df in frames:
            out = []
            for t, g, r in zip(df["t"], df["gram"], df["right"], strict=True):
                a, b = alpha * reduced, np.zeros(k)
                a = a.copy()
                for x in g if g is not None else ():
                    a[x["i"], x["j"]] += (1 - alpha) * x["v"]
                for x in r:
                    b[x["k"]] += x["v"]
                out += [(t, i, float(v)) for i, v in enumerate(linalg.solve(a, b))]
            yield pd.DataFrame(out, columns=["t", "k", "c"])

    kind = source.schema["t"].dataType.simpleString()
    c = right.join(gram, "t", "left").select("t", "gram", "right").mapInPandas(run, f"t {kind}, k long, c double")
    field = c.join(basis, "k").groupBy("t", "node").agg(F.sum(F.col("c") * F.col("b")).alias("_f"))
    return field.join(source, ["t", "node"], "left").select("t", "node", (delta * F.col("_f") + F.coalesce("z", F.lit(0.0))).alias("z"))


@dataclass
class Sequence(Estimator):
    """Residual boosting: each estimator is fitted to what those before it leave; estimates are added.

    transition puts a straight line through each step's estimates before they are added and taken off: fitted, over the
    stations left out in the past, to what was left before the step ("left") or to the values themselves ("values"). A step
    that estimates the same everywhere gets the mean. The parameters are a list: a step's, then its line (slope, intercept).
    """

    steps: list[Estimator] = field(default_factory=list)
    transition: str | None = None

    def _line(self, own: DataFrame) -> DataFrame:
        """(slope, intercept) of own (_y on _e), one row."""
        if self.transition is None:
            return own.sparkSession.createDataFrame([(1.0, 0.0)], "slope double, intercept double")
        both = own.where("_e is not null and _y is not null")
        line = both.agg(F.regr_slope("_y", "_e").alias("slope"), F.regr_intercept("_y", "_e").alias("intercept"), F.avg("_y").alias("_m"))
        flat = F.col("slope").isNull() | F.isnan("slope")
        return checkpointed(line.select(F.when(flat, 0.0).otherwise(F.col("slope")).alias("slope"), F.when(flat, F.coalesce("_m", F.lit(0.0))).otherwise(F.col("intercept")).alias("intercept")))

    def _apply(self, e: Estimator, p, line: DataFrame, now: DataFrame) -> DataFrame:
        """(station, t, _e) of a step on what is left now, along its line (one row)."""
        own = e.predict(p, now).join(F.broadcast(line))
        return own.select(F.col("fold").alias("station"), "t", (F.col("intercept") + F.col("slope") * F.col("estimate")).alias("_e"))

    def fit(self, past: DataFrame) -> list:
        out, now = [], past
        for e in self.steps:
            p = e.fit(now)
            against = past if self.transition == "values" else now
            seen = e.predict(p, now).select(F.col("fold").alias("station"), "t", F.col("estimate").alias("_e")).join(against.select("station", "t", F.col("z").alias("_y")), ["station", "t"])
            line = self._line(seen)
            out += [p, line]
            now = now.join(self._apply(e, p, line, now), ["station", "t"], "left").select("t", "station", (F.col("z") - F.coalesce("_e", F.lit(0.0))).alias("z"))
        return out

    def predict(self, parameters: list, panel: DataFrame) -> DataFrame:
        total, now = None, panel
        for e, p, line in zip(self.steps, parameters[::2], parameters[1::2], strict=True):
            own = self._apply(e, p, line, now)
            step = own.withColumnRenamed("station", "fold")
            total = step.withColumnRenamed("_e", "estimate") if total is None else total.join(step, ["fold", "t"], "left").select("fold", "t", (F.col("estimate") + F.coalesce("_e", F.lit(0.0))).alias("estimate"))
            now = now.join(own, ["station", "t"], "left").select("t", "station", (F.col("z") - F.coalesce("_e", F.lit(0.0))).alias("z"))
        return total


def stacked(predictions: DataFrame) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Models, covariance of their errors, X'X and X'y of their predictions, from one pair aggregate over (model, station, t)."""
    own = predictions.where("estimate is not null and truth is not null")
    names = [r[0] for r in own.select("model").distinct().orderBy("model").collect()]
    a = own.select("station", "t", F.col("model").alias("a"), F.col("estimate").alias("x"), "truth")
    b = own.select("station", "t", F.col("model").alias("b"), F.col("estimate").alias("y"))
    e, f = F.col("x") - F.col("truth"), F.col("y") - F.col("truth")
    rows = a.join(b, ["station", "t"]).groupBy("a", "b").agg(F.avg(e * f).alias("e"), F.sum(F.col("x") * F.col("y")).alias("g"), F.sum(F.col("x") * F.col("truth")).alias("m")).collect()
    at, k = {s: i for i, s in enumerate(names)}, len(names)
    cov, gram, moment = np.zeros((k, k)), np.zeros((k, k)), np.zeros(k)
    for r in rows:
        cov[at[r["a"]], at[r["b"]]], gram[at[r["a"]], at[r["b"]]] = r["e"], r["g"]
        if r["a"] == r["b"]:
            moment[at[r["a"]]] = r["m"]
    return names, cov, gram, moment


def ensemble_weights(predictions: DataFrame, how: str = "average") -> dict[str, float]:
    """Weights of models: average, mse (inverse mean square error), std (inverse deviation), blue (least error variance), regression (nonnegative); they sum to 1 but for regression."""
    names, cov, gram, moment = stacked(predictions)
    return _solved(names, cov, gram, moment, how)


def _solved(names: list[str], cov: np.ndarray, gram: np.ndarray, moment: np.ndarray, how: str) -> dict[str, float]:
    mse = np.maximum(np.diag(cov), 1e-12)
    w = {"average": lambda: np.ones(len(names)), "mse": lambda: 1 / mse, "std": lambda: mse**-0.5, "blue": lambda: linalg.simplex_weights(cov), "regression": lambda: linalg.nonnegative(gram, moment)}[how]()
    return dict(zip(names, (w if how == "regression" else w / w.sum()).tolist(), strict=True))


def ensemble(predictions: DataFrame, weights: dict[str, float], name: str = "ensemble") -> DataFrame:
    """Weighted sum of the models' estimates by (station, t); null where a model has none."""
    w = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])
    sums = predictions.where(F.col("model").isin(list(weights))).groupBy("station", "t").agg(F.sum(w[F.col("model")] * F.col("estimate")).alias("estimate"), F.count("estimate").alias("_n"), F.max("truth").alias("truth"))
    return sums.select(F.lit(name).alias("model"), "station", "t", F.when(F.col("_n") == len(weights), F.col("estimate")).alias("estimate"), "truth")


def nested_ensemble(predictions: DataFrame, how: str = "mse") -> DataFrame:
    """For each held-out station, weights from the other stations' predictions: all stations' from one aggregate, less their own, solved fold by fold."""
    own = predictions.where("estimate is not null and truth is not null")
    a = own.select("station", "t", F.col("model").alias("a"), F.col("estimate").alias("x"), "truth")
    b = own.select("station", "t", F.col("model").alias("b"), F.col("estimate").alias("y"))
    e, f = F.col("x") - F.col("truth"), F.col("y") - F.col("truth")
    sums = {"n": F.count(F.lit(1)), "e": F.sum(e * f), "g": F.sum(F.col("x") * F.col("y")), "m": F.sum(F.col("x") * F.col("truth"))}
    each = checkpointed(a.join(b, ["station", "t"]).groupBy("station", "a", "b").agg(*[c.alias(k) for k, c in sums.items()]))
    total = each.groupBy("a", "b").agg(*[F.sum(k).alias(f"_{k}") for k in sums])
    folds = predictions.where("station is not null").select("station").distinct().crossJoin(F.broadcast(total)).join(each, ["station", "a", "b"], "left")
    others = folds.select("station", "a", "b", *[(F.col(f"_{k}") - F.coalesce(k, F.lit(0))).alias(k) for k in sums]).where("n > 0")

    def solve(rows):
        import pandas as pd

        names = sorted(set(rows["a"]))
        at, k = {s: i for i, s in enumerate(names)}, len(names)
        cov, gram, moment = np.zeros((k, k)), np.zeros((k, k)), np.zeros(k)
        for r in rows.itertuples():
            cov[at[r.a], at[r.b]], gram[at[r.a], at[r.b]] = r.e / r.n, r.g
            if r.a == r.b:
                moment[at[r.a]] = r.m
        w = _solved(names, cov, gram, moment, how)
        return pd.DataFrame({"station": rows["station"].iloc[0], "model": list(w), "_w": list(w.values()), "_models": k})

    kind = predictions.schema["station"].dataType.simpleString()
    weights = others.groupBy("station").applyInPandas(solve, f"station {kind}, model string, _w double, _models long")
    out = predictions.join(weights, ["station", "model"]).groupBy("station", "t").agg(F.sum(F.col("_w") * F.col("estimate")).alias("estimate"), F.count("estimate").alias("_n"), F.max("_models").alias("_models"), F.max("truth").alias("truth"))
    return out.select(F.lit("ensemble").alias("model"), "station", "t", F.when(F.col("_n") == F.col("_models"), F.col("estimate")).alias("estimate"), "truth")


def blend(near: DataFrame, far: DataFrame, distances: DataFrame, sigma: float, form: str = "scale") -> DataFrame:
    """near * w + far * (1 - w) with w = exp(-d / sigma) ("scale") or exp(-sigma * d) ("rate"), d to the nearest sensor (station, d)."""
    d = F.col("d")
    w = F.exp(-d / sigma) if form == "scale" else F.exp(-sigma * d)
    both = near.select("station", "t", F.col("estimate").alias("_a"), "truth").join(far.select("station", "t", F.col("estimate").alias("_b")), ["station", "t"]).join(F.broadcast(distances), "station")
    return both.select(F.lit("blend").alias("model"), "station", "t", (w * F.col("_a") + (1 - w) * F.col("_b")).alias("estimate"), "truth")
