"""Queries of the estimators over the driver's tables; those that SQL can say have their SQL."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import estimators as E
from ..operators import evaluate, graph, physics, runs, search, spatial, spectral, traffic
from ..operators import panel as P
from ..operators.components import checkpointed, shared_folder
from . import solved as Q
from .bindings import Tables, with_tables
from .catalog import CORR, HOPS, query, r6

CUT = 473712  # past and future of the hourly panel: 15 of its 30 days


def _split(x: Tables) -> tuple[DataFrame, DataFrame]:
    p = x.sparse()
    return p.where(F.col("t") < CUT), p.where(F.col("t") >= CUT)


def _scores(predictions: DataFrame) -> DataFrame:
    m = evaluate.metrics(predictions)
    return m.select("model", "station", *[r6(c, c) for c in ("rmse", "mb", "cor", "coe")], "n")


def _xy(x: Tables) -> dict[str, tuple[float, float]]:
    return {r.station: (r.x, r.y) for r in x.positions().collect()}


@query("global_mean_loo", "select f.station, round(avg(p.z), 6) estimate from (select distinct station from sparse) f join sparse p on p.station <> f.station group by 1", ("sparse",))
def global_mean_loo(x: Tables) -> DataFrame:
    return E.GlobalMean().fit(x.sparse()).select(F.col("fold").alias("station"), r6("estimate", "estimate"))


@query("snapshot_quantile", Q.quantile(CUT), ("sparse",))
def snapshot_quantile(x: Tables) -> DataFrame:
    return _scores(E.SnapshotQuantile().evaluate(*_split(x)))


@query("snapshot_pca")
def snapshot_pca(x: Tables) -> DataFrame:
    return _scores(E.SnapshotPCA(2).evaluate(*_split(x)))


@query("snapshot_blue")
def snapshot_blue(x: Tables) -> DataFrame:
    return _scores(E.SnapshotBLUE().evaluate(*_split(x)))


@query("nnls_weights", f"{Q.snapshot_weights(CUT)} select fold, station, round(w, 6) + 0.0 weight from weights", ("sparse",))
def nnls_weights(x: Tables) -> DataFrame:
    return E.SnapshotWeighted(True).fit(_split(x)[0]).select("fold", "station", r6("weight", "weight"))


@query("snapshot_weighted", Q.snapshot_weighted(CUT), ("sparse",))
def snapshot_weighted(x: Tables) -> DataFrame:
    return _scores(E.SnapshotWeighted(True).evaluate(*_split(x)))


@query(
    "snapshot_invvar_scores",
    f"""select 'InverseVariance' model, station, round(sqrt(avg(power(e - z, 2))), 6) rmse, round(avg(e - z), 6) mb, round(corr(e, z), 6) cor, round(1 - sum(abs(e - z)) / sum(abs(z - m)), 6) coe, count(*) n from (
        select *, avg(z) over (partition by station) m from (
        select a.station, a.t, a.z, sum(w * b.z) / sum(w) e from sparse a join sparse b on a.t = b.t and a.station <> b.station
        join (select station, 1 / var_samp(z) w from sparse where t < {CUT} group by 1) v on v.station = b.station where a.t >= {CUT} group by 1, 2, 3)) group by station""",
    ("sparse",),
)
def snapshot_invvar_scores(x: Tables) -> DataFrame:
    return _scores(E.InverseVariance().evaluate(*_split(x)))


@query("blue", Q.blue(CUT, 0.1), ("sparse",))
def blue(x: Tables) -> DataFrame:
    return _scores(E.BLUE(0.1).evaluate(*_split(x)))


@query(
    "blue_two_stations",
    f"""{with_tables('panel')}, c as (select corr(a.z, b.z) c, avg(a.z) ma, avg(b.z) mb from panel a join panel b using (t) where a.station = 'click' and b.station = 'view' and t < {CUT})
    select p.t, round(c.mb + c.c / 1.1 * (p.z - m.m), 6) estimate from panel p, c, (select avg(z) m from panel where station = 'click' and t < {CUT}) m where p.station = 'click' and p.t >= {CUT}""".replace("c.mb +", "(select avg(z) from panel where station = 'view' and t < " + str(CUT) + ") +"),
)
def blue_two_stations(x: Tables) -> DataFrame:
    p = x.panel().where("station in ('click', 'view')")
    e = E.BLUE(0.1)
    out = e.predict(e.fit(p.where(F.col("t") < CUT)), p.where(F.col("t") >= CUT))
    return out.where("fold = 'view'").select("t", r6("estimate", "estimate"))


@query("kriging_exponential", Q.kriging(CUT, "exp(-5 * d)", 0.1), ("sparse", "positions"))
def kriging_exponential(x: Tables) -> DataFrame:
    return _scores(E.Kriging(_xy(x), lambda d: np.exp(-5 * d), 0.1).evaluate(*_split(x)))


@query("kriging_gaussian", Q.kriging(CUT, "exp(-d * d / (2 * power(0.2, 2)))", 0.1), ("sparse", "positions"))
def kriging_gaussian(x: Tables) -> DataFrame:
    return _scores(E.Kriging(_xy(x), lambda d: np.exp(-d * d / (2 * 0.2**2)), 0.1).evaluate(*_split(x)))


@query("kriging_old_form", Q.kriging(CUT, "exp(-5 * d)", 0.1, old=True), ("sparse", "positions"))
def kriging_old_form(x: Tables) -> DataFrame:
    return _scores(E.Kriging(_xy(x), lambda d: np.exp(-5 * d), 0.1, old=True).evaluate(*_split(x)))


@query(
    "kriging_two_stations",
    f"""{with_tables('sparse', 'positions')}, d as (select sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2)) dab, sqrt(power(a.x - c.x, 2) + power(a.y - c.y, 2)) dac, sqrt(power(b.x - c.x, 2) + power(b.y - c.y, 2)) dbc from positions a, positions b, positions c where a.station = 's0' and b.station = 's1' and c.station = 's2'),
    g as (select 0.9 * exp(-5 * dac) ga, 0.9 * exp(-5 * dbc) gb, 0.9 * exp(-5 * dab) k from d), w as (select (ga - k * gb) / ((ga - k * gb) + (gb - k * ga)) wa from g)
    select p.t, round(wa * p.z + (1 - wa) * q.z, 6) estimate from sparse p join sparse q using (t), w where p.station = 's0' and q.station = 's1'""",
)
def kriging_two_stations(x: Tables) -> DataFrame:
    p = x.sparse().where("station in ('s0', 's1', 's2')")
    e = E.Kriging(_xy(x), lambda d: np.exp(-5 * d), 0.1)
    return e.predict(e.fit(p), p).where("fold = 's2' and estimate is not null").select("t", r6("estimate", "estimate"))


@query("kernel_fit_exponential", f"select round(-s, 6) scale, round(greatest(0, least(1, 1 - exp(i))), 6) delta from (select regr_slope(ln(c), d) s, regr_intercept(ln(c), d) i from (select c, sqrt(power(p.x - q.x, 2) + power(p.y - q.y, 2)) d from ({CORR.format('sparse')}) join positions p on p.station = a join positions q on q.station = b where c > 0))", ("sparse", "positions"))
def kernel_fit_exponential(x: Tables) -> DataFrame:
    return E.fit_kernel(x.sparse(), x.positions(), "exponential").select(r6("scale", "scale"), r6("delta", "delta"))


SCORES = "round(sqrt(avg(power(e - z, 2))), 6) rmse, round(avg(e - z), 6) mb, round(corr(e, z), 6) cor, round(1 - sum(abs(e - z)) / sum(abs(z - m)), 6) coe, count(*) n"


@query("cosine_scores", f"select 'cosine' model, station, {SCORES} from (select station, z, 20 + 5 * cos((t - 473352) * 2 * pi() / 24) e, avg(z) over (partition by station) m from panel) group by station", ("panel",))
def cosine_scores(x: Tables) -> DataFrame:
    p = x.panel().select(F.lit("cosine").alias("model"), "station", "t", (20 + S.cosine_wave(F.col("t"), 473352, 5, 24, 0)).alias("estimate"), F.col("z").alias("truth"))
    return _scores(p)


def _features(x: Tables) -> DataFrame:
    """(t, station, f0..f3): colours of the pixels of a station's users at the hour, as shares; 0 without any."""
    p = x.pixels().withColumn("station", F.concat(F.lit("s"), (F.col("pixel") % 10).cast("string")))
    n = F.count(F.lit(1))
    return p.groupBy("t", "station").agg(*[(F.count_if(F.col("colour") == k + 1) / n).alias(f"f{k}") for k in range(4)])


NAMES = tuple(f"f{k}" for k in range(4))


def _regression(kind: str, degree: int = 1):
    return lambda x: _scores(E.Regression(_features(x), NAMES, kind, degree).evaluate(*_split(x)))


for _name, _kind, _degree in (("source_lasso", "lasso", 1), ("source_poly_lasso", "lasso", 2), ("source_random_forest", "forest", 1), ("source_perceptron", "perceptron", 1)):
    query(_name)(_regression(_kind, _degree))
for _kind, _sql in (("linear", Q.regression(CUT)), ("positive", Q.regression(CUT, positive=True)), ("ridge", Q.regression(CUT, alpha=1.0))):
    query(f"source_{_kind}", _sql, ("sparse", "pixels"))(_regression(_kind))


@query("traffic_mean_fit", "select round(regr_slope(z, active), 6) slope, round(regr_intercept(z, active), 6) intercept from panel join (select t, count(*) active from pixels where colour > 0 group by 1) using (t)", ("panel", "pixels"))
def traffic_mean_fit(x: Tables) -> DataFrame:
    features = x.panel().select("station", "t").join(traffic.activity(x.pixels()), "t").withColumn("f0", F.col("active").cast("double"))
    e = E.Regression(features.select("t", "station", "f0"), ("f0",), "linear", residual=False)
    return e.fit(x.panel()).agg(*[r6(F.max(F.when(F.col("term") == term, F.col("weight"))), name) for term, name in (("_p0", "slope"), (e.INTERCEPT, "intercept"))])


@query("traffic_mean_colours", Q.traffic_mean(CUT), ("sparse", "pixels"))
def traffic_mean_colours(x: Tables) -> DataFrame:
    """A regression on the whole map's colours at the time: every station gets the same estimate."""
    counts = x.pixels().groupBy("t").agg(*[F.count_if(F.col("colour") == k + 1).cast("double").alias(f"f{k}") for k in range(4)])
    features = x.sparse().select("t", "station").join(counts, "t")
    return _scores(E.Regression(features, NAMES, "linear", residual=False).evaluate(*_split(x)))


@query("sequenciator", Q.sequence(CUT), ("sparse", "pixels"))
def sequenciator(x: Tables) -> DataFrame:
    return _scores(E.Sequence([E.SnapshotMean(), E.Regression(_features(x), NAMES, "ridge", residual=False)]).evaluate(*_split(x)))


@query("sequenciator_transitions", Q.sequence_transitions(CUT), ("sparse", "pixels"))
def sequenciator_transitions(x: Tables) -> DataFrame:
    """The same steps, each along a line fitted to what was left before it."""
    return _scores(E.Sequence([E.SnapshotMean(), E.Regression(_features(x), NAMES, "ridge", residual=False)], "left").evaluate(*_split(x)))


def _three(x: Tables, part: int) -> DataFrame:
    past, future = _split(x)
    at = past if part == 0 else future
    out = None
    for name, e in (("mean", E.SnapshotMean()), ("invvar", E.InverseVariance()), ("distance", E.DistanceModel(x.positions(), lambda d: S.KERNELS["exponential"](d, 5.0)))):
        own = E.with_truth(e.predict(e.fit(past), at), at, name)
        out = own if out is None else out.unionByName(own)
    return out


@query(
    "grid_run",
    f"{Q.split(CUT)}, {Q.three('future', 'p')} select model, station, {Q.SCORES} from (select *, avg(z) over (partition by model, station) m from p where e is not null) group by 1, 2",
    ("sparse", "positions"),
)
def grid_run(x: Tables) -> DataFrame:
    """Three models over all stations, written to a folder as they end, and scored from there."""
    models = {"mean": E.SnapshotMean(), "invvar": E.InverseVariance(), "distance": E.DistanceModel(x.positions(), lambda d: S.KERNELS["exponential"](d, 5.0))}
    return _scores(runs.run_models(models, *_split(x), f"{shared_folder(x.spark)}/runs-{uuid.uuid4().hex}"))


RATES = (0.1, 400.0)


@query("kernel_rate_search", Q.rate_search(CUT, *RATES, 300), ("sparse", "positions"))
def kernel_rate_search(x: Tables) -> DataFrame:
    """The rate of an exponential kernel with the least error of stations left out, by each search; the SQL tries a fine grid."""
    past, positions, bounds = checkpointed(_split(x)[0]), checkpointed(x.positions()), {"rate": RATES}
    evaluate = E.kernel_losses(positions, past)
    losses = lambda: search.Losses(x.spark, bounds, evaluate)
    found = {
        "loguniform": search.uniform(losses(), 40, log=True), "evolution": search.evolution(losses(), population=8, generations=8, close=1e-4),
        "surrogate": search.surrogate(losses(), rounds=3), "descend": search.descend(bounds, E.kernel_gradient(positions, past), {"rate": 20.0}, steps=8, close=1e-6),
    }
    return x.spark.createDataFrame([(k, float(f.loss)) for k, f in found.items()], "method string, loss double").select("method", F.round("loss", 1).alias("loss"))


@query("source_lasso_conditions", "select kind, term, true holds from (select unnest(['lasso', 'positive_lasso']) kind), (select unnest(['_p0', '_p1', '_p2', '_p3']) term)")
def source_lasso_conditions(x: Tables) -> DataFrame:
    """Whether each weight is optimal at the penalty chosen: the rate of the square error's fall is alpha with the weight's sign, or at most alpha at 0."""
    past, out = _split(x)[0], None
    for kind in ("lasso", "positive_lasso"):
        e = E.Regression(_features(x), NAMES, kind)
        found = e.fit(past)
        frame = e._frame(past)
        terms = list(e._terms())
        left = E.with_weights(frame, found).withColumn("_r", F.col("z") - F.col("estimate") - E.weighted(terms))
        rates = left.agg(*[F.covar_pop(c, "_r").alias(c) for c in terms]).unpivot([], terms, "term", "rate").join(found, "term")
        close, rate = 1e-6, F.when(F.col("weight") == 0, F.col("rate") if kind == "positive_lasso" else F.abs("rate"))
        holds = F.when(F.col("weight") == 0, rate <= F.col("alpha") + close).otherwise(F.abs(F.col("rate") - F.signum("weight") * F.col("alpha")) <= close)
        own = rates.select(F.lit(kind).alias("kind"), "term", (holds & (F.lit(kind == "lasso") | (F.col("weight") >= 0))).alias("holds"))
        out = own if out is None else out.unionByName(own)
    return out


@query("aggregator_stacked", Q.aggregator_stacked(CUT), ("sparse", "positions"))
def aggregator_stacked(x: Tables) -> DataFrame:
    return _scores(E.ensemble(_three(x, 1), E.ensemble_weights(_three(x, 0), "regression"), "stacked"))


@query("aggregator_weights", Q.aggregator_weights(CUT), ("sparse", "positions"))
def aggregator_weights(x: Tables) -> DataFrame:
    p = _three(x, 0)
    rows = [(how, m, w) for how in ("average", "mse", "std", "blue") for m, w in E.ensemble_weights(p, how).items()]
    return x.spark.createDataFrame(rows, "how string, model string, weight double").select("how", "model", r6("weight", "weight"))


@query("aggregator_nested", Q.aggregator_nested(CUT), ("sparse", "positions"))
def aggregator_nested(x: Tables) -> DataFrame:
    return _scores(E.nested_ensemble(_three(x, 0), "mse"))


def _node_field(x: Tables) -> tuple[DataFrame, DataFrame]:
    """Edges of the largest component and its node source as a field (t, node, z)."""
    own = _component(x)
    q = traffic.node_source(x.traffic_edge(), own)
    return own, q.select("t", "node", traffic.linear(q, {"green": 0.1, "yellow": 0.3, "red": 0.7, "dark_red": 1.5}).alias("z"))


def _whole_field(x: Tables) -> DataFrame:
    """The node source of the whole graph as a field (t, node, z)."""
    q = traffic.node_source(x.traffic_edge(), x.edges())
    return q.select("t", "node", traffic.linear(q, {"green": 0.1, "yellow": 0.3, "red": 0.7, "dark_red": 1.5}).alias("z"))


@query("screened_poisson", Q.field_solution("length / 6 - 1000 / length", "sum(length / 3 + 1000 / length)"), ("ends", "traffic_edge", "degrees"))
def screened_poisson(x: Tables) -> DataFrame:
    e, source = _node_field(x)
    return E.screened_poisson(source, graph.diffusion_matrix(e), graph.mass_matrix(e), 1000.0, 1.0).select("t", "node", r6("z", "z"))


@query("soft_diffusion", Q.field_solution("-10 / length", "sum(10 / length) + 1"), ("ends", "traffic_edge", "degrees"))
def soft_diffusion(x: Tables) -> DataFrame:
    e, source = _node_field(x)
    return E.soft_diffusion(source, graph.laplacian(e, 1 / F.col("length")), 1.0, 10.0).select("t", "node", r6("z", "z"))


@query("laplacian_projection")
def laplacian_projection(x: Tables) -> DataFrame:
    e, source = _node_field(x)
    basis = E.laplacian_basis(graph.normalised_laplacian(e, F.col("length") * F.col("lanes")), 5)
    return E.project(source, basis).select("t", "node", r6("z", "z"))


@query("energy_filtered")
def energy_filtered(x: Tables) -> DataFrame:
    e, source = _node_field(x)
    return spectral.energy_filter(source, graph.laplacian(e, F.col("length")), 0.9).select("t", "node", r6("z", "z"))


@query("spectrum_counts", Q.spectrum_counts((0.25, 0.75, 1.25)), ("ends", "degrees"))
def spectrum_counts(x: Tables) -> DataFrame:
    """How many eigenvalues of the normalised Laplacian are below some bounds; the SQL counts negative pivots of its elimination."""
    matrix = graph.normalised_laplacian(x.edges(), F.col("length") * F.col("lanes"))
    bounds = [0.25, 0.75, 1.25]
    return x.spark.createDataFrame(list(zip(bounds, spectral.counts_below(matrix, bounds), strict=True)), "bound double, n long")


#: What orthonormal eigenvectors must give, for as many as there are: their products, and no residual.
ORTHONORMAL = "select a, b, cast(a = b as int) + 0.0 product, 0.0 residual from (select least({most}, ({count})) n), (select unnest(range({most})) a), (select unnest(range({most})) b) where a < n and b < n"


def _checked(basis: DataFrame, image: DataFrame) -> DataFrame:
    """Products of all pairs of vectors (node, k, b), and the size of each one's image less its multiple of the vector, as a share of the largest image."""
    other = basis.select("node", F.col("k").alias("k2"), F.col("b").alias("b2"))
    product = basis.join(other, "node").groupBy(F.col("k").alias("a"), F.col("k2").alias("b")).agg(F.sum(F.col("b") * F.col("b2")).alias("product"))
    both = basis.join(image.select("node", "k", F.col("b").alias("w")), ["node", "k"])
    value = both.groupBy("k").agg(F.sum(F.col("b") * F.col("w")).alias("value"))
    left = both.join(F.broadcast(value), "k").groupBy("k").agg(F.sqrt(F.sum(F.pow(F.col("w") - F.col("value") * F.col("b"), 2))).alias("left"), F.sqrt(F.sum(F.pow("w", F.lit(2)))).alias("size"))
    top = left.agg(F.greatest(F.max("size"), F.lit(1e-12)).alias("top"))
    residual = left.join(F.broadcast(top)).select(F.col("k").alias("a"), r6(F.col("left") / F.col("top"), "residual"))
    return product.join(residual, "a").select("a", "b", r6("product", "product"), "residual")


@query("laplacian_modes", ORTHONORMAL.format(most=5, count="select count(distinct node) from ends"), ("ends",))
def laplacian_modes(x: Tables) -> DataFrame:
    matrix = checkpointed(graph.normalised_laplacian(x.edges(), F.col("length") * F.col("lanes")))
    basis = checkpointed(E.laplacian_basis(matrix, 5))
    image = matrix.join(basis.withColumnRenamed("node", "j"), "j").groupBy(F.col("i").alias("node"), "k").agg(F.sum(F.col("value") * F.col("b")).alias("b"))
    return _checked(basis, image)


@query("principal_modes", ORTHONORMAL.format(most=4, count="select least(count(distinct t) - 1, count(distinct node), (select count(*) from (select distinct u, v from traffic_edge))) from field"), ("node_field",))
def principal_modes(x: Tables) -> DataFrame:
    source = checkpointed(_whole_field(x))
    basis = checkpointed(E.pca_basis(source, 4))
    there = source.join(basis, "node").groupBy("t", "k").agg(F.sum(F.col("z") * F.col("b")).alias("c"))
    mean = there.groupBy("k").agg(F.avg("c").alias("m"))
    n = there.select("t").distinct().agg(F.count(F.lit(1)).alias("n"))
    scaled = there.join(F.broadcast(mean), "k").join(F.broadcast(n)).select("t", "k", ((F.col("c") - F.col("m")) / F.col("n")).alias("c"))
    return _checked(basis, source.join(scaled, "t").groupBy("node", "k").agg(F.sum(F.col("z") * F.col("c")).alias("b")))


@query("principal_spectrum", Q.principal_spectrum(), ("node_field",))
def principal_spectrum(x: Tables) -> DataFrame:
    """Sums of powers of the covariance's eigenvalues; the SQL takes traces of the Gram matrix over times."""
    values, _ = spectral.principal_vectors(_whole_field(x), spectral.TIMES)
    total = values.sum()
    return x.spark.createDataFrame([(p, float(((values / (total if p > 1 else 1)) ** p).sum())) for p in (1, 2, 3)], "power int, value double").select("power", F.round("value", 5).alias("value"))


@query("pca_projection")
def pca_projection(x: Tables) -> DataFrame:
    _, source = _node_field(x)
    return E.project(source, E.pca_basis(source, 3)).select("t", "node", r6("z", "z"))


@query("assimilation")
def assimilation(x: Tables) -> DataFrame:
    e, source = _node_field(x)
    matrix = graph.normalised_laplacian(e, F.col("length") * F.col("lanes"))
    values, basis = spectral.eigenpairs(matrix, 4)  # the reduced operator is diagonal in them
    observed = source.where("node % 4 = 0").withColumn("z", F.col("z") * 1.1)
    return E.assimilate(source, observed, checkpointed(basis), np.diag(values + 1.0), 0.5, 1.0).select("t", "node", r6("z", "z"))


@query("resistance_distance", Q.resistance(), ("ends",))
def resistance_distance(x: Tables) -> DataFrame:
    e = _component(x)
    return E.resistances(graph.laplacian(e, 1 / F.col("length"))).select("a", "b", (F.round("r", 4) + 0.0).alias("r"))


@query("corr_vs_resistance", Q.corr_vs_resistance(), ("ends",))
def corr_vs_resistance(x: Tables) -> DataFrame:
    """Correlation of two sensors beside the resistance between them."""
    e = _component(x)
    own = _node_panel(x, e).select("t", F.col("station").cast("long").alias("station"), "z")
    found = E.resistances_and_correlations(graph.laplacian(e, 1 / F.col("length")), own, 5)
    return found.select("a", "b", (F.round("r", 4) + 0.0).alias("r"), r6("corr", "corr"), "n")


@query("gnn_layer", "with recursive {0} select b.node, 'balance' feature, round(greatest(0, 0.5 * s_acctbal + 0.4 * m), 6) as value from (select distinct node from ends) b join supplier on s_suppkey = b.node join (select e.node, avg(s_acctbal) m from ends e join supplier on s_suppkey = e.other group by 1) k on k.node = b.node".format(with_tables("ends").removeprefix("with recursive ")))
def gnn_layer(x: Tables) -> DataFrame:
    e = x.edges()
    nodes = e.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    features = x.read("supplier").select(F.col("s_suppkey").alias("node"), F.lit("balance").alias("feature"), F.col("s_acctbal").alias("value")).join(nodes, "node", "left_semi")
    return graph.gnn_layer(e, features, 0.5, 0.4).select("node", "feature", r6("value", "value"))


@query("field_map", "select t, id, round(sum(w * z) / sum(w), 6) estimate from (select q.t, p.id, q.z, exp(-5.0 * sqrt(power(p.x - s.x, 2) + power(p.y - s.y, 2))) w from points p, sparse q join positions s using (station) where q.t = 473400) group by 1, 2", ("points", "sparse", "positions"))
def field_map(x: Tables) -> DataFrame:
    own = x.sparse().where("t = 473400").join(x.positions(), "station")
    pairs = x.points().withColumnsRenamed({"x": "px", "y": "py"}).join(F.broadcast(own))
    w = S.KERNELS["exponential"](S.distance(F.col("px"), F.col("py"), F.col("x"), F.col("y")), 5.0)
    return pairs.groupBy("t", "id").agg(r6(F.sum(w * F.col("z")) / F.sum(w), "estimate"))


@query("stream_colour_counts", "select cast(floor(floor(epoch(ts)) / 900) as bigint) * 900 t, user_id % 20 edge, count(*) filter (k = 1) green, count(*) filter (k = 2) yellow, count(*) filter (k = 3) red, count(*) filter (k = 4) dark_red from (select ts, user_id, cast(regexp_extract(props, '([0-9]+)', 1) as int) % 5 k from events) where k > 0 group by 1, 2")
def stream_colour_counts(x: Tables) -> DataFrame:
    from ..streaming.traffic import windowed_colour_counts

    own = x.read("events").select("ts", F.col("user_id").alias("pixel"), (F.regexp_extract("props", "([0-9]+)", 1).cast("int") % 5).alias("colour"))
    edges = own.select("pixel").distinct().withColumn("edge", F.col("pixel") % 20)
    out = windowed_colour_counts(own, edges, edge=("edge",))
    return out.select(S.seconds_of(F.col("t")).alias("t"), "edge", *traffic.NAMES)


# --- regressions on the street graph: users that are nodes of the largest component are its sensors, by day


def _node_panel(x: Tables, edges: DataFrame) -> DataFrame:
    nodes = edges.select(F.explode(F.array("u", "v")).alias("user_id")).distinct()
    own = x.read("events").join(nodes, "user_id", "left_semi")
    return own.groupBy(F.floor(S.hour_of(F.col("ts")) / 24).alias("t"), F.col("user_id").cast("string").alias("station")).agg(F.avg("value").alias("z"))


def _component(x: Tables) -> DataFrame:
    e = x.edges()
    return checkpointed(graph.induced_subgraph(e, graph.largest_component(e)))


def _split_days(p: DataFrame) -> tuple[DataFrame, DataFrame]:
    return p.where(F.col("t") < CUT // 24), p.where(F.col("t") >= CUT // 24)


def _as_station(df: DataFrame) -> DataFrame:
    return df.withColumn("station", F.col("node").cast("string")).drop("node")


def _wide_hops(hops: DataFrame, depths: int) -> DataFrame:
    """Features of each depth side by side; the depths are given, so no distinct values are collected."""
    return hops.groupBy("t", "node").agg(*[F.coalesce(F.sum(F.when(F.col("depth") == d, F.col(c))), F.lit(0.0)).alias(f"{c}{d}") for d in range(depths + 1) for c in traffic.NAMES])


@query("neighbour_edge_regression")
def neighbour_edge_regression(x: Tables) -> DataFrame:
    e = _component(x)
    wide = _as_station(_wide_hops(traffic.area_weighted_hops(x.traffic_edge(), e, 1), 1))
    names = tuple(f"{c}{d}" for d in range(2) for c in traffic.NAMES)
    return _scores(E.Regression(wide, names, "lasso").evaluate(*_split_days(_node_panel(x, e))))


DECAYED = "with recursive {0} select q.t, source node, {1} from near n join ends e on e.node = n.node join degrees a on a.node = e.node join degrees b on b.node = e.other join traffic_edge q on q.u = least(e.node, e.other) and q.v = greatest(e.node, e.other) join edge_norm w on w.u = q.u and w.v = q.v group by 1, 2".format(
    HOPS.format(1), ", ".join(f"sum(power(0.5, depth) * length * lanes / power(a.degree, 0.5) / power(b.degree, 0.5) * {c} / norm) {c}" for c in traffic.NAMES)
)


@query("decayed_hops_regression", Q.node_regression(CUT // 24, DECAYED, 1.0), ("ends", "edge_norm", "degrees", "traffic_edge"))
def decayed_hops_regression(x: Tables) -> DataFrame:
    e = _component(x)
    features = _as_station(traffic.decayed_hops(x.traffic_edge(), e, 1, 0.5, 0.5))
    return _scores(E.Regression(features, traffic.NAMES, "ridge").evaluate(*_split_days(_node_panel(x, e))))


def _extra(x: Tables, e: DataFrame) -> tuple[DataFrame, tuple[str, ...]]:
    """Node source with the hour's and week's regressors, the mean source of all nodes and of the sensors', the mean of the other sensors and the weather.

    A row for each day of a sensor; no traffic is a source of 0. The hour's regressors are means over the sensor's events,
    as its value is. Squares of a sine and working days are left out: with the squares of the cosine and weekends they
    sum to 1, which the intercept has. Orders end before the events begin, so the weather is that of the calendar day,
    over all years.
    """
    own = graph.node_set(e)
    seen = x.read("events").join(own.withColumnRenamed("node", "user_id"), "user_id", "left_semi").withColumn("_hour", S.hour_of(F.col("ts")))
    hours = {k: c for k, c in S.hour_features(F.col("_hour")).items() if k != "sin_sin"}
    seen = seen.groupBy(F.floor(F.col("_hour") / 24).alias("t"), F.col("user_id").alias("node")).agg(F.avg("value").alias("z"), *[F.avg(c).alias(k) for k, c in hours.items()])
    q = checkpointed(traffic.node_source(x.traffic_edge(), e))
    sources = [F.coalesce(c, F.lit(0.0)).alias(c) for c in traffic.NAMES]
    sensors = checkpointed(seen.join(q, ["t", "node"], "left").select("t", "node", "z", *hours, *sources))
    nodes = F.broadcast(own.agg(F.count(F.lit(1)).alias("_nodes")))
    mean = q.groupBy("t").agg(*[F.sum(c).alias(f"_{c}") for c in traffic.NAMES]).join(nodes).select("t", *[(F.col(f"_{c}") / F.col("_nodes")).alias(f"avg_{c}") for c in traffic.NAMES])
    others = sensors.where("z is not null").groupBy("t").agg(F.sum("z").alias("_z"), F.count("z").alias("_n"), *[F.sum(c).alias(f"_{c}") for c in traffic.NAMES])
    there = F.col("z").isNotNull().cast("int")
    left = {f"avg_nodes_{c}": F.try_divide(F.col(f"_{c}") - there * F.col(c), F.col("_n") - there) for c in traffic.NAMES}
    left["avg_pollution"] = F.try_divide(F.col("_z") - F.coalesce("z", F.lit(0.0)), F.col("_n") - there)
    day = F.expr("timestampadd(DAY, cast(t as int), timestamp_ntz'1970-01-01 00:00:00')")
    out = sensors.join(F.broadcast(mean), "t", "left").fillna(0.0, [f"avg_{c}" for c in traffic.NAMES]).join(F.broadcast(others), "t").withColumns({**left, "weekend": S.week_features(day)["weekend"].cast("double")})
    out = out.withColumn("_day", F.date_format(day, "MM-dd")).join(F.broadcast(x.weather_by_calendar_day()), "_day")
    names = (*traffic.NAMES, *(f"avg_{c}" for c in traffic.NAMES), *left, *hours, "weekend", "temperature", "wind")
    return _as_station(out.select("t", "node", *names)), names


@query("source_with_extra_regressors")
def source_with_extra_regressors(x: Tables) -> DataFrame:
    e = _component(x)
    features, names = _extra(x, e)
    return _scores(E.Regression(features, names, "lasso").evaluate(*_split_days(_node_panel(x, e))))


@query("traffic_value_added")
def traffic_value_added(x: Tables) -> DataFrame:
    """RMSE with and without traffic for each sensor, best gain first."""
    e = _component(x)
    features, _ = _extra(x, e)
    names = (*traffic.NAMES, *(f"avg_{c}" for c in traffic.NAMES), "weekend")  # what isn't traffic would count as its gain
    past, future = _split_days(_node_panel(x, e))
    model = evaluate.metrics(E.Regression(features, names, "linear").evaluate(past, future), ["station"]).select("station", F.col("rmse").alias("model"))
    base = evaluate.metrics(E.SnapshotMean().evaluate(past, future), ["station"]).select("station", F.col("rmse").alias("baseline"))
    both = model.join(base, "station")
    return both.select("station", r6("model", "model"), r6("baseline", "baseline"), r6(F.col("model") - F.col("baseline"), "difference")).orderBy("difference", "station")


@query("projection_after_source")
def projection_after_source(x: Tables) -> DataFrame:
    """The regression's field at all nodes, projected on smooth modes of the graph."""
    e = _component(x)
    q = traffic.node_source(x.traffic_edge(), e)
    r = E.Regression(_as_station(q), traffic.NAMES, "ridge", residual=False)
    found = r.fit(_split_days(_node_panel(x, e))[0])
    field = E.with_weights(q, found).select("t", "node", E.weighted([f"_p{k}" for k in range(len(traffic.NAMES))], list(traffic.NAMES)).alias("z"))
    basis = E.laplacian_basis(graph.normalised_laplacian(e, F.col("length") * F.col("lanes")), 5)
    return E.project(field, basis).select("t", "node", r6("z", "z"))


@query("projected_source")
def projected_source(x: Tables) -> DataFrame:
    """Regression on the node source projected on smooth modes of the graph, their number by training error."""
    e = _component(x)
    basis = E.laplacian_basis(graph.normalised_laplacian(e, F.col("length") * F.col("lanes")), 4)
    return _scores(E.ProjectedRegression(checkpointed(traffic.node_source(x.traffic_edge(), e)), checkpointed(basis), traffic.NAMES, 4).evaluate(*_split_days(_node_panel(x, e))))


@query("projection_best_k")
def projection_best_k(x: Tables) -> DataFrame:
    """Mean square error of the projected source by number of principal vectors: all numbers in one plan."""
    e = _component(x)
    q = traffic.node_source(x.traffic_edge(), e)
    source = q.select("t", "node", traffic.linear(q, {"green": 0.1, "yellow": 0.3, "red": 0.7, "dark_red": 1.5}).alias("z"))
    basis = E.pca_basis(source, 6)
    c = source.join(basis, "node").groupBy("t", "k").agg(F.sum(F.col("z") * F.col("b")).alias("c"))
    each = c.join(basis, "k").select("t", "node", "k", (F.col("c") * F.col("b")).alias("p"))
    sizes = x.spark.range(1, 7).withColumnRenamed("id", "size")
    rebuilt = each.join(F.broadcast(sizes), F.col("k") < F.col("size")).groupBy("size", "t", "node").agg(F.sum("p").alias("p"))
    return rebuilt.join(source, ["t", "node"]).groupBy("size").agg(r6(F.avg(F.pow(F.col("z") - F.col("p"), 2)), "mse"))


@query(
    "static_feature_sweep",
    """select sigma, round(corr(f, z), 6) as corr from (
        select sigma, a.id, max(a.z) z, sum(case when b.label % 2 = 0 then exp(-sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2)) / sigma) else 0 end) f
        from (select vec_id id, cast(embedding[1] as double) x, cast(embedding[2] as double) y, cast(embedding[5] as double) z from embeddings) a,
             (select label, cast(embedding[3] as double) x, cast(embedding[4] as double) y from embeddings) b,
             (select unnest([0.02, 0.05, 0.1, 0.2, 0.5]) sigma) group by 1, 2) group by 1""",
)
def static_feature_sweep(x: Tables) -> DataFrame:
    """Correlation of a static mask's smoothed value with a target, for several bandwidths in one plan."""
    e = F.col("embedding")
    points = x.read("embeddings").select("vec_id", e[0].cast("double").alias("ax"), e[1].cast("double").alias("ay"), e[4].cast("double").alias("z"))
    mask = x.read("embeddings").where("label % 2 = 0").select(e[2].cast("double").alias("bx"), e[3].cast("double").alias("by"))
    widths = (0.02, 0.05, 0.1, 0.2, 0.5)
    if spatial.is_small(mask):
        pairs = points.join(F.broadcast(mask)).withColumn("d", S.distance(F.col("ax"), F.col("ay"), F.col("bx"), F.col("by"))).select("vec_id", "z", "d", F.explode(F.array(*[F.lit(v) for v in widths])).alias("sigma"))
        smooth = pairs.groupBy("sigma", "vec_id", "z").agg(F.sum(S.KERNELS["exp_by_scale"](F.col("d"), F.col("sigma"))).alias("f"))
        return smooth.groupBy("sigma").agg(r6(F.corr("f", "z"), "corr"))
    nodes = mask.select(F.col("bx").alias("x"), F.col("by").alias("y"), F.lit(1.0).alias("z"))
    sums = spatial.kernel_sums(points.select(F.col("vec_id").alias("id"), F.col("ax").alias("x"), F.col("ay").alias("y")), nodes, [lambda d, s=s: np.exp(-d / s) for s in widths])
    smooth = sums.join(points.select(F.col("vec_id").alias("id"), "z"), "id").select(F.element_at(F.array(*[F.lit(v) for v in widths]), F.col("k") + 1).alias("sigma"), "z", F.col("weights").alias("f"))
    return smooth.groupBy("sigma").agg(r6(F.corr("f", "z"), "corr"))


# --- calibrated physics: users that are nodes are sensors; every second one is held out


def _sensors(x: Tables, e: DataFrame) -> DataFrame:
    return _node_panel(x, e).select("t", F.col("station").cast("long").alias("node"), "z")


def _street_physics(x: Tables, e: DataFrame, **more) -> physics.CalibratedField:
    q = checkpointed(traffic.node_source(x.traffic_edge(), e))
    return physics.CalibratedField(q, traffic.NAMES, checkpointed(graph.diffusion_matrix(e)), checkpointed(graph.mass_matrix(e)), **more)


@query("diffusion_loss", Q.diffusion_loss(CUT // 24, 1000.0), ("ends", "traffic_edge", "degrees"))
def diffusion_loss(x: Tables) -> DataFrame:
    """The colours' best weights and the error at all sensors, for one diffusion."""
    e = _component(x)
    loss, _, w = _street_physics(x, e, positive=False).loss_and_slope(_split_days(_sensors(x, e))[0], 1000.0)
    return x.spark.createDataFrame([*zip(traffic.NAMES, map(float, w), strict=True), ("loss", loss)], "term string, value double").select("term", (F.round("value", 4) + 0.0).alias("value"))


def _held_out_scores(x: Tables, e: DataFrame, own: physics.CalibratedField, name: str) -> DataFrame:
    """Scores of every second sensor after the cut, from a calibration at the others before it."""
    past, future = _split_days(checkpointed(_sensors(x, e)))
    found = own.fit(past.where("node % 2 = 0"))
    estimates = own.predict(found, future.where("node % 2 = 0"))
    both = estimates.join(future.where("node % 2 = 1").withColumnRenamed("z", "truth"), ["t", "node"])
    return _scores(both.select(F.lit(name).alias("model"), F.col("node").cast("string").alias("station"), "t", "estimate", "truth"))


@query("calibrated_diffusion")
def calibrated_diffusion(x: Tables) -> DataFrame:
    """Diffusion and four colour weights fitted by adjoint slopes."""
    e = _component(x)
    return _held_out_scores(x, e, _street_physics(x, e, bounds=(1.0, 1e6), start=1e3, steps=4), "diffusion")


@query("calibrated_soft_diffusion")
def calibrated_soft_diffusion(x: Tables) -> DataFrame:
    """A regression's field at all nodes, less its mean, softened on the graph: the share, size and offset are fitted."""
    e = _component(x)
    q = checkpointed(traffic.node_source(x.traffic_edge(), e))
    r = E.Regression(_as_station(q), traffic.NAMES, "ridge", residual=False)
    past = _split_days(_node_panel(x, e))[0].where("station % 2 = 0")
    field = E.with_weights(q, r.fit(past)).select("t", "node", E.weighted([f"_p{k}" for k in range(len(traffic.NAMES))], list(traffic.NAMES)).alias("z"))
    field = field.join(field.groupBy("t").agg(F.avg("z").alias("_m")), "t").select("t", "node", (F.col("z") - F.col("_m")).alias("z"))
    stiffness = checkpointed(graph.laplacian(e, 1 / F.col("length")))
    own = physics.CalibratedField(checkpointed(field), ("z",), stiffness, physics.identity(stiffness), (1e-3, 1e5), 10.0, 4, offset=True, positive=False)
    return _held_out_scores(x, e, own, "soft")
