"""Named queries over the driver's tables, each with the SQL that must give the same rows.

Doubles are rounded to 6 decimals on both sides. Queries without SQL are those that SQL can't express well (eigenvectors,
penalties by cross-validation, trees, a perceptron); tests hold their operators against brute force on small cases.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import evaluate, graph, spatial, traffic
from ..operators import panel as P
from .bindings import Tables, with_tables

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, uses: tuple[str, ...] = ()):
    """Register f(tables) under a name, with the SQL of the same rows after the tables it uses."""

    def put(f):
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            # a text that goes on with tables of its own begins with their name
            ORACLE_SQL[name] = f"{with_tables(*uses)}{' ' if sql.startswith('select') else ', '}{sql}" if uses else sql
        return f

    return put


def r6(c, name: str):
    return (F.round(F.col(c) if isinstance(c, str) else c, 6) + 0.0).alias(name)


# --- snapshot estimators and panels


@query("loo_spatial_mean_rmse", "select station, round(sqrt(avg(power(p.z - (sz - p.z) / (n_at - 1), 2))), 6) rmse, count(*) n from panel p join (select t, sum(z) sz, count(z) n_at from panel group by t) s on p.t = s.t where n_at > 1 group by station", ("panel",))
def loo_spatial_mean_rmse(x: Tables) -> DataFrame:
    own = P.leave_one_out_mean(x.panel()).where("estimate is not null")
    return own.groupBy("station").agg(r6(F.sqrt(F.avg(F.pow(F.col("z") - F.col("estimate"), 2))), "rmse"), F.count(F.lit(1)).alias("n"))


@query("loo_spatial_median_rmse", "select f.station, round(sqrt(avg(power(f.z - m, 2))), 6) rmse, count(*) n from panel f join (select a.t, a.station, median(b.z) m from panel a join panel b on a.t = b.t and a.station <> b.station group by 1, 2) e on f.t = e.t and f.station = e.station group by 1", ("panel",))
def loo_spatial_median_rmse(x: Tables) -> DataFrame:
    p = x.panel()
    others = P.leave_one_out_folds(p, p.select("station").distinct()).groupBy("fold", "t").agg(F.median("z").alias("m"))
    own = p.join(others.withColumnRenamed("fold", "station"), ["station", "t"])
    return own.groupBy("station").agg(r6(F.sqrt(F.avg(F.pow(F.col("z") - F.col("m"), 2))), "rmse"), F.count(F.lit(1)).alias("n"))


@query("global_mean", "select round(avg(z), 6) mean, round(median(z), 6) median, count(*) n from panel", ("panel",))
def global_mean(x: Tables) -> DataFrame:
    return x.panel().agg(r6(F.avg("z"), "mean"), r6(F.median("z"), "median"), F.count(F.lit(1)).alias("n"))


@query("snapshot_weighted_invvar", "select a.station, a.t, round(sum(b.z * w) / sum(w), 6) estimate from sparse a join sparse b on a.t = b.t and a.station <> b.station join (select station, 1 / var_samp(z) w from sparse group by 1) v on v.station = b.station group by 1, 2", ("sparse",))
def snapshot_weighted_invvar(x: Tables) -> DataFrame:
    from ..operators.estimators import InverseVariance

    p, e = x.sparse(), InverseVariance()
    out = e.predict(e.fit(p), p).where("estimate is not null")
    return out.select(F.col("fold").alias("station"), "t", r6("estimate", "estimate"))


@query("cosine_model", "select t, round(2 + 3 * cos((t - 473352) * 2 * pi() / 24 + 0.5), 6) estimate from panel group by t", ("panel",))
def cosine_model(x: Tables) -> DataFrame:
    return x.panel().select("t").distinct().select("t", r6(2 + S.cosine_wave(F.col("t"), 473352, 3, 24, 0.5), "estimate"))


@query("snapshot_quantile_rank", "select f.station, f.t, round(count_if(p.z < f.z) / count(*), 6) as rank from sparse f join sparse p on f.station = p.station and p.t < 473712 where f.t >= 473712 group by f.station, f.t", ("sparse",))
def snapshot_quantile_rank(x: Tables) -> DataFrame:
    p = x.sparse()
    return P.past_quantile_rank(p.where("t < 473712"), p.where("t >= 473712")).select("station", "t", r6("rank", "rank"))


@query("panel_null_ratio_filter", "select s.station, round(1 - n / total, 6) null_ratio from (select station, count(z) n from sparse group by 1) s, (select count(distinct t) total from sparse) where 1 - n / total <= 0.4", ("sparse",))
def panel_null_ratio_filter(x: Tables) -> DataFrame:
    return P.null_ratio(x.sparse()).where("null_ratio <= 0.4").select("station", r6("null_ratio", "null_ratio"))


@query("known_stations", "select station, count(*) n from sparse where station in (select station from positions where station <> 's3') group by 1", ("sparse", "positions"))
def known_stations(x: Tables) -> DataFrame:
    return P.known_stations(x.sparse(), x.positions().where("station <> 's3'")).groupBy("station").agg(F.count(F.lit(1)).alias("n"))


@query("complete_times", "select t from panel group by t having count(distinct station) = (select count(distinct station) from panel)", ("panel",))
def complete_times(x: Tables) -> DataFrame:
    return P.complete_times(x.panel())


@query("valid_target_times", "select station, count(*) n, round(avg(z), 6) mean from sparse where t in (select t from sparse where station = 's3') group by 1", ("sparse",))
def valid_target_times(x: Tables) -> DataFrame:
    return P.valid_times(x.sparse(), "s3").groupBy("station").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("z"), "mean"))


def _thirds(x: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    p = x.panel()
    return p.where("station = 'click'"), p.where("station = 'view'"), p.where("station = 'error'")


@query("time_intersection", "select t from panel where station = 'click' intersect select t from panel where station = 'view' intersect select t from panel where station = 'error'", ("panel",))
def time_intersection(x: Tables) -> DataFrame:
    return P.common_times(*_thirds(x))


@query("time_union", "select t from panel where station = 'click' union select t from panel where station = 'view' union select t from panel where station = 'error'", ("panel",))
def time_union(x: Tables) -> DataFrame:
    return P.union_times(*_thirds(x))


@query("time_except", "select t from panel where station = 'click' except select t from panel where station = 'error'", ("panel",))
def time_except(x: Tables) -> DataFrame:
    a, _, c = _thirds(x)
    return P.times_except(a, c)


@query("station_set_equality", "select (select count(*) from (select distinct station from sparse except select station from positions)) only_a, (select count(*) from (select station from positions except select distinct station from sparse)) only_b", ("sparse", "positions"))
def station_set_equality(x: Tables) -> DataFrame:
    return P.differences(x.sparse().select("station").distinct(), x.positions().select("station"))


@query("station_order", "select event_type station, count(*) n, cast(case event_type when 'purchase' then 1 when 'view' then 2 when 'click' then 3 end as bigint) place from events group by 1")
def station_order(x: Tables) -> DataFrame:
    counts = x.read("events").groupBy(F.col("event_type").alias("station")).agg(F.count(F.lit(1)).alias("n"))
    return P.in_order(counts, "station", ["purchase", "view", "click"])


@query("traffic_on_available_times", "select pixel, count(*) n from pixels where t in (select t from panel where station = 'error') group by 1", ("pixels", "panel"))
def traffic_on_available_times(x: Tables) -> DataFrame:
    return x.pixels().join(x.panel().where("station = 'error'").select("t"), "t", "left_semi").groupBy("pixel").agg(F.count(F.lit(1)).alias("n"))


@query("train_test_split_ordinal", "select station, case when k <= floor(0.8 * n) then 'past' else 'future' end split, count(*) n, round(avg(z), 6) mean from panel join (select t, row_number() over (order by t) k, count(*) over () n from (select distinct t from panel)) using (t) group by 1, 2", ("panel",))
def train_test_split_ordinal(x: Tables) -> DataFrame:
    return P.split_by_time(x.panel(), 0.8).groupBy("station", "split").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("z"), "mean"))


@query("time_range_station_list", "select station, count(*) n, min(t) first_t, max(t) last_t from panel where t between 473400 and 473700 and station in ('click', 'view') group by 1", ("panel",))
def time_range_station_list(x: Tables) -> DataFrame:
    own = P.stations_with(P.time_range(x.panel(), 473400, 473700), ["click", "view"])
    return own.groupBy("station").agg(F.count(F.lit(1)).alias("n"), F.min("t").alias("first_t"), F.max("t").alias("last_t"))


@query("hourly_resample_shift", "select cast(floor(epoch(ts) / 3600) as bigint) * 3600 + 1800 t, event_type station, round(sum(value), 6) z from events group by 1, 2")
def hourly_resample_shift(x: Tables) -> DataFrame:
    own = x.read("events").select(S.seconds_of(F.col("ts")).alias("t"), F.col("event_type").alias("station"), F.col("value").alias("z"))
    return P.resample(own, 3600, 1800).select("t", "station", r6("z", "z"))


@query("floor15_lag", "select cast(floor((floor(epoch(ts)) - 3600) / 900) as bigint) * 900 t, count(*) n from events group by 1")
def floor15_lag(x: Tables) -> DataFrame:
    return x.read("events").groupBy(S.floor_minutes(F.col("ts")).alias("t")).agg(F.count(F.lit(1)).alias("n"))


@query("snapshot_residual", "select station, round(stddev_pop(z - m), 6) sd, round(max(z - m), 6) top from (select *, avg(z) over (partition by t) m from panel) group by 1", ("panel",))
def snapshot_residual(x: Tables) -> DataFrame:
    return P.residual(x.panel()).groupBy("station").agg(r6(F.stddev_pop("residual"), "sd"), r6(F.max("residual"), "top"))


@query("station_moments", "select station, round(avg(z), 6) mean, round(var_samp(z), 6) var_samp, round(stddev_samp(z), 6) sd_samp, round(stddev_pop(z), 6) sd_pop, round(median(z), 6) median from sparse group by 1", ("sparse",))
def station_moments(x: Tables) -> DataFrame:
    return x.sparse().groupBy("station").agg(r6(F.avg("z"), "mean"), r6(F.var_samp("z"), "var_samp"), r6(F.stddev_samp("z"), "sd_samp"), r6(F.stddev_pop("z"), "sd_pop"), r6(F.median("z"), "median"))


@query("standardise", "select station, round(min((z - m) / s), 6) low, round(max((z - m) / s), 6) high from (select *, avg(z) over (partition by station) m, stddev_pop(z) over (partition by station) s from sparse) group by 1", ("sparse",))
def standardise(x: Tables) -> DataFrame:
    return P.standardised(x.sparse(), "z", ["station"]).groupBy("station").agg(r6(F.min("standardised"), "low"), r6(F.max("standardised"), "high"))


@query("sorted_snapshot_vector", "select t, row_number() over (partition by t order by z, station) as rank, round(z, 6) z from panel", ("panel",))
def sorted_snapshot_vector(x: Tables) -> DataFrame:
    return P.sorted_snapshot(x.panel()).select("t", "rank", r6("z", "z"))


@query("last_n_rows", "select t, round(z, 6) z from panel where station = 'click' order by t desc limit 400", ("panel",))
def last_n_rows(x: Tables) -> DataFrame:
    return P.last_rows(x.panel().where("station = 'click'").select("t", r6("z", "z")), 400, F.col("t"))


@query("quantile_filter", "select event_id, value from events, (select quantile_cont(value, 0.1) lo, quantile_cont(value, 0.9) hi from events) where value > lo and value < hi")
def quantile_filter(x: Tables) -> DataFrame:
    return P.quantile_filter(x.read("events").select("event_id", "value"), "value", 0.1, 0.9)


@query("clamp", "select event_id, greatest(least(value, 20.0), 5.0) as value from events")
def clamp(x: Tables) -> DataFrame:
    return x.read("events").select("event_id", S.clamp(F.col("value"), 5.0, 20.0).alias("value"))


@query("nan_handling", "select event_type, count(case when value < 30 then 1 end) n, round(sum(case when value < 30 then value else 0 end), 6) total from events group by 1")
def nan_handling(x: Tables) -> DataFrame:
    v = F.when(F.col("value") < 30, F.col("value")).otherwise(F.lit(float("nan")))
    return x.read("events").withColumn("v", v).groupBy("event_type").agg(F.count(S.null_if_nan(F.col("v"))).alias("n"), r6(F.sum(S.zero_if_missing(F.col("v"))), "total"))


@query("sqrt_histogram", "select least(k - 1, cast(floor((value - lo) / ((hi - lo) / k)) as bigint)) bin, count(*) n from events, (select min(value) lo, max(value) hi, cast(floor(sqrt(count(value))) as bigint) k from events) group by 1")
def sqrt_histogram(x: Tables) -> DataFrame:
    return evaluate.histogram(x.read("events"), "value")


@query("deviation_bounds", "select event_type, round(median(value), 6) mid, round(median(value) - (max(value) - median(value)), 6) low, round(max(value), 6) high from events group by 1")
def deviation_bounds(x: Tables) -> DataFrame:
    mid = F.median("value")
    return x.read("events").groupBy("event_type").agg(r6(mid, "mid"), r6(mid - (F.max("value") - mid), "low"), r6(F.max("value"), "high"))


# --- correlations and metrics

CORR = "select a.station a, b.station b, corr(a.z, b.z) c, count(*) n from {0} a join {0} b on a.t = b.t and a.station < b.station group by 1, 2"


@query("station_corr_matrix", f"select a, b, round(c, 6) as corr, n from ({CORR.format('panel')})", ("panel",))
def station_corr_matrix(x: Tables) -> DataFrame:
    return P.correlations(x.panel()).select("a", "b", r6("corr", "corr"), "n")


@query("centred_corr", "select a.station a, b.station b, round(corr(a.r, b.r), 6) as corr from (select t, station, z - avg(z) over (partition by t) r from panel) a join (select t, station, z - avg(z) over (partition by t) r from panel) b on a.t = b.t and a.station < b.station group by 1, 2", ("panel",))
def centred_corr(x: Tables) -> DataFrame:
    own = P.residual(x.panel()).select("t", "station", F.col("residual").alias("z"))
    return P.correlations(own).select("a", "b", r6("corr", "corr"))


@query("corr_vs_distance", f"select a, b, round(c, 6) as corr, round(sqrt(power(p.x - q.x, 2) + power(p.y - q.y, 2)), 6) d from ({CORR.format('sparse')}) join positions p on p.station = a join positions q on q.station = b", ("sparse", "positions"))
def corr_vs_distance(x: Tables) -> DataFrame:
    a, b = (x.positions().select(F.col("station").alias(k), F.col("x").alias(f"x{k}"), F.col("y").alias(f"y{k}")) for k in "ab")
    d = S.distance(F.col("xa"), F.col("ya"), F.col("xb"), F.col("yb"))
    return P.correlations(x.sparse()).join(a, "a").join(b, "b").select("a", "b", r6("corr", "corr"), r6(d, "d"))


@query("corr_vs_distance_fit", f"select round(sqrt(abs(1 / s)), 4) scale, round(greatest(0, least(1, 1 - exp(i))), 6) delta from (select regr_slope(ln(c), d) s, regr_intercept(ln(c), d) i from (select c, power(p.x - q.x, 2) + power(p.y - q.y, 2) d from ({CORR.format('sparse')}) join positions p on p.station = a join positions q on q.station = b where c > 0))", ("sparse", "positions"))
def corr_vs_distance_fit(x: Tables) -> DataFrame:
    from ..operators.estimators import fit_kernel

    return fit_kernel(x.sparse(), x.positions()).select(F.round("scale", 4).alias("scale"), r6("delta", "delta"))


def _loo_predictions(x: Tables) -> DataFrame:
    return P.leave_one_out_mean(x.panel()).select(F.lit("mean").alias("model"), "station", "t", "estimate", F.col("z").alias("truth"))


LOO = "loo as (select a.station, a.t, a.z truth, avg(b.z) estimate from panel a join panel b on a.t = b.t and a.station <> b.station group by 1, 2, 3)"


@query("metrics_rmse_mb_coe_rmsre", f"""{{tables}}, {LOO} select l.station, round(sqrt(avg(power(estimate - truth, 2))), 6) rmse, round(avg(estimate - truth), 6) mb, round(abs(avg(estimate - truth)), 6) abs_mb,
    round(avg(abs(estimate - truth)), 6) mae, round(sqrt(avg(power((estimate - truth) / truth, 2))), 6) rmsre, round(corr(estimate, truth), 6) cor,
    round(1 - sum(abs(estimate - truth)) / sum(abs(truth - m)), 6) coe, round(median(power(estimate - truth, 2)), 6) medianse, count(*) n
    from loo l join (select station, avg(truth) m from loo group by 1) k on k.station = l.station group by 1""".replace("{tables}", with_tables("panel")))
def metrics_rmse_mb_coe_rmsre(x: Tables) -> DataFrame:
    m = evaluate.metrics(_loo_predictions(x), ["station"])
    return m.select("station", *[r6(c, c) for c in ("rmse", "mb", "abs_mb", "mae", "rmsre", "cor", "coe", "medianse")], "n")


@query("medianse", f"{with_tables('panel')}, {LOO} select station, round(median(power(estimate - truth, 2)), 6) medianse from loo group by 1")
def medianse(x: Tables) -> DataFrame:
    return evaluate.metrics(_loo_predictions(x), ["station"]).select("station", r6("medianse", "medianse"))


@query("ensemble_average", f"{with_tables('panel')}, {LOO}, g as (select station, avg(z) zg from panel group by 1) select l.station, l.t, round((estimate + zg) / 2, 6) estimate from loo l join g on g.station = l.station")
def ensemble_average(x: Tables) -> DataFrame:
    from ..operators.estimators import ensemble

    a = _loo_predictions(x).where("estimate is not null")
    b = x.panel().groupBy("station").agg(F.avg("z").alias("_g")).join(a, "station").select(F.lit("own").alias("model"), "station", "t", F.col("_g").alias("estimate"), "truth")
    return ensemble(a.unionByName(b), {"mean": 0.5, "own": 0.5}).select("station", "t", r6("estimate", "estimate"))


@query("blend_by_distance", f"""{with_tables('sparse', 'positions')}, loo as (select a.station, a.t, avg(b.z) e from sparse a join sparse b on a.t = b.t and a.station <> b.station group by 1, 2),
    near as (select a.station, min(sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2))) d from positions a join positions b on a.station <> b.station group by 1)
    select s.station, s.t, round(exp(-d / 0.1) * e + (1 - exp(-d / 0.1)) * z, 6) estimate from sparse s join loo using (station, t) join near on near.station = s.station""")
def blend_by_distance(x: Tables) -> DataFrame:
    from ..operators.estimators import blend

    p = x.sparse()
    one = P.leave_one_out_mean(p).where("estimate is not null").select("station", "t", "estimate", F.col("z").alias("truth"))
    two = p.select("station", "t", F.col("z").alias("estimate"))
    pos = x.positions().withColumnRenamed("station", "id")
    d = spatial.all_pairs(pos, pos).where("id_a <> id_b").groupBy(F.col("id_a").alias("station")).agg(F.min("d").alias("d"))
    return blend(one, two, d, 0.1).select("station", "t", r6("estimate", "estimate"))


# --- space

D2 = "sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2))"


@query("bbox_filter", "select id from points where x between (select min(x) from positions) and (select max(x) from positions) and y between (select min(y) from positions) and (select max(y) from positions)", ("points", "positions"))
def bbox_filter(x: Tables) -> DataFrame:
    return P.inside_box(x.points(), x.positions()).select("id")


@query("bounds", "select round(min(x), 6) x0, round(max(x), 6) x1, round(min(y), 6) y0, round(max(y), 6) y1, round(sqrt(power(max(x) - min(x), 2) + power(max(y) - min(y), 2)), 6) longest from places", ("places",))
def bounds(x: Tables) -> DataFrame:
    a, b, c, d = F.min("x"), F.max("x"), F.min("y"), F.max("y")
    return x.places().agg(r6(a, "x0"), r6(b, "x1"), r6(c, "y0"), r6(d, "y1"), r6(F.sqrt(F.pow(b - a, 2) + F.pow(d - c, 2)), "longest"))


@query("nearest_node", f"select id, node nearest, round(d, 6) d from (select a.id, b.id node, {D2} d, row_number() over (partition by a.id order by {D2}, b.id) k from points a, nodes b) where k = 1", ("points", "nodes"))
def nearest_node(x: Tables) -> DataFrame:
    return spatial.nearest(x.points(), x.nodes().drop("z")).select("id", "nearest", r6("d", "d"))


@query("nearest_node_bucketed", f"select id, node nearest, round(d, 6) d from (select a.id, b.id node, {D2} d, row_number() over (partition by a.id order by {D2}, b.id) k from points a, nodes b) where k = 1", ("points", "nodes"))
def nearest_node_bucketed(x: Tables) -> DataFrame:
    return spatial.nearest(x.points(), x.nodes().drop("z"), 0.02, cells=True).select("id", "nearest", r6("d", "d"))


SEGMENTS = "segments as (select a.id u, b.id v, a.x ax, a.y ay, b.x bx, b.y b_y from nodes a join nodes b on b.id = a.id + 1)"


@query("nearest_edge_segment", f"""{with_tables('points', 'nodes')}, {SEGMENTS}, s as (select p.*, g.*, case when power(bx - ax, 2) + power(b_y - ay, 2) > 0 then greatest(0, least(1, ((x - ax) * (bx - ax) + (y - ay) * (b_y - ay)) / (power(bx - ax, 2) + power(b_y - ay, 2)))) else 0 end k from points p, segments g)
    select id, u, v, round(d, 6) d from (select id, u, v, sqrt(power(x - (ax + k * (bx - ax)), 2) + power(y - (ay + k * (b_y - ay)), 2)) d, row_number() over (partition by id order by sqrt(power(x - (ax + k * (bx - ax)), 2) + power(y - (ay + k * (b_y - ay)), 2)), u, v) n from s) where n = 1""")
def nearest_edge_segment(x: Tables) -> DataFrame:
    n = x.nodes()
    a, b = n.select(F.col("id").alias("u"), F.col("x").alias("ax"), F.col("y").alias("ay")), n.select(F.col("id").alias("v"), F.col("x").alias("bx"), F.col("y").alias("by"))
    segments = a.join(b, F.col("v") == F.col("u") + 1)
    return spatial.nearest_edge(x.points(), segments).select("id", "u", "v", r6("d", "d"))


@query("all_pairs_distance", f"select a.id id_a, b.id id_b, round({D2}, 6) d from nodes a, nodes b", ("nodes",))
def all_pairs_distance(x: Tables) -> DataFrame:
    n = x.nodes().drop("z")
    return spatial.all_pairs(n, n).select("id_a", "id_b", r6("d", "d"))


@query("station_distance_stats", f"select a.id, round(min({D2}), 6) nearest, round(avg({D2}), 6) mean, round(median({D2}), 6) median from nodes a join nodes b on a.id <> b.id group by 1", ("nodes",))
def station_distance_stats(x: Tables) -> DataFrame:
    return spatial.distance_stats(x.nodes().drop("z")).select("id", r6("nearest", "nearest"), r6("mean", "mean"), r6("median", "median"))


@query("nearest_grid_cell", "select id, cast(greatest(0, least(39, ceil((x + 0.4) / 0.02 - 0.5))) as bigint) column_at, cast(greatest(0, least(39, ceil((y + 0.4) / 0.02 - 0.5))) as bigint) row_at from places", ("places",))
def nearest_grid_cell(x: Tables) -> DataFrame:
    return x.places().select("id", spatial.nearest_cell(F.col("x"), -0.4, 0.02, 40).alias("column_at"), spatial.nearest_cell(F.col("y"), -0.4, 0.02, 40).alias("row_at"))


@query("radius_mean", f"select a.id, round(avg(b.z), 6) mean, count(*) n from points a join nodes b on {D2} < 0.05 group by 1", ("points", "nodes"))
def radius_mean(x: Tables) -> DataFrame:
    return spatial.radius_mean(x.points(), x.nodes(), 0.05).select("id", r6("mean", "mean"), "n")


for _name, _kernel, _sql, _smooth in (
    ("gaussian_conv", lambda d: S.KERNELS["gaussian"](d, 0.1), "exp(-d * d / 0.02)", lambda d: np.exp(-d * d / 0.02)),
    ("exponential_conv", lambda d: S.KERNELS["exponential"](d, 5.0), "exp(-d * 5.0)", lambda d: np.exp(-d * 5.0)),
    ("rational_conv", lambda d: S.KERNELS["rational"](d, 2.0, 0.3), "2.0 / (d + 0.3)", lambda d: 2.0 / (d + 0.3)),
    ("exp_by_square_conv", lambda d: S.KERNELS["exp_by_square"](d, 0.5), "exp(-d / 0.25)", lambda d: np.exp(-d / 0.25)),
    ("exp_by_scale_conv", lambda d: S.KERNELS["exp_by_scale"](d, 0.2), "exp(-d / 0.2)", lambda d: np.exp(-d / 0.2)),
    ("inverse_conv", lambda d: S.KERNELS["inverse"](d, 0.2), "1 / (d + 0.2)", lambda d: 1 / (d + 0.2)),
):

    @query(_name, f"select id, round(sum(w * z) / sum(w), 6) estimate from (select id, z, {_sql} w from (select a.id, b.z, {D2} d from points a, nodes b)) group by 1", ("points", "nodes"))
    def _convolve(x: Tables, kernel=_kernel, smooth=_smooth) -> DataFrame:
        return spatial.kernel_mean(x.points(), x.nodes(), kernel, smooth=smooth).select("id", r6("estimate", "estimate"))


@query("threshold_conv", f"select id, round(sum(w * z) / nullif(sum(w), 0), 6) estimate from (select id, z, case when d <= 0.1 then 1.0 else 0.0 end w from (select a.id, b.z, {D2} d from points a, nodes b)) group by 1", ("points", "nodes"))
def threshold_conv(x: Tables) -> DataFrame:
    return spatial.disc_mean(x.points(), x.nodes(), 0.1).select("id", r6("estimate", "estimate"))


@query("distance_model", f"""{with_tables('sparse', 'positions')}, w as (select a.station fold, b.station, exp(-{D2} * 5.0) w from positions a join positions b on a.station <> b.station)
    select fold as station, t, round(sum(w * z) / sum(w), 6) estimate from sparse join w using (station) group by 1, 2""")
def distance_model(x: Tables) -> DataFrame:
    from ..operators.estimators import DistanceModel

    e = DistanceModel(x.positions(), lambda d: S.KERNELS["exponential"](d, 5.0))
    p = x.sparse()
    return e.predict(e.fit(p), p).select(F.col("fold").alias("station"), "t", r6("estimate", "estimate"))


SIGMAS = (0.05, 0.1, 0.2, 0.5)


def _by_bandwidth(x: Tables) -> DataFrame:
    """(sigma, id, estimate) of Gaussian kernels; many nodes are summed by cells."""
    if not spatial.is_small(x.nodes()):
        sums = spatial.kernel_sums(x.points(), x.nodes(), [lambda d, s=s: np.exp(-d * d / (2 * s * s)) for s in SIGMAS])
        return sums.select(F.element_at(F.array(*[F.lit(v) for v in SIGMAS]), F.col("k") + 1).alias("sigma"), "id", (F.col("sums") / F.col("weights")).alias("estimate"))
    pairs = spatial.all_pairs(x.points(), x.nodes()).select("id_a", "z_b", "d", F.explode(F.array(*[F.lit(v) for v in SIGMAS])).alias("sigma"))
    w = S.KERNELS["gaussian"](F.col("d"), F.col("sigma"))
    return pairs.withColumn("w", w).groupBy("sigma", F.col("id_a").alias("id")).agg((F.sum(F.col("w") * F.col("z_b")) / F.sum("w")).alias("estimate"))


@query("bandwidth_sweep_corr", f"""{with_tables('points', 'nodes', 'places')}, s as (select unnest([0.05, 0.1, 0.2, 0.5]) sigma), e as (select sigma, id, sum(w * z) / sum(w) estimate from (select sigma, a.id, b.z, exp(-power({D2}, 2) / (2 * sigma * sigma)) w from points a, nodes b, s) group by 1, 2)
    select sigma, round(corr(estimate, z), 6) as corr from e join places using (id) group by 1""")
def bandwidth_sweep_corr(x: Tables) -> DataFrame:
    e = _by_bandwidth(x)
    return e.join(x.places().select("id", "z"), "id").groupBy("sigma").agg(r6(F.corr("estimate", "z"), "corr"))


@query("best_bandwidth", f"""{with_tables('points', 'nodes', 'places')}, s as (select unnest([0.05, 0.1, 0.2, 0.5]) sigma), e as (select sigma, id, sum(w * z) / sum(w) estimate from (select sigma, a.id, b.z, exp(-power({D2}, 2) / (2 * sigma * sigma)) w from points a, nodes b, s) group by 1, 2)
    select sigma, round(avg(power(estimate - z, 2)), 6) loss from e join places using (id) group by 1 order by 2, 1 limit 1""")
def best_bandwidth(x: Tables) -> DataFrame:
    e = _by_bandwidth(x)
    losses = e.join(x.places().select("id", "z"), "id").select("sigma", F.pow(F.col("estimate") - F.col("z"), 2).alias("loss"))
    return evaluate.best_parameter(losses, "sigma").select("sigma", r6("loss", "loss"))


@query("running_mean_by_distance", f"select point, id, round(avg(z) over (partition by point order by d, id rows unbounded preceding), 6) running_mean from (select a.id point, b.id, b.z, {D2} d from points a, nodes b)", ("points", "nodes"))
def running_mean_by_distance(x: Tables) -> DataFrame:
    return spatial.running_means(x.points(), x.nodes()).select("point", "id", r6("running_mean", "running_mean"))


# --- traffic


@query("colour_counts_per_edge", "select t, pixel % 20 edge, count(*) filter (colour = 1) green, count(*) filter (colour = 2) yellow, count(*) filter (colour = 3) red, count(*) filter (colour = 4) dark_red from pixels where colour > 0 group by 1, 2", ("pixels",))
def colour_counts_per_edge(x: Tables) -> DataFrame:
    p = x.pixels()
    edge = p.select("pixel").distinct().withColumn("edge", F.col("pixel") % 20)
    return traffic.colour_counts(p, edge, ("edge",))


@query("kernel_weighted_colours", f"""{with_tables('pixels', 'points', 'nodes')}, w as (select a.id point, b.id pixel, exp(-{D2} * 5.0) w from points a, nodes b), total as (select point, sum(w) total from w where pixel in (select pixel from pixels) group by 1)
    select w.point, t, round(sum(case when colour = 1 then w else 0 end) / total, 6) green, round(sum(case when colour = 4 then w else 0 end) / total, 6) dark_red from pixels join w using (pixel) join total on total.point = w.point group by w.point, t, total""")
def kernel_weighted_colours(x: Tables) -> DataFrame:
    p = x.pixels().join(x.nodes().select(F.col("id").alias("pixel"), "x", "y"), "pixel").withColumnRenamed("pixel", "id")
    out = spatial.kernel_features(x.points(), p, lambda d: S.KERNELS["exponential"](d, 5.0), {"green": 1, "dark_red": 4}, normalise=True, smooth=lambda d: np.exp(-d * 5.0))
    return out.select("point", "t", r6("green", "green"), r6("dark_red", "dark_red"))


@query("pixel_activity_diff", "select t, active, active - lag(active) over (order by t) difference from (select t, count(*) active from pixels where colour > 0 group by 1)", ("pixels",))
def pixel_activity_diff(x: Tables) -> DataFrame:
    return P.first_difference(traffic.activity(x.pixels()), "active")


@query("active_pixels", "select distinct pixel from pixels where colour > 0", ("pixels",))
def active_pixels(x: Tables) -> DataFrame:
    return x.pixels().where("colour > 0").select("pixel").distinct()


@query("linear_colour_contraction", "select t, u, v, round(green * 0.1 + yellow * 0.3 + red * 0.7 + dark_red * 1.5, 6) emission from traffic_edge", ("traffic_edge",))
def linear_colour_contraction(x: Tables) -> DataFrame:
    q = x.traffic_edge()
    return q.select("t", "u", "v", r6(traffic.linear(q, {"green": 0.1, "yellow": 0.3, "red": 0.7, "dark_red": 1.5}), "emission"))


def _colours(f) -> str:
    return ", ".join(f(c) for c in traffic.NAMES)


for _name, _norm in (("node_source", False), ("node_source_normalised", True)):
    _q = "q.{0} / norm" if _norm else "q.{0}"

    @query(_name, f"select s.t, s.node, {_colours(lambda c: f'round({c} / degree, 6) {c}')} from (select q.t, n.node, {_colours(lambda c: f'sum({_q.format(c)} * n.length * n.lanes / 2) {c}')} from traffic_edge q join ends n on q.u = least(n.node, n.other) and q.v = greatest(n.node, n.other){' join edge_norm using (u, v)' if _norm else ''} group by 1, 2) s join degrees d on d.node = s.node", ("traffic_edge", "degrees", "edge_norm"))
    def _source(x: Tables, norm=_norm) -> DataFrame:
        return traffic.node_source(x.traffic_edge(), x.edges(), norm).select("t", "node", *[r6(c, c) for c in traffic.NAMES])


HOPS = "hops as (select distinct node source, node, 0 depth from ends union select source, o.other, depth + 1 from hops h join ends o on o.node = h.node where depth < {0}), near as (select source, node, min(depth) depth from hops group by 1, 2)"


@query("khop", f"{with_tables('ends')}, {HOPS.format(2)} select source, node, depth from near")
def khop(x: Tables) -> DataFrame:
    e = x.edges()
    return graph.k_hop(e, e.select(F.explode(F.array("u", "v")).alias("node")).distinct(), 2)


@query("khop_mean", f"{with_tables('ends')}, {HOPS.format(1)} select source node, round(avg(s_acctbal), 6) mean from near join supplier on s_suppkey = node group by 1")
def khop_mean(x: Tables) -> DataFrame:
    e = x.edges()
    nodes = e.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    values = x.read("supplier").select(F.col("s_suppkey").alias("node"), F.col("s_acctbal").alias("z")).join(nodes, "node", "left_semi")
    return graph.hop_mean(e, values, 1, by=()).select("node", r6("mean", "mean"))


@query("area_weighted_hops", f"{with_tables('ends', 'edge_norm')}, {HOPS.format(1)} select q.t, source node, depth, {_colours(lambda c: f'round(sum({c} / norm * length * lanes) / greatest(1, sum(length * lanes)), 6) {c}')} from near n join ends e on e.node = n.node join traffic_edge q on q.u = least(e.node, e.other) and q.v = greatest(e.node, e.other) join edge_norm w on w.u = q.u and w.v = q.v group by 1, 2, 3")
def area_weighted_hops(x: Tables) -> DataFrame:
    return traffic.area_weighted_hops(x.traffic_edge(), x.edges(), 1).select("t", "node", F.col("depth"), *[r6(c, c) for c in traffic.NAMES])


@query("decayed_hops", f"{with_tables('ends', 'edge_norm', 'degrees')}, {HOPS.format(1)} select q.t, source node, {_colours(lambda c: f'round(sum(power(0.5, depth) * length * lanes / power(a.degree, 0.3) / power(b.degree, 0.7) * {c} / norm), 6) {c}')} from near n join ends e on e.node = n.node join degrees a on a.node = e.node join degrees b on b.node = e.other join traffic_edge q on q.u = least(e.node, e.other) and q.v = greatest(e.node, e.other) join edge_norm w on w.u = q.u and w.v = q.v group by 1, 2")
def decayed_hops(x: Tables) -> DataFrame:
    return traffic.decayed_hops(x.traffic_edge(), x.edges(), 1, 0.5, 0.3).select("t", "node", *[r6(c, c) for c in traffic.NAMES])


@query("edge_norms", "select u, v, norm from edge_norm", ("edge_norm",))
def edge_norms(x: Tables) -> DataFrame:
    return traffic.edge_norm(x.traffic_edge())


# --- graph


@query("weighted_degree", "select node, round(degree, 6) degree from degrees", ("degrees",))
def weighted_degree(x: Tables) -> DataFrame:
    return graph.weighted_degree(x.edges()).select("node", r6("degree", "degree"))


@query("adjacency", "select node i, other j, round(length * lanes, 6) as value from ends", ("ends",))
def adjacency(x: Tables) -> DataFrame:
    return graph.adjacency(x.edges(), F.col("length") * F.col("lanes")).select("i", "j", r6("value", "value"))


def _matrix_sql(off: str, diagonal: str) -> str:
    return f"select node i, other j, round({off}, 6) as value from ends union all select node, node, round({diagonal}, 6) from ends group by node"


@query("laplacian", _matrix_sql("-length * lanes", "sum(length * lanes)"), ("ends",))
def laplacian(x: Tables) -> DataFrame:
    return graph.laplacian(x.edges(), F.col("length") * F.col("lanes")).select("i", "j", r6("value", "value"))


@query("mass_matrix", _matrix_sql("length / 6", "sum(length) / 3"), ("ends",))
def mass_matrix(x: Tables) -> DataFrame:
    return graph.mass_matrix(x.edges()).select("i", "j", r6("value", "value"))


@query("diffusion_matrix", _matrix_sql("-1 / length", "sum(1 / length)"), ("ends",))
def diffusion_matrix(x: Tables) -> DataFrame:
    return graph.diffusion_matrix(x.edges()).select("i", "j", r6("value", "value"))


@query("random_walk_matrix", "select e.node i, e.other j, round(lanes / length / d, 6) as value from ends e join (select node, sum(lanes / length) d from ends group by 1) k on k.node = e.other union all select node, node, -1.0 from ends group by node", ("ends",))
def random_walk_matrix(x: Tables) -> DataFrame:
    return graph.random_walk_matrix(x.edges()).select("i", "j", r6("value", "value"))


@query("normalised_laplacian", "select e.node i, e.other j, round(-length * lanes / sqrt(a.degree * b.degree), 6) as value from ends e join degrees a on a.node = e.node join degrees b on b.node = e.other union all select node, node, 1.0 from degrees", ("degrees",))
def normalised_laplacian(x: Tables) -> DataFrame:
    return graph.normalised_laplacian(x.edges(), F.col("length") * F.col("lanes")).select("i", "j", r6("value", "value"))


_STEP = "select b.node, 0.8 * coalesce(power(d, -0.5) * (select sum(lanes / length * power(w.d, -0.5) * o.f) from ends e join {0} o on o.node = e.other join w on w.node = e.other where e.node = b.node), 0) + 0.2 * f0 f from b left join w on w.node = b.node"


@query("label_propagation_3", f"{with_tables('ends')}, w as (select node, sum(lanes / length) d from ends group by 1), b as (select distinct node, s_acctbal f0 from ends join supplier on s_suppkey = node), f0_ as (select node, f0 f from b), f1 as ({_STEP.format('f0_')}), f2 as ({_STEP.format('f1')}), f3 as ({_STEP.format('f2')}) select node, round(f, 5) f from f3")
def label_propagation_3(x: Tables) -> DataFrame:
    e = x.edges().withColumn("weight", F.col("lanes") / F.col("length"))
    nodes = e.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    values = x.read("supplier").select(F.col("s_suppkey").alias("node"), F.col("s_acctbal").alias("f")).join(nodes, "node", "left_semi")
    return graph.label_propagation(e, values, 3, 0.8, 0.5).select("node", F.round("f", 5).alias("f"))


@query("degree_histogram", "select degree, count(*) n from (select node, count(*) degree from ends group by 1) group by 1", ("ends",))
def degree_histogram(x: Tables) -> DataFrame:
    return graph.degree_histogram(x.edges())


@query("connected_component_largest", f"{with_tables('ends')}, c as (select distinct node source, node from ends union select c.source, e.other from c join ends e on e.node = c.node), p as (select node, min(source) component from c group by 1), k as (select component from p group by 1 order by count(*) desc, component limit 1) select node from p join k using (component)")
def connected_component_largest(x: Tables) -> DataFrame:
    return graph.largest_component(x.edges())


@query("induced_subgraph", "select u, v, round(length, 6) length, lanes from edges where u % 3 <> 0 and v % 3 <> 0", ("edges",))
def induced_subgraph(x: Tables) -> DataFrame:
    nodes = x.read("supplier").where("s_suppkey % 3 <> 0").select(F.col("s_suppkey").alias("node"))
    return graph.induced_subgraph(x.edges(), nodes).select("u", "v", r6("length", "length"), "lanes")


@query("simple_undirected", "select u, v, round(min(length), 6) length from (select least(node, other) u, greatest(node, other) v, length from ends) group by 1, 2", ("ends",))
def simple_undirected(x: Tables) -> DataFrame:
    return graph.simple_edges(x.ends()).select("u", "v", r6("length", "length"))


@query("prune_to_sensors", f"{with_tables('ends', 'edges')}, {HOPS.format(1)} select u, v from edges where u in (select node from near where source % 20 = 0) and v in (select node from near where source % 20 = 0)")
def prune_to_sensors(x: Tables) -> DataFrame:
    e = x.edges()
    sensors = e.select(F.explode(F.array("u", "v")).alias("node")).distinct().where("node % 20 = 0")
    return graph.pruned_to(e, sensors, 1).select("u", "v")


@query("lane_imputation", "select p_partkey, p_type highway, round(coalesce(lanes, avg(lanes) over (partition by p_type), 1.0), 6) lanes from (select p_partkey, p_type, case when p_size % 7 = 0 then null else cast(p_size as double) end lanes from part)")
def lane_imputation(x: Tables) -> DataFrame:
    lanes = F.when(F.col("p_size") % 7 != 0, F.col("p_size").cast("double"))
    return graph.impute_lanes(x.read("part").select("p_partkey", F.col("p_type").alias("highway"), lanes.alias("lanes"))).select("p_partkey", "highway", r6("lanes", "lanes"))


@query("edge_length_histogram", "select least(k - 1, cast(floor((length - lo) / ((hi - lo) / k)) as bigint)) bin, count(*) n from edges, (select min(length) lo, max(length) hi, cast(floor(sqrt(count(*))) as bigint) k from edges) group by 1", ("edges",))
def edge_length_histogram(x: Tables) -> DataFrame:
    return evaluate.histogram(x.edges(), "length")


# --- scalars and features


@query("mercator_roundtrip", "select id, round((lon / 360 + 0.5) * 256, 6) wx, round((0.5 - ln((1 + s) / (1 - s)) / (4 * pi())) * 256, 6) wy, round(lat, 6) lat, round(lon, 6) lon from (select id, 48 + x lat, 2 + y lon, sin(radians(48 + x)) s from places)", ("places",))
def mercator_roundtrip(x: Tables) -> DataFrame:
    lat, lon = 48 + F.col("x"), 2 + F.col("y")
    wx, wy = S.mercator(lat, lon)
    own = x.places().select("id", wx.alias("wx"), wy.alias("wy"))
    back_lat, back_lon = S.inverse_mercator(F.col("wx"), F.col("wy"))
    return own.select("id", r6("wx", "wx"), r6("wy", "wy"), r6(back_lat, "lat"), r6(back_lon, "lon"))


@query(
    "lambert93_roundtrip",
    """select id, round(700000 + r * sin(turn), 4) x, round(12655612.050 - r * cos(turn), 4) y, round(lat, 8) lat, round(lon, 8) lon from (
        select *, 11754255.426 * exp(-0.7256077650 * (ln(tan(pi() / 4 + radians(lat) / 2) * power((1 - e * sin(radians(lat))) / (1 + e * sin(radians(lat))), e / 2)))) r, 0.7256077650 * radians(lon - 3) turn
        from (select id, 46.5 + 4 * x lat, 3 + 4 * y lon, 0.08181919112 e from places))""",
    ("places",),
)
def lambert93_roundtrip(x: Tables) -> DataFrame:
    own = x.places().select("id", *(c.alias(n) for c, n in zip(S.to_lambert93(46.5 + 4 * F.col("x"), 3 + 4 * F.col("y")), "xy", strict=True)))
    lat, lon = S.lambert93(F.col("x"), F.col("y"))
    return own.select("id", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"), F.round(lat, 8).alias("lat"), F.round(lon, 8).alias("lon"))


@query(
    "pixel_places",
    """select id, round(degrees(2 * atan(exp((0.5 - wy / 256) * 2 * pi())) - pi() / 2), 6) lat, round((wx / 256 - 0.5) * 360, 6) lon,
        round(sqrt(power(degrees(2 * atan(exp((0.5 - wy / 256) * 2 * pi())) - pi() / 2) - 48.85, 2) + power((wx / 256 - 0.5) * 360 - 2.35, 2)) * metres, 3) metres from (
        select id, (id % 800 + floor((2.35 / 360 + 0.5) * 256 * 4096) - 400) / 4096 wx, (id % 600 + floor((0.5 - ln((1 + sin(radians(48.85))) / (1 - sin(radians(48.85)))) / (4 * pi())) * 256 * 4096) - 300) / 4096 wy,
        9840 / sqrt(power(48.87551413370949 - 48.835641353886075, 2) + power(2.2944611276838867 - 2.414628350744604, 2)) metres from places)""",
    ("places",),
)
def pixel_places(x: Tables) -> DataFrame:
    """Where pixels of an image of 600 by 800 around a place are, and how far from its centre in metres."""
    lat, lon = S.pixel_position(F.col("id") % 800, F.col("id") % 600, 48.85, 2.35, 12, (600, 800))
    own = x.places().select("id", lat.alias("lat"), lon.alias("lon"))
    metres = S.distance(F.col("lat"), F.col("lon"), F.lit(48.85), F.lit(2.35)) * S.METRES_PER_DEGREE
    return own.select("id", r6("lat", "lat"), r6("lon", "lon"), F.round(metres, 3).alias("metres"))


def _raster(x: Tables) -> DataFrame:
    k = F.col("p_partkey")
    colour = lambda i: F.element_at(F.array(*[F.lit(v) for v in ([99, 255, 242, 129, 156, 168, 0][0:7], [214, 151, 60, 31, 192, 218, 0], [104, 77, 50, 31, 249, 181, 0])[i]]), (k % 7 + 1).cast("int"))
    return x.read("part").select((k % 100).alias("px"), F.floor(k / 100).alias("py"), *[(colour(i) + (k % 3 - 1)).cast("int").alias(c) for i, c in enumerate("rgb")])


RASTER = "raster as (select p_partkey % 100 px, cast(floor(p_partkey / 100) as bigint) py, [99, 255, 242, 129, 156, 168, 0][p_partkey % 7 + 1] + p_partkey % 3 - 1 r, [214, 151, 60, 31, 192, 218, 0][p_partkey % 7 + 1] + p_partkey % 3 - 1 g, [104, 77, 50, 31, 249, 181, 0][p_partkey % 7 + 1] + p_partkey % 3 - 1 b from part)"


@query("colour_classify", f"with {RASTER} select px, py, case when abs(r - 129) <= 1 and abs(g - 31) <= 1 and abs(b - 31) <= 1 then 4 when abs(r - 242) <= 1 and abs(g - 60) <= 1 and abs(b - 50) <= 1 then 3 when abs(r - 255) <= 1 and abs(g - 151) <= 1 and abs(b - 77) <= 1 then 2 when abs(r - 99) <= 1 and abs(g - 214) <= 1 and abs(b - 104) <= 1 then 1 else 0 end colour from raster")
def colour_classify(x: Tables) -> DataFrame:
    return _raster(x).select("px", "py", S.colour_class(F.col("r"), F.col("g"), F.col("b")).alias("colour"))


@query("water_mask_feature", f"with {RASTER}, water as (select px, py from raster where r = 156 and g = 192 and b = 249) select k.px, round(sum(exp(-sqrt(power(k.px - w.px, 2) + 1.0) / 10)), 6) water from (select distinct px from raster where px % 10 = 0) k, water w group by 1")
def water_mask_feature(x: Tables) -> DataFrame:
    raster = _raster(x)
    water = raster.where(S.is_colour(F.col("r"), F.col("g"), F.col("b"), S.WATER)).groupBy(F.col("px").alias("wx")).agg(F.count(F.lit(1)).alias("n"))
    stations = raster.where("px % 10 = 0").select("px").distinct()
    d = F.sqrt(F.pow(F.col("px") - F.col("wx"), 2) + 1.0)
    return stations.join(F.broadcast(water)).groupBy("px").agg(r6(F.sum(F.col("n") * S.KERNELS["exp_by_scale"](d, 10.0)), "water"))


@query("image_crop", f"with {RASTER} select px - 20 px, py - 5 py, r from raster where px between 20 and 79 and py between 5 and 14")
def image_crop(x: Tables) -> DataFrame:
    return _raster(x).where("px between 20 and 79 and py between 5 and 14").select((F.col("px") - 20).alias("px"), (F.col("py") - 5).alias("py"), F.col("r").cast("long").alias("r"))


@query("hour_week_features", "select event_id, round(cos(2 * pi() / 24 * hour(ts)), 6) cos1, round(sin(2 * pi() / 24 * hour(ts)), 6) sin1, round(power(cos(2 * pi() / 24 * hour(ts)), 2), 6) cos_cos, round(cos(2 * pi() / 24 * hour(ts)) * sin(2 * pi() / 24 * hour(ts)), 6) + 0.0 cos_sin, round(power(sin(2 * pi() / 24 * hour(ts)), 2), 6) sin_sin, (isodow(ts) - 1) weekday, cast(isodow(ts) > 5 as bigint) weekend from events")
def hour_week_features(x: Tables) -> DataFrame:
    own = x.read("events")
    return own.select("event_id", *[r6(c, k) for k, c in S.hour_features(F.hour("ts")).items()], *[c.alias(k) for k, c in S.week_features(F.col("ts")).items()])


@query("weather_broadcast_features", "select c.c_custkey, o.o_orderkey, round(temperature, 6) temperature, wind from orders o join customer c on c.c_custkey = o.o_custkey join weather w on w.d = cast(floor(epoch(o_orderdate) / 86400) as bigint)", ("weather",))
def weather_broadcast_features(x: Tables) -> DataFrame:
    o = x.read("orders").select("o_orderkey", "o_custkey", F.floor(S.seconds_of(F.col("o_orderdate")) / 86400).alias("d"))
    return o.join(x.read("customer").select("c_custkey"), F.col("o_custkey") == F.col("c_custkey")).join(x.weather(), "d").select("c_custkey", "o_orderkey", r6("temperature", "temperature"), "wind")


@query("url_filename_parse", r"select page_id, regexp_extract(url, '^(https?)://', 1) scheme, regexp_extract(url, '://([^/]+)/', 1) host, try_cast(regexp_extract(url, '/([0-9]+)', 1) as bigint) number from pages")
def url_filename_parse(x: Tables) -> DataFrame:
    u = F.col("url")
    return x.read("pages").select("page_id", F.regexp_extract(u, "^(https?)://", 1).alias("scheme"), F.regexp_extract(u, "://([^/]+)/", 1).alias("host"), F.regexp_extract(u, "/([0-9]+)", 1).try_cast("bigint").alias("number"))


@query("unpivot_weather", "select d, name, round(v, 6) as value from weather unpivot (v for name in (temperature, wind_speed))".replace("from weather", "from (select d, temperature, cast(wind as double) wind_speed from weather)"), ("weather",))
def unpivot_weather(x: Tables) -> DataFrame:
    wide = x.weather().select("d", "temperature", F.col("wind").cast("double").alias("wind_speed"))
    return wide.unpivot("d", ["temperature", "wind_speed"], "name", "v").select("d", "name", r6("v", "value"))


@query("string_tools", "select n_nationkey, upper(trim(n_name)) || '_' || n_regionkey tag, regexp_replace(n_name, '[^A-Z]', '', 'g') acronym, cast(regexp_extract('(' || n_nationkey || ', ' || n_regionkey || ')', '\\((\\d+), (\\d+)\\)', 2) as int) col from nation".replace("\\\\", "\\"))
def string_tools(x: Tables) -> DataFrame:
    text = F.concat(F.lit("("), F.col("n_nationkey").cast("string"), F.lit(", "), F.col("n_regionkey").cast("string"), F.lit(")"))
    return x.read("nation").select("n_nationkey", F.concat_ws("_", F.upper(F.trim("n_name")), F.col("n_regionkey").cast("string")).alias("tag"), S.acronym(F.col("n_name")).alias("acronym"), S.pair_of(text)[1].alias("col"))


@query("numeric_tools", "select p_partkey, round(sign(p_retailprice - 1000) * ln(abs(nullif(p_retailprice - 1000, 0))), 6) + 0.0 as signed_log, round_even(p_retailprice, 1) rounded, round(log10(p_retailprice), 6) log10 from part".replace("round(sign", "coalesce(round(sign").replace(", 6) + 0.0", ", 6), 0.0)"))
def numeric_tools(x: Tables) -> DataFrame:
    p = F.col("p_retailprice")
    return x.read("part").select("p_partkey", r6(S.signed_log(p - 1000), "signed_log"), S.round_half_even(p, 1).alias("rounded"), r6(F.log10(p), "log10"))


@query(
    "linspace_grid",
    """select i, j, round(low + i * (high - low) / 4, 6) x, round(power(10, least + j * (most - least) / 3), 6) y
    from (select min(cast(embedding[1] as double)) low, max(cast(embedding[1] as double)) high from embeddings),
         (select floor(log10(min(o_totalprice))) least, ceil(log10(max(o_totalprice))) most from orders), range(5) a(i), range(4) b(j)""",
)
def linspace_grid(x: Tables) -> DataFrame:
    """Even steps between the least and greatest place, and even powers of ten around all prices."""
    ends = x.places().agg(F.min("x").alias("low"), F.max("x").alias("high"))
    a = ends.select(F.posexplode(S.linspace(F.col("low"), F.col("high"), 5)).alias("i", "x")).select(F.col("i").cast("long"), "x")
    powers = x.read("orders").agg(F.floor(F.log10(F.min("o_totalprice"))).alias("least"), F.ceil(F.log10(F.max("o_totalprice"))).alias("most"))
    b = powers.select(F.posexplode(S.logspace(F.col("least"), F.col("most"), 4)).alias("j", "y")).select(F.col("j").cast("long"), "y")
    return a.join(F.broadcast(b)).select("i", "j", r6("x", "x"), r6("y", "y"))


@query("cumulative_energy", "select label, vec_id, round(sum(c * c) over (partition by label order by vec_id) / sum(c * c) over (partition by label), 6) energy from (select vec_id, label, cast(embedding[1] as double) c from embeddings)")
def cumulative_energy(x: Tables) -> DataFrame:
    own = x.read("embeddings").select("vec_id", "label", F.col("embedding")[0].cast("double").alias("c"))
    return P.cumulative_energy(own, "c", "vec_id", ["label"]).select("label", "vec_id", r6("energy", "energy"))


@query("traffic_pollution_corr", "select station, round(corr(z, active), 6) as corr, count(*) n from panel join (select t, count(*) active from pixels where colour > 0 group by 1) using (t) group by 1", ("panel", "pixels"))
def traffic_pollution_corr(x: Tables) -> DataFrame:
    return x.panel().join(traffic.activity(x.pixels()), "t").groupBy("station").agg(r6(F.corr("z", "active"), "corr"), F.count(F.lit(1)).alias("n"))


@query("deterministic_sample", "select event_id from events order by md5(cast(event_id as varchar)), event_id limit 50")
def deterministic_sample(x: Tables) -> DataFrame:
    return x.read("events").orderBy(F.md5(F.col("event_id").cast("string")), "event_id").limit(50).select("event_id")
