"""Regressors beside the node source, held against pandas."""

import numpy as np
import pandas as pd

from fieldloom.operators import traffic
from fieldloom.plans import catalog, models
from fieldloom.plans.bindings import Tables

SF = "/root/testdata/sf0.001"


def test_hours_weather_and_means_are_there(spark):
    x = Tables(spark, SF)
    e = models._component(x)
    features, names = models._extra(x, e)
    got = features.toPandas().set_index(["t", "station"]).sort_index()
    assert {"weekend", "cos1", "sin1", "cos_cos", "cos_sin", "temperature", "wind", "avg_pollution", "avg_red", "avg_nodes_red"} <= set(names)

    nodes = {n for r in e.collect() for n in (r.u, r.v)}
    events = pd.read_parquet(f"{SF}/events.parquet")
    events = events[events.user_id.isin(nodes)]
    t = ((events.ts - pd.Timestamp(0)) // pd.Timedelta("1D")).astype(int)
    angle = 2 * np.pi * events.ts.dt.hour / 24
    own = pd.DataFrame({"t": t, "station": events.user_id.astype(str), "z": events.value, "cos1": np.cos(angle), "sin1": np.sin(angle), "cos_cos": np.cos(angle) ** 2, "cos_sin": np.cos(angle) * np.sin(angle)})
    own = own.groupby(["t", "station"]).mean()
    assert list(got.index) == list(own.sort_index().index)
    own = own.loc[got.index]

    q = traffic.node_source(x.traffic_edge(), e).toPandas()
    q = q.assign(station=q.node.astype(str)).set_index(["t", "station"])["red"]
    own["red"] = q.reindex(own.index).fillna(0.0)
    own["avg_red"] = (q.groupby("t").sum() / len(nodes)).reindex(own.index.get_level_values("t")).fillna(0.0).to_numpy()
    days = own.groupby("t")
    size = days["z"].transform("size") - 1
    own["avg_nodes_red"] = (days["red"].transform("sum") - own["red"]) / size.where(size > 0)
    own["avg_pollution"] = (days["z"].transform("sum") - own["z"]) / size.where(size > 0)

    orders = pd.read_parquet(f"{SF}/orders.parquet")
    by_day = orders.groupby(orders.o_orderdate.dt.strftime("%m-%d"))
    day = (pd.Timestamp(0) + pd.to_timedelta(own.index.get_level_values("t"), "D")).strftime("%m-%d")
    own["temperature"] = by_day["o_totalprice"].mean().reindex(day).to_numpy()
    own["wind"] = (by_day.size() / by_day["o_orderdate"].agg(lambda d: d.dt.year.nunique())).reindex(day).to_numpy()
    for c in set(own) - {"z"}:
        assert np.allclose(got[c].astype(float), own[c].astype(float), atol=1e-9, equal_nan=True), c


def test_scores_of_every_sensor(spark):
    x = Tables(spark, SF)
    e = models._component(x)
    _, future = models._split_days(models._node_panel(x, e))
    want = {r.station for r in future.select("station").distinct().collect()}
    got = catalog.QUERIES["source_with_extra_regressors"](spark, SF).collect()
    assert {r.station for r in got} == want and all(r.rmse is not None and np.isfinite(r.rmse) for r in got)
