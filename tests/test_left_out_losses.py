"""Penalties by leave-one-station-out: the same whether the stations' sums come to the driver or stay in the tasks."""

import numpy as np
import pytest

from fieldloom.operators import estimators as E


def data(spark):
    rng = np.random.default_rng(3)
    rows = [(t, f"s{i}", float(rng.normal() + 0.3 * (i % 4)), float(rng.normal()), float(t % 7)) for t in range(12) for i in range(40) if (t + i) % 5]
    df = spark.createDataFrame(rows, "t long, station string, z double, f0 double, f1 double")
    return df.select("t", "station", "z"), df.select("t", "station", "f0", "f1")


@pytest.mark.parametrize("kind", ["lasso", "positive_lasso"])
def test_stations_stay_in_the_tasks(spark, monkeypatch, kind):
    panel, features = data(spark)
    e = E.Regression(features, ("f0", "f1"), kind, 2, residual=False)
    want = {r.term: (r.weight, r.alpha) for r in e.fit(panel).collect()}
    kind_of = type(panel)
    most, collect = [], kind_of.collect
    monkeypatch.setattr(E, "HELD_STATIONS", 0)
    monkeypatch.setattr(E, "LOSS_ROWS", 7)

    def counted(self):
        rows = collect(self)
        most.append(len(rows))
        return rows

    def none(self):
        raise AssertionError("stations come to the driver")

    monkeypatch.setattr(kind_of, "collect", counted)
    monkeypatch.setattr(kind_of, "toPandas", none)
    got = e.fit(panel)
    monkeypatch.undo()
    assert most and max(most) <= 30 < 40
    got = {r.term: (r.weight, r.alpha) for r in got.collect()}
    assert got.keys() == want.keys() and all(np.allclose(got[t], want[t], rtol=1e-9, atol=1e-12) for t in want)
