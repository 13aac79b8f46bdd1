"""Panels: tall tables (t, station, z) of a value by time and place. A missing value is null or no row at all.

t is any ordered type. Nothing here orders a table globally; orders are windows by station or by t.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import null_if_nan


def clean(panel: DataFrame) -> DataFrame:
    """NaN to null."""
    return panel.withColumn("z", null_if_nan(F.col("z")))


def time_range(panel: DataFrame, first, last) -> DataFrame:
    return panel.where(F.col("t").between(first, last))


def stations_with(panel: DataFrame, stations: Sequence[str]) -> DataFrame:
    return panel.where(F.col("station").isin(list(stations)))


def null_ratio(panel: DataFrame) -> DataFrame:
    """station, null_ratio over all times of the panel; a time without a row of the station counts as missing."""
    times = panel.agg(F.count_distinct("t").alias("_n"))
    held = panel.groupBy("station").agg(F.count("z").alias("_held"))
    return held.join(F.broadcast(times)).select("station", (1 - F.col("_held") / F.col("_n")).alias("null_ratio"))


def drop_sparse_stations(panel: DataFrame, most: float = 0.2) -> DataFrame:
    return panel.join(null_ratio(panel).where(F.col("null_ratio") <= most), "station", "left_semi")


def known_stations(panel: DataFrame, positions: DataFrame) -> DataFrame:
    return panel.join(positions, "station", "left_semi")


def inside_box(points: DataFrame, of: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """The points inside the bounding box of another table; the box is one row."""
    box = of.agg(F.min(x).alias("_x0"), F.max(x).alias("_x1"), F.min(y).alias("_y0"), F.max(y).alias("_y1"))
    inside = F.col(x).between(F.col("_x0"), F.col("_x1")) & F.col(y).between(F.col("_y0"), F.col("_y1"))
    return points.join(F.broadcast(box), inside).drop("_x0", "_x1", "_y0", "_y1")


def complete_times(panel: DataFrame) -> DataFrame:
    """t at which every station of the panel has a value."""
    stations = panel.agg(F.count_distinct("station").alias("_n"))
    held = panel.where("z is not null").groupBy("t").agg(F.count_distinct("station").alias("_held"))
    return held.join(F.broadcast(stations), F.col("_held") == F.col("_n")).select("t")


def valid_times(panel: DataFrame, target: str) -> DataFrame:
    """The panel at the times at which the target station has a value."""
    return panel.join(panel.where((F.col("station") == target) & F.col("z").isNotNull()).select("t").distinct(), "t", "left_semi")


def common_times(*tables: DataFrame) -> DataFrame:
    """t that all tables have."""
    out = tables[0].select("t").distinct()
    for other in tables[1:]:
        out = out.join(other.select("t"), "t", "left_semi")
    return out


def union_times(*tables: DataFrame) -> DataFrame:
    out = tables[0].select("t")
    for other in tables[1:]:
        out = out.union(other.select("t"))
    return out.distinct()


def times_except(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("t").distinct().join(b.select("t"), "t", "left_anti")


def quantile_filter(df: DataFrame, column: str, low: float, high: float) -> DataFrame:
    """Rows strictly between two quantiles, interpolated; the quantiles are one row."""
    q = df.agg(F.percentile(column, F.array(F.lit(low), F.lit(high))).alias("_q"))
    return df.join(F.broadcast(q), (F.col(column) > F.col("_q")[0]) & (F.col(column) < F.col("_q")[1])).drop("_q")


def split_by_time(panel: DataFrame, share: float = 0.8) -> DataFrame:
    """The panel with split "past" for the first int(share * n) of its n times, else "future"."""
    times = panel.select("t").distinct()
    n = times.count()  # one number; the cut is then a top-k of times, not a window over all
    k = int(share * n)
    if k == 0:
        return panel.withColumn("split", F.lit("future"))
    cut = times.orderBy("t").limit(k).agg(F.max("t").alias("_cut"))
    return panel.join(F.broadcast(cut)).withColumn("split", F.when(F.col("t") <= F.col("_cut"), "past").otherwise("future")).drop("_cut")


def snapshot(panel: DataFrame, how: str = "mean") -> DataFrame:
    """t, estimate: mean or median over stations."""
    return panel.groupBy("t").agg((F.avg("z") if how == "mean" else F.median("z")).alias("estimate"))


def leave_one_out_mean(panel: DataFrame) -> DataFrame:
    """(t, station, z, estimate): the mean of the other stations at t; null if there is none.

    Sums by t are joined back instead of a window, so that partial sums are made in the map.
    """
    sums = panel.groupBy("t").agg(F.sum("z").alias("_s"), F.count("z").alias("_n"))
    own = F.col("z").isNotNull().cast("int")
    others = F.nullif(F.col("_n") - own, F.lit(0))
    return panel.join(sums, "t").withColumn("estimate", (F.col("_s") - F.coalesce("z", F.lit(0.0))) / others).drop("_s", "_n")


def leave_one_out_folds(panel: DataFrame, held_out: DataFrame) -> DataFrame:
    """The panel once for each held-out station, without it, with a column fold. held_out is a short list of stations."""
    folds = held_out.select(F.col("station").alias("fold"))
    return panel.join(F.broadcast(folds), F.col("station") != F.col("fold"))


def residual(panel: DataFrame) -> DataFrame:
    """z less the mean over stations at its time, as column residual."""
    means = panel.groupBy("t").agg(F.avg("z").alias("_m"))
    return panel.join(means, "t").withColumn("residual", F.col("z") - F.col("_m")).drop("_m")


def first_difference(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    w = Window.partitionBy(*by).orderBy("t")
    return df.withColumn("difference", F.col(value) - F.lag(value).over(w))


def running_mean_by_rank(df: DataFrame, value: str, order: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Mean of value over the rows up to each, by order within by."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn("running_mean", F.avg(value).over(w))


def cumulative_energy(df: DataFrame, coefficient: str, order: str, by: Sequence[str]) -> DataFrame:
    """Share of the summed squares up to each coefficient."""
    w = Window.partitionBy(*by)
    square = F.pow(F.col(coefficient), 2)
    upto = w.orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn("energy", F.sum(square).over(upto) / F.sum(square).over(w))


def past_quantile_rank(past: DataFrame, now: DataFrame) -> DataFrame:
    """(t, station, z, rank): the share of the station's past values below z.

    Both tables are sorted together by station; ties count only past values strictly below.
    """
    both = past.where("z is not null").select("station", "z", F.lit(None).cast(now.schema["t"].dataType).alias("t"), F.lit(1).alias("_past")).unionByName(now.where("z is not null").select("station", "z", "t", F.lit(0).alias("_past")))
    below = Window.partitionBy("station").orderBy("z").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    same = Window.partitionBy("station", "z")
    n = Window.partitionBy("station")
    ranked = both.withColumns({"_below": F.sum("_past").over(below) - F.sum("_past").over(same), "_n": F.sum("_past").over(n)})
    return ranked.where("_past = 0").select("t", "station", "z", (F.col("_below") / F.nullif(F.col("_n"), F.lit(0))).alias("rank"))


def last_rows(df: DataFrame, n: int, order: Column) -> DataFrame:
    """The n last rows by order, which must be unique (a top-k, no global sort)."""
    return df.orderBy(order.desc()).limit(n)


def sorted_snapshot(panel: DataFrame) -> DataFrame:
    """(t, rank, z): the values of each time in rising order."""
    w = Window.partitionBy("t").orderBy("z", "station")
    return panel.where("z is not null").select("t", F.row_number().over(w).cast("long").alias("rank"), "z")


def resample(df: DataFrame, step: int, shift: int, value: str = "z") -> DataFrame:
    """Sums over steps of seconds, labelled by the step's start plus shift; t is in seconds."""
    return df.groupBy((F.floor(F.col("t") / step) * step + shift).alias("t"), "station").agg(F.sum(value).alias(value))


def standardised(df: DataFrame, value: str, by: Sequence[str], how: str = "population") -> DataFrame:
    """(value - mean) / standard deviation within by; a deviation of 0 counts as 1."""
    w = Window.partitionBy(*by)
    sd = F.stddev_pop(value) if how == "population" else F.stddev_samp(value)
    return df.withColumn("standardised", (F.col(value) - F.avg(value).over(w)) / F.coalesce(F.nullif(sd.over(w), F.lit(0.0)), F.lit(1.0)))


def correlations(panel: DataFrame, least: int = 2) -> DataFrame:
    """(a, b, corr, n) for a < b: Pearson over the times that both stations have.

    From pair sums: each time is joined to itself, so rows grow with the stations of a time, squared, not with times.
    """
    left = panel.where("z is not null").select("t", F.col("station").alias("a"), F.col("z").alias("_x"))
    right = panel.where("z is not null").select("t", F.col("station").alias("b"), F.col("z").alias("_y"))
    pairs = left.join(right, "t").where("a < b")
    return pairs.groupBy("a", "b").agg(F.corr("_x", "_y").alias("corr"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row (only_a, only_b): how many rows, repeats counted, each of two tables of the same columns has beyond the other; 0 and 0 if they are equal."""
    both = a.withColumn("_side", F.lit(1)).unionByName(b.withColumn("_side", F.lit(-1)))
    left = both.groupBy(*a.columns).agg(F.sum("_side").alias("_n"))
    return left.agg(*[F.coalesce(F.sum(F.greatest(c, F.lit(0))), F.lit(0)).alias(n) for n, c in (("only_a", F.col("_n")), ("only_b", -F.col("_n")))])


def in_order(df: DataFrame, column: str, names: Sequence[str]) -> DataFrame:
    """df with place, the position of column's value in names, sorted by it; values that names lacks come last, with null."""
    place = F.nullif(F.array_position(F.array(*[F.lit(n) for n in names]), F.col(column)), F.lit(0)) if names else F.lit(None).cast("long")
    return df.withColumn("place", place).orderBy(F.asc_nulls_last("place"), column)
