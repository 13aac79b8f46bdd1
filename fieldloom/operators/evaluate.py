"""Metrics of predictions (model, station, t, estimate, truth) and frames behind figures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def metrics(predictions: DataFrame, by: Sequence[str] = ("model", "station")) -> DataFrame:
    """rmse, mb (mean bias), abs_mb, mae, rmsre, cor, coe (1 - sum abs(e) / sum abs(truth - its mean)), medianse, n.

    Rows with a missing estimate or truth are left out. Two aggregates: the mean of the truth is needed first.
    """
    p = predictions.where("estimate is not null and truth is not null")
    mean = p.groupBy(*by).agg(F.avg("truth").alias("_m"))
    e = F.col("estimate") - F.col("truth")
    out = p.join(mean, list(by)).groupBy(*by).agg(
        F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(e).alias("mb"), F.abs(F.avg(e)).alias("abs_mb"), F.avg(F.abs(e)).alias("mae"),
        F.sqrt(F.avg(F.pow(F.try_divide(e, F.col("truth")), 2))).alias("rmsre"), F.corr("estimate", "truth").alias("cor"),
        (1 - F.sum(F.abs(e)) / F.nullif(F.sum(F.abs(F.col("truth") - F.col("_m"))), F.lit(0.0))).alias("coe"),
        F.median(e * e).alias("medianse"), F.count(F.lit(1)).alias("n"),
    )
    return out


def histogram(df: DataFrame, value: str) -> DataFrame:
    """(bin, n) over int(sqrt(n)) equal bins from the least to the greatest value, which is in the last."""
    spread = df.agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"), F.greatest(F.lit(1), F.floor(F.sqrt(F.count(value)))).cast("int").alias("_k"))
    width = F.nullif((F.col("_hi") - F.col("_lo")) / F.col("_k"), F.lit(0.0))
    place = F.least(F.col("_k") - 1, F.coalesce(F.floor((F.col(value) - F.col("_lo")) / width), F.lit(0)))
    return df.where(F.col(value).isNotNull()).join(F.broadcast(spread)).groupBy(place.cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def best_parameter(losses: DataFrame, parameter: str, loss: str = "loss") -> DataFrame:
    """The parameter with the least mean loss; of equals, the least."""
    mean = losses.groupBy(parameter).agg(F.avg(loss).alias(loss))
    return mean.agg(F.min(F.struct(loss, parameter)).alias("_m")).select(f"_m.{parameter}", f"_m.{loss}")
