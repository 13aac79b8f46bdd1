"""Estimators over a grid of models: fitted, kept, scored, and taken up again where a run ended."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import sinks
from .estimators import Estimator, with_truth


def run_models(models: dict[str, Estimator], past: DataFrame, future: DataFrame, folder: str, recalculate: bool = False) -> DataFrame:
    """(model, station, t, estimate, truth, seconds) of all models, one folder a model: parameters, predictions, times.

    A model whose predictions are complete in the folder is read, not run, so that a run that ended is taken up again;
    one whose parameters are there is only applied. The folder stands for these panels: use another for others.
    seconds is what fitting and predicting took when they were done. Models run one after the other, each as Spark jobs
    over all its stations; nothing but the names of models is on the driver.
    """
    spark, out = past.sparkSession, None
    for name, e in models.items():
        base = f"{folder.rstrip('/')}/{name}"
        if recalculate or not sinks.exists(spark, f"{base}/predictions"):
            start = time.perf_counter()
            if recalculate or not sinks.has_model(spark, f"{base}/parameters"):
                sinks.write_model(e.fit(past), f"{base}/parameters")
            predicted = e.predict(sinks.read_model(spark, f"{base}/parameters"), future)
            sinks.write_table(with_truth(predicted, future, name), f"{base}/predictions")
            sinks.write_table(spark.createDataFrame([(time.perf_counter() - start,)], "seconds double"), f"{base}/times")
        took = F.broadcast(spark.read.parquet(f"{base}/times"))
        own = spark.read.parquet(f"{base}/predictions").join(took)
        out = own if out is None else out.unionByName(own)
    return out
