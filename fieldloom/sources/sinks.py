"""Stage tables, parameters and results as Parquet, found again by a key of inputs and parameters."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def stage_key(name: str, parameters: dict) -> str:
    """A name with a digest of the parameters, which should name the inputs' versions too."""
    return f"{name}-{hashlib.sha256(json.dumps(parameters, sort_keys=True, default=str).encode()).hexdigest()[:16]}"


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def stage(spark: SparkSession, folder: str, name: str, parameters: dict, make: Callable[[], DataFrame], recalculate: bool = False) -> DataFrame:
    """The table under this key; made and written first if it is not there, or only in part."""
    path = f"{folder.rstrip('/')}/{stage_key(name, parameters)}"
    if recalculate or not exists(spark, path):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def write_predictions(predictions: DataFrame, path: str) -> None:
    """(model, station, t, estimate, truth), a folder for each model; the models given replace their folders only."""
    predictions.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("model").parquet(path)


def read_predictions(spark: SparkSession, path: str, models: list[str] | None = None) -> DataFrame:
    from pyspark.sql import functions as F

    out = spark.read.parquet(path)
    return out if models is None else out.where(F.col("model").isin(models))


def write_run_info(spark: SparkSession, path: str, values: dict) -> None:
    spark.createDataFrame([(k, str(v)) for k, v in values.items()], "key string, value string").coalesce(1).write.mode("append").parquet(path)


def write_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_model(parameters, path: str) -> None:
    """What an estimator's fit gave: a table, a pyspark.ml model, or a list of these; complete once its table kind is there."""
    spark, path = SparkSession.active(), path.rstrip("/")
    if isinstance(parameters, list):
        kind, size = "list", len(parameters)
        for k, x in enumerate(parameters):
            write_model(x, f"{path}/{k}")
    elif isinstance(parameters, DataFrame):
        kind, size = "table", 1
        write_table(parameters, f"{path}/table")
    else:
        kind, size = "model", 1
        parameters.write().overwrite().save(f"{path}/model")
    write_table(spark.createDataFrame([(kind, size)], "kind string, size int"), f"{path}/kind")


def has_model(spark: SparkSession, path: str) -> bool:
    return exists(spark, f"{path.rstrip('/')}/kind")


def read_model(spark: SparkSession, path: str):
    from pyspark.ml import PipelineModel

    path = path.rstrip("/")
    own = spark.read.parquet(f"{path}/kind").first()
    if own.kind == "list":
        return [read_model(spark, f"{path}/{k}") for k in range(own.size)]
    return spark.read.parquet(f"{path}/table") if own.kind == "table" else PipelineModel.load(f"{path}/model")
