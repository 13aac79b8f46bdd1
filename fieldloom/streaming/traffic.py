"""Traffic colours by edge as a stream: the same rows as the batch operator over the same events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import COLOURS


def pixel_stream(spark: SparkSession, folder: str, schema, files_per_trigger: int | None = None) -> DataFrame:
    """Parquet files of (ts, pixel, colour) as they arrive in a folder."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(folder)


def windowed_colour_counts(pixels: DataFrame, edge_pixels: DataFrame, late: str = "1 hour", width: str = "15 minutes", edge: tuple[str, ...] = ("u", "v")) -> DataFrame:
    """(t, edge, colours) for windows of time; pixels is a stream or a table of (ts timestamp, pixel, colour).

    On a stream, state is a counter for each open window and edge; windows close late after the greatest time seen.
    """
    own = pixels.withWatermark("ts", late) if pixels.isStreaming else pixels
    joined = own.where("colour > 0").join(edge_pixels, "pixel")
    counts = joined.groupBy(F.window("ts", width).alias("_w"), *edge).agg(*[F.count_if(F.col("colour") == k).alias(c) for c, (k, _) in COLOURS.items()])
    return counts.select(F.col("_w.start").alias("t"), *edge, *COLOURS)


def latest_colours(pixels: DataFrame, late: str = "1 hour", width: str = "15 minutes") -> DataFrame:
    """(t, pixel, colour): the last colour of each pixel in each window; of equal times, the greatest colour."""
    own = pixels.withWatermark("ts", late) if pixels.isStreaming else pixels
    last = own.groupBy(F.window("ts", width).alias("_w"), "pixel").agg(F.max(F.struct("ts", "colour")).alias("_m"))
    return last.select(F.col("_w.start").alias("t"), "pixel", F.col("_m.colour").alias("colour"))


def run_to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append"):
    """Write all that is there now to Parquet and stop; started again with the same checkpoint, it goes on."""
    q = stream.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def estimate_each_batch(stream: DataFrame, estimate, path: str, checkpoint: str):
    """Apply a fitted estimator (DataFrame to DataFrame) to every micro-batch; a batch that is run again replaces its own folder."""

    def write(batch: DataFrame, number: int) -> None:
        estimate(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    q = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q
