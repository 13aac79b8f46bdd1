"""Connected components of an edge table, by alternating star contractions."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder, which all executors share.

    It is the cluster's spark.checkpoint.dir. Where that is unset, a local session (tests, the bench) gets a
    temporary folder; a cluster raises, since its executors would not find each other's files there.
    """
    context = spark.sparkContext
    if not context.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="fieldloom-"))
    return context.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """Write df once to the shared checkpoint folder and cut its lineage."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is joined to the least of the node and its neighbours."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    # from a checkpoint, so that the join has an exchange of its own, which AQE can split where a node is a hub
    least = checkpointed(both.groupBy("u").agg(F.min("v").alias("_m")))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.least("u", "_m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node and its smaller neighbours are joined to the least of them. Edges go from the larger node."""
    least = checkpointed(edges.groupBy("u").agg(F.min("v").alias("_m")))
    moved = edges.join(least, "u").where("v <> _m").select(F.col("v").alias("u"), F.col("_m").alias("v"))
    return moved.unionByName(least.select("u", F.col("_m").alias("v"))).distinct()


def connected_components(edges: DataFrame, src: str = "u", dst: str = "v", max_rounds: int = 60) -> DataFrame:
    """node, component (its least node) for every node with an edge to another; self-loops, repeats and nulls are ignored.

    Each round is two aggregates with map-side combine and two joins; the edges never outgrow the input and end as one
    star for each component, after a number of rounds that grows with the logarithm of the longest path. Rounds are cut
    by checkpoints. Nothing but one count a round comes to the driver.
    """
    a, b = F.col(src), F.col(dst)
    now = checkpointed(edges.where(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    for _ in range(max_rounds):
        after = checkpointed(_small_star(_large_star(now)))
        # stars: no node is both a centre and a leaf, and no leaf has two centres
        leaves = after.groupBy("u").agg(F.count(F.lit(1)).alias("_n"))
        open_ends = leaves.where("_n > 1").select("u").unionByName(after.join(leaves.select(F.col("u").alias("v")), "v", "left_semi").select("u"))
        now = after
        if open_ends.isEmpty():
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    centres = now.select(F.col("v").alias("node")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(centres.withColumn("component", F.col("node")))
