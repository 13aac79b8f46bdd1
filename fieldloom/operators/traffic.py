"""Traffic: colours of pixels, counted by edge, passed to nodes and their surroundings.

traffic_edge is (t, u, v, green, yellow, red, dark_red) with u < v; both directions of a street are summed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import COLOURS
from .graph import both_ways, k_hop, weighted_degree

NAMES = tuple(COLOURS)


def colour_counts(traffic_pixel: DataFrame, edge_pixels: DataFrame, edge: tuple[str, ...] = ("u", "v"), pixel: tuple[str, ...] = ("pixel",)) -> DataFrame:
    """Pixels of each colour by time and edge; edge and pixel name their keys."""
    joined = traffic_pixel.where("colour > 0").join(edge_pixels, list(pixel))
    return joined.groupBy("t", *edge).agg(*[F.count_if(F.col("colour") == k).alias(c) for c, (k, _) in COLOURS.items()])


def activity(traffic_pixel: DataFrame) -> DataFrame:
    """(t, active): pixels with a colour."""
    return traffic_pixel.where("colour > 0").groupBy("t").agg(F.count(F.lit(1)).alias("active"))


def edge_norm(traffic_edge: DataFrame, least_one: bool = True) -> DataFrame:
    """(u, v, norm): the most pixels of any colour that an edge had at once."""
    most = F.max(sum((F.col(c) for c in NAMES), F.lit(0)))
    return traffic_edge.groupBy("u", "v").agg((F.greatest(F.lit(1), most) if least_one else most).alias("norm"))


def linear(traffic_edge: DataFrame, weights: dict[str, float]) -> Column:
    return sum((F.col(c) * w for c, w in weights.items()), F.lit(0.0))


def node_source(traffic_edge: DataFrame, edges: DataFrame, normalise: bool = False) -> DataFrame:
    """(t, node, colours): the sum over a node's edges of q * length * lanes / 2 / degree; q is by edge norm if normalised."""
    own = traffic_edge.join(edges, ["u", "v"])
    if normalise:
        own = own.join(edge_norm(traffic_edge), ["u", "v"])
        own = own.select("t", "u", "v", "length", "lanes", *[(F.col(c) / F.col("norm")).alias(c) for c in NAMES])
    half = F.col("length") * F.col("lanes") / 2
    ends = own.select("t", F.explode(F.array("u", "v")).alias("node"), *[(F.col(c) * half).alias(c) for c in NAMES])
    sums = ends.groupBy("t", "node").agg(*[F.sum(c).alias(c) for c in NAMES])
    return sums.join(weighted_degree(edges), "node").select("t", "node", *[F.try_divide(F.col(c), F.col("degree")).alias(c) for c in NAMES])


def area_weighted_hops(traffic_edge: DataFrame, edges: DataFrame, hops: int) -> DataFrame:
    """(t, node, depth, colours): over the edges that leave the nodes at each depth, sum of q / norm * area / max(1, area); area is lanes * length."""
    near = k_hop(edges, edges.select(F.explode(F.array("u", "v")).alias("node")).distinct(), hops)
    area = F.col("lanes") * F.col("length")
    leaving = both_ways(edges.select("u", "v")).join(edges.select("u", "v", area.alias("area")).unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"), area.alias("area"))), ["u", "v"])
    leaving = leaving.select(F.col("u").alias("node"), F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), "area")
    reach = near.join(leaving, "node").select(F.col("source").alias("node"), "depth", "u", "v", "area")
    share = traffic_edge.join(edge_norm(traffic_edge), ["u", "v"])
    each = reach.join(share, ["u", "v"])
    total = F.greatest(F.lit(1.0), F.sum("area"))
    return each.groupBy("t", "node", "depth").agg(*[(F.sum(F.col(c) / F.col("norm") * F.col("area")) / total).alias(c) for c in NAMES])


def decayed_hops(traffic_edge: DataFrame, edges: DataFrame, hops: int, tau: float, gamma: float) -> DataFrame:
    """(t, node, colours): sum over edges within reach of tau^depth * q / norm * area / deg(u)^gamma / deg(v)^(1 - gamma), u the nearer end."""
    degree = weighted_degree(edges)
    near = k_hop(edges, edges.select(F.explode(F.array("u", "v")).alias("node")).distinct(), hops)
    area = (F.col("lanes") * F.col("length")).alias("area")
    ways = both_ways(edges.select("u", "v", "length", "lanes")).select(F.col("u").alias("node"), F.col("v").alias("other"), area)
    each = near.join(ways, "node").join(degree.withColumnRenamed("degree", "_du"), "node").join(degree.select(F.col("node").alias("other"), F.col("degree").alias("_dv")), "other")
    weight = F.pow(F.lit(tau), F.col("depth")) * F.col("area") / F.pow("_du", F.lit(gamma)) / F.pow("_dv", F.lit(1 - gamma))
    reach = each.select(F.col("source"), F.least("node", "other").alias("u"), F.greatest("node", "other").alias("v"), weight.alias("_w"))
    share = traffic_edge.join(edge_norm(traffic_edge), ["u", "v"])
    return reach.join(share, ["u", "v"]).groupBy("t", F.col("source").alias("node")).agg(*[F.sum(F.col("_w") * F.col(c) / F.col("norm")).alias(c) for c in NAMES])
