"""Graphs as edge tables. Simple undirected edges are (u, v) with u < v and weights; directed ones have both ways.

Matrices are tall (i, j, value). Spectra and dense solves (numpy) are for graphs whose nodes are counted first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import checkpointed, connected_components

#: Nodes of a graph that is collected for dense linear algebra.
DENSE_NODES = 5_000


def simple_edges(edges: DataFrame) -> DataFrame:
    """Undirected edges once, least node first, without loops; of parallel edges the shortest, then of most lanes.

    Raises if a length or a number of lanes is missing.
    """
    if not edges.where("length is null or lanes is null").isEmpty():
        raise ValueError("every edge must have length and lanes")
    own = edges.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), F.struct("length", (-F.col("lanes")).alias("_l")).alias("_k"))
    best = own.groupBy("u", "v").agg(F.min("_k").alias("_k"))
    return best.select("u", "v", F.col("_k.length").alias("length"), (-F.col("_k._l")).alias("lanes"))


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.withColumns({"u": F.col("v"), "v": F.col("u")}))


def node_set(edges: DataFrame) -> DataFrame:
    """(node): each node with an edge once."""
    return edges.select(F.explode(F.array("u", "v")).alias("node")).distinct()


def impute_lanes(edges: DataFrame) -> DataFrame:
    """Missing lanes become the mean of the edge's highway kind, or 1 without a kind or a mean. lanes and highway may be lists: summed, first."""
    kinds = dict(edges.dtypes)
    out = edges
    if kinds["lanes"].startswith("array"):
        out = out.withColumn("lanes", F.aggregate("lanes", F.lit(0.0), lambda a, x: a + x.try_cast("double")))
    if kinds["highway"].startswith("array"):
        out = out.withColumn("highway", F.get("highway", F.lit(0)))
    means = out.groupBy("highway").agg(F.avg("lanes").alias("_mean"))
    return out.join(means, "highway", "left").withColumn("lanes", F.coalesce("lanes", "_mean", F.lit(1.0))).drop("_mean")


def weighted_degree(edges: DataFrame, weight: Column | None = None) -> DataFrame:
    """(node, degree): the sum of the weights (length * lanes) of a node's edges."""
    w = F.col("length") * F.col("lanes") if weight is None else weight
    ends = edges.withColumn("_w", w).select(F.explode(F.array("u", "v")).alias("node"), "_w")
    return ends.groupBy("node").agg(F.sum("_w").alias("degree"))


def adjacency(edges: DataFrame, weight: Column) -> DataFrame:
    return both_ways(edges.withColumn("value", weight).select("u", "v", "value")).select(F.col("u").alias("i"), F.col("v").alias("j"), "value")


def _with_diagonal(off: DataFrame, diagonal: DataFrame) -> DataFrame:
    return off.unionByName(diagonal.select(F.col("i"), F.col("i").alias("j"), "value"))


def laplacian(edges: DataFrame, weight: Column) -> DataFrame:
    """D - A."""
    a = adjacency(edges, weight)
    return _with_diagonal(a.withColumn("value", -F.col("value")), a.groupBy("i").agg(F.sum("value").alias("value")))


def mass_matrix(edges: DataFrame) -> DataFrame:
    """length / 6 off the diagonal, the sum of lengths / 3 on it."""
    a = adjacency(edges, F.col("length") / 6)
    return _with_diagonal(a, a.groupBy("i").agg((2 * F.sum("value")).alias("value")))


def diffusion_matrix(edges: DataFrame) -> DataFrame:
    return laplacian(edges, 1 / F.col("length"))


def random_walk_matrix(edges: DataFrame) -> DataFrame:
    """A / degree of the column - I, with weight lanes / length."""
    a = adjacency(edges, F.col("lanes") / F.col("length"))
    degree = a.groupBy("j").agg(F.sum("value").alias("_d"))
    off = a.join(degree, "j").select("i", "j", (F.col("value") / F.col("_d")).alias("value"))
    return _with_diagonal(off, degree.select(F.col("j").alias("i"), F.lit(-1.0).alias("value")))


def normalised_laplacian(edges: DataFrame, weight: Column) -> DataFrame:
    """I - D^-1/2 A D^-1/2."""
    a = adjacency(edges, weight)
    d = a.groupBy("i").agg(F.sum("value").alias("_d"))
    off = a.join(d, "i").join(d.select(F.col("i").alias("j"), F.col("_d").alias("_e")), "j")
    off = off.select("i", "j", (-F.col("value") / F.sqrt(F.col("_d") * F.col("_e"))).alias("value"))
    return _with_diagonal(off, d.select("i", F.lit(1.0).alias("value")))


def k_hop(edges: DataFrame, start: DataFrame, hops: int) -> DataFrame:
    """(source, node, depth): every node within so many hops of the sources (a column node), itself at depth 0.

    A breadth-first front is joined to the edges hop by hop; nodes already reached are taken out, so rows are pairs,
    not paths.
    """
    ways = both_ways(edges.select("u", "v"))
    reached = start.select(F.col("node").alias("source"), "node", F.lit(0).alias("depth")).distinct()
    front = reached
    for depth in range(1, hops + 1):
        step = front.join(ways, F.col("node") == F.col("u")).select("source", F.col("v").alias("node")).distinct()
        front = step.join(reached.select("source", "node"), ["source", "node"], "left_anti").withColumn("depth", F.lit(depth))
        if depth < hops:
            front = checkpointed(front)
        reached = reached.unionByName(front)
    return reached


def hop_mean(edges: DataFrame, values: DataFrame, hops: int, by: tuple[str, ...] = ("t",)) -> DataFrame:
    """(node, *by, mean) of the values (node, *by, z) within so many hops, the node's own among them."""
    near = k_hop(edges, values.select("node"), hops).select("source", "node")
    return near.join(values, "node").groupBy(F.col("source").alias("node"), *by).agg(F.avg("z").alias("mean"))


def label_propagation(edges: DataFrame, values: DataFrame, rounds: int, share: float, decay: float, checkpoint_every: int = 4) -> DataFrame:
    """(node, f): f <- share * d^-decay * A (d^(decay - 1) f) + (1 - share) * f0, so many rounds; d is the weighted degree.

    edges have a column weight; nodes without edges keep (1 - share) * f0.
    """
    a = checkpointed(adjacency(edges, F.col("weight")))
    d = a.groupBy("i").agg(F.sum("value").alias("_d"))
    base = checkpointed(values.select("node", F.col("f").alias("_f0")).join(d.withColumnRenamed("i", "node"), "node", "left"))
    now = base.select("node", F.col("_f0").alias("f"), "_d")
    for k in range(1, rounds + 1):
        sent = a.join(now.select(F.col("node").alias("j"), (F.pow("_d", F.lit(decay - 1)) * F.col("f")).alias("_m")), "j")
        got = sent.groupBy(F.col("i").alias("node")).agg(F.sum(F.col("value") * F.col("_m")).alias("_s"))
        now = base.join(got, "node", "left").select("node", (share * F.coalesce(F.pow("_d", F.lit(-decay)) * F.col("_s"), F.lit(0.0)) + (1 - share) * F.col("_f0")).alias("f"), "_d")
        if k % checkpoint_every == 0:
            now = checkpointed(now)
    return now.select("node", "f")


def largest_component(edges: DataFrame) -> DataFrame:
    """node of the component with most nodes; of equals, the one with the least node."""
    parts = checkpointed(connected_components(edges))
    top = parts.groupBy("component").agg(F.count(F.lit(1)).alias("_n")).orderBy(F.desc("_n"), "component").limit(1)
    return parts.join(F.broadcast(top.select("component")), "component", "left_semi").select("node")


def induced_subgraph(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The edges with both ends among nodes."""
    left = edges.join(nodes.select(F.col("node").alias("u")), "u", "left_semi")
    return left.join(nodes.select(F.col("node").alias("v")), "v", "left_semi").select(*edges.columns)


def pruned_to(edges: DataFrame, sensors: DataFrame, hops: int) -> DataFrame:
    return induced_subgraph(edges, k_hop(edges, sensors, hops).select("node").distinct())


def degree_histogram(edges: DataFrame) -> DataFrame:
    """(degree, n) by number of edges."""
    return weighted_degree(edges, F.lit(1)).groupBy("degree").agg(F.count(F.lit(1)).alias("n"))


def gnn_layer(edges: DataFrame, features: DataFrame, self_weight: float, neighbour_weight: float) -> DataFrame:
    """One message-passing step on (node, feature, value): a weighted sum of a node's value and its neighbours' mean, through a rectifier."""
    ways = both_ways(edges.select("u", "v"))
    got = ways.join(features.withColumnRenamed("node", "v"), "v").groupBy(F.col("u").alias("node"), "feature").agg(F.avg("value").alias("_m"))
    return features.join(got, ["node", "feature"], "left").select("node", "feature", F.greatest(F.lit(0.0), self_weight * F.col("value") + neighbour_weight * F.coalesce("_m", F.lit(0.0))).alias("value"))


def dense(matrix: DataFrame):
    """(nodes, numpy array) of a tall matrix; raises beyond DENSE_NODES nodes."""
    import numpy as np

    nodes = [r[0] for r in matrix.select("i").distinct().orderBy("i").limit(DENSE_NODES + 1).collect()]
    if len(nodes) > DENSE_NODES:
        raise ValueError(f"more than {DENSE_NODES} nodes; use the iterative operators")
    place = {n: k for k, n in enumerate(nodes)}
    out = np.zeros((len(nodes), len(nodes)))
    for r in matrix.collect():
        out[place[r["i"]], place[r["j"]]] += r["value"]
    return nodes, out
