"""How the driver's tables stand for panels, pixels, positions and a street graph: as DataFrames, and as SQL of the same.

Every table is used whole. An embedding gives a place by its first two numbers and a node by its next two; stations lie
at the mean place of a label. The street graph joins each supplier to the PARTNERS suppliers that it shares most orders
with, over all orders: a graph of few streets a node at every size.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import hour_of
from ..operators import graph
from ..operators.components import checkpointed

#: Streets that start at a node (those that end there come on top).
PARTNERS = 2
#: Lines of orders in one part of the join that counts pairs of suppliers: some 1.5 million pairs.
PART_LINES = 250_000

SQL = {
    "panel": "panel as (select cast(floor(epoch(ts) / 3600) as bigint) t, event_type station, avg(value) z from events group by 1, 2)",
    "sparse": "sparse as (select cast(floor(epoch(ts) / 3600) as bigint) t, 's' || (user_id % 10) station, avg(value) z from events group by 1, 2)",
    "pixels": "pixels as (select cast(floor(epoch(ts) / 3600) as bigint) t, user_id pixel, cast(regexp_extract(props, '([0-9]+)', 1) as int) % 5 colour from events)",
    "places": "places as (select vec_id id, cast(embedding[1] as double) x, cast(embedding[2] as double) y, cast(label as double) z from embeddings)",
    "nodes": "nodes as (select vec_id id, cast(embedding[3] as double) x, cast(embedding[4] as double) y, cast(label as double) z from embeddings)",
    "points": "points as (select id, x, y from places)",
    "positions": "positions as (select 's' || cast(z as bigint) station, avg(x) x, avg(y) y from places group by 1)",
    "edges": f"""pairs as (
        select p.l_suppkey u, q.l_suppkey v, count(*) lanes from lineitem p join lineitem q on p.l_orderkey = q.l_orderkey where p.l_suppkey < q.l_suppkey group by 1, 2),
    partners as (select a, b, lanes, row_number() over (partition by a order by lanes desc, b) k from (select u a, v b, lanes from pairs union all select v, u, lanes from pairs)),
    edges as materialized (
        select u, v, abs(a.s_acctbal - b.s_acctbal) + 1 length, cast(lanes as double) lanes
        from (select distinct least(a, b) u, greatest(a, b) v, lanes from partners where k <= {PARTNERS}) e
        join supplier a on a.s_suppkey = u join supplier b on b.s_suppkey = v)""",
    "ends": "ends as (select u node, v other, length, lanes from edges union all select v, u, length, lanes from edges)",
    "degrees": "degrees as (select node, sum(length * lanes) degree from ends group by 1)",
    "edge_pixels": "edge_pixels as (select u, v, (u * 31 + v * 17) % 150 pixel from edges)",
    "traffic_edge": """traffic_edge as (
        select cast(floor(t / 24) as bigint) t, u, v, count(*) filter (colour = 1) green, count(*) filter (colour = 2) yellow, count(*) filter (colour = 3) red, count(*) filter (colour = 4) dark_red
        from pixels join edge_pixels using (pixel) where colour > 0 group by 1, 2, 3)""",
    "edge_norm": "edge_norm as (select u, v, greatest(1, max(green + yellow + red + dark_red)) norm from traffic_edge group by 1, 2)",
    "node_field": """field as (
        select q.t, n.node, sum((q.green * 0.1 + q.yellow * 0.3 + q.red * 0.7 + q.dark_red * 1.5) * n.length * n.lanes / 2) / max(d.degree) z
        from traffic_edge q join ends n on q.u = least(n.node, n.other) and q.v = greatest(n.node, n.other) join degrees d on d.node = n.node group by 1, 2)""",
    "weather": "weather as (select cast(floor(epoch(o_orderdate) / 86400) as bigint) d, avg(o_totalprice) temperature, count(*) wind from orders group by 1)",
}
NEEDS = {
    "points": ("places",), "positions": ("places",), "ends": ("edges",), "degrees": ("ends",), "edge_pixels": ("edges",),
    "traffic_edge": ("pixels", "edge_pixels"), "edge_norm": ("traffic_edge",), "node_field": ("traffic_edge", "ends", "degrees"),
}


def with_tables(*names: str) -> str:
    """A WITH clause of these tables and what they need."""
    order: list[str] = []

    def put(name: str) -> None:
        for need in NEEDS.get(name, ()):
            put(need)
        if name not in order:
            order.append(name)

    for name in names:
        put(name)
    return "with recursive " + ", ".join(SQL[n] for n in order)


class Tables:
    """The same tables as DataFrames over one folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir, self._edges = spark, sf_dir, None

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def _by_hour(self, station) -> DataFrame:
        return self.read("events").groupBy(hour_of(F.col("ts")).alias("t"), station.alias("station")).agg(F.avg("value").alias("z"))

    def panel(self) -> DataFrame:
        return self._by_hour(F.col("event_type"))

    def sparse(self) -> DataFrame:
        return self._by_hour(F.concat(F.lit("s"), (F.col("user_id") % 10).cast("string")))

    def pixels(self) -> DataFrame:
        return self.read("events").select(hour_of(F.col("ts")).alias("t"), F.col("user_id").alias("pixel"), (F.regexp_extract("props", "([0-9]+)", 1).cast("int") % 5).alias("colour"))

    def places(self) -> DataFrame:
        e = F.col("embedding")
        return self.read("embeddings").select(F.col("vec_id").alias("id"), e[0].cast("double").alias("x"), e[1].cast("double").alias("y"), F.col("label").cast("double").alias("z"))

    def nodes(self) -> DataFrame:
        e = F.col("embedding")
        return self.read("embeddings").select(F.col("vec_id").alias("id"), e[2].cast("double").alias("x"), e[3].cast("double").alias("y"), F.col("label").cast("double").alias("z"))

    def points(self) -> DataFrame:
        return self.places().drop("z")

    def positions(self) -> DataFrame:
        return self.places().groupBy(F.concat(F.lit("s"), F.col("z").cast("long").cast("string")).alias("station")).agg(F.avg("x").alias("x"), F.avg("y").alias("y"))

    def edges(self) -> DataFrame:
        """Written once for a query, since plans use them often. Lines are dealt by order, and pairs (both ways) by their
        first supplier, into as many parts as the lines need, so that a task's sort and counts stay as small at any size.
        """
        if self._edges is None:
            read = self.read("lineitem").select("l_orderkey", "l_suppkey")
            parts = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(read.count() / PART_LINES))
            lines = read.repartition(parts, "l_orderkey")
            pairs = lines.withColumnRenamed("l_suppkey", "u").join(lines.withColumnRenamed("l_suppkey", "v"), "l_orderkey").where("u <> v")
            pairs = pairs.select("u", "v").repartition(parts, "u").groupBy("u", "v").agg(F.count(F.lit(1)).cast("double").alias("lanes"))
            best = Window.partitionBy("u").orderBy(F.desc("lanes"), "v")
            partners = pairs.withColumn("_k", F.row_number().over(best)).where(F.col("_k") <= PARTNERS)
            found = partners.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), "lanes").distinct()
            s = self.read("supplier")
            a, b = s.select(F.col("s_suppkey").alias("u"), F.col("s_acctbal").alias("_a")), s.select(F.col("s_suppkey").alias("v"), F.col("s_acctbal").alias("_b"))
            self._edges = checkpointed(found.join(a, "u").join(b, "v").select("u", "v", (F.abs(F.col("_a") - F.col("_b")) + 1).alias("length"), "lanes"))
        return self._edges

    def edge_pixels(self) -> DataFrame:
        return self.edges().select("u", "v", ((F.col("u") * 31 + F.col("v") * 17) % 150).alias("pixel"))

    def traffic_edge(self) -> DataFrame:
        from ..operators.traffic import colour_counts

        days = self.pixels().withColumn("t", F.floor(F.col("t") / 24))
        return colour_counts(days, self.edge_pixels())

    def weather(self) -> DataFrame:
        from ..functions.scalars import seconds_of

        return self.read("orders").groupBy(F.floor(seconds_of(F.col("o_orderdate")) / 86400).alias("d")).agg(F.avg("o_totalprice").alias("temperature"), F.count(F.lit(1)).alias("wind"))

    def weather_by_calendar_day(self) -> DataFrame:
        """(_day, temperature, wind): the weather of a month's day, such as 01-15: the mean price over all years' orders and the mean number of orders of a year that has some."""
        read = self.read("orders")
        rows = read.groupBy(F.date_format("o_orderdate", "MM-dd").alias("_day"), F.year("o_orderdate").alias("_year")).agg(F.sum("o_totalprice").alias("_s"), F.count("o_totalprice").alias("_n"), F.count(F.lit(1)).alias("_w"))
        return rows.where("_day is not null").groupBy("_day").agg(F.try_divide(F.sum("_s"), F.sum("_n")).alias("temperature"), F.avg("_w").alias("wind"))

    def ends(self) -> DataFrame:
        return graph.both_ways(self.edges())
