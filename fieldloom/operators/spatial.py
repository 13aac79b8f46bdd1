"""Joins by distance. Distances are Euclidean in the units of the coordinates.

A pure distance predicate becomes a nested loop in Spark. Where a radius or a cell size is known, points are put into
cells and joined on them, so the plan is a hash or sort-merge join that AQE can split. A side is broadcast only after
its rows are counted.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import distance, segment_distance
from . import counted, sparse
from .components import checkpointed
from .kernels import kernel_sums
from .panel import running_mean_by_rank

#: A side of up to this many rows is broadcast for a nested loop; beyond, cells are used.
SMALL_SIDE = 20_000


#: Up to this many nodes or edges are met by every point in a search for the nearest.
FEW = 1_000


def is_small(df: DataFrame, most: int | None = None, side: int | None = None) -> bool:
    side = SMALL_SIDE if side is None else side
    most = side if most is None else min(most, side)
    return df.limit(most + 1).count() <= most


def all_pairs(a: DataFrame, b: DataFrame) -> DataFrame:
    """(a.*, b.*, d) of two tables of (id, x, y) whose columns end in _a and _b.

    The smaller side is broadcast if it is small; of larger ones b is, up to PAIR_ROWS rows, and a is dealt over the
    tasks, so that nothing is stored on the way; beyond, both are dealt in blocks and each block meets each (the result
    has that many rows anyhow).
    """
    left = a.select(*[F.col(c).alias(f"{c}_a") for c in a.columns])
    right = b.select(*[F.col(c).alias(f"{c}_b") for c in b.columns])
    pairs = left.join(F.broadcast(right)) if is_small(b) else F.broadcast(left).join(right) if is_small(a) else _large_pairs(left, right)
    return pairs.withColumn("d", distance(F.col("x_a"), F.col("y_a"), F.col("x_b"), F.col("y_b")))


#: Rows of a table that is broadcast because each of them meets each of another large one.
PAIR_ROWS = 500_000


def _large_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    if not is_small(right, side=PAIR_ROWS):
        return left.hint("shuffle_replicate_nl").join(right)
    return left.repartition(2 * left.sparkSession.sparkContext.defaultParallelism).join(F.broadcast(right))


#: Rows of a table of places that every task holds: two numbers, an id and a value each, 32 bytes.
HELD_ROWS = 2_000_000
#: Distances that a task works on at once, 16 MB.
DISTANCES = 2_000_000


def per_point(points: DataFrame, nodes: DataFrame, make: Callable, schema: str) -> DataFrame:
    """make(ids, distances, node ids, z) of blocks of points (id, x, y) and all nodes (id, x, y, z), for what needs every pair.

    Pairs exist in a task's block alone: nodes go to all tasks, points are dealt over them, and nothing is shuffled but
    the points. At most HELD_ROWS nodes; rows without a place must be left out before.
    """
    table = nodes.select("id", "x", "y", "z").toArrow()
    held = nodes.sparkSession.sparkContext.broadcast([table.column(c).to_numpy() for c in ("id", "x", "y", "z")])
    own = checkpointed(points.select("id", "x", "y"))
    width = max(1, DISTANCES // max(table.num_rows, 1))

    def run(frames):
        other, bx, by, z = held.value
        for df in frames:
            x, y = df["x"].to_numpy(), df["y"].to_numpy()
            for a in range(0, len(df), width):
                own = slice(a, a + width)
                yield make(df["id"].to_numpy()[own], np.sqrt((x[own, None] - bx) ** 2 + (y[own, None] - by) ** 2), other, z)

    return sparse.dealt(own, own.count()).mapInPandas(run, schema)


def holds(df: DataFrame) -> bool:
    """Whether a table of places can go to all tasks: few rows, whole numbers as ids, and a place for every row."""
    return dict(df.dtypes)["id"] in ("int", "bigint") and is_small(df, HELD_ROWS, HELD_ROWS) and df.where(F.col("id").isNull() | ~_placed()).isEmpty()


def distance_stats(places: DataFrame) -> DataFrame:
    """(id, nearest, mean, median) of the distances from each of (id, x, y) to those of other ids; exact, so all pairs are looked at."""
    if not holds(places):
        pairs = all_pairs(places, places).where("id_a <> id_b")
        return pairs.groupBy(F.col("id_a").alias("id")).agg(F.min("d").alias("nearest"), F.avg("d").alias("mean"), F.median("d").alias("median"))
    once = checkpointed(places.select("id", "x", "y"))
    if once.count() > once.select("id").distinct().count():
        pairs = all_pairs(once, once).where("id_a <> id_b")
        return pairs.groupBy(F.col("id_a").alias("id")).agg(F.min("d").alias("nearest"), F.avg("d").alias("mean"), F.median("d").alias("median"))

    def make(ids, d, other, _):
        import pandas as pd

        n = len(other) - 1
        place = np.argsort(other, kind="stable")
        d[np.arange(len(ids)), place[np.searchsorted(other, ids, sorter=place)]] = np.inf  # itself comes last
        if not n:
            return pd.DataFrame({"id": ids[:0], "nearest": 0.0, "mean": 0.0, "median": 0.0})
        middle = np.partition(d, sorted({(n - 1) // 2, n // 2}), axis=1)
        median = (middle[:, (n - 1) // 2] + middle[:, n // 2]) / 2
        return pd.DataFrame({"id": ids, "nearest": d.min(1), "mean": np.where(np.isinf(d), 0.0, d).sum(1) / n, "median": median})

    return per_point(once, once.withColumn("z", F.lit(0.0)), make, f"id {dict(once.dtypes)['id']}, nearest double, mean double, median double")


def running_means(points: DataFrame, nodes: DataFrame) -> DataFrame:
    """(point, id, running_mean): for each point, the mean z of the nodes up to each by distance, then id. A row a pair."""
    if not (holds(points) and holds(nodes) and nodes.where("z is null").isEmpty()):
        pairs = all_pairs(points, nodes).select(F.col("id_a").alias("point"), F.col("id_b").alias("id"), F.col("z_b").alias("z"), "d")
        return running_mean_by_rank(pairs, "z", ["d", "id"], ["point"]).select("point", "id", "running_mean")
    kinds = dict(points.dtypes)["id"], dict(nodes.dtypes)["id"]

    def make(ids, d, other, z):
        import pandas as pd

        by = np.stack([np.lexsort((other, row)) for row in d])
        return pd.DataFrame({"point": np.repeat(ids, len(other)), "id": other[by].ravel(), "running_mean": (np.cumsum(z[by], axis=1) / np.arange(1, len(other) + 1)).ravel()})

    return per_point(points, nodes, make, f"point {kinds[0]}, id {kinds[1]}, running_mean double")


#: Strips of a radius.
STRIPS = 64


def disc_sums(points: DataFrame, nodes: DataFrame, radius: float) -> DataFrame:
    """(id, weights, sums): how many nodes (x, y, z) lie within radius of each point (id, x, y), the radius included, and the sum of their z.

    Every task holds the nodes by strips of y, sorted by x. What of a strip is inside the disc for all the strip's heights
    comes from sums up to a place; only nodes in a thin ring are looked at one by one.
    """
    table = nodes.select("x", "y", "z").toArrow()
    x, y, z = (table.column(c).to_numpy() for c in ("x", "y", "z"))
    h, x0, y0 = radius / STRIPS, x.min(), y.min()
    strip = np.floor((y - y0) / h).astype(np.int64)
    by = np.lexsort((x, strip))
    span = 4 * (x.max() - x0 + radius + 1)
    number, place = np.unique(strip[by], return_inverse=True)  # strips that hold nodes
    starts = np.append(np.searchsorted(strip[by], number), len(by))
    held = nodes.sparkSession.sparkContext.broadcast((x[by], y[by], z[by], number, starts, place * span + (x[by] - x0), np.append(0.0, np.cumsum(z[by]))))
    kind = dict(points.dtypes)["id"]

    def sums(px, py):
        x, y, z, number, starts, key, upto = held.value
        n, total = np.zeros(len(px)), np.zeros(len(px))
        slack = 1e-9 * (radius + span + span * len(number))
        first, last = (np.searchsorted(number, np.floor((py + a * (radius + h) - y0) / h)) for a in (-1, 1))
        m = np.maximum(last + 1 - first, 0)
        at = np.repeat(np.arange(len(px)), m)
        s = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m) + np.repeat(first, m)
        at, s = at[s < len(number)], s[s < len(number)]
        low = y0 + number[s] * h - py[at]
        near, far = np.maximum(np.maximum(low, -low - h) - slack, 0), np.maximum(np.abs(low), np.abs(low + h)) + slack
        reach = near <= radius
        at, s, near, far = at[reach], s[reach], near[reach], far[reach]
        outer, inner = np.sqrt(radius**2 - near**2) + slack, np.sqrt(np.maximum(radius**2 - far**2, 0)) - slack
        middle = s * span + (px[at] - x0)
        bound = lambda v: np.searchsorted(key, v).clip(starts[s], starts[s + 1])
        a, d = bound(middle - outer), bound(middle + outer)
        whole = inner > 0
        b = np.where(whole, bound(middle - inner), d)
        c = np.where(whole, np.maximum(bound(middle + inner), b), d)
        np.add.at(n, at, c - b)
        np.add.at(total, at, upto[c] - upto[b])
        for f, e in ((a, b), (c, d)):
            m = e - f
            ends = np.cumsum(m)
            for i in range(0, len(m), 50_000):  # the ring, in pieces
                own = slice(i, i + 50_000)
                k = m[own]
                j = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k) + np.repeat(f[own], k)
                p = np.repeat(at[own], k)
                inside = np.sqrt((px[p] - x[j]) ** 2 + (py[p] - y[j]) ** 2) <= radius
                n += np.bincount(p[inside], minlength=len(px))
                total += np.bincount(p[inside], weights=z[j[inside]], minlength=len(px))
        return n, total

    def run(frames):
        import pandas as pd

        for df in frames:
            for a in range(0, len(df), 1_000):
                own = df.iloc[a : a + 1_000]
                n, total = sums(own["x"].to_numpy(), own["y"].to_numpy())
                yield pd.DataFrame({"id": own["id"].to_numpy(), "weights": n, "sums": total})

    own = checkpointed(points.select("id", "x", "y"))
    each = sparse.dealt(own, own.count()).mapInPandas(run, f"id {kind}, weights double, sums double")
    return each.groupBy("id").agg(F.sum("weights").alias("weights"), F.sum("sums").alias("sums"))


def disc_mean(points: DataFrame, nodes: DataFrame, radius: float) -> DataFrame:
    """(id, estimate): the mean z of the nodes within radius, the radius included; null if there are none."""
    whole = nodes.where(F.col("z").isNull() | F.isnan("z")).isEmpty() and not nodes.isEmpty()
    if not (whole and holds(nodes) and points.where(F.col("id").isNull() | ~_placed()).isEmpty()):
        pairs = all_pairs(points, nodes).withColumn("_w", F.when(F.col("d") <= radius, 1.0).otherwise(0.0))
        sums = pairs.groupBy(F.col("id_a").alias("id")).agg(F.sum("_w").alias("weights"), F.sum(F.col("_w") * F.col("z_b")).alias("sums"))
    else:
        sums = disc_sums(points, nodes, radius)
    return sums.select("id", (F.col("sums") / F.nullif("weights", F.lit(0.0))).alias("estimate"))


def cell(v: Column, size: float) -> Column:
    return F.floor(v / size).cast("long")


def radius_join(a: DataFrame, b: DataFrame, radius: float) -> DataFrame:
    """all_pairs with d < radius, by an equi-join on cells: each row of a looks into the nine cells around its own."""
    around = F.array(*[F.struct((cell(F.col("x_a"), radius) + i).alias("i"), (cell(F.col("y_a"), radius) + j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    left = a.select(*[F.col(c).alias(f"{c}_a") for c in a.columns]).withColumn("_cell", F.explode(around))
    right = b.select(*[F.col(c).alias(f"{c}_b") for c in b.columns]).withColumn("_cell", F.struct(cell(F.col("x_b"), radius).alias("i"), cell(F.col("y_b"), radius).alias("j")))
    d = distance(F.col("x_a"), F.col("y_a"), F.col("x_b"), F.col("y_b"))
    return left.join(right, "_cell").drop("_cell").withColumn("d", d).where(F.col("d") < radius)


def _nearest_of(pairs: DataFrame, points: DataFrame) -> DataFrame:
    keep = [f"{c}_a" for c in points.columns]
    return pairs.groupBy(*keep).agg(F.min(F.struct("d", "id_b")).alias("_m")).select(*[F.col(f"{c}_a").alias(c) for c in points.columns], F.col("_m.id_b").alias("nearest"), F.col("_m.d").alias("d"))


def _placed(x: str = "x", y: str = "y") -> Column:
    """Whether both coordinates are numbers."""
    return F.col(x).isNotNull() & F.col(y).isNotNull() & ~F.isnan(x) & ~F.isnan(y)


def _settled(points: DataFrame, others: DataFrame, size: float, found_in, columns: dict[str, str]) -> DataFrame:
    """points with what found_in(points, size) finds near them, for sizes that double until all are settled.

    A point is settled by what is no farther than size, for found_in sees all that near. Points without a place, and all
    points if there are no others, get nulls; so the search ends once size spans all places.
    """
    placed = points.where(_placed())
    done = points.where(~_placed()).select("*", *[F.lit(None).cast(k).alias(c) for c, k in columns.items()])
    if others.isEmpty():
        return done.unionByName(placed.select("*", *[F.lit(None).cast(k).alias(c) for c, k in columns.items()]))
    todo = placed
    while True:
        found = checkpointed(found_in(todo, size).where(F.col("d") <= size))
        done = done.unionByName(found)
        todo = checkpointed(todo.join(found.select("id"), "id", "left_anti"))
        if todo.isEmpty():
            return done
        size *= 2


def _box(df: DataFrame) -> tuple[float, float, float, float, int]:
    """x0, x1, y0, y1 and number of the rows with a place."""
    r = df.where(_placed()).agg(F.min("x"), F.max("x"), F.min("y"), F.max("y"), F.count(F.lit(1))).first()
    return tuple(r) if r[4] else (0.0, 0.0, 0.0, 0.0, 0)


def _side(box: tuple[float, float, float, float, int]) -> float:
    """The side of cells that hold one of the rows on average, if they are spread evenly."""
    w, h, n = box[1] - box[0], box[3] - box[2], max(box[4], 1)
    return max((w * h / n) ** 0.5, max(w, h) / n) or 1.0


def _cell_size(points: DataFrame, nodes: DataFrame, most: float | None) -> float:
    """A side of cells, at most so long, in which points meet few nodes: halved until they meet FEW_MET on average.

    Both are counted by cell, so a check is a join of counts. nodes have each place once, so that halving ends.
    """
    size = _side(_box(nodes))
    size = size if most is None else min(size, most)
    n = max(points.count(), 1)
    by = lambda df, name: df.groupBy(cell(F.col("x"), size).alias("i"), cell(F.col("y"), size).alias("j")).agg(F.count(F.lit(1)).alias(name))
    for _ in range(40):
        met = by(points, "p").join(by(nodes, "q"), ["i", "j"]).agg(F.sum(F.col("p") * F.col("q"))).first()[0] or 0
        if met <= FEW_MET * n:
            break
        size /= 2
    return size


#: Nodes in a point's own cell, on average over the points.
FEW_MET = 4


def nearest(points: DataFrame, nodes: DataFrame, size: float | None = None, cells: bool = False) -> DataFrame:
    """points with the id of the nearest node and its distance; of equals, the least id. Both have (id, x, y).

    Few nodes are broadcast, unless cells says otherwise. Else points look into the cells around them; those that find a
    node no farther than a cell's size are settled, the others try again with cells of twice the size. Cells start at
    size at most, smaller where nodes are dense, so that a point meets few nodes however many there are. Points without
    a place (null or NaN) get null, nodes without one are no node's nearest.
    """
    nodes = nodes.where(_placed())
    if not cells and is_small(nodes, FEW):
        near = _nearest_of(all_pairs(points.where(_placed()), nodes), points)
        kinds = {c: k for c, k in near.dtypes if c in ("nearest", "d")}
        if nodes.isEmpty():
            return points.select("*", *[F.lit(None).cast(k).alias(c) for c, k in kinds.items()])
        return near.unionByName(points.where(~_placed()).select("*", *[F.lit(None).cast(k).alias(c) for c, k in kinds.items()]))
    kinds = {"nearest": dict(nodes.dtypes)["id"], "d": "double"}
    # of the nodes at one place only the least can be nearest
    nodes = checkpointed(nodes.groupBy("x", "y").agg(F.min("id").alias("id")).select("id", "x", "y"))
    points = checkpointed(points)
    start = _cell_size(points.where(_placed()), nodes, size)
    # radius_join has what is nearer than its radius; a node at exactly the size is found with a hair more
    return _settled(points, nodes, start, lambda todo, s: _nearest_of(radius_join(todo, nodes, s * (1 + 1e-9)), points), kinds)


#: Sides of cells of edges, in radii that points look around.
EDGE_CELL = 8


def nearest_edge(points: DataFrame, edges: DataFrame, size: float | None = None, cells: bool = False) -> DataFrame:
    """points (id, x, y) with the nearest edge (u, v) of (u, v, ax, ay, bx, by) and its distance; of equals, the least (u, v).

    As nearest: few edges are broadcast; many lie in the cells that they cross, as far as points are near, and points look
    into the cells within a radius that is a share of a cell's size, at first (at most size) with one point a cell.
    """
    edges = edges.where(_placed("ax", "ay") & _placed("bx", "by"))
    d = segment_distance(*[F.col(c) for c in ("x", "y", "ax", "ay", "bx", "by")])
    best = lambda pairs, most: pairs.withColumn("d", d).where(F.col("d") <= most).groupBy("id", "x", "y").agg(F.min(F.struct("d", "u", "v")).alias("_m")).select("id", "x", "y", F.col("_m.u").alias("u"), F.col("_m.v").alias("v"), F.col("_m.d").alias("d"))
    kinds = {"u": dict(edges.dtypes)["u"], "v": dict(edges.dtypes)["v"], "d": "double"}
    points = points.select("id", "x", "y")
    if not cells and is_small(edges, FEW):
        return _settled(points, edges, float("inf"), lambda todo, s: best(todo.join(F.broadcast(edges)), s), kinds)
    points, edges = checkpointed(points), checkpointed(edges)
    box = _box(points)
    start = _side(box) / EDGE_CELL
    start = start if size is None else min(start, size)

    def found_in(todo: DataFrame, r: float) -> DataFrame:
        s, reach = r * EDGE_CELL, r * (1 + 1e-9)
        x0, x1, y0, y1 = box[0] - 2 * r, box[1] + 2 * r, box[2] - 2 * r, box[3] + 2 * r
        slack = lambda v: (F.abs(v) + s) * 1e-9
        low, high = F.greatest(F.least("ax", "bx"), F.lit(x0)), F.least(F.greatest("ax", "bx"), F.lit(x1))
        placed = edges.withColumns({"_from": cell(low - slack(low), s), "_to": cell(high + slack(high), s)}).where(F.col("_from") <= F.col("_to"))
        placed = placed.withColumn("_i", F.explode(F.sequence("_from", "_to")))
        # the edge's height where it enters and leaves the column of cells; an upright edge is in one column with all of it
        slope = F.try_divide(F.col("by") - F.col("ay"), F.col("bx") - F.col("ax"))
        at = lambda x: F.col("ay") + slope * (F.greatest(F.least("ax", "bx"), F.least(F.greatest("ax", "bx"), x)) - F.col("ax"))
        left, right = F.col("_i") * s, (F.col("_i") + 1) * s
        left, right = left - slack(left), right + slack(right)
        steep = F.abs(F.col("bx") - F.col("ax")) <= s * 1e-6
        bottom = F.when(steep, F.least("ay", "by")).otherwise(F.least(at(left), at(right)))
        top = F.when(steep, F.greatest("ay", "by")).otherwise(F.greatest(at(left), at(right)))
        placed = placed.withColumns({"_from": cell(F.greatest(bottom - slack(bottom), F.lit(y0)), s), "_to": cell(F.least(top + slack(top), F.lit(y1)), s)}).where(F.col("_from") <= F.col("_to"))
        placed = placed.withColumn("_j", F.explode(F.sequence("_from", "_to"))).drop("_from", "_to")
        span = lambda c: F.explode(F.sequence(cell(F.col(c) - reach - slack(F.col(c)), s), cell(F.col(c) + reach + slack(F.col(c)), s)))
        return best(todo.withColumn("_i", span("x")).withColumn("_j", span("y")).join(placed, ["_i", "_j"]), r)

    return _settled(points, edges, start, found_in, kinds)


def nearest_cell(v: Column, start: float, step: float, n: int) -> Column:
    """Index of the nearest of n grid lines start + k * step; halfway goes to the lower."""
    return F.greatest(F.lit(0), F.least(F.lit(n - 1), F.ceil((v - start) / step - 0.5))).cast("long")


def radius_mean(points: DataFrame, values: DataFrame, radius: float) -> DataFrame:
    """(id, mean, n): the mean of z over the rows of values (id, x, y, z) nearer than radius."""
    return radius_join(points, values, radius).groupBy(F.col("id_a").alias("id")).agg(F.avg("z_b").alias("mean"), F.count("z_b").alias("n"))


def kernel_mean(points: DataFrame, values: DataFrame, kernel: Callable[[Column], Column], cut: float | None = None, smooth: Callable | None = None) -> DataFrame:
    """(id, estimate): values weighted by kernel(d), over all of values or those nearer than cut.

    smooth is the kernel on numpy arrays, if it is smooth away from distance 0; many values are then summed by cells.
    """
    if smooth is not None and cut is None and not is_small(values):
        return kernel_sums(points, values, [smooth]).select("id", (F.col("sums") / F.col("weights")).alias("estimate"))
    pairs = all_pairs(points, values) if cut is None else radius_join(points, values, cut)
    weighted = pairs.withColumn("_w", kernel(F.col("d")))
    return weighted.groupBy(F.col("id_a").alias("id")).agg((F.sum(F.col("_w") * F.col("z_b")) / F.sum("_w")).alias("estimate"))


#: Counts of pixels that a task holds; rows that a task gives.
COUNTS, SUMS = 500_000, 1_000_000
#: Points beyond which a matrix of counts is held by the tasks (some 25 MB a million); its counts and columns, at most; points of a task.
MANY_POINTS, HELD_COUNTS, HELD_COLUMNS, CELL_POINTS = 5_000, 4_000_000, 4_000, 2_000


def _weighted_counts(points: DataFrame, counts: DataFrame, kernel: Callable, names: list[str], pieces: int, rows: int) -> DataFrame:
    """(point, t, names): sums of kernel(d) * count over counts (piece, t, x, y, names), whose pieces meet parts of the points.

    rows is the number of pairs of a point and a t. A time may be in several pieces; then it has as many rows.
    """
    at_once = points.sparkSession.sparkContext.defaultParallelism
    parts = max(math.ceil(rows / pieces / SUMS), math.ceil(2 * at_once / pieces))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    own = points.select("id", "x", "y", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int").alias("part")).withColumn("piece", each(pieces))
    other = counts.select("piece", "t", "x", "y", *names).withColumn("part", each(parts))

    def run(points, counts):
        import pandas as pd

        counts = counts.sort_values("t", kind="stable")
        times, starts = np.unique(counts["t"].to_numpy(), return_index=True)
        ends = np.append(starts[1:], len(counts))
        values = counts[names].to_numpy(dtype=float)
        if not len(times) or not len(points):
            return pd.DataFrame({"point": points["id"][:0], "t": counts["t"][:0], **{c: values[:0, 0] for c in names}})
        places, of = np.unique(counts[["x", "y"]].to_numpy(dtype=float), axis=0, return_inverse=True)
        of = of.ravel()
        x, y = points["x"].to_numpy(), points["y"].to_numpy()
        out = np.zeros((len(points), len(times), len(names)))
        width = max(1, min(256, DISTANCES // len(places)))
        for a in range(0, len(x), width):
            w = kernel(np.sqrt((places[:, :1] - x[a : a + width]) ** 2 + (places[:, 1:] - y[a : a + width]) ** 2))
            for k, (b, e) in enumerate(zip(starts, ends, strict=True)):
                for c in range(b, e, 10_000):
                    out[a : a + width, k] += w[of[c : min(c + 10_000, e)]].T @ values[c : min(c + 10_000, e)]
        return pd.DataFrame({"point": np.repeat(points["id"].to_numpy(), len(times)), "t": np.tile(times, len(points)), **{c: out[:, :, k].ravel() for k, c in enumerate(names)}})

    form = f"point {dict(points.dtypes)['id']}, t {dict(counts.dtypes)['t']}, " + ", ".join(f"{c} double" for c in names)
    return own.groupBy("piece", "part").cogroup(other.groupBy("piece", "part")).applyInPandas(run, form)


def _odd(*tables: DataFrame) -> bool:
    """Whether a place isn't finite."""
    finite = lambda c: ~F.isnan(c) & (F.abs(c) < math.inf)
    return any(not df.where(~(finite(F.col("x")) & finite(F.col("y")))).isEmpty() for df in tables)


def _by_held_counts(points: DataFrame, places: DataFrame, some: DataFrame, times: DataFrame, smooth: Callable, names: list[str], normalise: bool, n: int) -> DataFrame:
    """kernel_features where the counts that aren't 0 are held by the tasks and points are dealt by place."""
    spark = points.sparkSession
    table = places.toArrow()
    ids, x, y = (table.column(c).to_numpy() for c in ("id", "x", "y"))
    order = np.argsort(ids)
    ids, x, y = ids[order], x[order].astype(float), y[order].astype(float)
    days = np.sort(times.toArrow().column(0).to_numpy())
    b = points.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    x0, x1, y0, y1 = min(b[0], x.min()), max(b[1], x.max()), min(b[2], y.min()), max(b[3], y.max())
    box = (float(x0), float(y0), float(max(x1 - x0, y1 - y0, 1e-12) * (1 + 1e-9)))
    table = some.select("id", "t", *names).toArrow()
    row, t = np.searchsorted(ids, table.column("id").to_numpy()), np.searchsorted(days, table.column("t").to_numpy())
    rows, columns, values = [], [], []
    for k, c in enumerate(names):
        own = table.column(c).to_numpy()
        kept = np.flatnonzero(own)
        rows.append(row[kept].astype(np.int32))
        columns.append((t[kept] * len(names) + k).astype(np.int32))
        values.append(own[kept].astype(np.float32) if own.max(initial=0.0) < 2**24 else own[kept])
    del table
    if normalise:  # a column of ones for the sum over all places
        rows.append(np.arange(len(ids), dtype=np.int32))
        columns.append(np.full(len(ids), len(days) * len(names), np.int32))
        values.append(np.ones(len(ids), np.float32))
    rows, columns, values = (np.concatenate(v) for v in (rows, columns, values))
    by = np.argsort(rows, kind="stable")
    starts = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=len(ids)))])
    held = counted.Counts(x, y, starts, columns[by], values[by], len(days) * len(names) + normalise, box, counted.depth_of(x, y, box))
    shared = spark.sparkContext.broadcast((held, days))
    id_kind, t_kind = dict(points.dtypes)["id"], dict(times.dtypes)["t"]
    # cells of some points; those of more are dealt into several
    level = min(3, held.depth)
    cell = [F.floor((F.col(c) - o) / (box[2] / 2**level)).alias(a) for c, o, a in (("x", box[0], "_i"), ("y", box[1], "_j"))]
    own = points.select("id", "x", "y", *cell)
    sizes = own.groupBy("_i", "_j").agg(F.ceil(F.count(F.lit(1)) / CELL_POINTS).alias("_parts"))
    own = checkpointed(own.join(F.broadcast(sizes), ["_i", "_j"]).withColumn("_part", F.pmod(F.xxhash64("id"), F.col("_parts"))))

    def run(df):
        import pandas as pd

        held, days = shared.value
        sums = held.sums(df["x"].to_numpy(), df["y"].to_numpy(), smooth)
        if normalise:
            sums = sums[:, :-1] / sums[:, -1:]
        sums = sums.reshape(len(df), len(days), len(names))
        return pd.DataFrame({"point": np.repeat(df["id"].to_numpy(), len(days)), "t": np.tile(days, len(df)), **{c: sums[:, :, k].ravel() for k, c in enumerate(names)}})

    form = f"point {id_kind}, t {t_kind}, " + ", ".join(f"{c} double" for c in names)
    tasks = max(1, own.select("_i", "_j", "_part").distinct().count())
    return own.repartition(min(4 * tasks, 1000), "_i", "_j", "_part").groupBy("_i", "_j", "_part").applyInPandas(run, form)


def _features_by_parts(points: DataFrame, pixels: DataFrame, smooth: Callable, colours: dict[str, int], normalise: bool) -> DataFrame | None:
    """kernel_features without a row for a pair of point and pixel; None where ids or places are missing or not unique."""
    names = list(colours)
    counts = checkpointed(pixels.groupBy("id", "x", "y", "t").agg(*[F.count_if(F.col("colour") == k).cast("double").alias(c) for c, k in colours.items()]))
    points = checkpointed(points.select("id", "x", "y"))
    places = checkpointed(counts.select("id", "x", "y").distinct())
    unique = lambda df: df.where(F.col("id").isNull() | ~_placed()).isEmpty() and df.count() == df.select("id").distinct().count()
    number = [dict(df.dtypes)[c] in ("int", "bigint") for df, c in ((points, "id"), (counts, "t"))]
    if not (all(number) and unique(points) and unique(places) and counts.where("t is null").isEmpty()):
        return None
    n, times = points.count(), counts.select("t").distinct().count()
    some = counts.where(sum((F.col(c) for c in names), F.lit(0.0)) > 0)
    if n > MANY_POINTS and some.count() <= HELD_COUNTS and times * len(names) <= HELD_COLUMNS and not _odd(points, places):
        return _by_held_counts(points, places, some, counts.select("t").distinct(), smooth, names, normalise, n)
    pieces = max(1, math.ceil(counts.count() / COUNTS))
    sums = _weighted_counts(points, counts.withColumn("piece", F.pmod(F.xxhash64("t"), F.lit(pieces)).cast("int")), smooth, names, pieces, n * times)
    if not normalise:
        return sums
    pieces = max(1, math.ceil(places.count() / COUNTS))
    ones = places.select(F.pmod(F.xxhash64("id"), F.lit(pieces)).cast("int").alias("piece"), F.lit(0).alias("t"), "x", "y", F.lit(1.0).alias("_all"))
    total = _weighted_counts(points, ones, smooth, ["_all"], pieces, n * pieces).groupBy("point").agg(F.sum("_all").alias("_all"))
    return sums.join(total, "point").select("point", "t", *[(F.col(c) / F.col("_all")).alias(c) for c in names])


def kernel_features(points: DataFrame, pixels: DataFrame, kernel: Callable[[Column], Column], colours: dict[str, int], normalise: bool = False, cut: float | None = None, smooth: Callable | None = None) -> DataFrame:
    """Per point and t, the kernel's sum over the pixels (id, x, y, t, colour) of each colour; optionally by its sum over all pixels.

    With cut, only pixels nearer than that count, found by cells. A pixel's colours of one t are counted first.
    smooth is the kernel on numpy arrays; with it, and without cut, pairs of points and pixels stay inside the tasks.
    """
    if smooth is not None and cut is None:
        found = _features_by_parts(points, pixels, smooth, colours, normalise)
        if found is not None:
            return found
    places = pixels.select("id", "x", "y").distinct()
    pairs = all_pairs(points, places) if cut is None else radius_join(points, places, cut)
    weights = pairs.withColumn("_w", kernel(F.col("d"))).select(F.col("id_a").alias("point"), F.col("id_b").alias("id"), "_w")
    total = weights.groupBy("point").agg(F.sum("_w").alias("_all"))
    sums = pixels.select("id", "t", "colour").join(weights, "id").groupBy("point", "t").agg(*[F.sum(F.when(F.col("colour") == k, F.col("_w")).otherwise(0.0)).alias(c) for c, k in colours.items()])
    if not normalise:
        return sums
    return sums.join(total, "point").select("point", "t", *[(F.col(c) / F.col("_all")).alias(c) for c in colours])
