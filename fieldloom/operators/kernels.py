"""Sums of a kernel over all pairs of points and nodes, for kernels that are smooth away from distance 0.

Nodes lie in the leaves of a quadtree of one depth. Near leaves are summed pair by pair. For what is farther, each cell's
nodes are put on a grid of ORDER x ORDER Chebyshev points (its moments), moments go to the cells at the same level whose
parents are neighbours, and a cell's sums on its own grid are interpolated at its points: the black-box multipole method.
Work grows with points and nodes, not with their product; ORDER is high enough for some 12 digits. Leaves, moments and
sums are rows that are joined by cell; nothing whole goes to one task or the driver.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import checkpointed

ORDER, LEAF, DEEPEST = 20, 150, 14
#: A point whose weights sum to less than this share of the kernel's value at 0 is summed pair by pair.
LONELY = 0.01
#: Sums that a task gives at once.
ROWS = 20_000
_CHEB = np.cos((2 * np.arange(ORDER) + 1) * np.pi / (2 * ORDER))
_T = np.cos(np.outer(np.arange(1, ORDER), np.arccos(_CHEB)))


def basis(at: np.ndarray) -> np.ndarray:
    """Values at (places in -1..1) of the polynomials that are 1 at one Chebyshev point and 0 at the others: (places, ORDER)."""
    t = np.cos(np.outer(np.arccos(at.clip(-1, 1)), np.arange(1, ORDER)))
    return 1 / ORDER + 2 / ORDER * t @ _T


def _grid(x: np.ndarray, y: np.ndarray, i: int, j: int, h: float, x0: float, y0: float) -> np.ndarray:
    a, b = basis((x - x0) / h - 2 * i - 1), basis((y - y0) / h - 2 * j - 1)
    return (a[:, :, None] * b[:, None, :]).reshape(len(x), -1)


def _depth(places: DataFrame, cell: Callable, n: int) -> int:
    """The least depth at which a node shares its leaf with LEAF others on average."""
    for depth in range(DEEPEST):
        met = places.groupBy(*cell(depth)).count().agg(F.sum(F.col("count") * F.col("count"))).first()[0]
        if met <= LEAF * n:
            return depth
    return DEEPEST


def kernel_sums(points: DataFrame, nodes: DataFrame, kernels: list[Callable[[np.ndarray], np.ndarray]]) -> DataFrame:
    """(id, k, weights, sums): for each point (id, x, y) and kernel k of distances, the sums of w and of w * z over all nodes (x, y, z).

    Rows without a place or a value are left out. Nodes at one place are one node.
    """
    there = "x is not null and y is not null and not isnan(x) and not isnan(y)"
    places = checkpointed(nodes.where(there).where("z is not null").groupBy("x", "y").agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum("z").alias("z")))
    points = points.where(there)
    kind, number = points.schema["id"].dataType.simpleString(), len(kernels)
    b = points.select("x", "y").unionByName(places.select("x", "y")).agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    n = places.count()
    form = f"id {kind}, k int, weights double, sums double"
    if not n or b[0] is None:
        return points.sparkSession.createDataFrame([], form)
    x0, y0, side = b[0], b[2], max(b[1] - b[0], b[3] - b[2], 1e-12) * (1 + 1e-9)
    cell = lambda depth: [F.floor((F.col(c) - o) / (side / 2**depth)).cast("long").alias(a) for c, o, a in (("x", x0, "i"), ("y", y0, "j"))]
    depth = _depth(places, cell, n)
    sources = checkpointed(places.withColumns(dict(zip("ij", cell(depth), strict=True))).groupBy("i", "j").agg(*[F.collect_list(c).alias(f"s{c}") for c in ("x", "y", "n", "z")]))
    # a leaf of many points is many rows, so that no row is large
    part = F.pmod(F.xxhash64("id"), F.lit(max(1, points.count() // 1000))).alias("part") if depth == 0 else F.pmod(F.xxhash64("id"), F.lit(4)).alias("part")
    targets = checkpointed(points.select("id", "x", "y", part).withColumns(dict(zip("ij", cell(depth), strict=True))).groupBy("i", "j", "part").agg(*[F.collect_list(c).alias(c) for c in ("id", "x", "y")]))

    def _frame(ids, found):
        import pandas as pd

        ids = np.concatenate(ids)
        f = np.concatenate(found, axis=1)  # (kernel, point, 2)
        return pd.DataFrame({"id": np.tile(ids, number), "k": np.repeat(np.arange(number, dtype=np.int32), len(ids)), "weights": f[:, :, 0].ravel(), "sums": f[:, :, 1].ravel()})

    def near(frames):
        ids, found, held = [], [], 0
        for df in frames:
            for own, x, y, sx, sy, sn, sz in zip(*[df[c] for c in ("id", "x", "y", "sx", "sy", "sn", "sz")], strict=True):
                weights = np.stack([sn, sz], axis=1)
                for a in range(0, len(own), 256):
                    d = np.sqrt((x[a : a + 256, None] - sx[None]) ** 2 + (y[a : a + 256, None] - sy[None]) ** 2)
                    ids.append(own[a : a + 256])
                    found.append(np.stack([k(d) @ weights for k in kernels]))
                    held += len(ids[-1])
                    if held > ROWS:
                        yield _frame(ids, found)
                        ids, found, held = [], [], 0
        if held:
            yield _frame(ids, found)

    span = lambda c: F.explode(F.sequence(F.col(c) - 1, F.col(c) + 1))
    around = sources.withColumn("i", span("i")).withColumn("j", span("j"))
    out = targets.join(around, ["i", "j"]).select("id", "x", "y", "sx", "sy", "sn", "sz").mapInPandas(near, form)
    add = lambda df: df.groupBy("id", "k").agg(F.sum("weights").alias("weights"), F.sum("sums").alias("sums"))
    if depth < 2:
        return add(out)
    out = checkpointed(add(out.unionByName(_far(sources, targets, kernels, depth, side, x0, y0, _frame, form))))
    # a point far from all nodes has sums that are small beside a grid's error; it meets every node
    top = F.element_at(F.array(*[F.lit(float(k(np.zeros(1))[0])) for k in kernels]), F.col("k") + 1)
    lonely = checkpointed(out.where(F.col("weights") < LONELY * top).select("id").distinct())
    if lonely.isEmpty():
        return out
    own = points.join(lonely, "id", "left_semi").groupBy(F.pmod(F.xxhash64("id"), F.lit(1 + lonely.count() // 200)).alias("part"))
    own = own.agg(*[F.collect_list(c).alias(c) for c in ("id", "x", "y")]).crossJoin(sources).select("id", "x", "y", "sx", "sy", "sn", "sz")
    return out.join(lonely, "id", "left_anti").unionByName(add(own.mapInPandas(near, form)))


def _far(sources: DataFrame, targets: DataFrame, kernels: list, depth: int, side: float, x0: float, y0: float, frame: Callable, form: str) -> DataFrame:
    p2, number = ORDER * ORDER, len(kernels)

    def moments(frames):
        import pandas as pd

        for df in frames:
            out = []
            for r in df.itertuples():
                weights = np.stack([r.sn, r.sz], axis=1)
                for level in range(2, depth + 1):
                    i, j = r.i >> (depth - level), r.j >> (depth - level)
                    out.append((level, i, j, (_grid(r.sx, r.sy, i, j, side / 2**level / 2, x0, y0).T @ weights).tobytes()))
            yield pd.DataFrame(out, columns=["level", "i", "j", "m"])

    def added(key, df):
        import pandas as pd

        return pd.DataFrame([(*key, sum(np.frombuffer(m) for m in df["m"]).tobytes())], columns=["level", "i", "j", "m"])

    cells = "level int, i long, j long, m binary"
    sums = sources.mapInPandas(moments, cells).groupBy("level", "i", "j").applyInPandas(added, cells)
    # to the cells whose parents are neighbours, without a cell's own neighbours
    span = lambda c: F.explode(F.sequence(2 * F.floor(F.col(c) / 2) - 2, 2 * F.floor(F.col(c) / 2) + 3))
    sent = sums.withColumn("ti", span("i")).withColumn("tj", span("j")).where(~((F.abs(F.col("ti") - F.col("i")) <= 1) & (F.abs(F.col("tj") - F.col("j")) <= 1)))
    level = F.explode(F.sequence(F.lit(2), F.lit(depth))).alias("level")
    up = lambda c: F.floor(F.col(c) / F.pow(F.lit(2.0), depth - F.col("level"))).cast("long").alias(f"t{c}")
    wanted = targets.select("i", "j").distinct().select("i", "j", level).select("level", up("i"), up("j")).distinct()
    grid = np.stack(np.meshgrid(_CHEB, _CHEB, indexing="ij"), axis=-1).reshape(p2, 2)
    held: dict = {}

    def local(key, df):
        import pandas as pd

        h = side / 2 ** key[0] / 2
        total = np.zeros((number, p2, 2))
        for i, j, m in zip(df["i"], df["j"], df["m"], strict=True):
            own = (key[0], i - key[1], j - key[2])
            if own not in held:
                if len(held) * number > 40:
                    held.clear()
                d = np.sqrt(((grid[:, None] - grid[None] - 2 * np.array(own[1:])) ** 2).sum(2)) * h
                held[own] = [k(d) for k in kernels]
            m = np.frombuffer(m).reshape(p2, 2)
            for k in range(number):
                total[k] += held[own][k] @ m
        return pd.DataFrame([(*key, total.tobytes())], columns=["level", "ti", "tj", "f"])

    locals_ = sent.join(wanted, ["level", "ti", "tj"]).groupBy("level", "ti", "tj").applyInPandas(local, "level int, ti long, tj long, f binary")

    def read(frames):
        ids, found, held = [], [], 0
        for df in frames:
            for own, x, y, level, i, j, f in zip(*[df[c] for c in ("id", "x", "y", "level", "ti", "tj", "f")], strict=True):
                f = np.frombuffer(f).reshape(number, p2, 2)
                for a in range(0, len(own), 1000):
                    at = _grid(x[a : a + 1000], y[a : a + 1000], i, j, side / 2**level / 2, x0, y0)
                    ids.append(own[a : a + 1000])
                    found.append(np.stack([at @ f[k] for k in range(number)]))
                    held += len(ids[-1])
                    if held > ROWS:
                        yield frame(ids, found)
                        ids, found, held = [], [], 0
        if held:
            yield frame(ids, found)

    each = targets.select("id", "x", "y", "i", "j", level).select("id", "x", "y", "level", up("i"), up("j"))
    return each.join(locals_, ["level", "ti", "tj"]).mapInPandas(read, form)
