"""Eigenpairs of symmetric tall matrices and principal vectors of fields, for graphs and panels of any size.

A block of vectors is a table (node, v0, v1, ...). Nothing of the size of a matrix or a vector comes to the driver, only
Gram matrices of the block's columns: X'X is summed by tasks. Matrices of up to DENSE_NODES nodes are solved in numpy.

eigenpairs: Chebyshev-filtered subspace iteration. A filter of some degree is that many products with the matrix, each one
join and one sum by node; it damps the part of the spectrum that isn't wanted. After each filter, the best vectors inside
the block's span (Rayleigh-Ritz) come from two Gram matrices; their residuals end the rounds. A matrix of few entries
(sparse.hold) is sent to the tasks, which filter one vector each, so that a round is a few small shuffles and the degree
can be as high as the spectrum needs.

principal_vectors: the method of snapshots. With no more than TIMES times, covariances between nodes have their vectors in
the span of the snapshots, so the Gram matrix over times is solved and carried back by one join. With more times the same
block iteration runs on the covariance as an operator, two joins a product; nodes by nodes is never formed.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import krylov, sparse
from .components import checkpointed

DENSE_NODES, TIMES = 2_000, 1_000
#: Vectors of a block beyond those asked for, which speed up the others; products of a filter; products between checkpoints.
EXTRA, DEGREE, CHAIN = 6, 12, 4
#: Where tasks hold the matrix: the most products of a filter; by how much (as a logarithm) it may lift the outermost
#: vector over the rest, before rounding makes all vectors look like that one; nodes of a part of the vectors.
HELD_DEGREE, LIFT, PART = 2_000, 16.0, 50_000
#: Vectors whose Gram matrices come from the parts; more are left to the plain block iteration.
HELD_VECTORS = 200


def _names(n: int, letter: str = "v") -> list[str]:
    return [f"{letter}{k}" for k in range(n)]


def gram(df: DataFrame, columns: list[str]) -> np.ndarray:
    """X'X of these columns, summed in the tasks."""
    n = len(columns)

    def run(batches):
        total = np.zeros((n, n))
        for b in batches:
            x = np.stack([np.asarray(c, dtype=float) for c in b.columns], axis=1)
            total += x.T @ x
        i, j = np.triu_indices(n)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total[i, j])], ["i", "j", "v"])

    out = np.zeros((n, n))
    for r in df.select(*columns).mapInArrow(run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        out[r.i, r.j] = out[r.j, r.i] = r.v
    return out


def rotated(columns: list[str], c: np.ndarray, letter: str) -> list[Column]:
    """The block's columns times a small matrix."""
    return [sum((F.col(v) * float(c[i, k]) for i, v in enumerate(columns)), F.lit(0.0)).alias(f"{letter}{k}") for k in range(c.shape[1])]


def ritz(g: np.ndarray, p: int) -> tuple[np.ndarray, np.ndarray]:
    """From the Gram matrix of [V, AV]: values in rising order, and coefficients of orthonormal vectors in V."""
    s, h = g[:p, :p], (g[:p, p:] + g[p:, :p].T) / 2
    size = np.sqrt(np.maximum(np.diag(s), 1e-300))
    e, u = np.linalg.eigh(s / np.outer(size, size))
    keep = e > 1e-12 * e[-1]
    white = (u[:, keep] / np.sqrt(e[keep])) / size[:, None]
    values, inner = np.linalg.eigh(white.T @ ((h + h.T) / 2) @ white)
    return values, white @ inner


def residuals(both: DataFrame, columns: list[str], images: list[str], values: np.ndarray, c: np.ndarray) -> np.ndarray:
    """|A v - value v| of the vectors V c, summed over rows (from the Gram matrix it would be lost in rounding)."""
    left = [sum((F.col(w) * float(x) - F.col(v) * float(x * value) for v, w, x in zip(columns, images, own, strict=True)), F.lit(0.0)) for own, value in zip(c.T, values, strict=True)]
    found = both.agg(*[F.sum(x * x).alias(f"r{k}") for k, x in enumerate(left)]).first()
    return np.sqrt(np.array([found[f"r{k}"] or 0.0 for k in range(len(left))]))


def start_block(nodes: DataFrame, p: int) -> DataFrame:
    """(node, v0, ...) between -1 and 1 by a hash of the node, so that reruns agree."""
    return nodes.select("node", *[(F.xxhash64("node", F.lit(k)) / 2.0**63).alias(f"v{k}") for k in range(p)])


def multiply(matrix: DataFrame, block: DataFrame, columns: list[str], letter: str = "w") -> DataFrame:
    """(node, the columns, their products with the tall matrix)."""
    into = matrix.join(block, matrix["j"] == block["node"]).groupBy("i").agg(*[F.sum(F.col("value") * F.col(v)).alias(f"{letter}{k}") for k, v in enumerate(columns)])
    return block.join(into.withColumnRenamed("i", "node"), "node", "left").na.fill(0.0, _names(len(columns), letter))


def filtered(steps: DataFrame, block: DataFrame, p: int, degree: int) -> DataFrame:
    """T_degree of the scaled matrix in steps (i, j, value) applied to the block, by its three-term recurrence.

    A row carries the last two vectors, x and y. steps has, beside the matrix's entries (doubled), one row a node that
    carries x over and takes y off, so that a product is one join and one sum over a single use of the last one.
    """
    x, y = _names(p), _names(p, "y")
    now = block.select("node", *x, *[F.lit(0.0).alias(c) for c in y])
    for k in range(degree):
        half = F.lit(0.5 if k == 0 else 1.0)
        moved = now.join(steps, now["node"] == steps["j"])
        new = [F.sum(F.when(F.col("carry"), -F.col(b)).otherwise(half * F.col("value") * F.col(a))).alias(a) for a, b in zip(x, y, strict=True)]
        old = [F.sum(F.when(F.col("carry"), F.col(a)).otherwise(0.0)).alias(b) for a, b in zip(x, y, strict=True)]
        now = moved.groupBy("i").agg(*new, *old).withColumnRenamed("i", "node")
        if (k + 1) % CHAIN == 0:
            now = checkpointed(now)
    return now.select("node", *x)


def _tall(block: DataFrame, c: np.ndarray, columns: list[str]) -> DataFrame:
    """(node, k, b) of the block's columns times c."""
    wide = block.select("node", *rotated(columns, c, "b"))
    return wide.select("node", F.posexplode(F.array(*_names(c.shape[1], "b")))).select("node", F.col("pos").cast("long").alias("k"), F.col("col").alias("b"))


def _dense_basis(matrix: DataFrame, nodes: list, vectors: np.ndarray) -> DataFrame:
    n, k = vectors.shape
    table = pa.table({"node": pa.array(nodes).take(pa.array(np.repeat(np.arange(n), k))), "k": np.tile(np.arange(k), n), "b": np.ascontiguousarray(vectors, dtype=float).ravel()})
    kind = matrix.schema["i"].dataType
    return matrix.sparkSession.createDataFrame(table).withColumn("node", F.col("node").cast(kind))


def eigenpairs(matrix: DataFrame, k: int, which: str = "smallest", close: float = 1e-8, rounds: int = 200) -> tuple[np.ndarray, DataFrame]:
    """The k eigenvalues at one end of a symmetric tall matrix (i, j, value), outermost first, and (node, k, b) of their vectors.

    Vectors are orthonormal and end when each residual is close times the spectrum's width (RuntimeError after rounds).
    Entries that repeat are summed. With fewer nodes than k, all of them; without nodes, none.
    """
    sign = 1.0 if which == "smallest" else -1.0
    matrix = checkpointed(matrix.groupBy("i", "j").agg((sign * F.sum("value")).alias("value")))
    own = [r[0] for r in matrix.select("i").distinct().orderBy("i").limit(DENSE_NODES + 1).collect()]
    if len(own) <= DENSE_NODES:
        table = matrix.toArrow()
        place = {n: x for x, n in enumerate(own)}
        dense = np.zeros((len(own), len(own)))
        dense[[place[i] for i in table.column("i").to_pylist()], [place[j] for j in table.column("j").to_pylist()]] = table.column("value").to_numpy()
        values, vectors = np.linalg.eigh((dense + dense.T) / 2)
        return sign * values[:k], _dense_basis(matrix, own, vectors[:, :k])
    nodes = matrix.select(F.col("i").alias("node")).distinct()
    n = nodes.count()
    p = min(k + max(EXTRA, k // 4), n)
    held = sparse.hold(matrix) if p <= HELD_VECTORS else None
    if held is not None:
        values, basis = _by_vectors(matrix, held, k, p, close, rounds)
        return sign * values, basis
    columns = _names(p)
    off = F.sum(F.when(F.col("i") != F.col("j"), F.abs("value")).otherwise(0.0))
    middle = F.sum(F.when(F.col("i") == F.col("j"), F.col("value")).otherwise(0.0))
    bounds = matrix.groupBy("i").agg((middle + off).alias("high"), (middle - off).alias("low")).agg(F.max("high"), F.min("low")).first()
    top, width = bounds[0], max(bounds[0] - bounds[1], 1e-300)
    block, low = start_block(nodes, p), None
    for _ in range(rounds):
        both = checkpointed(multiply(matrix, checkpointed(block), columns))
        values, c = ritz(gram(both, [*columns, *_names(p, "w")]), p)
        if len(values) >= min(k, n) and (residuals(both, columns, _names(p, "w"), values[:k], c[:, :k]) <= close * width).all():
            return sign * values[:k], _tall(both, c[:, :k], columns)
        # damp from the block's largest value up; at first that is far from the end that is wanted
        low = max(values[-1], bounds[1] + 1e-6 * width) if low is None else min(low, values[-1])
        low = min(low, top - 1e-3 * width)
        centre, half = (top + low) / 2, (top - low) / 2
        steps = matrix.select("i", "j", (F.col("value") * (2 / half)).alias("value"), F.lit(False).alias("carry"))
        shift = nodes.select(F.col("node").alias("i"), F.col("node").alias("j"), F.lit(-2 * centre / half).alias("value"), F.lit(False).alias("carry"))
        carry = nodes.select(F.col("node").alias("i"), F.col("node").alias("j"), F.lit(0.0).alias("value"), F.lit(True).alias("carry"))
        steps = checkpointed(steps.unionByName(shift).unionByName(carry))
        # columns are scaled to the filter's size at their value, so that sums stay near 1
        at = np.maximum(np.abs((values - centre) / half), 1.0)
        c = c / np.cosh(DEGREE * np.arccosh(at))
        if c.shape[1] < p:
            c = np.hstack([c, np.zeros((p, p - c.shape[1]))])
        block = filtered(steps, both.select("node", *rotated(columns, c, "v")), p, DEGREE)
    raise RuntimeError(f"no eigenpairs after {rounds} rounds")


def _by_vectors(matrix: DataFrame, held: sparse.Held, k: int, p: int, close: float, rounds: int) -> tuple[np.ndarray, DataFrame]:
    """The k least eigenvalues and (node, k, b), with the matrix in the tasks: a task filters a vector, then vectors are cut
    into parts of nodes, whose Gram matrices are summed and where vectors are turned and put together again.
    """
    spark, n = matrix.sparkSession, len(held.nodes)
    shared = spark.sparkContext.broadcast(held)
    off = held.sizes_beside()
    top, bottom = float((held.diagonal + off).max()), float((held.diagonal - off).min())
    width = max(top - bottom, 1e-300)
    parts = [(a, min(a + PART, n)) for a in range(0, n, PART)]
    pieces = "part int, c int, v binary, w binary"

    def cut(c: int, x: np.ndarray):
        import pandas as pd

        y = shared.value.product(x[:, None])[:, 0]
        return pd.DataFrame([(a, c, x[b:e].tobytes(), y[b:e].tobytes()) for a, (b, e) in enumerate(parts)], columns=["part", "c", "v", "w"])

    def fresh(c: int, turn: int) -> np.ndarray:
        return np.random.default_rng([c, turn]).uniform(-1, 1, n)  # the same at every rerun

    def start(frames):
        for df in frames:
            for c in df["c"]:
                yield cut(c, fresh(c, 0))

    def stacked(rows):
        rows = rows.sort_values("c")
        return tuple(np.stack([np.frombuffer(x) for x in rows[name]], axis=1) for name in ("v", "w"))

    def gathered(key, rows):
        import pandas as pd

        v, w = stacked(rows)
        both = np.hstack([v, w])
        return pd.DataFrame([(key[0], v.tobytes(), w.tobytes(), (both.T @ both).tobytes())], columns=["part", "v", "w", "g"])

    def sharpened(turn: int, centre: float, half: float, degree: int):
        def run(key, rows):
            m = shared.value
            x = np.concatenate([np.frombuffer(v) for v in rows.sort_values("part")["v"]])[:, None]
            if len(x) < n:  # a vector that the others span already
                x = fresh(key[0], turn)[:, None]
            y = np.zeros_like(x)
            for s in range(degree):
                x, y = (m.product(x) - centre * x) * ((1 if s == 0 else 2) / half) - y, x
                if s % 10 == 9:
                    size = max(np.sqrt((x * x).sum()), 1e-300)
                    x, y = x / size, y / size
            return cut(key[0], x[:, 0] / max(np.sqrt((x * x).sum()), 1e-300))

        return run

    ids = spark.range(0, p, 1, p).select(F.col("id").cast("int").alias("c"))
    columns, low = ids.mapInPandas(start, pieces), None
    for turn in range(1, rounds + 1):
        block = checkpointed(columns.groupBy("part").applyInPandas(gathered, "part int, v binary, w binary, g binary"))
        gram_ = sum(np.frombuffer(r.g).reshape(2 * p, 2 * p) for r in block.select("g").collect())
        values, c = ritz(gram_, p)
        first = min(k, n)

        def left(frames, values=values, c=c):
            import pandas as pd

            for df in frames:
                sums = np.zeros(first)
                for v, w in zip(df["v"], df["w"], strict=True):
                    v, w = (np.frombuffer(x).reshape(-1, p) for x in (v, w))
                    sums += ((w @ c[:, :first] - v @ (c[:, :first] * values[:first])) ** 2).sum(0)
                yield pd.DataFrame({"k": range(first), "r": sums})

        if len(values) >= first:
            found = block.select("v", "w").mapInPandas(left, "k int, r double").groupBy("k").agg(F.sum("r").alias("r")).collect()
            if all(r.r <= (close * width) ** 2 for r in found):
                break
        low = max(values[-1], bottom + 1e-6 * width) if low is None else min(low, values[-1])
        low = min(low, top - 1e-3 * width)
        centre, half = (top + low) / 2, (top - low) / 2
        out = math.acosh(max((centre - values[0]) / half, 1 + 1e-12))
        degree = int(min(max(LIFT / out, DEGREE), HELD_DEGREE))

        def turned(frames, c=c):
            import pandas as pd

            for df in frames:
                for part, v in zip(df["part"], df["v"], strict=True):
                    x = np.frombuffer(v).reshape(-1, p) @ c
                    yield pd.DataFrame([(part, k, x[:, k].tobytes()) for k in range(c.shape[1])], columns=["part", "c", "v"])

        kept = block.select("part", "v").mapInPandas(turned, "part int, c int, v binary")
        missing = ids.where(F.col("c") >= c.shape[1]).select(F.lit(0).alias("part"), "c", F.lit(b"").alias("v"))
        # a number of its own, so that vectors are not put into few tasks for their small size
        columns = kept.unionByName(missing).repartition(p, "c").groupBy("c").applyInPandas(sharpened(turn, centre, half, degree), pieces)
    else:
        raise RuntimeError(f"no eigenpairs after {rounds} rounds")

    def rows(frames):
        import pandas as pd

        m = shared.value
        for df in frames:
            for part, v in zip(df["part"], df["v"], strict=True):
                b, e = parts[part]
                x = np.frombuffer(v).reshape(-1, p) @ c[:, :first]
                yield pd.DataFrame({"node": np.repeat(m.nodes[m.order[b:e]], first), "k": np.tile(np.arange(first), e - b), "b": x.ravel()})

    return values[:first], block.select("part", "v").mapInPandas(rows, f"node {matrix.schema['i'].dataType.simpleString()}, k long, b double")


def counts_below(matrix: DataFrame, bounds: list[float]) -> list[int]:
    """How many eigenvalues of a symmetric tall matrix (i, j, value) are below each bound.

    As many as negative pivots when the matrix less the bound is eliminated, so no eigenvalue is sought. A task eliminates
    for a bound: nodes of few neighbours first, as long as they have few, then the eigenvalues' signs of what is left, at
    most CORE nodes. Small matrices, and those with a larger rest, are solved by eigenpairs.
    """
    matrix = checkpointed(matrix.groupBy("i", "j").agg(F.sum("value").alias("value")))
    n = matrix.select("i").distinct().count()
    held = sparse.hold(matrix) if n > DENSE_NODES else None
    if held is not None:
        shared = matrix.sparkSession.sparkContext.broadcast(held)

        def run(frames):
            import pandas as pd

            for df in frames:
                yield pd.DataFrame({"k": df["k"], "n": [negative_pivots(shared.value, b) for b in df["bound"]]})

        own = matrix.sparkSession.createDataFrame(list(enumerate(map(float, bounds))), "k int, bound double")
        found = {r.k: r.n for r in own.repartition(len(bounds), "k").mapInPandas(run, "k int, n long").collect()}
        if min(found.values()) >= 0:
            return [found[k] for k in range(len(bounds))]
    values, _ = eigenpairs(matrix, n)
    return [int((values < b).sum()) for b in bounds]


#: Nodes of the rest of an elimination that is solved as a dense matrix (200 MB, and its copies); neighbours of a node that is
#: eliminated alone. A street graph of 60,000 nodes leaves some 3,000.
CORE, NEIGHBOURS = 5_000, 64


def negative_pivots(held: sparse.Held, bound: float) -> int:
    """Of the matrix less bound, the number of negative eigenvalues; -1 if more than CORE nodes are left for the dense part."""
    import heapq

    rows: list[dict[int, float]] = [{} for _ in held.diagonal]
    for columns, values in held.slots:
        for i, (j, v) in enumerate(zip(columns.tolist(), values.tolist(), strict=True)):
            rows[i][j] = v
    for i, own in enumerate(rows):
        own[i] = own.get(i, 0.0) - bound
    heap = [(len(own), i) for i, own in enumerate(rows)]
    heapq.heapify(heap)
    left, negative = set(range(len(rows))), 0
    while heap and heap[0][0] <= NEIGHBOURS + 1:
        size, i = heapq.heappop(heap)
        if i not in left or size != len(rows[i]):
            continue
        own = rows[i]
        pivot = own.pop(i)
        if abs(pivot) < 1e-3 * max((abs(v) for v in own.values()), default=0.0):  # too small to divide by: it stays
            own[i] = pivot
            continue
        left.discard(i)
        negative += pivot < 0
        for j, v in own.items():
            other, share = rows[j], v / pivot
            del other[i]
            for c, w in own.items():
                other[c] = other.get(c, 0.0) - share * w
            heapq.heappush(heap, (len(other), j))
    if len(left) > CORE:
        return -1
    place = {i: k for k, i in enumerate(left)}
    dense = np.zeros((len(left), len(left)))
    for i, k in place.items():
        for j, v in rows[i].items():
            dense[k, place[j]] = v
    return int(negative + (np.linalg.eigvalsh((dense + dense.T) / 2) < 0).sum())


def eigenbasis(matrix: DataFrame, k: int, which: str = "smallest") -> DataFrame:
    return eigenpairs(matrix, k, which)[1]


def energy_filter(field: DataFrame, matrix: DataFrame, share: float, first: int = 32) -> DataFrame:
    """(t, node, z) of a field on the smoothest modes of a matrix that hold at most this share of a time's energy.

    Energy is the sum of z^2 over the matrix's nodes, so it does not depend on how many modes are known. Beyond DENSE_NODES
    a matrix of few entries is filtered without its modes (krylov.py); else modes are added, twice as many each time, until
    every time's share is passed or there are no more.
    """
    nodes = matrix.select(F.col("i").alias("node")).distinct()
    own = checkpointed(field.where("z is not null").join(nodes, "node", "left_semi").groupBy("t", "node").agg(F.sum("z").alias("z")))
    total = checkpointed(own.groupBy("t").agg(F.sum(F.col("z") * F.col("z")).alias("_all")))
    n, k = nodes.count(), first
    if n > DENSE_NODES and 0 < share < 1:
        held = sparse.hold(checkpointed(matrix.groupBy("i", "j").agg(F.sum("value").alias("value"))))
        if held is not None:
            return krylov.filtered(own, held, share)
    while True:
        basis = checkpointed(eigenbasis(matrix, n if n <= DENSE_NODES else min(k, n)))
        c = own.join(basis, "node").groupBy("t", "k").agg(F.sum(F.col("z") * F.col("b")).alias("c"))
        upto = checkpointed(_cumulative(c).join(total, "t").withColumn("_share", F.try_divide(F.col("_upto"), F.col("_all"))))
        if k >= n or n <= DENSE_NODES or upto.groupBy("t").agg(F.max("_share").alias("_most")).where(F.col("_most") <= share).isEmpty():
            break
        k *= 2
    kept = upto.where(F.col("_share") <= share)
    return kept.join(basis, "k").groupBy("t", "node").agg(F.sum(F.col("c") * F.col("b")).alias("z"))


def _cumulative(c: DataFrame) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("t").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    return c.withColumn("_upto", F.sum(F.col("c") * F.col("c")).over(w))


# --- principal vectors


def _gram_of_times(own: DataFrame, times: int) -> np.ndarray:
    """Sum over nodes of z(t) z(s), from each node's values; a task's sums are one row a time."""

    def run(batches):
        total = np.zeros((times, times))
        for b in batches:
            lists = b.column(0)
            at, z = (np.asarray(lists.values.field(k)) for k in (0, 1))
            offsets = np.asarray(lists.offsets)
            for first in range(0, b.num_rows, 1_000):
                ends = offsets[first : first + 1_001]
                x = np.zeros((len(ends) - 1, times))
                span = slice(ends[0], ends[-1])
                x[np.repeat(np.arange(len(ends) - 1), np.diff(ends)), at[span]] = z[span]
                total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(range(times), pa.int32()), pa.array([r.tobytes() for r in total])], ["i", "g"])

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for i, g in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                sums[i] = sums.get(i, 0.0) + np.frombuffer(g)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([g.tobytes() for g in sums.values()], pa.binary())], ["i", "g"])

    by_node = own.groupBy("node").agg(F.collect_list(F.struct("_at", "z")).alias("own")).select("own")
    parts = by_node.mapInArrow(run, "i int, g binary").repartition("i").mapInArrow(add, "i int, g binary")
    out = np.zeros((times, times))
    for r in parts.collect():
        out[r.i] = np.frombuffer(r.g)
    return out


def principal_vectors(field: DataFrame, k: int, close: float = 1e-8, rounds: int = 500) -> tuple[np.ndarray, DataFrame]:
    """The k largest eigenvalues of a field's covariance between nodes, over all its times, and (node, k, b) of their vectors.

    field is (t, node, z); a missing value counts as 0, repeated rows are summed. A vector's largest entry is positive.
    Vectors of eigenvalue 0 are left out, so there may be fewer than k.
    """
    own = checkpointed(field.where("z is not null").groupBy("t", "node").agg(F.sum("z").alias("z")))
    times = [r[0] for r in own.select("t").distinct().orderBy("t").limit(TIMES + 1).collect()]
    if not times:
        return np.zeros(0), own.select("node", F.lit(0).cast("long").alias("k"), F.col("z").alias("b"))
    if len(times) > TIMES:
        return _principal_by_blocks(own, k, close, rounds)
    n = len(times)
    place = own.sparkSession.createDataFrame([(t, x) for x, t in enumerate(times)], f"t {own.schema['t'].dataType.simpleString()}, _at int")
    g = _gram_of_times(own.join(F.broadcast(place), "t"), n)
    centred = g - g.mean(0)[None, :] - g.mean(1)[:, None] + g.mean()
    values, u = np.linalg.eigh((centred + centred.T) / 2)
    values, u = values[::-1][:k], u[:, ::-1][:, :k]
    on = values > 1e-10 * max(values[0], 1e-300) if len(values) else np.zeros(0, bool)
    values, u = values[on], u[:, on] / np.sqrt(values[on])
    rows = [(t, x, float(u[a, x])) for a, t in enumerate(times) for x in range(u.shape[1])]
    if not rows:
        return np.zeros(0), own.limit(0).select("node", F.lit(0).cast("long").alias("k"), F.col("z").alias("b"))
    small = own.sparkSession.createDataFrame(rows, f"t {own.schema['t'].dataType.simpleString()}, k long, u double")
    basis = own.join(F.broadcast(small), "t").groupBy("node", "k").agg(F.sum(F.col("z") * F.col("u")).alias("b"))
    return values / n, _signed(basis)


def _signed(basis: DataFrame) -> DataFrame:
    """Each vector times the sign of its entry of largest size (of equals, the least node's)."""
    basis = checkpointed(basis)
    largest = basis.groupBy("k").agg(F.max(F.struct(F.round(F.abs("b"), 9), F.col("b"))).alias("_m"))
    return basis.join(F.broadcast(largest), "k").select("node", "k", F.when(F.col("_m.b") < 0, -F.col("b")).otherwise(F.col("b")).alias("b"))


def _principal_by_blocks(own: DataFrame, k: int, close: float, rounds: int) -> tuple[np.ndarray, DataFrame]:
    """Block power iteration with Rayleigh-Ritz on the covariance; a product goes to the times and back."""
    nodes = own.select("node").distinct()
    n_times, n = own.select("t").distinct().count(), nodes.count()
    p = min(k + max(EXTRA, k), n)
    columns, images = _names(p), _names(p, "w")
    block = start_block(nodes, p)
    for _ in range(rounds):
        block = checkpointed(block)
        there = own.join(block, "node").groupBy("t").agg(*[F.sum(F.col("z") * F.col(v)).alias(v) for v in columns])
        mean = there.agg(*[F.sum(v).alias(v) for v in columns]).first()
        there = there.select("t", *[(F.col(v) - (mean[v] or 0.0) / n_times).alias(v) for v in columns])
        back = own.join(there, "t").groupBy("node").agg(*[(F.sum(F.col("z") * F.col(v)) / n_times).alias(w) for v, w in zip(columns, images, strict=True)])
        both = checkpointed(block.join(back, "node", "left").na.fill(0.0, images))
        values, c = ritz(gram(both, [*columns, *images]), p)
        top = np.arange(len(values))[::-1][:k]
        if (residuals(both, columns, images, values[top], c[:, top]) <= close * max(values[-1], 1e-300)).all():
            top = top[values[top] > 1e-10 * max(values[-1], 1e-300)]
            return values[top], _signed(_tall(both, c[:, top], columns))
        c = c / np.maximum(np.abs(values), 1e-6 * max(math.fabs(values[-1]), 1e-300))  # images of about the same size
        c = np.hstack([c, np.zeros((p, p - c.shape[1]))])
        block = both.select("node", *rotated(images, c, "v"))
    raise RuntimeError(f"no principal vectors after {rounds} rounds")
