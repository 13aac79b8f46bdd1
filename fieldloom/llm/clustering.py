"""Centroid clustering: exact integer Lloyd rounds that work on what has changed.

A round has two steps over the vectors, which stay where they are; owner and distance are kept beside them:

1. Assignment. A vector whose owner's centroid has not moved is nearest to it or to one of the centroids that have moved,
   so it is compared with these only; one whose owner's centroid has moved is compared with all of them.
2. Transfers. Vectors that changed owner are taken from the old owner's sums and added to the new one's: signed integers,
   summed in each task first. The sums of all rounds are kept, so a centroid is floor(sum / count) of exact integers.

What comes to the driver is one sum for each changed cluster and component, whatever the number of vectors.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, lean

SCALE = 64
#: Integer components beyond this would pass 64 bits in a squared distance of 64 components; they raise.
LARGEST = 1 << 27


def integers(df: DataFrame, size: int, id_col: str, vector_col: str) -> DataFrame:
    """id, x: the vectors with exactly size components, none null or non-finite, as floor(64 * component)."""
    v = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    kept = df.select(F.col(id_col).alias("id"), v.alias("v")).where((F.size("v") == size) & ~F.exists("v", odd))
    large = F.exists("v", lambda x: F.abs(x) * SCALE >= LARGEST)
    whole = F.transform("v", lambda x: F.floor(x * SCALE).cast("int"))
    return kept.select("id", F.when(large, F.raise_error(F.lit(f"a component of {LARGEST // SCALE} or more has no exact distance in 64 bits"))).otherwise(whole).alias("x"))


def first_centroids(vectors: DataFrame, k: int) -> np.ndarray:
    """The k vectors with the smallest sha256 of ``1:<id>``, in that order; of rows that repeat an id, by components."""
    name = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    rows = vectors.select(name.alias("name"), "x").orderBy("name", "x").limit(k).collect()
    return np.array([r.x for r in rows], dtype=np.int64)


def _assigned(state: DataFrame, centroids: np.ndarray, moved: list[int]) -> DataFrame:
    """state with owner and distance for these centroids, of which those in moved differ from the last round's."""

    def nearest(x, numbers, owner, distance):
        for c in numbers:  # in rising order: a tie stays with the smaller number
            d = ((x - centroids[c]) ** 2).sum(axis=1)
            nearer = (d < distance) | (d == distance) & (c < owner)
            owner[nearer], distance[nearer] = c, d[nearer]

    def run(batches):
        for b in batches:
            n = b.num_rows
            x = np.asarray(b.column(1).flatten(), dtype=np.int64).reshape(n, -1)
            before = b.column(2).to_numpy()
            owner, distance = before.astype(np.int32), b.column(3).to_numpy().astype(np.int64)
            lost = np.isin(before, [-1, *moved])
            owner[lost], distance[lost] = len(centroids), np.iinfo(np.int64).max
            for rows, numbers in ((lost, range(len(centroids))), (~lost, moved)):
                if rows.any() and len(numbers):
                    o, d = owner[rows], distance[rows]
                    nearest(x[rows], numbers, o, d)
                    owner[rows], distance[rows] = o, d
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(owner, pa.int32()), pa.array(distance, pa.int64()), pa.array(before, pa.int32())], ["id", "x", "owner", "distance", "before"])

    kind = state.schema["id"].dataType.simpleString()
    return checkpointed(state.select("id", "x", "owner", "distance").mapInArrow(lean(run), f"id {kind}, x array<int>, owner int, distance long, before int"))


def _transfers(state: DataFrame, k: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """How sums (k by size) and counts change by the vectors that changed owner."""

    def run(batches):
        sums, counts = np.zeros((k, size), dtype=np.int64), np.zeros(k, dtype=np.int64)
        for b in batches:
            x = np.asarray(b.column(0).flatten(), dtype=np.int64).reshape(b.num_rows, size)
            for column, sign in ((1, 1), (2, -1)):
                owner = b.column(column).to_numpy()
                for c in np.unique(owner[owner >= 0]):
                    sums[c] += sign * x[owner == c].sum(axis=0)
                    counts[c] += sign * int((owner == c).sum())
        touched = [c for c in range(k) if counts[c] or sums[c].any()]
        at = [(c, j, int(v)) for c in touched for j, v in enumerate([*sums[c], counts[c]]) if v]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in at], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.int64()))], ["c", "j", "v"])

    parts = state.where("owner <> before").select("x", "owner", "before").mapInArrow(lean(run), "c int, j int, v long")
    out = np.zeros((k, size + 1), dtype=object)
    for r in parts.groupBy("c", "j").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).collect():
        out[r.c, r.j] = int(r.v)
    return out[:, :size], out[:, size]


def lloyd(vectors: DataFrame, k: int = 16, rounds: int = 3, size: int = 64, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """id, cluster, distance, cluster_inertia, inertia, centroid_sha256 for each vector that is kept.

    Vectors with exactly size components, none null or non-finite, are kept, as floor(64 * component); one with a
    component of 2^21 or more raises, since its distance may not fit in 64 bits. Ties go to the smaller cluster; a
    cluster that loses all its vectors keeps its centroid. With fewer than k vectors there are as many clusters as
    vectors; without any, no rows. Rows that repeat an id count again, a null id is like any other (hashed as empty).
    Other columns are ignored.
    """
    kind = vectors.schema[id_col].dataType
    x = integers(vectors, size, id_col, vector_col)
    state = checkpointed(x.select("id", "x", F.lit(-1).alias("owner"), F.lit(0).cast("long").alias("distance")))
    centroids = first_centroids(state, k)
    k = len(centroids)
    if not k:
        return vectors.sparkSession.createDataFrame([], "id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string").withColumn("id", F.col("id").cast(kind)).withColumnRenamed("id", id_col)
    sums, counts, moved = np.zeros((k, size), dtype=object), np.zeros(k, dtype=object), list(range(k))
    for _ in range(rounds):
        state = _assigned(state, centroids, moved)
        more, n = _transfers(state, k, size)
        sums, counts = sums + more, counts + n
        after = np.array([[s // counts[c] for s in sums[c]] if counts[c] else centroids[c].tolist() for c in range(k)], dtype=np.int64)
        moved = [c for c in range(k) if (after[c] != centroids[c]).any()]
        centroids = after
    state = _assigned(state, centroids, moved)
    within = {r.owner: int(r.d) for r in state.groupBy("owner").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}
    digest = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    facts = [(c, d, sum(within.values()), digest[c]) for c, d in sorted(within.items())]
    table = F.create_map(*(y for c, *f in facts for y in (F.lit(c), F.struct(F.lit(f[0]).cast("long").alias("cluster_inertia"), F.lit(f[1]).cast("long").alias("inertia"), F.lit(f[2]).alias("centroid_sha256")))))
    return state.select(F.col("id").alias(id_col), F.col("owner").alias("cluster"), "distance", F.element_at(table, F.col("owner")).alias("f")).select(id_col, "cluster", "distance", "f.*")


def oracle(k: int = 16, rounds: int = 3, size: int = 64) -> str:
    """The same rows in SQL; every round compares all vectors with all centroids."""
    steps = []
    for n in range(rounds + 1):
        steps.append(
            f"""near{n} AS MATERIALIZED (
  SELECT row, min({k} * d + c) AS best FROM (
    SELECT row, c, CAST(sum((p.v - q.v) * (p.v - q.v)) AS BIGINT) AS d FROM places p JOIN centre{n} q USING (j) GROUP BY row, c) GROUP BY row
)"""
        )
        if n < rounds:
            steps.append(
                f"""sums{n} AS (
  SELECT best % {k} AS c, j, sum(v) AS s, count(*) AS n FROM places JOIN near{n} USING (row) GROUP BY 1, 2
), centre{n + 1} AS MATERIALIZED (
  SELECT c, j, CAST(coalesce((s - ((s % n) + n) % n) // n, v) AS BIGINT) AS v FROM centre{n} LEFT JOIN sums{n} USING (c, j)
)"""
            )
    return f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS row, vec_id, [CAST(floor({SCALE} * CAST(e AS DOUBLE)) AS BIGINT) FOR e IN embedding] AS x
  FROM embeddings WHERE len(embedding) = {size} AND len([e FOR e IN embedding IF e IS NOT NULL AND isfinite(e)]) = {size}
), places AS MATERIALIZED (
  SELECT row, j, x[j] AS v FROM kept, (SELECT unnest(range(1, {size + 1})) AS j)
), centre0 AS MATERIALIZED (
  SELECT c, j, x[j] AS v FROM (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), x) - 1 AS c, x FROM kept QUALIFY c < {k}), (SELECT unnest(range(1, {size + 1})) AS j)
), {", ".join(steps)}, digests AS (
  SELECT c, sha256(string_agg(CAST(v AS VARCHAR), ',' ORDER BY j)) AS centroid_sha256 FROM centre{rounds} GROUP BY c
)
SELECT vec_id, CAST(best % {k} AS INTEGER) AS cluster, best // {k} AS distance, CAST(sum(best // {k}) OVER (PARTITION BY best % {k}) AS BIGINT) AS cluster_inertia,
       CAST(sum(best // {k}) OVER () AS BIGINT) AS inertia, centroid_sha256
FROM near{rounds} JOIN kept USING (row) JOIN digests ON c = best % {k}
"""
