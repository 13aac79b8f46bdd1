"""Near-duplicate documents by fast similarity sketching, banding and exact verification.

1. Sketch. A document's set is its distinct shingles, hashed to 64 bits. In rounds, every shingle is hashed to a bin and
   a value, the round number in its high bits; a bin keeps the least. Rounds go on until all COORDINATES bins are full;
   the last COORDINATES of at most twice as many rounds send all shingles to one bin each, so every coordinate fills.
   Two sets agree in a coordinate with the probability of their Jaccard similarity, with concentration as for
   independent samples, at a cost of n + t log t instead of n * t.
2. Nodes. Equal sets become one node under a 128-bit hash; a partial aggregate does this in the map, so a set that a
   third of all rows share is one row a task.
3. Bands. BANDS keys of ROWS coordinates; a pair at similarity 0.8 shares none with probability
   (1 - 0.8 ** 6) ** 40 = 5e-6. The members of a bucket are joined to its least member, never to each other; the
   connected parts of that graph are candidate clusters, and no two sets of different clusters share a key.
4. Verification. All pairs inside a cluster are compared on their full sets, so what banding found by chance counts for
   nothing. A cluster is cut into blocks of about BLOCK sets or BLOCK_SHINGLES shingles, and a group compares two blocks
   by one matrix product; it returns a spanning forest of the links, at most one row a set. A cluster of any size is
   spread over the tasks, and rows grow with its size times the number of its blocks, not with its pairs.
5. Components of the links give each document the smallest id that it can reach.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from .common import checkpointed, lean, raw_texts, small_batches, text_key, without, worker_state

BANDS, ROWS = 40, 6
COORDINATES = BANDS * ROWS
BLOCK, BLOCK_SHINGLES = 256, 400_000
#: Tables of ids or nodes are broadcast up to this many rows (some 40 MB); beyond, they are shuffled.
BROADCAST_ROWS = 400_000
SLICE_DOCS, SLICE_BYTES, COLUMNS = 512, 2_000_000, 4096
MAX_HASHES = 200_000

U = np.uint64
ODD = tuple(U(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3))


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser of 64 bits: every bit of x reaches every bit of the result."""
    x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(32))


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > MAX_HASHES:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def shingle_set(text: bytes, size: int, hashes: WordHashes) -> np.ndarray:
    """The sorted distinct hashes of the text's word shingles; of fewer words, the whole sequence; of none, empty."""
    words = text.lower().split()
    n = len(words)
    if not n:
        return np.zeros(0, dtype=np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), dtype=np.uint64, count=n)
    if n < size:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=n)], dtype=np.uint64)
    total = np.zeros(n - size + 1, dtype=np.uint64)
    for k in range(size):
        total += h[k : n - size + 1 + k] * ODD[k]
    return np.unique(mix(total))


def sketches(sets: list[np.ndarray], t: int = COORDINATES) -> np.ndarray:
    """A row of t coordinates for each set; none may be empty."""
    empty = U(0xFFFFFFFFFFFFFFFF)
    out = np.full((len(sets), t), empty, dtype=np.uint64)
    flat = out.reshape(-1)
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    values = np.concatenate(sets) if sets else np.zeros(0, dtype=np.uint64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    for i in range(2 * t):
        if not len(values):
            break
        h = mix(values + U(i + 1) * ODD[0])
        place = ((h >> U(32)) * U(t) >> U(32)).astype(np.int64) if i < t else np.full(len(h), i - t)
        slot = owner * t + place
        value = (U(i) << U(48)) | (mix(h) >> U(16))
        still = flat[slot] >= (U(i) << U(48))  # filled bins hold an earlier round
        np.minimum.at(flat, slot[still], value[still])
        open_sets = (out == empty).any(axis=1)
        if not open_sets.any():
            break
        if i % 4 == 0 or i < 8:
            stay = open_sets[owner]
            values, owner = values[stay], owner[stay]
    return out


def band_keys(sketch: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    parts = sketch[:, : bands * rows].reshape(len(sketch), bands, rows)
    total = np.zeros(parts.shape[:2], dtype=np.uint64)
    for k in range(rows):
        total = mix(total + parts[:, :, k] * ODD[k % len(ODD)])
    return mix(total + np.arange(1, bands + 1, dtype=np.uint64)[None, :] * ODD[1]).view(np.int64)


def _slices(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Parts of a batch of few documents and bytes."""
    texts, start, held = raw_texts(batch.column(1)), 0, 0
    for i, x in enumerate(texts):
        if i > start and (held + len(x) > SLICE_BYTES or i - start >= SLICE_DOCS):
            yield batch.slice(start, i - start), texts[start:i]
            start, held = i, 0
        held += len(x)
    yield batch.slice(start), texts[start:]


def node_of(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def _sketch(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = worker_state("near_dedup", WordHashes)
        with np.errstate(over="ignore"):
            for batch in batches:
                for part, texts in _slices(batch):
                    sets = [shingle_set(x, size, hashes) for x in texts]
                    full = [s for s in sets if len(s)]
                    keys = iter(band_keys(sketches(full)))
                    rows = [next(keys) if len(s) else None for s in sets]
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0), part.column(2), pa.array([node_of(s) if len(s) else None for s in sets], pa.binary()), pa.array([len(s) for s in sets], pa.int64()), pa.array(rows, pa.list_(pa.int64()))],
                        ["_fl_id", "_fl_key", "node", "n_shingles", "keys"],
                    )

    return run


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = worker_state("near_dedup", WordHashes)
        with np.errstate(over="ignore"):
            for batch in batches:
                for _, texts in _slices(batch):
                    sets = [s for s in (shingle_set(x, size, hashes) for x in texts) if len(s)]
                    yield pa.RecordBatch.from_arrays([pa.array([node_of(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], ["node", "shingles"])

    return run


def intersections(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of every set of left with every set of right."""
    out = np.zeros((len(left), len(right)), dtype=np.int64)
    sets = left + right
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    values, column = np.unique(np.concatenate(sets), return_inverse=True)
    many = np.bincount(column) > 1  # a shingle of one set adds to no intersection
    rank = np.cumsum(many) - 1
    keep = many[column]
    owner, column = owner[keep], rank[column[keep]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    for first in range(0, int(many.sum()), COLUMNS):
        a, b = np.searchsorted(column, (first, first + COLUMNS))
        held = np.zeros((len(sets), min(COLUMNS, int(many.sum()) - first)), dtype=np.float32)
        held[owner[a:b], column[a:b] - first] = 1
        out += (held[: len(left)] @ held[len(left) :].T).astype(np.int64)
    return out


def links_of(left: list[np.ndarray], right: list[np.ndarray], percent: int) -> np.ndarray:
    """Index pairs (left, right) whose sets have 100 * intersection >= percent * union."""
    if len(left) * len(right) <= 64:
        found = []
        for i, a in enumerate(left):
            for j, b in enumerate(right):
                if 100 * min(len(a), len(b)) >= percent * max(len(a), len(b)):
                    both = len(np.intersect1d(a, b, assume_unique=True))
                    if 100 * both >= percent * (len(a) + len(b) - both):
                        found.append((i, j))
        return np.array(found, dtype=np.int64).reshape(-1, 2)
    both = intersections(left, right)
    n, m = np.array([len(s) for s in left]), np.array([len(s) for s in right])
    return np.argwhere(100 * both >= percent * (n[:, None] + m[None, :] - both))


def forest(pairs: np.ndarray, n: int) -> list[tuple[int, int]]:
    """Those of the pairs that join two parts of 0..n-1."""
    up, out = list(range(n)), []

    def find(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in pairs.tolist():
        x, y = find(a), find(b)
        if x != y:
            up[x] = y
            out.append((a, b))
    return out


def _verify(percent: int):
    def links(rows: list[tuple]) -> list[tuple[bytes, bytes]]:
        rows = list({r[0]: r for r in rows}.values())  # a node once
        names, parts = [r[0] for r in rows], np.array([r[1] for r in rows])
        sets = [np.frombuffer(r[2], dtype=np.uint64) for r in rows]
        a = np.flatnonzero(parts == parts.min())
        b = np.flatnonzero(parts == parts.max()) if rows[0][3] else a
        if not len(a) or not len(b) or rows[0][3] and parts.min() == parts.max():
            return []
        pairs = links_of([sets[i] for i in a], [sets[i] for i in b], percent)
        pairs = np.stack([a[pairs[:, 0]], b[pairs[:, 1]]], axis=1)
        return [(names[i], names[j]) for i, j in forest(pairs[pairs[:, 0] != pairs[:, 1]], len(sets))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state("near_dedup", WordHashes).clear()
        out: list[tuple[bytes, bytes]] = []
        group, key = [], None
        flushed = lambda: pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.binary()) for k in (0, 1)], ["u", "v"])
        for batch in (b.slice(k, 256) for b in batches for k in range(0, len(b), 256)):
            for cluster, i, j, node, part, shingles in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (cluster, i, j) != key:
                    out += links(group) if group else []
                    group, key = [], (cluster, i, j)
                group.append((node, part, shingles, i != j))
            if len(out) > 10_000:
                yield flushed()
                out = []
        out += links(group) if group else []
        if out:
            yield flushed()

    return run


def candidate_clusters(nodes: DataFrame) -> DataFrame:
    """node, cluster of (node, keys): the connected parts of the graph that joins a bucket's members to its least.

    A node has a least in each of its buckets; it is joined to the smallest of them, and the others are too. Members of
    a large cluster have the same few leasts, so that edges are about as many as nodes, not as bands.
    """
    rows = nodes.select("node", F.explode("keys").alias("key"))
    least = rows.groupBy("key").agg(F.min("node").alias("_fl_least"), F.max("node").alias("_fl_most")).where("_fl_least <> _fl_most").drop("_fl_most")
    least = checkpointed(least)  # so that AQE can split the join where a third of all rows share a key
    own = rows.join(least, "key").groupBy("node").agg(F.array_sort(F.collect_set("_fl_least")).alias("_fl_leasts"))
    ends = F.explode(F.array_append("_fl_leasts", F.col("node"))).alias("u")
    edges = own.select(F.element_at("_fl_leasts", 1).alias("v"), ends)
    return connected_components(edges).withColumnRenamed("component", "cluster")


def small(table: DataFrame) -> DataFrame:
    """A checkpointed table, marked for broadcast if it has at most BROADCAST_ROWS rows.

    Beyond, it is shuffled; as a checkpoint it has an exchange of its own, so AQE can split the other side at a hot key.
    """
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def blocked(members: DataFrame) -> DataFrame:
    """(cluster, i, j, part, ...) of (cluster, node, n_shingles, ...): each node once for each pair of blocks that it is in.

    A cluster has as many blocks as its sets or shingles ask for, but no more than sets.
    """
    n = F.count(F.lit(1))
    size = members.groupBy("cluster").agg(F.least(n, F.ceil(F.greatest(n / BLOCK, F.sum("n_shingles") / BLOCK_SHINGLES))).cast("int").alias("_fl_blocks"))
    several = small(checkpointed(size.where("_fl_blocks > 1")))
    placed = members.join(several, "cluster", "left").withColumn("_fl_blocks", F.coalesce("_fl_blocks", F.lit(1)))
    placed = placed.withColumn("part", F.pmod(F.xxhash64("node"), F.col("_fl_blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("_fl_blocks") - 1)).alias("_fl_other")
    return placed.select("*", other).withColumns({"i": F.least("part", "_fl_other"), "j": F.greatest("part", "_fl_other")}).drop("_fl_other", "_fl_blocks")


def _components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """_fl_id, _fl_key (of the text), n_shingles, component_id, kept of each row of docs."""
    kind = docs.schema[id_col].dataType.simpleString()
    own = small_batches(docs).select(F.col(id_col).alias("_fl_id"), F.col(text_col).alias("_fl_text"), text_key(F.col(text_col)).alias("_fl_key"))
    sketched = checkpointed(own.mapInArrow(lean(_sketch(shingle)), f"_fl_id {kind}, _fl_key long, node binary, n_shingles long, keys array<long>"))
    nodes = sketched.where("node is not null").groupBy("node").agg(F.min("_fl_id").alias("_fl_first"), F.count(F.lit(1)).alias("_fl_rows"), F.first("n_shingles").alias("n_shingles"), F.first("keys").alias("keys"))
    nodes = checkpointed(nodes)
    clusters = checkpointed(candidate_clusters(nodes.select("node", "keys")).join(nodes.select("node", "_fl_first", "n_shingles"), "node"))
    wanted = small(checkpointed(clusters.select(F.col("_fl_first").alias("_fl_want")).distinct()))
    sets = own.join(wanted, F.col("_fl_id").eqNullSafe(F.col("_fl_want")), "left_semi").select("_fl_id", "_fl_text").mapInArrow(lean(_sets(shingle)), "node binary, shingles binary")
    parts = blocked(clusters.drop("_fl_first")).join(sets, "node").select("cluster", "i", "j", "node", "part", "shingles")
    parts = parts.repartition("cluster", "i", "j").sortWithinPartitions("cluster", "i", "j")
    links = checkpointed(parts.mapInArrow(lean(_verify(percent)), "u binary, v binary"))

    linked = checkpointed(connected_components(links).join(nodes.select("node", "_fl_first"), "node"))
    first = small(checkpointed(linked.groupBy("component").agg(F.min("_fl_first").alias("component_id"))))
    of_linked = checkpointed(linked.join(first, "component").select("node", "component_id"))
    # a node of one row without a link is its own component, and needs no join
    of_node = nodes.select("node", "_fl_first", "_fl_rows").join(small(of_linked), "node", "left").where("component_id is not null or _fl_rows > 1")
    of_node = small(checkpointed(of_node.select(F.col("node").alias("_fl_node"), F.coalesce("component_id", "_fl_first").alias("component_id"))))
    # rows without a set are linked with nothing; a key of their own spreads them
    key = F.coalesce("node", F.xxhash64("_fl_id", "_fl_key").cast("string").cast("binary"))
    out = sketched.select("_fl_id", "_fl_key", "n_shingles", key.alias("_fl_own")).join(of_node, F.col("_fl_own") == F.col("_fl_node"), "left")
    component = F.coalesce("component_id", "_fl_id")
    return out.select("_fl_id", "_fl_key", "n_shingles", component.alias("component_id"), F.col("_fl_id").eqNullSafe(component).alias("kept"))


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """One row for each row of docs: id, n_shingles, component_id, kept (id = component_id).

    Sets with 100 * intersection >= percent * union are linked. Null and empty texts have an empty set and are linked
    with nothing; a text of fewer than ``shingle`` words is one shingle. component_id is the smallest id reachable,
    null ids aside. A row that repeats an id repeats its result; an empty table gives no rows; other columns are ignored.
    """
    return _components(docs, id_col, text_col, shingle, percent).drop("_fl_key").withColumnRenamed("_fl_id", id_col)


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs whose id is the smallest of their component, with all their columns."""
    found = _components(docs, id_col, text_col, shingle, percent)
    dropped = checkpointed(found.where("not kept").select(F.col("_fl_id").alias("_fl_drop_id"), F.col("_fl_key").alias("_fl_drop_key")))
    return without(docs, dropped, id_col, text_col)
