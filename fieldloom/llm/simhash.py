"""SimHash near-duplicates: 64-bit fingerprints of word shingles, compared bit by bit over whole blocks.

1. Fingerprints. A bit is set if it is set in over half of the shingles' XXH64 (seed 42), repeats included. Equal
   fingerprints become one node by a partial aggregate, so that copies that are a third of all rows are one row a task.
2. Buckets. The 64 bits are cut into radius + 2 parts; two fingerprints within the radius agree in at least two of them,
   so each goes to one bucket for each pair of parts. Of a bucket with more than BUCKET members the open bits are cut into
   radius + 1 parts, of which two members within the radius agree in at least one, and its members go to one smaller
   bucket each; this is done DEEPER times. At radius 2 a bucket then has 14 open bits, 16,384 members at most. No pair
   within the radius is lost, whatever the buckets' sizes.
3. Comparison. A bucket is stored by planes: one integer for each open bit, a binary digit for each member, in blocks of
   WIDTH members. A member is held against a block by adding the planes in which it differs, two at a time, to carry-save
   counters that start so that they overflow beyond the radius; the block is left as soon as all of it has overflowed.
   Members are reached from one another and leave the block then, so that a bucket gives a spanning forest of its links.
4. Components of the links give each document the smallest id that it can reach.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from .common import checkpointed, lean, raw_texts, small_batches

SEED, BITS = 42, 64
BUCKET, DEEPER, WIDTH = 1_024, 2, 1_024
#: Keys of large buckets are broadcast up to this many (some 40 MB); beyond, they are shuffled.
BROADCAST_ROWS = 400_000
#: Shingles whose bits are counted at a time, so that a very long text takes 16 MB.
COUNTED = 250_000


def fingerprint(text: bytes, shingle: int) -> int:
    """The fingerprint of a text's word shingles; with fewer words that of the whole sequence, without words 0."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    parts = map(b" ".join, zip(*(words[k:] for k in range(shingle)), strict=False))
    n = len(words) - shingle + 1
    h = np.fromiter(map(xxhash.xxh64_intdigest, parts, itertools.repeat(SEED)), dtype=np.uint64, count=n)
    ones = np.zeros(BITS, dtype=np.int64)
    for k in range(0, n, COUNTED):
        ones += np.unpackbits(h[k : k + COUNTED].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, shingle: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and fp (64 bits as a long) for each row of docs."""

    def run(batches):
        for b in batches:
            fps = np.fromiter((fingerprint(x, shingle) for x in raw_texts(b.column(1))), dtype=np.uint64, count=b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], ["id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return small_batches(docs).select(F.col(id_col), F.col(text_col)).mapInArrow(lean(run), f"id {kind}, fp long")


def _cut(bits: list[int], parts: int) -> list[list[int]]:
    edges = [round(k * len(bits) / parts) for k in range(parts + 1)]
    return [bits[a:b] for a, b in itertools.pairwise(edges)]


def _mask(bits) -> int:
    return sum(1 << b for b in bits)


def open_bits(mask: int) -> list[int]:
    return [b for b in range(BITS) if not mask >> b & 1]


def first_masks(radius: int) -> list[int]:
    """Two fingerprints within the radius agree under at least one of these masks."""
    parts = _cut(list(range(BITS)), radius + 2)
    return [_mask(a + b) for a, b in itertools.combinations(parts, 2)]


def finer_masks(mask: int, radius: int) -> list[int]:
    """Two fingerprints within the radius that agree under mask do so under at least one of these."""
    return [mask | _mask(part) for part in _cut(open_bits(mask), radius + 1) if part]


def _signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


class Planes:
    """Up to WIDTH fingerprints by bit planes: digit k of a plane belongs to the k-th of them."""

    def __init__(self, fps: np.ndarray, bits: list[int]):
        self.all = (1 << len(fps)) - 1
        digits = np.unpackbits(fps.view(np.uint8).reshape(len(fps), 8), axis=1, bitorder="little")[:, bits]
        packed = np.packbits(digits, axis=0, bitorder="little")
        ones = [int.from_bytes(packed[:, k].tobytes(), "little") for k in range(len(bits))]
        self.differ = [(one, one ^ self.all) for one in ones]  # by the other's bit

    def within(self, digits: list[int], radius: int, among: int) -> int:
        """Which of ``among`` differ from the fingerprint with these open bits in at most radius of them."""
        planes = [pair[d] for pair, d in zip(self.differ, digits, strict=True)]
        width = (radius + 1).bit_length()
        bias = (1 << width) - 1 - radius  # radius + 1 more overflow
        counters = [self.all if bias >> k & 1 else 0 for k in range(width)]
        over = 0
        for k in range(0, len(planes), 2):
            a, b = planes[k], planes[k + 1] if k + 1 < len(planes) else 0
            half = counters[0] ^ a
            carry = (counters[0] & a) | (half & b)
            counters[0] = half ^ b
            for j in range(1, width):
                counters[j], carry = counters[j] ^ carry, counters[j] & carry
            over |= carry
            if not among & ~over:
                return 0
        return among & ~over


def links_of_bucket(fps: np.ndarray, mask: int, radius: int) -> Iterator[tuple[int, int]]:
    """A spanning forest, by places in fps, of the links between distinct fingerprints that agree under mask."""
    bits = open_bits(mask)
    blocks = [(k, Planes(fps[k : k + WIDTH], bits)) for k in range(0, len(fps), WIDTH)]
    left = [planes.all for _, planes in blocks]
    values = fps.tolist()
    for start in range(len(values)):
        if not left[start // WIDTH] >> (start % WIDTH) & 1:
            continue
        left[start // WIDTH] ^= 1 << (start % WIDTH)
        reached = [start]
        while reached:
            one = reached.pop()
            digits = [values[one] >> b & 1 for b in bits]
            for k, (first, planes) in enumerate(blocks):
                if left[k] and (found := planes.within(digits, radius, left[k])):
                    left[k] ^= found
                    while found:
                        low = found & -found
                        other = first + low.bit_length() - 1
                        found ^= low
                        reached.append(other)
                        yield one, other


def links(nodes: DataFrame, radius: int = 2) -> DataFrame:
    """u, v: links between the distinct fingerprints fp of nodes, as many as connect whatever is within the radius."""

    def run(batches):
        held: list[np.ndarray] = []  # rows of the bucket that the last batch left open

        def linked(rows: np.ndarray):
            if len(rows) > 1:
                fps = np.ascontiguousarray(rows[:, 2]).view(np.uint64)
                for a, b in links_of_bucket(fps, int(rows[0, 0]) & ((1 << BITS) - 1), radius):
                    yield int(rows[a, 2]), int(rows[b, 2])

        def batch(found):
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], ["u", "v"])

        for b in batches:
            rows = np.stack([b.column(k).to_numpy() for k in range(3)], axis=1)
            edges = np.flatnonzero((rows[1:, :2] != rows[:-1, :2]).any(axis=1)) + 1
            if held and len(rows) and (rows[0, :2] != held[-1][-1, :2]).any():
                yield batch(list(linked(np.concatenate(held))))
                held = []
            cuts = [0, *edges.tolist(), len(rows)]
            found = []
            for first, end in itertools.pairwise(cuts):
                if end == len(rows):
                    held.append(rows[first:])
                elif held:
                    found += linked(np.concatenate([*held, rows[first:end]]))
                    held = []
                elif end - first > 1:
                    found += linked(rows[first:end])
            yield batch(found)
        if held:
            yield batch(list(linked(np.concatenate(held))))

    fp = F.col("fp")
    key = lambda mask: F.struct(mask.alias("mask"), fp.bitwiseAND(mask).alias("key"))
    masks = [_signed(m) for m in first_masks(radius)]
    rows = nodes.select("fp", F.explode(F.array(*(key(F.lit(m)) for m in masks))).alias("_k")).select("_k.*", "fp")
    found = None
    for depth in range(DEEPER + 1):
        large = None
        if depth < DEEPER:
            large = checkpointed(rows.groupBy("mask", "key").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > BUCKET).select("mask", "key"))
            n = large.count()
            large = None if not n else F.broadcast(large) if n <= BROADCAST_ROWS else large
        small = rows if large is None else rows.join(large, ["mask", "key"], "left_anti")
        part = small.select("mask", "key", "fp").repartition("mask", "key").sortWithinPartitions("mask", "key").mapInArrow(lean(run), "u long, v long")
        found = part if found is None else found.unionByName(part)
        if large is None:
            return checkpointed(found.distinct())
        finer = {m: [_signed(x) for x in finer_masks(m & ((1 << BITS) - 1), radius)] for m in masks}
        children = F.create_map(*(x for m, own in finer.items() for x in (F.lit(m), F.array(*map(F.lit, own)))))
        rows = checkpointed(rows.join(large, ["mask", "key"], "left_semi").select("fp", F.explode(F.element_at(children, F.col("mask"))).alias("mask")).select("mask", fp.bitwiseAND(F.col("mask")).alias("key"), "fp"))
        masks = sorted({x for own in finer.values() for x in own})
    return checkpointed(found.distinct())


def components(docs: DataFrame, shingle: int = 5, radius: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: id, fingerprint (16 hex digits), component_id (smallest id reachable).

    Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z; null and empty texts have fingerprint 0 and are linked like
    others. Fingerprints link at ``radius`` or fewer differing bits. Rows that repeat an id stay apart and may be in
    different components; a null id is never the smallest unless its component has no other. An empty table gives no
    rows; other columns are ignored.
    """
    rows = checkpointed(fingerprints(docs, shingle, id_col, text_col))
    nodes = checkpointed(rows.groupBy("fp").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n")))
    parts = connected_components(links(nodes, radius))
    joined = nodes.join(parts.select(F.col("node").alias("fp"), "component"), "fp", "left")
    # a node with no link and one row keeps its own id; the others are looked up
    named = checkpointed(joined.where("component is not null or n > 1").select("fp", "least", F.coalesce("component", "fp").alias("component")))
    least = checkpointed(named.groupBy("component").agg(F.min("least").alias("component_id")))
    known = checkpointed(named.join(least, "component").select("fp", "component_id", F.lit(True).alias("known")))
    component = F.when(F.col("known"), F.col("component_id")).otherwise(F.col("id"))
    return rows.join(known, "fp", "left").select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), component.alias("component_id"))
