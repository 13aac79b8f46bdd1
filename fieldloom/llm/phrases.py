"""Phrase collocations: phrases of 2 to 4 words that are frequent and hang together, for each language.

1. Blocks. One pass over the texts turns them into blocks of about BLOCK words: 32-bit numbers of the block's own
   dictionary, -1 between pieces. The dictionaries, with counts, are summed by (lang, word); words with fewer than
   ``least`` occurrences go, the others are numbered, and a join by block brings the numbers back. No dictionary of the
   corpus is held anywhere.
2. Candidates, from 2 words up. A phrase of k words is (slot of its first k - 1 words, slot of its last k - 1): exact in
   64 bits. Where both are frequent (a subphrase is never rarer), mappers propose it with a local count; proposals are
   summed and those below ``least`` go.
3. Slots. A minimal perfect hash over at most SLICE candidates is built and broadcast, one slice after the other; mappers
   write each place's slot, -1 where the key stored in the slot is another.
4. Counts. Mappers bincount the slots, in chunks of CHUNK; chunks are summed in a tree whose nodes add about FAN parts.
   The filter's sums of step 2 are not used further: a, l and r all come from these counts.
5. Cuts. Candidates know the slots of their first and last parts, so l and r of each cut are joins by slot.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import checkpointed, lean, raw_texts, small_batches
from .perfect_hash import PerfectHash

#: Words of a block (it ends with a text), places whose proposals are merged before they leave a mapper, slots of a chunk.
BLOCK, MERGED, CHUNK = 1_000_000, 4_000_000, 1 << 16
#: Candidates of one perfect hash (24 MB with its keys), and parts that a node of the tree adds.
SLICE, FAN = 1_500_000, 32
#: Frequent words are broadcast up to this many (some 40 MB); beyond, they are shuffled.
BROADCAST_ROWS = 400_000
SALTS = 64

#: A-Z in lower case; the separators of pieces become a byte that UTF-8 never has; tabs become spaces.
_BREAK = b"\xff"
_FOLD = bytes(0xFF if chr(c) in ".,;:!?\n\x0b\x0c\r" else 0x20 if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256))


class _Numbers(dict):
    """Words of one language to numbers, given out in the order of arrival."""

    def __init__(self, more: Iterator[int]):
        super().__init__({_BREAK: -1})
        self.more = more

    def __missing__(self, word: bytes) -> int:
        self[word] = k = next(self.more)
        return k


def packed(numbers: np.ndarray) -> bytes:
    return pa.Codec("zstd", 1).compress(pa.py_buffer(np.ascontiguousarray(numbers, dtype=np.int32)), asbytes=True)


def unpacked(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(pa.Codec("zstd").decompress(data, 4 * n), dtype=np.int32)


class _Block:
    def __init__(self):
        self.more, self.size = itertools.count(), 0
        self.ids: dict[str, _Numbers] = {}
        self.parts: list[np.ndarray] = []

    def add(self, lang: str, text: bytes) -> None:
        words = text.translate(_FOLD).replace(_BREAK, b" \xff ").split()
        if lang not in self.ids:
            self.ids[lang] = _Numbers(self.more)
        self.parts += [np.fromiter(map(self.ids[lang].__getitem__, words), np.int32, len(words)), np.array([-1], np.int32)]
        self.size += len(words) + 1

    def row(self, block: int) -> pa.RecordBatch:
        places = np.concatenate(self.parts)
        n = np.bincount(places[places >= 0])
        words, langs = [b""] * len(n), [""] * len(n)
        for lang, numbers in self.ids.items():
            for word, k in numbers.items():
                if k >= 0:
                    words[k], langs[k] = word, lang
        entries = pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(words, pa.binary()).cast(pa.string()), pa.array(n, pa.int64())], ["lang", "word", "n"])
        dictionary = pa.ListArray.from_arrays(pa.array([0, len(n)], pa.int32()), entries)
        return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([len(places)], pa.int64()), pa.array([packed(places)], pa.binary()), dictionary], ["block", "size", "places", "words"])


def blocks_of(docs: DataFrame, lang_col: str, text_col: str) -> DataFrame:
    """block, size, places, words (their place in the array is their number in the block)."""

    def run(batches):
        part, at, block = TaskContext.get().partitionId(), itertools.count(), _Block()
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), raw_texts(b.column(1)), strict=True):
                block.add(lang, text)
                if block.size >= BLOCK:
                    yield block.row((part << 32) + next(at))
                    block = _Block()
        if block.size:
            yield block.row((part << 32) + next(at))

    columns = small_batches(docs).select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")), F.col(text_col))
    return columns.mapInArrow(lean(run), "block long, size long, places binary, words array<struct<lang string, word string, n long>>")


def numbered(df: DataFrame) -> DataFrame:
    """df with slot, from 0 without gaps. Only the number of rows of each partition comes to the driver."""
    df = checkpointed(df.withColumn("_fl_place", F.monotonically_increasing_id()))
    part = F.shiftright("_fl_place", 33)
    sizes = sorted((r[0], r[1]) for r in df.groupBy(part.alias("part")).count().collect())
    starts = dict(zip((p for p, _ in sizes), itertools.accumulate((n for _, n in sizes), initial=0), strict=False))
    if not starts:
        return df.select("*", F.lit(0).cast("long").alias("slot")).drop("_fl_place")
    first = F.element_at(F.create_map(*(F.lit(x).cast("long") for p in starts.items() for x in p)), part)
    return checkpointed(df.withColumn("slot", first + F.col("_fl_place").bitwiseAND((1 << 33) - 1)).drop("_fl_place"))


def _word_slots(blocks: DataFrame, entries: DataFrame, words: DataFrame) -> DataFrame:
    """block, size, places with the numbers of frequent words in place of the block's own; others become -1."""

    def run(batches):
        for b in batches:
            out = []
            for size, places, pairs in zip(b.column(1).to_pylist(), b.column(2), b.column(3), strict=True):
                own = unpacked(places.as_py(), size)
                if pairs.is_valid:
                    local, slot = (np.asarray(pairs.values.field(k)) for k in (0, 1))
                    table = np.full(max(int(own.max(initial=0)), int(local.max(initial=0))) + 2, -1, dtype=np.int32)
                    table[local] = slot
                    own = table[own]  # -1 is the last entry
                else:
                    own = np.full(size, -1, dtype=np.int32)
                out.append(packed(own))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.binary())], ["block", "size", "places"])

    small = F.broadcast(words) if words.count() <= BROADCAST_ROWS else words
    pairs = entries.join(small.select("lang", "word", "slot"), ["lang", "word"]).groupBy("block").agg(F.collect_list(F.struct("local", "slot")).alias("pairs"))
    return blocks.select("block", "size", "places").join(pairs, "block", "left").mapInArrow(lean(run), "block long, size long, places binary")


def _keys(places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the phrases one word longer, and where they begin."""
    at = np.flatnonzero((places[:-1] >= 0) & (places[1:] >= 0))
    return (places[at].astype(np.int64) << 32) | places[at + 1], at


def _proposals(blocks: DataFrame) -> DataFrame:
    """key, n: phrases one word longer than those of the blocks' slots; a key comes up to once for MERGED places."""

    def run(batches):
        held, size = [], 0

        def merged():
            keys, n = np.unique(np.concatenate(held), return_counts=True)
            for k in range(0, len(keys), CHUNK):
                yield pa.RecordBatch.from_arrays([pa.array(keys[k : k + CHUNK]), pa.array(n[k : k + CHUNK])], ["key", "n"])

        for b in batches:
            for n, places in zip(b.column(1).to_pylist(), b.column(2), strict=True):
                held.append(_keys(unpacked(places.as_py(), n))[0])
                size += len(held[-1])
                if size >= MERGED:
                    yield from merged()
                    held, size = [], 0
        if held:
            yield from merged()

    return blocks.mapInArrow(lean(run), "key long, n long")


def _slotted(blocks: DataFrame, candidates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Blocks with the candidates' slots, and the candidates (key) with slot, a slice at a time."""
    total = candidates.count()
    slices = -(-total // SLICE)
    context, found, start = blocks.sparkSession.sparkContext, None, 0
    if not total:
        return blocks.limit(0), candidates.withColumn("slot", F.lit(0).cast("long"))
    rows = blocks.select("block", "size", "places", F.lit(None).cast("binary").alias("slots"))
    for k in range(slices):
        own = candidates.where(F.pmod(F.xxhash64("key", F.lit(11)), F.lit(slices)) == k) if slices > 1 else candidates
        keys = own.toArrow().column("key").to_numpy()
        table = context.broadcast(PerfectHash(keys))

        def fill(batches, table=table, start=start):
            for b in batches:
                out = []
                for n, places, slots in zip(b.column(1).to_pylist(), b.column(2), b.column(3), strict=True):
                    now = unpacked(slots.as_py(), n).copy() if slots.is_valid else np.full(n, -1, dtype=np.int32)
                    keys, at = _keys(unpacked(places.as_py(), n))
                    slot = table.value.find(keys)
                    now[at[slot >= 0]] = slot[slot >= 0] + start
                    out.append(packed(now))
                yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(out, pa.binary())], b.schema.names)

        def named(batches, table=table, start=start):
            for b in batches:
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(table.value.find(b.column(0).to_numpy()) + start)], ["key", "slot"])

        rows = checkpointed(rows.mapInArrow(lean(fill), "block long, size long, places binary, slots binary"))
        part = checkpointed(own.select("key").mapInArrow(named, "key long, slot long"))
        found = part if found is None else found.unionByName(part)
        start += len(keys)
        table.unpersist()
    return rows.select("block", "size", F.col("slots").alias("places")), found


def _counts(blocks: DataFrame) -> DataFrame:
    """slot, a: how often each slot stands in the blocks, by bincounts that are summed in a tree."""

    def chunks(counts: np.ndarray, first: int, lane: int):
        at = np.flatnonzero(counts)
        return lane, first, at.astype(np.uint16).tobytes(), counts[at].astype(np.int64).tobytes()

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], ["lane", "chunk", "at", "n"])

    def bincounts(batches):
        lane, held, size = TaskContext.get().partitionId(), [], 0

        def counted():
            slots = np.sort(np.concatenate(held))
            edges = np.flatnonzero(np.diff(slots >> 16)) + 1
            for own in np.split(slots, edges):
                if len(own):
                    yield batch([chunks(np.bincount(own & (CHUNK - 1)), int(own[0]) >> 16, lane)])

        for b in batches:
            for n, places in zip(b.column(1).to_pylist(), b.column(2), strict=True):
                slots = unpacked(places.as_py(), n)
                held.append(slots[slots >= 0])
                size += len(held[-1])
                if size >= MERGED:
                    yield from counted()
                    held, size = [], 0
        if held:
            yield from counted()

    def summed(batches):
        """Runs of one (lane, chunk) become one row."""
        key, total = None, None
        for b in batches:
            for lane, chunk, at, n in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                if key != (lane, chunk):
                    if key is not None:
                        yield batch([chunks(total, key[1], key[0])])
                    key, total = (lane, chunk), np.zeros(CHUNK, dtype=np.int64)
                total[np.frombuffer(at, np.uint16)] += np.frombuffer(n, np.int64)
        if key is not None:
            yield batch([chunks(total, key[1], key[0])])

    def opened(batches):
        for b in batches:
            for chunk, at, n in zip(*(b.column(k).to_pylist() for k in (1, 2, 3)), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(at, np.uint16).astype(np.int64) + (chunk << 16)), pa.array(np.frombuffer(n, np.int64))], ["slot", "a"])

    schema = "lane int, chunk int, at binary, n binary"
    rows, width = blocks.mapInArrow(lean(bincounts), schema), blocks.rdd.getNumPartitions()
    while True:
        width = max(1, -(-width // FAN))
        rows = rows.withColumn("lane", F.pmod("lane", F.lit(width))).repartition("lane", "chunk").sortWithinPartitions("lane", "chunk").mapInArrow(summed, schema)
        if width == 1:
            return checkpointed(rows.mapInArrow(opened, "slot long, a long"))


def collocations(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = 30, longest: int = 4, top: int | None = 2000, cover: int = 80) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score for the best phrases of each language (top=None: all).

    Words are counted after lower-casing A-Z, inside pieces cut at ``[.,;:!?\\x0A-\\x0D]``. n: word occurrences of the
    language, a: occurrences of the phrase, l and r: those of the first and last part of its lowest-scoring cut,
    floor(2000000 * a / (l + r)); of equal cuts the first. A phrase goes if a longer candidate around it has at least
    cover % of its occurrences. Order: score and a descending, then the phrase's bytes. A null language is ``und``, a
    null text empty; repeated rows count again; no rows, or no frequent phrase, give no rows. Other columns are ignored.
    """
    blocks = checkpointed(blocks_of(docs, lang_col, text_col))
    entries = blocks.select("block", F.posexplode("words").alias("local", "w")).select("block", "local", "w.*")
    totals = checkpointed(entries.groupBy("lang").agg(F.sum("n").alias("n")))
    words = numbered(entries.groupBy("lang", "word").agg(F.sum("n").alias("a")).where(F.col("a") >= least))
    blocks = checkpointed(_word_slots(blocks, entries, words))
    #: by length: slot, text, a, firsts and lasts (counts of its first and last 1, 2, ... words), first and last word
    word = words.select("slot", "lang", F.col("word").alias("phrase"), "a", F.array("a").alias("firsts"), F.array("a").alias("lasts"), F.col("word").alias("last"))
    shorter, found = word, None
    for _ in range(2, longest + 1):
        candidates = checkpointed(_proposals(blocks).groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= least).select("key"))
        blocks, slots = _slotted(blocks, candidates)
        counted = slots.join(_counts(blocks), "slot").withColumns({"p": F.shiftright("key", 32), "q": F.col("key").bitwiseAND(0xFFFFFFFF)})
        begin = shorter.select(F.col("slot").alias("p"), "lang", F.col("phrase").alias("_fl_begin"), F.col("firsts").alias("_fl_firsts"))
        end = shorter.select(F.col("slot").alias("q"), F.col("lasts").alias("_fl_lasts"), "last")
        longer = checkpointed(
            counted.join(begin, "p").join(end, "q").select(
                "slot", "p", "q", "lang", F.concat_ws(" ", "_fl_begin", "last").alias("phrase"), "a",
                F.concat("_fl_firsts", F.array("a")).alias("firsts"), F.concat("_fl_lasts", F.array("a")).alias("lasts"), "last",
            )
        )
        if found is not None:  # the longest phrase around each of the shorter ones
            around = longer.select(F.explode(F.array("p", "q")).alias("slot"), F.col("a").alias("b")).groupBy("slot").agg(F.max("b").alias("b"))
            found[-1] = found[-1].join(around, "slot", "left").where(F.col("b").isNull() | (F.lit(100) * F.col("b") < F.lit(cover) * F.col("a"))).drop("b")
        found = [*(found or []), longer]
        shorter = longer
    rows = None
    for k, df in enumerate(found or [], 2):
        cuts = [_cut(c, F.element_at("firsts", c), F.element_at("lasts", k - c)) for c in range(1, k)]
        part = df.select("lang", "phrase", "a", F.least(*cuts).alias("cut") if k > 2 else cuts[0].alias("cut"))
        rows = part if rows is None else rows.unionByName(part)
    rows = checkpointed(rows.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score"))
    order = (F.desc("score"), F.desc("a"), F.asc("phrase"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")
    if top is not None:  # first within parts of a language, so that a large one isn't sorted in one task
        salt = F.pmod(F.xxhash64("phrase"), F.lit(SALTS))
        rows = rows.withColumn("_fl_rank", F.row_number().over(Window.partitionBy("lang", salt).orderBy(*order))).where(F.col("_fl_rank") <= top).drop("_fl_rank")
    rows = rows.withColumn("rank", place)
    rows = rows if top is None else rows.where(F.col("rank") <= top)
    return rows.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def _cut(k: int, left, right):
    """(score, k, l, r): in decimals, since 2000000 * a may pass 64 bits."""
    whole = lambda x: x.cast("decimal(20,0)")
    top = F.lit(2_000_000).cast("decimal(8,0)") * whole(F.col("a"))
    parts = whole(left) + whole(right)
    score = (top - top % parts) / parts
    return F.struct(score.cast("long").alias("score"), F.lit(k).alias("k"), left.alias("l"), right.alias("r"))


_GRAMS = " UNION ALL ".join(f"SELECT lang, {k} AS k, unnest([array_to_string(w[i:i + {k - 1}], ' ') FOR i IN range(1, len(w) - {k} + 2)]) AS phrase FROM pieces" for k in range(1, 5))
ORACLE = f"""
WITH pieces AS MATERIALIZED (
  SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece
    FROM documents)
), grams AS MATERIALIZED (
  SELECT lang, k, phrase, count(*) AS f FROM ({_GRAMS}) GROUP BY ALL
), totals AS (
  SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM grams WHERE k = 1 GROUP BY lang
), candidates AS MATERIALIZED (
  SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM grams WHERE k > 1 AND f >= 30
), inner_phrases AS (
  SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, max(a) AS b
  FROM candidates, (SELECT unnest(range(1, 4)) AS i), (SELECT unnest(range(2, 4)) AS m) WHERE m < k AND i + m - 1 <= k GROUP BY ALL
), cuts AS (
  SELECT c.lang, c.phrase, c.a, x.f AS l, y.f AS r, h.i AS i, (2000000::HUGEINT * c.a) // (x.f + y.f) AS score
  FROM candidates c JOIN (SELECT unnest(range(1, 4)) AS i) h ON h.i < c.k
  JOIN grams x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:h.i], ' ')
  JOIN grams y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[h.i + 1:c.k], ' ')
), scored AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, i) = 1
), kept AS (
  SELECT s.* FROM scored s LEFT JOIN inner_phrases o USING (lang, phrase) WHERE o.b IS NULL OR 100 * o.b < 80 * s.a
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score
FROM kept JOIN totals USING (lang) QUALIFY rank <= 2000
"""
