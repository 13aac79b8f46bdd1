"""Scoring a corpus with the gated recurrent language model of gru_lm.

Over all training documents (crc32 of the id as text, mod 5, is not 1), distributed:

1. Token counts, by a table in each task and a sum by token. Tokens are words with A-Z folded, and one end a text.
2. The head, the most frequent tokens and the end: HEAD of them at most (a bound on what is broadcast), by a threshold
   from a histogram of counts; the end and the VOCAB most frequent are the model's words. All other tokens are in the model by shape, with
   the share (c + 0.5) / (mass of the shape) inside it, so that model and base score the same events.
3. Training. Documents are dealt by a hash of id and text to groups of about GROUP tokens, in an order of that hash. Each
   group is read with the state carried over whole documents and learned from in every window, at a falling rate; the
   groups' weights are averaged by the targets they learned from. First a pass over one document in FIRST_PASS from the
   unigram model, so that the groups start alike, then one over all from the first average. Groups don't depend on how
   rows fall into tasks, so neither do scores; what is gathered grows with the number of groups.
4. Scoring. Whole documents; tokens outside the head are joined to their counts and added per document.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import gru_lm
from .common import checkpointed, raw_texts, small_batches, worker_state

FOLDS, HELD_OUT = 5, 1
HEAD, VOCAB = 1 << 18, 4096
FIRST_PASS, GROUP = 8, 4_000_000
SLICE_BYTES, CHUNK_BYTES, OUT_ROWS = 32_000_000, 6_000_000, 20_000
PIECE = 512
LOG10 = float(np.log(10))


def is_held_out(doc_id: Column) -> Column:
    """A null id is for training."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def _blank_table() -> np.ndarray:
    t = np.zeros(256, dtype=bool)
    t[[0x20, *range(0x09, 0x0E)]] = True
    return t


BLANK = _blank_table()


@dataclass
class Tokens:
    """The words of several texts, A-Z folded, as one Arrow array; how many each text has; their shapes."""

    words: pa.Array
    per_text: np.ndarray
    shapes: np.ndarray


def tokenised(texts: list[bytes]) -> Tokens:
    """Words without Python objects: the bytes between blanks, with the blanks taken out."""
    data = np.frombuffer(b"\n".join(texts).lower() + b"\n", dtype=np.uint8)
    blank = np.ones(len(data) + 1, dtype=bool)
    blank[1:] = BLANK[data]
    edge = np.flatnonzero(blank[1:] != blank[:-1])
    starts, ends = edge[0::2], edge[1::2]
    offsets = np.zeros(len(starts) + 1, dtype=np.int32)
    np.cumsum(ends - starts, out=offsets[1:])
    words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data[~blank[1:]])])
    after = np.cumsum(np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)) + 1)
    upto = np.searchsorted(starts, after)
    return Tokens(words, np.diff(upto, prepend=0), gru_lm.shapes(data[starts], data[ends - 1]))


def _chunks(texts: list[bytes]) -> Iterator[list[bytes]]:
    start = held = 0
    for i, x in enumerate(texts):
        if i > start and held + len(x) > CHUNK_BYTES:
            yield texts[start:i]
            start, held = i, 0
        held += len(x)
    if texts:
        yield texts[start:]


def end_bytes(tokens: pa.Array) -> np.ndarray:
    """The shapes of binary tokens; that of the empty one is arbitrary."""
    offsets = np.frombuffer(tokens.buffers()[1], dtype=np.int32)[tokens.offset : tokens.offset + len(tokens) + 1]
    data = np.frombuffer(tokens.buffers()[2] or b"\0", dtype=np.uint8)
    if not len(data):
        data = np.zeros(1, dtype=np.uint8)
    top = len(data) - 1
    return gru_lm.shapes(data[np.minimum(offsets[:-1], top)], data[np.clip(offsets[1:] - 1, 0, top)])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of the tokens of each SLICE_BYTES of text."""
    for _, texts in _gathered(batches, 0):
        parts = [pc.value_counts(tokenised(chunk).words) for chunk in _chunks(texts)]
        table = pa.table({"token": pa.chunked_array([p.field(0) for p in parts]), "n": pa.chunked_array([p.field(1) for p in parts])})
        sums = table.group_by("token").aggregate([("n", "sum")]).select(["token", "n_sum"]).rename_columns(["token", "n"])
        yield from sums.to_batches(max_chunksize=OUT_ROWS)
        yield pa.RecordBatch.from_arrays([pa.array([b""], pa.binary()), pa.array([len(texts)], pa.int64())], ["token", "n"])


def token_counts(texts: DataFrame) -> DataFrame:
    """(token, c) of a table of one text column; the end is the empty token."""
    parts = texts.mapInArrow(_count, "token binary, n long")
    return checkpointed(parts.groupBy("token").agg(F.sum("n").alias("c")))


def _tails(vocab: frozenset):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, v = np.zeros(gru_lm.TAILS), np.zeros(gru_lm.TAILS)
        for batch in batches:
            tokens, c = batch.column(0), batch.column(1).to_numpy()
            outside = np.fromiter((t not in vocab for t in tokens.to_pylist()), dtype=bool, count=len(tokens))
            shape = end_bytes(tokens)[outside]
            n += np.bincount(shape, c[outside], gru_lm.TAILS)
            v += np.bincount(shape, minlength=gru_lm.TAILS)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(gru_lm.TAILS)), pa.array(n), pa.array(v)], ["shape", "n", "v"])

    return run


class Lexicon:
    """The head tokens with their counts, the first VOCAB of them the model's words, and the mass of every shape."""

    def __init__(self, blob: bytes, counts: bytes, tails: bytes, n: int, v: int, vocab: int):
        tokens = blob.split(b"\n") if blob else []
        self.end = tokens.index(b"") if b"" in tokens else -1
        self.vocab = vocab
        self.tokens, self.counts = tokens, np.frombuffer(counts, dtype=np.int64)
        tail_n, tail_v = np.frombuffer(tails, dtype=np.float64).reshape(2, -1)
        self.layout = gru_lm.Layout(self.counts[: self.vocab].astype(float), tail_n)
        self.tail_mass = np.log10(tail_n + 0.5 * (tail_v + 1))
        self.base_mass = np.log10(n + 0.5 * (v + 1))
        self.head = pa.array(tokens, pa.binary())
        self.own = self.head.slice(0, vocab)
        self.log_count = np.log10(self.counts + 0.5)

    def symbols(self, tokens: Tokens) -> tuple[np.ndarray, list[np.ndarray]]:
        """Places of all words in the head (-1: none); each text's symbols for the model, the end last."""
        place = pc.index_in(tokens.words, value_set=self.head).fill_null(-1).to_numpy()
        return place, self._with_ends(np.where((place < 0) | (place >= self.vocab), self.vocab + tokens.shapes, place), tokens.per_text)

    def model_symbols(self, tokens: Tokens) -> list[np.ndarray]:
        """The symbols alone, from the model's own words."""
        place = pc.index_in(tokens.words, value_set=self.own).fill_null(-1).to_numpy()
        return self._with_ends(np.where(place < 0, self.vocab + tokens.shapes, place), tokens.per_text)

    def _with_ends(self, symbols: np.ndarray, per_text: np.ndarray) -> list[np.ndarray]:
        upto = np.cumsum(per_text)
        whole = np.insert(symbols.astype(np.int32), upto, self.end)
        return np.split(whole, upto[:-1] + np.arange(1, len(upto)))


def lexicon(*parts) -> Lexicon:
    """The lexicon of these parts, kept between tasks."""
    held, key = worker_state("lm_score", dict), hash(parts)
    if key not in held:
        held.clear()
        held[key] = Lexicon(*parts)
    return held[key]


def build_lexicon(counts: DataFrame) -> tuple:
    """The parts of a Lexicon, bounded by HEAD tokens."""
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    level = F.floor(F.log("c") * 64)
    steps = counts.groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect()  # at most 64 * ln(2 ** 63) rows
    kept, least = 1, None  # the end is one of them, however often it is met
    for r in steps:
        if kept + r["count"] > HEAD:
            break
        kept, least = kept + r["count"], r["level"]
    is_end = F.octet_length("token") == 0
    head = counts.where(is_end if least is None else is_end | (level >= least)).toArrow().to_pydict()
    both = sorted(zip(head["c"], head["token"], strict=True), key=lambda x: (-x[0], x[1]))
    both.sort(key=lambda x: x[1] != b"")  # the end is always one of the model's words
    both[:VOCAB] = sorted(both[:VOCAB], key=lambda x: (-x[0], x[1]))
    vocab = frozenset(t for _, t in both[:VOCAB])
    tails = np.zeros((2, gru_lm.TAILS))
    for r in counts.mapInArrow(_tails(vocab), "shape long, n double, v double").groupBy("shape").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect():
        tails[:, r["shape"]] = r["n"], r["v"]
    return b"\n".join(t for _, t in both), np.array([c for c, _ in both], dtype=np.int64).tobytes(), tails.tobytes(), total["n"], total["v"], len(vocab)


def _gathered(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Batches joined to about SLICE_BYTES of text, so that lanes are long and even."""
    held, size, texts = [], 0, []
    for batch in batches:
        own = raw_texts(batch.column(column))
        start = 0
        for i, x in enumerate(own):
            if (held or i > start) and size + len(x) > SLICE_BYTES:
                held.append(batch.slice(start, i - start))
                yield pa.concat_batches([b for b in held if len(b)]), texts
                held, size, texts, start = [], 0, [], i
            texts.append(x)
            size += len(x)
        held.append(batch.slice(start))
    if texts:
        yield pa.concat_batches([b for b in held if len(b)]), texts


def _by_group(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[bytes], bool]]:
    """(group, texts, whether they end it) of rows in the order of groups; up to SLICE_BYTES of texts at a time."""
    now, held, size = None, [], 0
    for batch in batches:
        for group, text in zip(batch.column(0).to_pylist(), raw_texts(batch.column(1)), strict=True):
            if held and (group != now or size + len(text) > SLICE_BYTES):
                yield now, held, group != now
                held, size = [], 0
            now = group
            held.append(text)
            size += len(text)
    if held:
        yield now, held, True


def _learn(parts: tuple, flat: bytes | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = lexicon(*parts)
        start = gru_lm.initial(lex.layout)
        if flat is not None:
            start = gru_lm.unpacked(np.frombuffer(flat, dtype=np.float32), start)
        weights: dict | None = None
        for _, texts, over in _by_group(batches):
            if weights is None:
                weights, memory, learned = {k: w.copy() for k, w in start.items()}, {}, 0
            learned += gru_lm.train([x for chunk in _chunks(texts) for x in lex.model_symbols(tokenised(chunk))], weights, lex.layout, memory=memory)[0]
            if over:
                out = gru_lm.packed(weights) * np.float32(learned)
                pieces = [out[k : k + PIECE].tobytes() for k in range(0, len(out), PIECE)]
                yield pa.RecordBatch.from_arrays([pa.array(range(len(pieces)), pa.int32()), pa.array([learned] * len(pieces), pa.int64()), pa.array(pieces, pa.binary())], ["piece", "learned", "weights"])
                weights = None

    return run


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    learned: Counter = Counter()
    for batch in batches:
        for k, n, w in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            w = np.frombuffer(w, dtype=np.float32).astype(np.float64)
            sums[k] = sums[k] + w if k in sums else w
            learned[k] += n
    if sums:
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([(sums[k] / learned[k]).astype(np.float32).tobytes() for k in sums], pa.binary())], ["piece", "weights"])


def averaged(texts: DataFrame, tokens: int, parts: tuple, flat: bytes | None) -> bytes | None:
    """The groups' weights after a pass over texts (_fl_key, _fl_text), averaged piece by piece.

    There is a group for each GROUP of tokens; the model comes to the driver (half a MB).
    """
    groups = max(1, -(-tokens // GROUP))
    dealt = texts.select(F.pmod("_fl_key", F.lit(groups)).cast("int").alias("_fl_group"), "_fl_key", "_fl_text")
    rows = dealt.repartitionById(groups, "_fl_group").sortWithinPartitions("_fl_group", "_fl_key").select("_fl_group", "_fl_text")
    own = rows.mapInArrow(_learn(parts, flat), "piece int, learned long, weights binary")
    pieces = own.repartition("piece").mapInArrow(_add, "piece int, weights binary").collect()
    return b"".join(r.weights for r in sorted(pieces, key=lambda r: r.piece)) or flat


def _score(parts: tuple, flat: bytes | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = lexicon(*parts)
        weights = gru_lm.initial(lex.layout)
        if flat is not None:
            weights = gru_lm.unpacked(np.frombuffer(flat, dtype=np.float32), weights)
        for part, texts in _gathered(batches, 3):
            symbols, known, base, shaped, tails = [], [], [], [], []
            for chunk in _chunks(texts):
                tokens = tokenised(chunk)
                place, own = lex.symbols(tokens)
                symbols += own
                text_of = np.repeat(np.arange(len(chunk)), tokens.per_text)
                in_head, outside = place >= 0, (place < 0) | (place >= lex.vocab)
                per_text = lambda mask, values, n=len(chunk), at=text_of: np.bincount(at[mask], values, n)
                counted = lex.log_count[place[in_head]]
                known.append(per_text(in_head, None) + 1)
                base.append(per_text(in_head, counted) + lex.log_count[lex.end] - (tokens.per_text + 1) * lex.base_mass)
                both = in_head & outside
                shaped.append(per_text(both, lex.log_count[place[both]]) - per_text(outside, lex.tail_mass[tokens.shapes[outside]]))
                unknown = np.flatnonzero(~in_head)
                ends = np.concatenate(([0], np.cumsum(np.bincount(text_of[unknown], minlength=len(chunk))))).astype(np.int32)
                tails.append(pa.ListArray.from_arrays(pa.array(ends), tokens.words.take(pa.array(unknown))))
            model = gru_lm.score(symbols, weights, lex.layout) / LOG10
            out = [pa.array(np.fromiter(map(len, symbols), dtype=np.int64, count=len(symbols))), pa.array(np.concatenate(known).astype(np.int64)), pa.array(np.concatenate(base)), pa.array(np.concatenate(shaped) + model), pa.concat_arrays(tails)]
            yield from pa.table([*part.columns[:3], *out], names=["_fl_row", "_fl_id", "held_out", "n_tokens", "n_known", "base", "model", "tail"]).to_batches(max_chunksize=OUT_ROWS)

    return run


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10).

    Null texts count as empty: one token, the end. A null id is for training. Repeated rows are rows of their own and
    are counted as often; an empty table gives no rows. If no row is for training, all tokens are unknown, the model is
    the base and score equals base_score. Other columns are ignored. Whole texts are read, in memory that follows their
    tokens. Groups of documents train apart and are averaged; sums of floats apart, score is the same however rows fall
    into tasks.
    """
    own = small_batches(docs).select(F.col(id_col).alias("_fl_id"), F.col(text_col).alias("_fl_text"), is_held_out(F.col(id_col)).alias("held_out"))
    train = own.where("not held_out")
    counts = token_counts(train.select("_fl_text"))
    parts = build_lexicon(counts)
    n, v = parts[3:5]
    kind = docs.schema[id_col].dataType.simpleString()
    if not n:
        total = F.size(F.filter(F.split(F.coalesce("_fl_text", F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")).cast("long") + 1
        base = total * float(np.log10(0.5 / (n + 0.5 * (v + 1))))
        return own.select(F.col("_fl_id").alias(id_col), "held_out", total.alias("n_tokens"), F.lit(0).cast("long").alias("n_known"), F.lit(0).cast("long").alias("train_tokens"), base.alias("base_score"), base.alias("score"))
    keyed = train.select(F.xxhash64("_fl_id", "_fl_text", F.lit(5)).alias("_fl_key"), "_fl_text")
    first = keyed.where(F.pmod(F.xxhash64("_fl_key"), F.lit(FIRST_PASS)) == 0)
    flat = averaged(first, -(-n // FIRST_PASS), parts, None)
    flat = averaged(keyed, n, parts, flat)

    numbered = own.select(F.monotonically_increasing_id().alias("_fl_row"), "_fl_id", "held_out", "_fl_text")
    scored = checkpointed(numbered.mapInArrow(_score(parts, flat), f"_fl_row long, _fl_id {kind}, held_out boolean, n_tokens long, n_known long, base double, model double, tail array<binary>"))
    tail = scored.select("_fl_row", F.explode("tail").alias("token")).join(counts, "token", "left")
    added = tail.groupBy("_fl_row").agg(F.sum(F.log10(F.coalesce("c", F.lit(0)) + 0.5)).alias("_fl_log"), F.count("c").alias("_fl_known"))
    out = scored.drop("tail").join(added, "_fl_row", "left")
    more = F.coalesce("_fl_log", F.lit(0.0))
    return out.select(
        F.col("_fl_id").alias(id_col), "held_out", "n_tokens", (F.col("n_known") + F.coalesce("_fl_known", F.lit(0))).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"), (F.col("base") + more).alias("base_score"), (F.col("model") + more).alias("score"),
    )
