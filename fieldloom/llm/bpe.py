"""BPE encoding and decoding with content-defined chunk reuse.

A rolling hash over the last WINDOW bytes marks, among the starts of words, where a chunk begins; the same passage gives
the same chunks in every document, wherever it stands. A worker keeps the chunks that it has encoded in a table of a
fixed size that outlives the task, and encodes only what it has not seen. At each chunk join, the words to both sides
are encoded together and apart; where that differs, the two chunks become one, which is encoded anew, until all joins
agree.

Chunks are reused only with a tokenizer that is ``word_wise``: its pre-tokenizer drops white space and never joins
across it, its normaliser works on single characters and on marks after a base character, and added tokens hold no
blank. With any other tokenizer, whole texts go to the library.

A chunk of Latin text is encoded by tiktoken where the vocabulary allows it (see ``unreached``): tokenizers spends most of
its time on the alignment of each word with the text, which nothing here asks for. Other chunks, and the words at the
joins, are encoded by tokenizers, so that joins are verified by the library whose ids are wanted.
"""

from __future__ import annotations

import gc
import json
import os
import re
import unicodedata
from array import array
from collections.abc import Iterator
from itertools import pairwise
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, lean, raw_texts, small_batches, worker_state

WINDOW, MULTIPLIER, MASK = 16, np.uint32(0x9E3779B1), np.uint32(127)
#: Bounds of the tables in a worker: joins and chunks (in bytes of text).
MAX_JOINS, MAX_CHUNK_BYTES = 50_000, 6_000_000
PART_DOCS, PART_BYTES = 512, 2_000_000
#: Characters that the library encodes at once: it holds some 35 bytes a character until their ids are read.
AT_ONCE = 200_000
#: Bytes from which UTF-8 has characters beyond U+023F. Those below have no marks to compose and one lower-case form,
#: so that str.lower() can stand for the normaliser (each worker compares them all first).
LATIN = 0x240
BEYOND_LATIN = re.compile(rb"[\xc9-\xff]")
#: The pattern of the pre-tokenizer that SPLIT follows for these characters (each worker compares them all first).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
LETTERS, NUMBERS = ("".join(sorted({x for c in range(0x80, LATIN) for x in chr(c) + chr(c).lower() if unicodedata.category(x)[0] == k})) for k in "LN")
SPLIT = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[a-z{LETTERS}]+|[0-9{NUMBERS}]|[^\t-\r \x85\xa0a-z{LETTERS}0-9{NUMBERS}]+")
#: The end of a word in what tiktoken gets; texts that hold it go to tokenizers.
END = "\x01"


def _blank_table() -> np.ndarray:
    t = np.zeros(256, dtype=bool)
    t[[0x20, *range(0x09, 0x0E)]] = True
    return t


BLANK = _blank_table()


def rolling(data: np.ndarray) -> np.ndarray:
    """The hash of the WINDOW bytes that end at each position, by doubling the span."""
    h, m, span = data.astype(np.uint32), MULTIPLIER, 1
    while span < WINDOW:
        more = h.copy()
        more[span:] += m * h[:-span]
        h, m, span = more, m * m, span * 2
    return h


def chunks(text: bytes) -> list[bytes]:
    """The text cut before words whose preceding bytes hash to 0 under MASK; blanks stay with the word before."""
    data = np.frombuffer(text, dtype=np.uint8)
    if len(data) <= WINDOW:
        return [text] if len(data) else []
    with np.errstate(over="ignore"):
        h = rolling(data)
    blank = BLANK[data]
    starts = np.flatnonzero(blank[:-1] & ~blank[1:])
    # the hash ends at the last byte of the word before, so it does not depend on how many blanks follow
    ends = np.flatnonzero(~blank[:-1] & blank[1:])
    if len(ends) and len(starts):
        before = np.searchsorted(ends, starts, side="right") - 1
        ok = before >= 0
        starts, before = starts[ok], before[ok]
        v = h[ends[before]]
        starts = starts[((v ^ (v >> np.uint32(15))) & MASK) == 0] + 1
    else:
        starts = starts[:0]
    at = [0, *starts.tolist(), len(text)]
    return [text[a:b] for a, b in pairwise(at) if b > a]


class Kept(dict):
    """A table of bounded size that keeps its newer half when full."""

    def trim(self, most: int) -> None:
        if len(self) > most:
            for k in list(self)[: len(self) - most // 2]:
                del self[k]


def _steps(part: dict | None, key: str) -> list[dict]:
    return [] if part is None else part[key] if part["type"] == "Sequence" else [part]


def word_wise(spec: dict) -> bool:
    """Whether a tokenizer (its JSON) encodes each word by itself, so that texts may be cut at blanks; no doubtful case is."""
    pre, norm = _steps(spec.get("pre_tokenizer"), "pretokenizers"), _steps(spec.get("normalizer"), "normalizers")
    if not pre or pre[0]["type"] != "Split" or pre[0]["behavior"] != "Removed" or not pre[0]["invert"] or "Regex" not in pre[0]["pattern"]:
        return False
    pattern = re.sub(r"\[\^\\s[^\]]*\]", "", pre[0]["pattern"]["Regex"])  # what is left must match no blank
    return (
        not any(x in pattern for x in (" ", ".", "[^", "(?", "\\s", "\\S", "\\W", "\\D", "\\P"))
        and all(x["type"] == "ByteLevel" and not x["add_prefix_space"] and not x["use_regex"] for x in pre[1:])
        and all(x["type"] in ("NFC", "Lowercase") or x["type"] == "Replace" and x["pattern"] == {"Regex": "\\s+"} and x["content"] == " " for x in norm)
        and spec.get("decoder") is None and spec.get("post_processor") is None and spec["model"]["type"] == "BPE"
        and not any(x["lstrip"] or x["rstrip"] or x["single_word"] or x["normalized"] or len(x["content"].split()) != 1 for x in spec.get("added_tokens", ()))
    )


def byte_of() -> dict[str, int]:
    """The byte that each character of a ByteLevel token stands for."""
    seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(0x100) if b not in set(seen)]
    return {chr(b): b for b in seen} | {chr(0x100 + k): b for k, b in enumerate(rest)}


def unreached(spec: dict) -> tuple[int, ...] | None:
    """The ids of tokens that merging never gives, if a tokenizer's merges may be read from the ranks of its other tokens; else None.

    Ranks merge the neighbours x, y whose bytes together are the token of least id; merges ask for the pair. Both are the same
    if ids ascend with the merges and each token t = xy comes out whole when its own characters are encoded: until x and y
    stand side by side, nothing has merged across the ends of t, so that its characters went the way that they go by
    themselves, which ends in t only if x, y is one of the pairs. Likewise, a token that doesn't come out whole comes out
    nowhere.
    """
    from tokenizers.models import BPE

    pre, model = _steps(spec.get("pre_tokenizer"), "pretokenizers"), spec["model"]
    if not word_wise(spec) or pre[0]["pattern"]["Regex"] != PATTERN or [x["type"] for x in pre[1:]] != ["ByteLevel"]:
        return None
    suffix, vocab, merges = model.get("end_of_word_suffix"), model["vocab"], [tuple(x.split(" ")) if isinstance(x, str) else tuple(x) for x in model["merges"]]
    if not suffix or len(suffix) == 1 or any(model.get(x) for x in ("dropout", "continuing_subword_prefix", "byte_fallback", "ignore_merges")):
        return None
    singles = {c + end for c in byte_of() for end in ("", suffix)}
    made = [vocab.get(a + b, -1) for a, b in merges]
    if not singles <= vocab.keys() or made != sorted(set(made)) or set(vocab) - singles != {a + b for a, b in merges}:
        return None
    if made and max(vocab[x] for x in singles) >= made[0] or any(a.endswith(suffix) or (a + b).endswith(suffix) != b.endswith(suffix) for a, b in merges):
        return None  # ends of words are not told apart from what stands in them
    if any(chr(0x100 + ord(END)) in x for x in vocab if x not in singles):
        return None  # END inside a word
    inner, whole = BPE(vocab, merges), BPE(vocab, merges, end_of_word_suffix=suffix)
    alone = ((i, whole.tokenize(t.removesuffix(suffix)) if t.endswith(suffix) else inner.tokenize(t)) for t, i in vocab.items())
    return tuple(i for i, found in alone if [x.id for x in found] != [i])


class Chunk(NamedTuple):
    """An encoded chunk: ids as int32 bytes, its tokens joined by a blank, its first and last word (empty if it has none)."""

    ids: bytes
    tokens: str
    first: bytes
    last: bytes


class Traits(NamedTuple):
    """What a tokenizer's JSON says about it; read once, since parsing it in every worker takes memory."""

    word_wise: bool
    lower: bool
    added: tuple[str, ...]
    suffix: str | None
    unreached: tuple[int, ...] | None


def traits(json_text: str) -> Traits:
    spec = json.loads(json_text)
    lower = "Lowercase" in {x["type"] for x in _steps(spec.get("normalizer"), "normalizers")}
    added = tuple(x["content"].lower() for x in spec.get("added_tokens", ()))
    return Traits(word_wise(spec), lower, added, spec["model"].get("end_of_word_suffix"), unreached(spec) if lower else None)


def _groups(texts: list) -> Iterator[list]:
    """The texts in order, in lists of at most AT_ONCE characters (or bytes) or of one longer text."""
    start = held = 0
    for i, x in enumerate(texts):
        if i > start and held + len(x) > AT_ONCE:
            yield texts[start:i]
            start, held = i, 0
        held += len(x)
    if start < len(texts):
        yield texts[start:]


class Encoder:
    """Encodes whole texts as tokenizer.encode(text, add_special_tokens=False), decodes as decode(ids, skip_special_tokens=False)."""

    def __init__(self, json_text: str, known: Traits | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        known = known or traits(json_text)
        self.word_wise, lower, self.added = known.word_wise, known.lower, known.added
        self.tokenizer = self._load(json_text)
        self.token = [self.tokenizer.id_to_token(i) for i in range(self.tokenizer.get_vocab_size())]
        self.bare = self.ranks = None  # the tokenizer and tiktoken for Latin texts in lower case, which need no normaliser
        if self.word_wise and lower:
            bare = self._load(json_text)
            bare.normalizer = None
            each = [f"a{chr(c)}b {chr(c)} {chr(c)}{chr(c)}a" for c in range(LATIN)]
            same = zip(self._ids(self.tokenizer, each), self._ids(bare, [x.lower() for x in each]), strict=True)
            self.bare = bare if all(x == y for x, y in same) else None
        if self.bare is not None and known.unreached is not None:
            self.ranks = self._ranks(known.suffix, set(known.unreached))
            low = [x.lower() for x in each if END not in x]
            if self._ids(bare, low) != [self._by_ranks(x) for x in low]:
                self.ranks = None
        self.chunks, self.joins, self.chunk_bytes, self.seen, self.reused = Kept(), Kept(), 0, 0, 0

    @staticmethod
    def _load(json_text: str):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_str(json_text)
        tokenizer.no_padding()
        tokenizer.no_truncation()
        return tokenizer

    @staticmethod
    def _ids(tokenizer, texts: list[str]) -> list[list[int]]:
        return [e.ids for own in _groups(texts) for e in tokenizer.encode_batch_fast(own, add_special_tokens=False)]

    def _ranks(self, suffix: str, without: set[int]):
        """tiktoken with the tokenizer's tokens as bytes, END for the suffix, and their ids as ranks."""
        import tiktoken

        byte, held = byte_of(), {}
        for i, t in enumerate(self.token):
            core = t.removesuffix(suffix)
            if i not in without and all(c in byte for c in core) and t.lower() not in self.added:
                held[bytes([byte[c] for c in core]) + (END.encode() if core != t else b"")] = i
        return tiktoken.Encoding("own", pat_str=f"[^{END}]+{END}", mergeable_ranks=held, special_tokens={})

    def _by_ranks(self, low: str) -> list[int]:
        words = SPLIT.findall(low)
        return self.ranks.encode_ordinary(END.join(words) + END) if words else []

    def _plain(self, x: bytes) -> str | None:
        """The text in lower case if it is known to need no other normaliser."""
        if self.bare is None or BEYOND_LATIN.search(x):
            return None
        low = x.decode("utf-8", "replace").lower()
        return None if any(t in low for t in self.added) else low

    def _encode(self, parts: list[bytes], by_ranks: bool = False) -> list[list[int]]:
        """The ids of texts, by the tokenizer without its normaliser (or by ranks, if asked) where that is known to be the same."""
        out: list = [None] * len(parts)
        bare, full = [], []
        for i, x in enumerate(parts):
            low = self._plain(x)
            if low is None:
                full.append((i, x.decode("utf-8", "replace")))
            elif by_ranks and self.ranks is not None and END not in low:
                out[i] = self._by_ranks(low)
            else:
                bare.append((i, low))
        for tokenizer, own in ((self.bare, bare), (self.tokenizer, full)):
            if own:
                for (i, _), ids in zip(own, self._ids(tokenizer, [x for _, x in own]), strict=True):
                    out[i] = ids
        return out

    def _add(self, fresh: list[bytes]) -> None:
        """Encode chunks and put them in the table."""
        token = self.token
        for own in _groups(fresh):
            for c, ids in zip(own, self._encode(own, by_ranks=True), strict=True):
                words = c.split(None, 1)
                last = c.rsplit(None, 1)
                self.chunks[c] = Chunk(array("i", ids).tobytes(), " ".join([token[i] for i in ids]), words[0] if words else b"", last[-1].strip() if words else b"")
                self.chunk_bytes += len(c)

    def encode(self, texts: list[bytes]) -> tuple[list[bytes], list[str]]:
        """ids (int32 bytes) and decoded text of each text."""
        if not self.word_wise:
            found = self._ids(self.tokenizer, [x.decode("utf-8", "replace") for x in texts])
            return [np.array(x, dtype=np.int32).tobytes() for x in found], self.tokenizer.decode_batch(found, skip_special_tokens=False)
        cut = [chunks(t) for t in texts]
        fresh = list(dict.fromkeys(c for own in cut for c in own if c not in self.chunks))
        self.seen += sum(map(len, cut))
        self.reused += sum(map(len, cut)) - len(fresh)
        self._add(fresh)
        known = self.chunks
        bad = self.disagreeing({(known[a].last, known[b].first) for own in cut for a, b in pairwise(own)})
        ids, decoded = [], []
        for own in cut:
            parts = self.repaired(own) if bad and any((known[a].last, known[b].first) in bad for a, b in pairwise(own)) else [known[c] for c in own]
            ids.append(b"".join([p.ids for p in parts]))
            decoded.append(" ".join([p.tokens for p in parts if p.tokens]))
        if self.chunk_bytes > MAX_CHUNK_BYTES:
            self.chunks.trim(len(self.chunks) // 2)
            self.chunk_bytes = sum(map(len, self.chunks))
        return ids, decoded

    def disagreeing(self, joins: set[tuple[bytes, bytes]]) -> set[tuple[bytes, bytes]]:
        """The joins (last word, first word) whose words, encoded together, differ from the two apart."""
        self.joins.trim(MAX_JOINS)
        todo = [x for x in joins if x not in self.joins]
        words = list({w for x in todo for w in x})
        alone = dict(zip(words, self._encode(words), strict=True))
        for (a, b), ids in zip(todo, self._encode([a + b" " + b for a, b in todo]), strict=True):
            self.joins[a, b] = ids == alone[a] + alone[b]
        return {x for x in joins if not self.joins[x]}

    def repaired(self, own: list[bytes]) -> list[Chunk]:
        """The chunks of a text, where those to both sides of a join that disagrees are one, encoded anew."""
        out = own[:1]
        for c in own[1:]:
            self._add([x for x in (out[-1], c) if x not in self.chunks])
            if self.disagreeing({(self.chunks[out[-1]].last, self.chunks[c].first)}):
                out[-1] += c
            else:
                out.append(c)
        self._add([x for x in out if x not in self.chunks])
        return [self.chunks[x] for x in out]


def encoder(json_text: str, known: Traits) -> Encoder:
    """One encoder for each vocabulary in a worker, kept between tasks."""
    held = worker_state("bpe", dict)
    key = hash(json_text)
    if key not in held:
        held.clear()
        held[key] = Encoder(json_text, known)
        give_back()
    return held[key]


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of few documents and bytes, so that a worker holds little at a time."""
    sizes = [x.as_py() or 0 for x in pa.compute.binary_length(batch.column(1))]
    start = held = 0
    for i, n in enumerate(sizes):
        if i > start and (held + n > PART_BYTES or i - start >= PART_DOCS):
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    yield batch.slice(start)


def _run(json_text: str, known: Traits):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute  # noqa: F401

        own = encoder(json_text, known)
        gc.disable()  # the tables are large and nothing here makes cycles
        try:
            for batch in batches:
                for part in _parts(batch):
                    ids, decoded = own.encode(raw_texts(part.column(1)))
                    offsets = np.concatenate(([0], np.cumsum([len(x) // 4 for x in ids]))).astype(np.int32)
                    values = pa.array(np.frombuffer(b"".join(ids), dtype=np.int32))
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(offsets), values), pa.array(decoded, pa.string())], ["_fl_id", "ids", "decoded"])
        finally:
            gc.enable()

    return run


def encode(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: id, ids (array<int>), decoded.

    tokenizer_path is read on the driver and its content goes to the workers; chunks are reused if the tokenizer is
    word_wise, else whole texts go to it. Null texts count as empty and have no ids;
    whole texts are encoded, however long; repeated ids give repeated rows; an empty table gives none; other columns
    are ignored.
    """
    with open(tokenizer_path, encoding="utf-8") as f:
        json_text = f.read()
    kind = docs.schema[id_col].dataType.simpleString()
    own = small_batches(docs).select(F.col(id_col).alias("_fl_id"), F.col(text_col).alias("_fl_text"))
    return own.mapInArrow(lean(_run(json_text, traits(json_text))), f"_fl_id {kind}, ids array<int>, decoded string").withColumnRenamed("_fl_id", id_col)


def digests(encoded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return encoded.select(
        id_col,
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
