"""Quality rules: repetition limits, then the distance of a text's histograms from its language's reference.

Two passes over whole texts:

1. References. Every document adds its character classes and words to its language; counts are summed by key with a
   partial sum in each task, and the COMMON_WORDS most frequent words of each language are kept with the rest as one
   bin. Every language has a reference; a null language is held against the reference of all documents.
2. Verdicts. Each text's two histograms are compared by Jensen-Shannon distance (base 2, square root). Short texts have
   noisy histograms, so each comparison has its own minimum length, and the words' limit is wider for a short text. It
   is a share of the distance of a text without common words, and a text with far fewer common words than its language
   is far at any distance. A text far from its own language's reference is held against those of the other languages
   too, as language tags can be wrong.

At most MAX_LANGS references are broadcast at once, those of the largest languages first. Where there are more, what is
not settled by the first ones is held against the next ones, and so on.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, raw_texts, small_batches, worker_state

COMMON_WORDS, MAX_LANGS = 200, 64
#: Words that a text needs for each comparison, and the largest distance that is kept.
MIN_WORDS_CHARS, MAX_CHARS_JS = 50, 0.31
MIN_WORDS_WORDS, MAX_WORDS_JS = 50, 0.55
#: Common words that a text of its language would have for words to be compared; the limit as a share of the distance of
#: a text without any, from WIDE_BELOW of them on (wider below); the least share of the common words to be expected.
MIN_COMMON, WIDE_BELOW, SHARE_OF_NONE, LEAST_COMMON = 10, 42, 0.98, 0.1
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
ALL = ""  # the language key of the reference of all documents
FLUSH = 200_000

SYMBOLS = b"#*$%&|<>"
CLASSES = ("lower", "upper", "digit", "space", "stop", "symbol", "other_ascii", "beyond_ascii")


def _class_table() -> np.ndarray:
    """The class of each byte as a row of 0 and 1; UTF-8 continuation bytes are in none, so a character counts once."""
    kind = np.full(256, len(CLASSES), dtype=np.int64)
    for b in range(256):
        c = chr(b)
        if b >= 0xC0:
            kind[b] = 7
        elif b >= 0x80:
            continue
        elif "a" <= c <= "z":
            kind[b] = 0
        elif "A" <= c <= "Z":
            kind[b] = 1
        elif "0" <= c <= "9":
            kind[b] = 2
        elif b == 0x20 or 0x09 <= b <= 0x0D:
            kind[b] = 3
        elif c in ".,;:!?'\"()-":
            kind[b] = 4
        elif b in SYMBOLS:
            kind[b] = 5
        else:
            kind[b] = 6
    return np.eye(len(CLASSES) + 1, dtype=np.int64)[kind][:, :-1]


CLASS_OF = _class_table()
SYMBOL_BYTES = np.frombuffer(SYMBOLS, dtype=np.uint8)


def byte_counts(text: bytes) -> np.ndarray:
    return np.bincount(np.frombuffer(text, dtype=np.uint8), minlength=256)


def repeated_words(words: list[bytes]) -> int:
    """How many words stand in a window of three words that the text has twice or more."""
    n = len(words)
    if n < 4:
        return 0
    ids: dict[bytes, int] = {}
    a = np.fromiter((ids.setdefault(w, len(ids)) for w in words), dtype=np.int64, count=n)
    m = len(ids)
    if m == n:
        return 0
    pair = a[:-2] * m + a[1:-1]
    if m > 2_000_000:
        pair = np.unique(pair, return_inverse=True)[1]
    _, back, count = np.unique(pair * m + a[2:], return_inverse=True, return_counts=True)
    at = np.flatnonzero(count[back] > 1)
    marked = np.zeros(n, dtype=bool)
    for k in range(3):
        marked[at + k] = True
    return int(marked.sum())


def duplicate_lines(text: bytes) -> int:
    lines = [x for x in text.split(b"\n") if x.strip(b" \t\n\x0b\x0c\r")]
    return len(lines) - len(set(lines))


def js_distance(p: np.ndarray, q: np.ndarray) -> float:
    """Jensen-Shannon distance of two count vectors, 0 to 1; an empty one is at distance 0."""
    a, b = p.sum(), q.sum()
    if not a or not b:
        return 0.0
    p, q = p / a, q / b
    m = (p + q) / 2
    kl = lambda x: float((x[x > 0] * np.log2(x[x > 0] / m[x > 0])).sum())
    return float(np.sqrt(max(0.0, (kl(p) + kl(q)) / 2)))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    worker_state("quality", dict)
    words: dict[str, Counter] = {}
    chars: dict[str, np.ndarray] = {}
    held = 0

    def flush() -> pa.RecordBatch:
        rows = [(lang, True, w.decode("utf-8", "replace"), n) for lang, c in words.items() for w, n in c.items()]
        rows += [(lang, False, CLASSES[k], int(v)) for lang, h in chars.items() for k, v in enumerate(h @ CLASS_OF)]
        words.clear()
        chars.clear()
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.bool_(), pa.string(), pa.int64()))], ["lang", "is_word", "key", "n"])

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), raw_texts(batch.column(1)), strict=True):
            lang = lang or ALL
            c = words.setdefault(lang, Counter())
            before = len(c)
            c.update(text.lower().split())
            held += len(c) - before
            h = byte_counts(text)
            chars[lang] = chars[lang] + h if lang in chars else h
            if held > FLUSH:
                yield flush()
                held = 0
    if chars:
        yield flush()


def references(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """lang, is_word, key, n: character classes and common words of each language, and of all under lang = ''.

    The words' rest is under the key null. Counts are over all documents and whole texts.
    """
    parts = small_batches(docs).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")).mapInArrow(_count, "lang string, is_word boolean, key string, n long")
    by_lang = checkpointed(parts.groupBy("lang", "is_word", "key").agg(F.sum("n").alias("n")))
    everywhere = by_lang.groupBy("is_word", "key").agg(F.sum("n").alias("n")).withColumn("lang", F.lit(ALL))
    both = by_lang.where(F.col("lang") != ALL).unionByName(everywhere)
    ranked = both.where("is_word").withColumn("_fl_rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "key"))).where(F.col("_fl_rank") <= COMMON_WORDS).drop("_fl_rank")
    total = both.where("is_word").groupBy("lang", "is_word").agg(F.sum("n").alias("_fl_all"))
    top = ranked.groupBy("lang").agg(F.sum("n").alias("_fl_top"))
    rest = total.join(top, "lang").select("lang", "is_word", F.lit(None).cast("string").alias("key"), (F.col("_fl_all") - F.col("_fl_top")).alias("n"))
    return both.where("not is_word").unionByName(ranked).unionByName(rest)


def words_limit(n: int, words_ref: np.ndarray) -> tuple[float, float] | None:
    """The largest distance of common words, and the fewest of them, in a text of n words; None if it has too few to tell."""
    total = words_ref.sum()
    rest = float(words_ref[-1] / total) if total else 1.0
    common = n * (1 - rest)
    if n < MIN_WORDS_WORDS or common < MIN_COMMON:
        return None
    none = np.sqrt(((1 - rest) - np.log2((1 + rest) / 2) + (rest * np.log2(2 * rest / (1 + rest)) if rest else 0)) / 2)
    return min(MAX_WORDS_JS, SHARE_OF_NONE * float(none) * max(1.0, WIDE_BELOW / common) ** (1 / 6)), LEAST_COMMON * common


def distances(words: list[bytes], classes: np.ndarray, ref: tuple) -> tuple[bool, float | None, float | None]:
    """Whether a text, in lower case words, is far from one reference; its distances: of character classes, of common words."""
    chars_ref, places, words_ref = ref
    n = len(words)
    chars_js = js_distance(classes, chars_ref) if n >= MIN_WORDS_CHARS else None
    limit = words_limit(n, words_ref)
    far = (chars_js or 0) > MAX_CHARS_JS
    if limit is None:
        return far, chars_js, None
    rest = len(words_ref) - 1
    own = np.bincount([places.get(w, rest) for w in words], minlength=rest + 1)
    words_js = js_distance(own, words_ref)
    return far or words_js > limit[0] or n - own[-1] < limit[1], chars_js, words_js


def nearest(words: list[bytes], classes: np.ndarray, refs: dict) -> tuple[bool, float | None, float | None] | None:
    """The distances from the nearest of the languages' references; that of all documents is no language's."""
    return min((distances(words, classes, r) for lang, r in refs.items() if lang != ALL), key=_order, default=None)


def _order(x: tuple) -> tuple:
    return x[0], x[2] or 0, x[1] or 0


def base_values(text: bytes) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed; the counts of character classes."""
    words, h = text.split(), byte_counts(text)
    n, classes = len(words), h @ CLASS_OF
    repeat = repeated_words(words)
    return (n, int(classes.sum() - classes[3]), int(h[SYMBOL_BYTES].sum()), duplicate_lines(text), repeat, n < MIN_WORDS or 100 * repeat > MAX_REPEAT_PERCENT * n), classes


def judged(lang: str | None, text: bytes, refs: dict) -> tuple:
    """The values of VERDICT for one text, from the references of all languages."""
    (*counts, failed), classes = base_values(text)
    words = text.lower().split()
    best = distances(words, classes, refs.get(lang or ALL) or refs[ALL])
    if best[0] and not failed:  # a text under a wrong language tag is held against all languages
        best = min(best, nearest(words, classes, refs) or best, key=_order)
    return *counts, best[1], best[2], failed, not failed and not best[0]


KINDS = (*(pa.int64(),) * 5, *(pa.float64(),) * 2, *(pa.bool_(),) * 2)
#: For more languages than MAX_LANGS: the verdict as far as it is known, and whether it is the last word.
STATE = ("_fl_far", "_fl_chars", "_fl_words", "_fl_settled")


def _judge(refs: dict):
    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state("quality", dict)
        for batch in batches:
            out = [judged(lang, text, refs) for lang, text in zip(batch.column(1).to_pylist(), raw_texts(batch.column(2)), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[i] for r in out], t) for i, t in enumerate(KINDS))], ["_fl_id", *VERDICT])

    return judge


def _keep(refs: dict, lang_at: int, text_at: int):
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state("quality", dict)
        for batch in batches:
            langs = batch.column(lang_at).to_pylist()
            yield batch.filter(pa.array([judged(None if x is None else str(x), text, refs)[-1] for x, text in zip(langs, raw_texts(batch.column(text_at)), strict=True)], pa.bool_()))

    return keep


def _round(refs: dict, known: frozenset, lang_at: int, text_at: int):
    """One round over rows that end with STATE, held against these references. The own language's settles a row that is near it or fails the base rules."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state("quality", dict)
        for batch in batches:
            rows, names, out = batch.num_columns - 4, batch.schema.names, []
            state = zip(*(batch.column(rows + k).to_pylist() for k in range(3)), strict=True)
            for lang, text, before in zip(batch.column(lang_at).to_pylist(), raw_texts(batch.column(text_at)), state, strict=True):
                (n, *_, failed), classes = base_values(text)
                words, key = text.lower().split(), ALL if lang is None or str(lang) not in known else str(lang)
                own = distances(words, classes, refs[key]) if key in refs else None
                settled = own is not None and (failed or not own[0])
                if failed:
                    best = (True, *(own or before)[1:])
                else:
                    best = own if settled else min((x for x in (before if before[0] is not None else None, own, nearest(words, classes, refs)) if x is not None), key=_order)
                out.append((*best, settled))
            yield pa.RecordBatch.from_arrays([*batch.columns[:rows], *(pa.array([r[i] for r in out], t) for i, t in enumerate((pa.bool_(), pa.float64(), pa.float64(), pa.bool_())))], names)

    return run


def _told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The verdicts of rows (id, language, text, STATE) after all rounds."""
    for batch in batches:
        far, chars, words = (batch.column(k).to_pylist() for k in (3, 4, 5))
        base = [base_values(text)[0] for text in raw_texts(batch.column(2))]
        out = [(*b[:5], c, w, b[5], not b[5] and not f) for b, f, c, w in zip(base, far, chars, words, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[i] for r in out], t) for i, t in enumerate(KINDS))], ["_fl_id", *VERDICT])


def in_rounds(docs: DataFrame, reference: DataFrame, langs: list[str], lang_col: str, text_col: str) -> DataFrame:
    """docs with STATE, from the references of MAX_LANGS languages at a time; each round has only rows that are open."""
    known = frozenset(langs)
    rows = docs.select("*", *[F.lit(None).cast(t).alias(c) for c, t in zip(STATE, ("boolean", "double", "double", "boolean"), strict=True)])
    names, done = rows.schema, []
    for k in range(0, len(langs), MAX_LANGS):
        some = [*langs[k : k + MAX_LANGS], *([ALL] if k == 0 else [])]
        refs = loaded(reference.where(F.col("lang").isin(some)))
        if k:
            refs.pop(ALL)
        now = checkpointed(rows.mapInArrow(_round(refs, known, docs.columns.index(lang_col), docs.columns.index(text_col)), names))
        done.append(now.where("_fl_settled"))
        rows = now.where("not _fl_settled")
    for x in done:
        rows = rows.unionByName(x)
    return rows


def by_size(reference: DataFrame) -> list[str]:
    """The names of the languages, those with the most characters first."""
    return [r.lang for r in reference.where(~F.col("is_word") & (F.col("lang") != ALL)).groupBy("lang").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "lang").select("lang").collect()]


VERDICT = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "chars_js", "words_js", "base_failed", "kept")


def loaded(reference: DataFrame) -> dict:
    """By language: counts of character classes, places of the common words, their counts and the rest's."""
    refs: dict = {}
    for r in reference.collect():  # of at most MAX_LANGS languages and of all
        refs.setdefault(r.lang, []).append(r)
    ready = {}
    for lang, rows in refs.items():
        chars, n = {r.key: r.n for r in rows if not r.is_word}, sorted((r for r in rows if r.is_word and r.key is not None), key=lambda r: r.key)
        rest = sum(r.n for r in rows if r.is_word and r.key is None)
        ready[lang] = (np.array([chars.get(c, 0) for c in CLASSES]), {r.key.encode(): k for k, r in enumerate(n)}, np.array([r.n for r in n] + [rest]))
    ready.setdefault(ALL, (np.zeros(len(CLASSES)), {}, np.zeros(1)))
    return ready


def verdicts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", corpus: DataFrame | None = None) -> DataFrame:
    """One row for each row of docs: id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, chars_js, words_js, base_failed, kept.

    corpus (docs, if not given) makes the references. Null texts count as empty and fail; a null language, or one that
    corpus has not, is held against all documents. Distances are null for texts below their minimum length, and such
    texts pass them. Repeated ids give repeated rows; an empty table gives none. Other columns are ignored.
    """
    reference = references(docs if corpus is None else corpus, lang_col, text_col)
    kind = docs.schema[id_col].dataType.simpleString()
    names = f"_fl_id {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, chars_js double, words_js double, base_failed boolean, kept boolean"
    own = docs.select(F.col(id_col).alias("_fl_id"), F.col(lang_col).cast("string").alias("_fl_lang"), F.col(text_col).alias("_fl_text"))
    langs = by_size(reference)
    if len(langs) > MAX_LANGS:
        out = in_rounds(own, reference, langs, "_fl_lang", "_fl_text").mapInArrow(_told, names)
    else:
        out = own.mapInArrow(_judge(loaded(reference)), names)
    return out.withColumnRenamed("_fl_id", id_col)


def kept_documents(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of docs that pass, with all their columns; the references are those of docs."""
    reference = references(docs, lang_col, text_col)
    langs = by_size(reference)
    if len(langs) > MAX_LANGS:
        return in_rounds(docs, reference, langs, lang_col, text_col).where("not _fl_far").drop(*STATE)
    return docs.mapInArrow(_keep(loaded(reference), docs.columns.index(lang_col), docs.columns.index(text_col)), docs.schema)
