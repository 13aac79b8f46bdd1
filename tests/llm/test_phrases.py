import random
import re
from collections import Counter

import numpy as np
import pytest

from fieldloom.llm import phrases as P
from fieldloom.llm.perfect_hash import PerfectHash


def brute(rows, least, longest=4, top=2000, cover=80):
    counts, n, out = {}, Counter(), []
    for lang, text in rows:
        lang = lang or "und"
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                counts.setdefault(lang, Counter()).update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    for lang, f in counts.items():
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        inside = Counter()
        for p, b in candidates.items():
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    inside[p[i : i + m]] = max(inside[p[i : i + m]], b)
        kept = []
        for p, a in candidates.items():
            if 100 * inside[p] >= cover * a:
                continue
            score, _, left, right = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, rank, phrase.decode(), -a, left, right, n[lang], -s) for rank, (s, a, phrase, left, right) in enumerate(sorted(kept)[:top], 1)]
    return sorted(out)


def corpus(n=300, seed=3):
    rng = random.Random(seed)
    words = ["a", "B", "cc", "É", "é", "\x1cd", "e'f", "\x00g", "日本"]
    rows = []
    for k in range(n):
        text = "".join(rng.choice(words) + rng.choice(("  ", " ", " ", "\t", ", ", "\n", "\r\n", ". ")) for _ in range(rng.randint(0, 40)))
        rows.append((rng.choice(("en", "en", "fr", None, "und")), rng.choice((text, text + " New York city hall", "new york City hall"))))
    return rows + [("en", None), (None, ""), ("de", "new york city hall"), ("fr", "x " * 3000), ("en", ".,;")]


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("small", [False, True])
def test_equals_brute_force(spark, monkeypatch, small):
    if small:  # several blocks, slices, chunks of slots and tree levels; no broadcast of words
        for name, value in (("BLOCK", 500), ("MERGED", 300), ("SLICE", 20), ("FAN", 2), ("BROADCAST_ROWS", 0), ("SALTS", 3)):
            monkeypatch.setattr(P, name, value)
    rows = corpus()
    df = spark.createDataFrame(rows, "lang string, text string").selectExpr("*", "1 as n", "'x' as word", "'y' as block", "2 as slot").repartition(3)
    got = rows_of(P.collocations(df, least=12, top=25))
    assert got == brute(rows, 12, top=25) and len(got) > 20
    assert got and {type(x) for x in got[0]} == {str, int}


def test_all_phrases_and_another_length(spark):
    rows = corpus(80, seed=5)
    df = spark.createDataFrame(rows, "lang string, text string")
    assert rows_of(P.collocations(df, least=5, longest=3, top=None)) == brute(rows, 5, longest=3, top=10**9)


def test_chunks_of_slots(spark, monkeypatch):
    monkeypatch.setattr(P, "CHUNK", 1 << 16)
    slots = np.array([5, -1, 70_000, 70_000, 5, 5, 200_000], dtype=np.int32)
    blocks = spark.createDataFrame([(k, len(slots), P.packed(slots)) for k in range(9)], "block long, size long, places binary").repartition(9)
    assert rows_of(P._counts(blocks)) == [(5, 27), (70_000, 18), (200_000, 9)]


def test_no_rows_and_no_phrases(spark):
    assert P.collocations(spark.createDataFrame([], "lang string, text string")).collect() == []
    assert P.collocations(spark.createDataFrame([("en", "a b"), (None, None)], "lang string, text string")).collect() == []


def test_products_beyond_64_bits(spark):
    big = 8 * 10**12
    row = spark.createDataFrame([(big + 7, big + 9, big + 8)], "a long, l long, r long")
    cut = row.select(P._cut(1, row["l"], row["r"]).alias("c")).first().c
    assert cut.score == 2_000_000 * (big + 7) // (2 * big + 17)


def test_perfect_hash():
    rng = np.random.default_rng(2)
    for n in (0, 1, 2, 63, 5000):
        keys = np.unique(rng.integers(-(2**62), 2**62, n)) if n else np.zeros(0, np.int64)
        table = PerfectHash(keys)
        slots = table.find(keys)
        assert sorted(slots.tolist()) == list(range(len(keys)))
        others = rng.integers(-(2**62), 2**62, 3000)
        assert (table.find(others)[~np.isin(others, keys)] == -1).all()
    with pytest.raises(ValueError):
        PerfectHash(np.array([4, 4]))
