import random
import re

import numpy as np
import pytest
import xxhash

from fieldloom.llm import simhash as S


def brute_fingerprint(text, shingle):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    parts = [" ".join(words[i : i + shingle]) for i in range(len(words) - shingle + 1)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps, radius):
    up = list(range(len(fps)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                up[find(i)] = find(j)
    return [find(k) for k in range(len(fps))]


def expected(rows, shingle, radius):
    fps = [brute_fingerprint(t, shingle) for _, t in rows]
    parts = brute_components(fps, radius)
    least = {}
    for (d, _), p in zip(rows, parts, strict=True):
        least[p] = d if least.get(p) is None else least[p] if d is None else min(least[p], d)
    return sorted((str(d), f"{fp:016x}", str(least[p])) for (d, _), fp, p in zip(rows, fps, parts, strict=True))


def corpus(n=250):
    rng = random.Random(4)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(500)]
    base, rows = [rng.choice(vocabulary) for _ in range(400)], []
    for k in range(n):
        if k % 3 == 0:
            words = list(base)
            for _ in range(rng.randint(0, 4)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
        else:
            words = [rng.choice(vocabulary) for _ in range(rng.choice((1, 2, 3, 40, 90)))]
        rows.append((k, " ".join(words)))
    return rows + [(1000, None), (1001, ""), (1002, " \n"), (1003, "Z É\x1cx"), (7, rows[3][1]), (7, "other text of its own"), (None, rows[6][1]), (None, "alone")]


@pytest.mark.parametrize("small", [False, True])
def test_components_equal_brute_force(spark, monkeypatch, small):
    if small:
        for name, value in (("BUCKET", 3), ("WIDTH", 5), ("BROADCAST_ROWS", 0), ("COUNTED", 7)):
            monkeypatch.setattr(S, name, value)
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as fp", "1 as id", "2 as component").repartition(3)
    got = S.components(df, shingle=3).collect()
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in got) == expected(rows, 3, 2)
    assert len({r.component_id for r in got}) < len(got) - 60


@pytest.mark.parametrize("radius", [0, 1, 2, 3, 5])
def test_links_of_close_fingerprints(spark, monkeypatch, radius):
    """Crowded buckets: fingerprints a few bits from each other, so that all levels of buckets are met."""
    monkeypatch.setattr(S, "BUCKET", 6)
    rng = random.Random(radius)
    seeds = [rng.getrandbits(64) for _ in range(4)]
    fps = set()
    while len(fps) < 160:
        x = rng.choice(seeds)
        for _ in range(rng.randint(0, 7)):
            x ^= 1 << rng.choice((0, 1, 2, 30, 31, 33, 62, 63, rng.randrange(64)))
        fps.add(x)
    fps = sorted(fps)
    nodes = spark.createDataFrame([(S._signed(x),) for x in fps], "fp long")
    place = {S._signed(x): k for k, x in enumerate(fps)}
    up = list(range(len(fps)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for r in S.links(nodes, radius).collect():
        assert (fps[place[r.u]] ^ fps[place[r.v]]).bit_count() <= radius
        up[find(place[r.u])] = find(place[r.v])
    want = brute_components(fps, radius)
    same = lambda parts: {frozenset(k for k in range(len(fps)) if parts[k] == p) for p in parts}
    assert same([find(k) for k in range(len(fps))]) == same(want)


def test_planes_count_like_popcounts():
    rng = np.random.default_rng(1)
    fps = rng.integers(0, 2**63, 70).astype(np.uint64)
    fps[1:40] = fps[0] ^ (np.uint64(1) << rng.integers(0, 64, 39).astype(np.uint64))
    bits = list(range(64))
    planes = S.Planes(fps, bits)
    for radius in range(7):
        for q in fps[:5].tolist():
            found = planes.within([q >> b & 1 for b in bits], radius, planes.all)
            assert [k for k in range(70) if found >> k & 1] == [k for k, x in enumerate(fps.tolist()) if (x ^ q).bit_count() <= radius]


def test_empty_table_and_a_very_long_text(spark):
    assert S.components(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    long = "word other third " * 200_000
    got = S.components(spark.createDataFrame([(1, long), (2, long.upper()), (3, "x")], "doc_id long, text string"), shingle=3).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(1, 1), (2, 1), (3, 3)]
