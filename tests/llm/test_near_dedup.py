import random

import numpy as np

from fieldloom.llm import near_dedup as N


def brute(rows, size=4):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set())
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                up[find(i)] = find(j)
    ids = {}
    for k, (d, _) in enumerate(rows):
        ids.setdefault(find(k), []).append(d)
    return sorted((d, len(sets[k]), min(ids[find(k)])) for k, (d, _) in enumerate(rows))


def corpus(n=260):
    rng = random.Random(9)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(3000)]
    text = lambda k: [rng.choice(vocabulary) for _ in range(k)]
    base, passage, rows = text(90), text(60), []
    for k in range(n):
        if k % 4 == 0:
            w = list(base)
            for _ in range(rng.randint(0, 6)):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
        elif k % 4 == 1:
            w = passage + text(rng.randint(5, 60))
        elif k % 4 == 2 and k > 8:
            w = rows[rng.randrange(len(rows))][1].split()
            w[-1:] = text(1)
        else:
            w = text(rng.randint(1, 80))
        rows.append((k, " ".join(w)))
    return rows + [(1000, "A b"), (1001, "a B "), (1002, ""), (1003, None), (1004, " \n"), (1005, "a b c")]


def test_components_equal_brute_force(spark, monkeypatch):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as node", "1 as keys")
    monkeypatch.setattr(N, "BLOCK", 16)  # so that clusters are cut into several blocks
    got = N.components(df, shingle=4).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_beyond_the_broadcast_bound(spark, monkeypatch):
    rows = corpus(80)
    monkeypatch.setattr(N, "BROADCAST_ROWS", 0)
    got = N.components(spark.createDataFrame(rows, "doc_id long, text string"), shingle=4).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute(rows)


def test_sketches_fill_and_estimate():
    rng = np.random.default_rng(4)
    with np.errstate(over="ignore"):
        small = N.sketches([rng.integers(0, 2**63, k, dtype=np.uint64) for k in (1, 2, 7, 240, 5000)])
        assert not (small == np.uint64(0xFFFFFFFFFFFFFFFF)).any()
        errors = []
        for _ in range(60):
            both = rng.integers(0, 2**63, 300, dtype=np.uint64)
            a, b = N.sketches([both[:240], both[60:]])
            errors.append((a == b).mean() - 0.6)
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.06


def test_empty_and_null_ids(spark):
    schema = "doc_id long, text string"
    assert N.components(spark.createDataFrame([], schema)).count() == 0
    got = N.components(spark.createDataFrame([(None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f")], schema)).collect()
    assert sorted([(str(r.doc_id), r.component_id, r.kept) for r in got]) == [("3", 3, True), ("3", 3, True), ("None", 3, False)]


def test_few_large_sets_are_few_blocks(spark):
    members = spark.createDataFrame([("c", b"a", 4_000_000), ("c", b"b", 4_000_000), ("d", b"e", 5), ("d", b"f", 5)], "cluster string, node binary, n_shingles long")
    got = N.blocked(members).collect()
    assert sorted((r.cluster, bytes(r.node), r.i, r.j) for r in got if r.cluster == "d") == [("d", b"e", 0, 0), ("d", b"f", 0, 0)]
    assert len([r for r in got if r.cluster == "c"]) == 4


def test_very_long_texts(spark):
    """Texts of 150,000 words: one changed in a few words is linked, one changed in half of them is not."""
    rng = random.Random(6)
    words = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(150_000)]
    near = [w if k % 1000 else "new" for k, w in enumerate(words)]
    far = [w if k % 5 else "other" for k, w in enumerate(words)]
    rows = [(3, " ".join(words)), (1, " ".join(near)), (2, " ".join(far)), (4, "short text"), (5, None)]
    got = {r.doc_id: r.component_id for r in N.components(spark.createDataFrame(rows, "doc_id long, text string"), shingle=4).collect()}
    assert got == {3: 1, 1: 1, 2: 2, 4: 4, 5: 5}
