import random

import numpy as np
import xxhash

from fieldloom.llm import mixing as M


def corpus():
    rng = random.Random(6)
    good, bad, foul = ([f"{p}{k}" for k in range(n)] for p, n in (("w", 60), ("junk#", 12), ("foul", 5)))
    rows, labels = [], []
    for k in range(240):
        kind = k % 8
        text = [rng.choice(good) for _ in range(rng.randint(10, 60))]
        if kind in (1, 2):
            text = [rng.choice(bad) for _ in text]
        if kind == 3:
            text += [rng.choice(foul) for _ in range(8)]
        rows.append((k, " ".join(text)))
        if k % 2:
            labels.append((k, int(kind not in (1, 2)), int(kind == 3)))
    return rows + [(900, None), (901, ""), (902, " \n"), (None, "w1 w2")], labels


def brute(rows, labels, targets, repeats):
    tokens = [[w for w in (t or "").lower().split()] for _, t in rows]
    bucket = lambda w: np.int64(np.uint64(xxhash.xxh64_intdigest(w.encode(), seed=42)).astype(np.int64)) % M.BUCKETS
    domain = {d: 2 if toxic else 1 - quality for d, quality, toxic in labels}
    counts = np.zeros((M.BUCKETS, 3))
    for (d, _), words in zip(rows, tokens, strict=True):
        if d in domain:
            for w in words:
                counts[bucket(w), domain[d]] += 1
    share = counts.sum(1, keepdims=True) / counts.sum()
    with np.errstate(all="ignore"):
        weight = np.nan_to_num(np.log((counts + M.BACKGROUND * share) / (counts.sum(0) + M.BACKGROUND) / share))
    prior = np.array([sum(x == k for x in domain.values()) + 1 for k in range(3)]) / (len(domain) + 3)
    sums = np.array([weight[[bucket(w) for w in words]].sum(0) if words else np.zeros(3) for words in tokens])
    logit = np.log(prior) + sums
    e = np.exp(np.maximum(logit - logit.max(1, keepdims=True), -M.CLIP))
    p = e / e.sum(1, keepdims=True)
    n = np.array([len(w) for w in tokens])
    total = (n[:, None] * p).sum(0)
    want = np.array(targets) * (n.sum() if repeats else min(n.sum(), *(total / targets)))
    r, s = np.ones(len(n)), total / n.sum()
    for _ in range(M.STEPS):
        t = (r[:, None] * n[:, None] * p).sum(0)
        if abs(t - want).max() <= M.CLOSE * n.sum():
            break
        r = np.clip(r - (p @ ((t - want) / n.sum() / s) + M.RIDGE * (r - 1)) / (1 + M.RIDGE), 0, None if repeats else 1)
    return p, r, want


def test_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(M, "BACKGROUND", 20.0)  # the corpus is small
    rows, labels = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as bucket", "9 as rate")
    lab = spark.createDataFrame(labels + [(None, 1, 0), (5, None, None)], "doc_id long, quality int, toxic int")
    for repeats in (True, False):
        p, r, want = brute(rows, labels, [M.TARGETS[d] for d in M.DOMAINS], repeats)
        got = {x.doc_id: x for x in M.mix(docs, lab, repeats=repeats).collect()}
        assert len(got) == len(rows)
        for k, (d, t) in enumerate(rows):
            x = got[d]
            assert x.n_tokens == len((t or "").split())
            np.testing.assert_allclose([x.p_clean, x.p_low, x.p_toxic], p[k], atol=1e-9)
            assert abs(x.rate - r[k]) < 1e-6 and x.rate >= 0 and abs(x.copies - x.rate) < 1.01
        totals = [sum(x.rate * x.n_tokens * x[f"p_{d}"] for x in got.values()) for d in M.DOMAINS]
        np.testing.assert_allclose(totals, want, rtol=0.02)


def test_without_labels_or_rows(spark):
    lab = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame([(1, "a b"), (1, "a b")], "doc_id long, text string")
    got = M.mix(docs, lab).collect()
    assert len(got) == 2 and all(abs(x.p_clean - 1 / 3) < 1e-9 for x in got)
    assert M.mix(docs.limit(0), lab).count() == 0


def test_scarce_domains_do_not_thin_clean_documents(spark, monkeypatch):
    monkeypatch.setattr(M, "BACKGROUND", 20.0)
    rng = random.Random(3)
    rows = [(k, " ".join(rng.choice(["junk", "spam"] if k % 50 == 1 else ["foul", "vile"] if k == 2 else ["good", "fine", "fair"]) for _ in range(20))) for k in range(400)]
    labels = [(k, int(k % 50 != 1), int(k == 2)) for k in range(400)]
    docs, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert sorted(r.doc_id for r in M.thinned(docs, lab).collect()) == list(range(400))
    few = {"clean": 0.99, "low": 0.001, "toxic": 0.009}
    left = {r.doc_id for r in M.thinned(docs, lab, few).collect()}
    assert {k for k in range(400) if k % 50 != 1} <= left and len(left) < 398


def test_a_very_long_text_and_repeated_ids(spark):
    rows = [(1, "w1 w2 " * 200_000), (1, "w1"), (1, "w1"), (2, "junk")]
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int")
    got = M.mix(spark.createDataFrame(rows, "doc_id long, text string"), labels).collect()
    assert sorted((r.doc_id, r.n_tokens) for r in got) == [(1, 1), (1, 1), (1, 400_000), (2, 1)]
