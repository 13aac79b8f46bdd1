import math
import os
import random
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from fieldloom.llm import gru_lm as G
from fieldloom.llm import lm_score as L


def corpus(n=400):
    rng = random.Random(8)
    tongues = [["".join(rng.choice(letters) for _ in range(rng.randint(2, 5))) for _ in range(60)] for letters in ("abcd", "efgh", "ijkl")]
    rows = [(k, " ".join(rng.choice(tongues[k % 3]) for _ in range(rng.randint(20, 120))) + rng.choice(["", "\nRare%d É\x1cx" % k])) for k in range(n)]
    return rows + [(5000, None), (5001, ""), (None, "Abc unseen"), (5002, " \t")]


def brute(rows):
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 5 == 1
    lower = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    tokens = {d: re.findall(r"[^\x20\x09-\x0D]+", lower(t)) + [""] for d, t in rows}
    c = Counter(w for d, ws in tokens.items() if not held(d) for w in ws)
    n, v = sum(c.values()), len(c)
    return {d: (held(d), len(ws), sum(c[w] > 0 for w in ws), n, sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)) for d, ws in tokens.items()}


def test_base_equals_brute_force_and_the_model_beats_it(spark, monkeypatch):
    monkeypatch.setattr(L, "HEAD", 150)  # so that many tokens are outside the head
    monkeypatch.setattr(L, "VOCAB", 100)
    monkeypatch.setattr(L, "FIRST_PASS", 2)
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as token", "2 as c").repartition(2)
    got = L.score(df).collect()
    want = brute(rows)
    assert len(got) == len(rows)
    for r in got:
        h, tokens, known, n, base = want[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (h, tokens, known, n)
        assert abs(r.base_score - base) < 1e-6 * max(1, abs(base))
        assert r.score < 0
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held) + 0.02 * sum(r.n_tokens for r in held)


def small():
    layout = G.Layout(np.array([50.0, 40, 30, 20, 10, 5, 5, 2]), np.arange(G.TAILS, dtype=float))
    rng = np.random.default_rng(0)
    weights = {k: (w + rng.normal(0, 0.3, w.shape)).astype(np.float32) for k, w in G.initial(layout).items()}
    return layout, weights


def test_probabilities_sum_to_one():
    layout, weights = small()
    every = [np.array([3, s], dtype=np.int32) for s in range(layout.vocab + G.TAILS)]
    prefix = G.score([np.array([3], dtype=np.int32)], weights, layout)[0]
    assert abs(np.exp(G.score(every, weights, layout) - prefix).sum() - 1) < 1e-4


def test_state_is_carried_over_windows_and_reset_between_documents(monkeypatch):
    layout, weights = small()
    rng = np.random.default_rng(1)
    docs = [rng.integers(0, layout.vocab + G.TAILS, n).astype(np.int32) for n in (3, 200, 31, 1, 77, 64)]
    alone = [G.score([d], weights, layout)[0] for d in docs]
    monkeypatch.setattr(G, "SCORE_LANES", 2)
    np.testing.assert_allclose(G.score(docs, weights, layout), alone, rtol=1e-4)
    monkeypatch.setattr(G, "SCORE_WINDOW", 5)
    np.testing.assert_allclose(G.score(docs, weights, layout), alone, rtol=1e-4)


def test_gradient_equals_finite_differences(monkeypatch):
    layout, weights = small()
    rng = np.random.default_rng(2)
    docs = [rng.integers(0, layout.vocab + G.TAILS, 9).astype(np.int32) for _ in range(4)]
    seen = {}

    class Spy(dict):
        pass

    monkeypatch.setattr(G, "CLIP", 1e9)
    before = {k: w.copy() for k, w in weights.items()}
    memory = {k: np.full(w.shape, 1e12, dtype=np.float32) for k, w in weights.items()}
    moved = {k: w.copy() for k, w in weights.items()}
    G.train(docs, moved, layout, rate=1e6 * 1e-2, memory=memory)  # a step of 1e-2 * gradient
    n = sum(map(len, docs))
    for k in ("U", "W", "E", "C", "O", "b", "ob", "cb"):
        g = (before[k] - moved[k]) / 1e-2
        at = np.unravel_index(np.argmax(np.abs(g)), g.shape)
        up, down = ({x: w.astype(np.float64).copy() for x, w in before.items()} for _ in range(2))
        up[k][at] += 1e-2
        down[k][at] -= 1e-2
        f = lambda w: -G.score(docs, {x: y.astype(np.float32) for x, y in w.items()}, layout).sum() / n
        seen[k] = (float(g[at]), (f(up) - f(down)) / 2e-2)
    for k, (own, numeric) in seen.items():
        assert abs(own - numeric) < 0.03 * abs(numeric) + 2e-3, seen


def test_no_training_rows(spark):
    held = next(d for d in range(100) if zlib.crc32(str(d).encode()) % 5 == 1)
    got = L.score(spark.createDataFrame([(held, "a b")], "doc_id long, text string")).collect()
    assert [(r.n_tokens, r.n_known, r.train_tokens) for r in got] == [(3, 0, 0)] and got[0].score == got[0].base_score
    assert L.score(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_training_learns_from_every_target(spark):
    rows = [(f"{k} " * 40 + "b c " * 60,) for k in range(5)] + [("a",), (None,)]
    texts = spark.createDataFrame(rows, "text string")
    parts = L.build_lexicon(L.token_counts(texts))
    batch = lambda own, group: pa.RecordBatch.from_arrays([pa.array([group] * len(own), pa.int32()), pa.array([t for t, in own], pa.string())], ["group", "text"])
    out = list(L._learn(parts, None)([batch(rows[:2], 0), batch(rows[2:4], 0), batch(rows[4:], 3)]))
    targets = lambda own: sum(len((t or "").split()) + 1 for t, in own)
    assert [b.column(1)[0].as_py() for b in out] == [targets(rows[:4]), targets(rows[4:])]


SF = "/root/testdata/sf0.01/documents.parquet"


@pytest.mark.skipif(not os.path.exists(SF), reason="no test data")
def test_the_model_beats_the_base_on_real_rows_however_rows_are_placed(spark, monkeypatch):
    monkeypatch.setattr(L, "GROUP", 150_000)  # so that groups are averaged
    docs = spark.read.parquet(SF)
    gains = []
    for rows in (docs.coalesce(1), docs.repartition(5)):
        r = L.score(rows).where("held_out").selectExpr("sum(score) / sum(n_tokens) as s", "sum(base_score) / sum(n_tokens) as b").first()
        gains.append(r.s - r.b)
    assert min(gains) > 0.1 and abs(gains[0] - gains[1]) < 1e-3, gains


def test_the_end_is_a_word_of_the_model_however_rare(spark, monkeypatch):
    monkeypatch.setattr(L, "HEAD", 4)
    monkeypatch.setattr(L, "VOCAB", 3)
    rows = [(k, " ".join(f"w{j}" for j in range(30)) + f" r{k}") for k in (2, 5)]
    got = L.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = brute(rows)
    for r in got:
        assert (r.n_tokens, r.n_known, r.train_tokens) == (want[r.doc_id][1], want[r.doc_id][2], want[r.doc_id][3])
        assert abs(r.base_score - want[r.doc_id][4]) < 1e-6 and r.score < 0


def test_repeated_ids_and_a_very_long_text(spark):
    long = "word other " * 150_000
    rows = [(7, long), (7, "word"), (7, None), (9, "word other"), (9, "word other")]
    got = L.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_tokens) for r in got) == [(7, 1), (7, 2), (7, 300_001), (9, 3), (9, 3)]
    assert len({r.score for r in got if r.doc_id == 9}) == 1


def test_a_long_text_among_short_ones_takes_memory_by_its_tokens():
    layout, weights = small()
    docs = [np.zeros(200_000, dtype=np.int32)] + [np.zeros(3, dtype=np.int32)] * 400
    tracemalloc.start()
    lanes = G.Lanes(docs, 256)
    assert tracemalloc.get_traced_memory()[1] < 20_000_000
    tracemalloc.stop()
    for i, k in enumerate(lanes.start):
        assert lanes.begins[k] and lanes.sizes[i] == len(docs[i])
    assert sum(int(live.sum()) for _, _, _, live, _ in lanes.windows(16, 64)) == 200_000 + 1200
