import random
import re

import numpy as np

from fieldloom.llm import quality as Q

SF = "/root/testdata/sf0.001"


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    many = {w for w in windows if windows.count(w) > 1}
    marked = {i + k for i, w in enumerate(windows) if w in many for k in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(marked), len(words) < 50 or 100 * len(marked) > 50 * len(words)


def test_base_values_equal_brute_force():
    rng = random.Random(4)
    pieces = ["a", "b", "the", "É", "#", "<x>", " ", " ", "\n", "\n", "\t", "\x0b", "\x1c", "\xa0", "😀", "same line here\n"]
    refs = {Q.ALL: (np.zeros(len(Q.CLASSES)), {}, np.zeros(1))}
    for _ in range(3000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 120)))
        got = Q.judged(None, text.encode(), refs)
        assert (*got[:5], got[7]) == brute(text), text


def test_distance():
    p, q = np.array([3.0, 1, 0]), np.array([0.0, 1, 3])
    a, b = p / 4, q / 4
    m = (a + b) / 2
    want = np.sqrt(sum(0.5 * x * np.log2(x / y) for v in (a, b) for x, y in zip(v, m, strict=True) if x))
    assert abs(Q.js_distance(p, q) - want) < 1e-12 and Q.js_distance(p, p) == 0 and abs(Q.js_distance(np.array([1, 0]), np.array([0, 1])) - 1) < 1e-12


def test_references_equal_brute_force(spark):
    rows = [("en", "The cat the END.\n"), ("en", None), ("fr", "Le chat é le"), (None, "the x")]
    got = {(r.lang, r.is_word, r.key): r.n for r in Q.references(spark.createDataFrame(rows, "lang string, text string")).collect()}
    assert got["en", True, "the"] == 2 and got["fr", True, "le"] == 2 and got[Q.ALL, True, "the"] == 3
    assert got["en", False, "upper"] == 4 and got["fr", False, "beyond_ascii"] == 1 and got[Q.ALL, False, "space"] == 8
    assert got["en", True, None] == 0


def test_verdicts_on_real_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: r for r in Q.verdicts(docs).collect()}
    text = {r.doc_id: r.text for r in docs.collect()}
    assert len(got) == len(text)
    for d, r in got.items():
        n, chars, symbols, dup, repeat, failed = brute(text[d])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == (n, chars, symbols, dup, repeat, failed)
        assert not (r.base_failed and r.kept)
    good = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1").collect()}
    judged = [got[d] for d in good if not got[d].base_failed]
    assert sum(r.kept for r in judged) >= 0.98 * len(judged)


def test_a_wrong_language_tag_is_forgiven_and_junk_is_not(spark):
    rng = random.Random(1)
    en, fr = (["".join(rng.choice(letters) for _ in range(rng.randint(2, 6))) for _ in range(80)] for letters in ("theofandwrsi", "lademisonréuê"))
    make = lambda ws, n=150: " ".join(rng.choice(ws) for _ in range(n))
    rows = [(k, make(en), "en") for k in range(40)] + [(100 + k, make(fr), "fr") for k in range(40)]
    rows += [(900, make(en), "fr"), (901, " ".join("".join(rng.choice("#$%&*<>0123456789|") for _ in range(6)) for _ in range(150)), "en"), (902, None, None)]
    got = {r.doc_id: r.kept for r in Q.verdicts(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert got[900] and not got[901] and not got[902] and sum(v for k, v in got.items() if k < 900) == 80


def prose(rng, n):
    """Words of which three in five are rare, as in natural text."""
    letters = "theofandwrsilm"
    often = ["".join(random.Random(k).choice(letters) for _ in range(3 + k % 4)) for k in range(80)]
    return " ".join(rng.choice(often) if rng.random() < 0.4 else "".join(rng.choice(letters) for _ in range(7)) for _ in range(n))


def test_texts_of_unknown_words_are_rejected(spark):
    rng = random.Random(2)
    rows = [(k, prose(rng, 60 + 3 * k), "en") for k in range(200)] + [(1000 + k, " ".join("w" + "".join(rng.choice("theofandwrsilm") for _ in range(7)) for _ in range(50 + 5 * k)), "en") for k in range(20)]
    got = {r.doc_id: r for r in Q.verdicts(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert all(got[k].kept for k in range(200))
    assert not any(got[1000 + k].kept for k in range(20)) and not any(got[1000 + k].base_failed for k in range(20))


def test_low_quality_salad_of_the_labels_is_rejected(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = {r.doc_id: r for r in Q.verdicts(docs).collect()}
    judged = {q: [got[r.doc_id] for r in labels.where(f"quality = {q}").collect() if not got[r.doc_id].base_failed] for q in (0, 1)}
    assert sum(r.kept for r in judged[0]) <= 0.02 * len(judged[0]) and sum(r.kept for r in judged[1]) >= 0.99 * len(judged[1])


def test_every_language_has_its_reference(spark, monkeypatch):
    rng = random.Random(5)
    make = lambda ws: " ".join(rng.choice(ws) for _ in range(120))
    tongues = ["abcdé", "efghü", "ijklñ", "mnopß", "qrstå"]
    vocabulary = [["".join(rng.choice(letters) for _ in range(rng.randint(3, 6))) for _ in range(80)] for letters in tongues]
    rows = [(100 * t + k, make(v), f"l{t}") for t, v in enumerate(vocabulary) for k in range(20 - 2 * t)]
    rows += [(900, make(vocabulary[4]), "l0"), (901, make(vocabulary[0]), None), (902, make([f"z{k}y" for k in range(90)]), "l3"), (903, "a b", "l4"), (904, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("more", Q.F.lit(1))
    whole = {r.doc_id: tuple(r) for r in Q.verdicts(df).collect()}
    monkeypatch.setattr(Q, "MAX_LANGS", 2)
    assert {r.lang for r in Q.references(df).collect()} == {Q.ALL, *(f"l{t}" for t in range(5))}
    assert {r.doc_id: tuple(r) for r in Q.verdicts(df).collect()} == whole
    left = Q.kept_documents(df)
    assert left.columns == df.columns and {r.doc_id for r in left.collect()} == {d for d, r in whole.items() if r[-1]}
    assert all(whole[d][-1] for d, *_ in rows if d < 902)


def test_a_very_long_text_and_repeated_ids(spark):
    rows = [(1, " ".join(f"w{k}" for k in range(300_000)), "en"), (1, "a b", "en"), (1, "a b", None)]
    got = Q.verdicts(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert sorted((r.n_words, r.base_failed) for r in got) == [(2, True), (2, True), (300_000, False)]
