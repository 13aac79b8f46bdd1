import hashlib

from pyspark.sql import functions as F

from fieldloom.llm import exact_dedup as D

SCHEMA = "doc_id long, text string, kept string, keep_id int"


def fold(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def brute(rows):
    groups = {}
    for d, t in rows:
        groups.setdefault(fold(t), []).append(d)
    best = {t: max((d for d in g if d is not None), default=None) for t, g in groups.items()}
    return sorted(((d, best[fold(t)], len(groups[fold(t)]), hashlib.sha256(fold(t).encode()).hexdigest()) for d, t in rows), key=str)


ROWS = [(1, "Abc"), (5, "aBC"), (9, "abc "), (2, "É"), (3, "é"), (4, None), (6, ""), (7, "x" * 100_000), (8, "X" * 100_000), (None, "abc"), (10, "alone")] + [(100 + k, "Hot copy") for k in range(60)]


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "a", 1) for d, t in rows], SCHEMA)


def test_groups_equal_brute_force(spark):
    got = D.exact_groups(frame(spark, ROWS)).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=str) == brute(ROWS)
    assert all(r.kept == (r.doc_id == r.keep_id) for r in got)
    assert D.exact_groups(frame(spark, ROWS).limit(0)).count() == 0


def test_colliding_hashes_are_told_apart_by_bytes(spark, monkeypatch):
    for bound in (D.BROADCAST_ROWS, 0):
        monkeypatch.setattr(D, "BROADCAST_ROWS", bound)
        got = D.exact_groups(frame(spark, ROWS), hash_of=lambda text: F.substring(F.unhex(F.md5(text)), 1, 0)).collect()
        assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=str) == brute(ROWS)


def test_rows_that_repeat_an_id(spark):
    rows = [(1, "a"), (1, "a"), (1, "b"), (2, "A"), (2, "a"), (None, "z"), (None, "z")]
    got = D.exact_groups(frame(spark, rows)).collect()
    assert sorted(r.doc_id for r in got if r.kept and r.doc_id) == [1, 2] and sum(r.kept for r in got) == 3
    left = D.deduplicated(frame(spark, rows))
    assert left.columns == ["doc_id", "text", "kept", "keep_id"]
    assert sorted(((r.doc_id, fold(r.text)) for r in left.collect()), key=str) == [(1, "b"), (2, "a"), (None, "z")]


def test_the_smallest_id_may_stay(spark):
    got = D.exact_groups(frame(spark, [(3, "a"), (4, "A")]), keep="min").collect()
    assert {r.keep_id for r in got} == {3}


def test_very_long_texts(spark):
    long = "word Other " * 200_000
    rows = [(1, long), (2, long.upper()), (3, long + "x"), (4, None), (5, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in D.exact_groups(df).collect()}
    assert got == {1: (2, 2, False), 2: (2, 2, True), 3: (3, 1, True), 4: (5, 2, False), 5: (5, 2, True)}
