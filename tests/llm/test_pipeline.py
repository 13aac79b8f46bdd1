import hashlib

import corpus_pipeline
from test_near_dedup import brute as near_brute
from tokenizers import Tokenizer

from fieldloom.llm import mixing, quality
from fieldloom.llm.queries import TOKENIZER

SF = "/root/testdata/sf0.001"


def fold(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, stages = docs.columns, dict(corpus_pipeline.STAGES)
    rows = {r.doc_id: r for r in docs.collect()}

    passed = stages["quality_rules"](spark, docs, SF)
    kept = {r.doc_id for r in quality.verdicts(docs).where("kept").collect()}
    assert passed.columns == columns and {tuple(r) for r in passed.collect()} == {tuple(rows[d]) for d in kept}

    exact = stages["exact_dedup"](spark, passed, SF)
    best = {}
    for d in kept:
        best[fold(rows[d].text)] = max(d, best.get(fold(rows[d].text), -1))
    assert exact.columns == columns and sorted(r.doc_id for r in exact.collect()) == sorted(best.values())

    near = stages["near_dedup"](spark, exact, SF)
    want = [d for d, _, c in near_brute([(d, rows[d].text) for d in sorted(best.values())], 5) if d == c]
    assert near.columns == columns and sorted(r.doc_id for r in near.collect()) == want

    mixed = stages["mixing"](spark, near, SF)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rates = {r.doc_id: r for r in mixing.mix(near, labels, repeats=False, examples=docs).collect()}
    left = sorted(r.doc_id for r in mixed.collect())
    assert mixed.columns == columns and left == sorted(d for d, r in rates.items() if r.copies)
    assert all(0 <= r.rate <= 1 and r.copies <= 1 for r in rates.values())
    clean = {r.doc_id for r in labels.where("quality = 1 and toxic = 0").collect()} & set(rates)
    assert len(clean & set(left)) >= 0.95 * len(clean)

    library = Tokenizer.from_file(TOKENIZER)
    got = {r.doc_id: r for r in stages["bpe"](spark, mixed, SF).collect()}
    assert sorted(got) == left
    for d in left[:40]:
        ids = library.encode(rows[d].text, add_special_tokens=False).ids
        assert got[d].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()


def test_run_equals_the_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) == sorted(map(tuple, docs.collect()))


def test_nulls_repeats_and_no_rows(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, _x int"
    text = " ".join(f"word{k % 70}" for k in range(120)) + " end"
    rows = [(1, text, "en", "s", 1, 0), (1, text, "en", "s", 1, 0), (2, None, None, None, None, None), (None, text.upper(), None, "s", 0, 1), (3, "", "en", "s", 0, 0)]
    df = spark.createDataFrame(rows, schema)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, df, SF).collect()
        if name == "exact_dedup":
            assert sorted(str(r.doc_id) for r in out) == ["1", "3"]
        assert stage(spark, df.limit(0), SF).count() == 0


def test_mixing_keeps_as_large_a_share_at_every_size(spark):
    stage, kept = dict(corpus_pipeline.STAGES)["mixing"], []
    for sf in ("/root/testdata/sf0.01", "/root/testdata/sf0.1"):
        docs = spark.read.parquet(f"{sf}/documents.parquet")
        passed = quality.kept_documents(docs)
        kept.append(stage(spark, passed, sf).count() / passed.count())
    assert min(kept) > 0.9 and max(kept) - min(kept) < 0.05, kept
