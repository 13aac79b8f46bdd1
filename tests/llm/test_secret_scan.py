import hashlib
import random
import re

from fieldloom.llm import secret_scan

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def brute(text):
    out = [(m.start(), 0, f"assign:{m.start()}:{m.end()}") for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    out += [(m.start(), 1, f"access:{m.start()}:{m.end()}") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    out += [(m.start(), 2, f"hex:{m.start()}:{m.end()}") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return [x[2] for x in sorted(out)]


def texts(n=400):
    rng = random.Random(3)
    pieces = ["token", "Secret", "PASSWORD", "api_key", "apikey", ": ", "=", " = ", "'", '"', "abcdef0123456789", "short", "AKIA", "ABCDEFGH12345678", "é", "😀", "\n", " ", "0f" * 9, "x_y.z=" * 2]
    return ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 25))) for _ in range(n)]


def test_spans_equal_brute_force(spark):
    rows = list(enumerate(texts())) + [(1000, None), (1001, ""), (1002, "token: secret: abcdefghijklmnop"), (None, "AKIA" + "A" * 20)]
    rows += [(k, "token=abcdefabcdef00") for k in range(2000, 2050)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "1 as spans", "'x' as blob")
    found, ledger = secret_scan.scan(df)
    got = secret_scan.digests(found).collect()
    assert len(got) == len(rows)
    want = dict(rows)
    for r in got:
        base = brute(want[r.doc_id] or "")
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert [x for x in r.spans.split(",") if x and not x.startswith("provider")] == base
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(x.startswith(k) for x in base) for k in ("assign", "access", "hex"))
    assert ledger.count() == len({t or "" for _, t in rows})


def test_only_unseen_pairs_are_scanned(spark):
    first = spark.createDataFrame([(1, "token=abcdefabcdef00"), (2, "clean")], "doc_id long, text string")
    _, ledger = secret_scan.scan(first)
    both = first.union(spark.createDataFrame([(3, "AKIA" + "B" * 16), (4, "clean")], "doc_id long, text string"))
    assert secret_scan.scan_unseen(both, ledger).count() == 1
    newer = (*secret_scan.BASE_RULES[:2], secret_scan.Rule("hex", 2, r"[0-9a-f]{14,}+"), *secret_scan.ADDED_RULES)
    again = secret_scan.scan_unseen(first, ledger, newer).collect()
    assert len(again) == 2 and all(r.rules == ["hex@2"] for r in again)
    found, _ = secret_scan.scan(both, ledger)
    assert sorted(r.doc_id for r in found.where("size(spans) > 0").collect()) == [1, 3]


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert secret_scan.scan(df)[0].count() == 0


def plain(found):
    return sorted((r.doc_id, r.blob, [tuple(s) for s in r.spans]) for r in found.collect())


def test_incremental_findings_equal_fresh_ones_for_every_rule_set(spark, tmp_path):
    """Rules that get stricter, are dropped, or come back, over texts that change: what an old version found is not given."""
    R = secret_scan.Rule
    strict, loose = R("hex", 2, r"[0-9a-f]{32,}+"), R("hex", 3, r"[0-9a-f]{8,}+")
    sets = [secret_scan.RULES, (secret_scan.BASE_RULES[0], strict), (strict,), (loose, *secret_scan.BASE_RULES[:2]), secret_scan.RULES, (secret_scan.BASE_RULES[1], secret_scan.BASE_RULES[0])]
    pieces, path = texts(120), str(tmp_path / "ledger")
    for k, rules in enumerate(sets):
        rows = [(d, t if d % 3 else t + " 0123456789abcdef" * (k // 2)) for d, t in enumerate(pieces)]
        df = spark.createDataFrame([*rows, (7, pieces[7]), (None, "deadbeef" * 5)], "doc_id long, text string").repartition(3)
        fresh = secret_scan.findings(df, secret_scan.scan_unseen(df, None, rules), rules)
        got = secret_scan.scan_into(df, path, rules)
        key = lambda rows: sorted(rows, key=str)
        assert key([tuple(map(str, r)) for r in got.collect()]) == key([tuple(map(str, r)) for r in fresh.collect()]), k
        assert secret_scan.unseen(df, secret_scan.read_ledger(spark, path), rules).count() == 0
    held = secret_scan.read_ledger(spark, path).selectExpr("blob", "explode(rules) as rule")
    assert held.groupBy("blob", "rule").count().where("count > 1").count() == 0


def test_a_ledger_row_that_is_there_twice(spark):
    df = spark.createDataFrame([(1, "token=abcdefabcdef00")], "doc_id long, text string")
    found, ledger = secret_scan.scan(df)
    assert plain(secret_scan.findings(df, ledger.unionByName(ledger))) == plain(found)


def test_a_very_long_text(spark):
    text = "word " * 400_000 + "token=abcdefabcdef00"
    got = secret_scan.digests(secret_scan.scan(spark.createDataFrame([(1, text)], "doc_id long, text string"))[0]).first()
    assert got.spans == f"assign:{len(text) - 20}:{len(text)}"
