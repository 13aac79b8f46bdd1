import random
import re

from fieldloom.llm import pii

RULES = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute(text):
    out = []
    for rank, (kind, rule) in enumerate(RULES.items()):
        for m in re.finditer(rule, text):
            x, digits = m[0], re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in x.split(".")), "card": 12 <= len(digits) <= 19 and pii.luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if ok:
                out.append((m.start(), rank, f"{kind}:{m.start()}:{m.end()}"))
    return [x[2] for x in sorted(out)]


def base(text, anchors=pii.automaton()):
    return [f"{k}:{a}:{b}" for a, k, b in pii.find(text, anchors) if k in pii.BASE]


def test_random_texts_equal_the_patterns():
    rng = random.Random(7)
    pieces = ["a@b.c", "@", ".", "1", "255", "256", "+", "12", "4111111111111111", "4111-1111 1111 1111", " ", "-", "(", ")", "é", "x", "\n", "+1 (555) 010-9999", "10.0.0.1", "a.b@c-d.ef.", "0"]
    for _ in range(20000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 14)))
        assert base(text) == brute(text), text


def test_added_kinds():
    a = pii.automaton()
    assert [k for _, k, _ in pii.find("IBAN: GB82 WEST 1234 5698 7654 32 and", a)] == ["iban"]
    assert [k for _, k, _ in pii.find("ssn 123-45-6789", a)] == ["ssn"]
    assert pii.find("see http://bob:pw@h/x", a)[0][1] == "login"
    assert pii.find("see http://example.org/x", a) == []


def test_table(spark):
    rows = [(1, "mail a@b.org", "x"), (2, None, "x"), (None, "", "x"), (1, "mail a@b.org", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    out = sorted(pii.scan(df).select("doc_id", "n_email", "spans").collect(), key=str)
    assert [tuple(r) for r in out] == [(1, 1, "email:5:12"), (1, 1, "email:5:12"), (2, 0, ""), (None, 0, "")]
    assert pii.scan(df.limit(0)).count() == 0


def test_a_very_long_text(spark):
    text = "word 1 " * 300_000 + "a@b.example"
    got = pii.scan(spark.createDataFrame([(1, text), (1, None)], "doc_id long, text string")).collect()
    assert sorted((r.n_email, r.spans.split(",")[-1]) for r in got) == [(0, ""), (1, f"email:{len(text) - 11}:{len(text)}")]
