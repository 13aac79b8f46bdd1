import random

import pytest

from fieldloom.llm import chat_format as C


def test_escape_is_reversible():
    rng = random.Random(5)
    pieces = ["\\", "#", "##", "###", "<", "</turn>", "/turn>", "\n", ": ", "é", "x", "### assistant: ", "</turn>\n"]
    for _ in range(20000):
        role, text = ("".join(rng.choice(pieces) for _ in range(rng.randint(0, k))) for k in (4, 10))
        safe = C.escape(text)
        assert C.unescape(safe) == text and "###" not in safe and "</turn>" not in safe
        one, two = C.render(role, text)[0], C.render("assistant", text)
        assert C.read_turns(one + two[0]) == [(role, text), ("assistant", text)]
        assert C.unescape(two[0][two[1] : two[2]]) == text
    with pytest.raises(ValueError):
        C.read_turns("### a: b")


def test_fold():
    k = (1, 0)
    log = [(k, "start", "assistant", None), (k, "delta", None, "wrong"), (k, "regenerate", None, None), (k, "delta", None, "ri"), (k, "delta", None, "ght"), ((1, 1), "message", "user", "hi"), ((1, 1), "edit", None, "hello"), ((1, 2), "message", "user", "x"), ((1, 2), "delete", None, None), ((1, 3), "delta", "assistant", "late")]
    assert list(C.fold(iter(log))) == [(k, "assistant", "right"), ((1, 1), "user", "hello"), ((1, 3), "assistant", "late")]
    with pytest.raises(ValueError):
        list(C.fold(iter([(k, "other", "", "")])))


def test_events_out_of_order_nulls_and_ties(spark):
    schema = "conv_id long, turn long, seq long, event string, role string, text string, nth int"
    log = [(1, 1, 3, "delta", None, "lo", 1), (1, 1, 1, "start", "assistant", None, 1), (1, 1, 2, "delta", None, "hel", 1), (1, 0, 0, "message", "user", "\\### ", 1), (None, None, None, "message", None, None, 1), (2, 0, 0, "message", "user", "same", 1), (2, 0, 0, "message", "user", "same", 1)]
    parts = C.segments(spark.createDataFrame(log, schema))
    whole = {r.conv_id: C.read_turns(r.formatted) for r in C.conversations(parts).collect()}
    assert whole == {1: [("user", "\\### "), ("assistant", "hello")], None: [("", "")], 2: [("user", "same")] * 2}
    back = {r.conv_id: r for r in C.read_back(parts).collect()}
    assert back[1].n_turns == 2 and back[1].loss_chars == 5 and back[2].n_turns == 2 and back[None].formatted_chars == 14
    assert C.read_back(C.segments(spark.createDataFrame([], schema))).count() == 0


def folded_by_hand(log):
    """Final messages by (conv_id, turn) of (conv_id, turn, seq, event, role, text), each key's events replayed by themselves."""
    out = {}
    for conv, turn in sorted({(r[0], r[1]) for r in log}):
        messages, here = [], False
        for _, _, _, event, role, text in sorted((r for r in log if r[:2] == (conv, turn)), key=lambda r: r[2]):
            if event in ("message", "start") or event == "delta" and not here:
                messages.append([role or "", text or ""])
                here = True
            elif event == "delta":
                messages[-1][1] += text or ""
            elif event == "edit" and here:
                messages[-1][1] = text or ""
            elif event == "regenerate" and here:
                messages[-1][1] = ""
            elif event == "delete" and here:
                messages.pop()
                here = False
        out.setdefault(conv, []).extend(map(tuple, messages))
    return {c: m for c, m in out.items() if m}


def test_streamed_logs_equal_a_fold_by_hand(spark):
    """Deltas, edits, regenerations, deletions and null events of many conversations, dealt out of order."""
    rng = random.Random(12)
    pieces = ["\\", "### user: ", "</turn>\n", "word ", "É", "", "x"]
    log = []
    for conv in range(60):
        for turn in range(rng.randint(1, 6)):
            for seq in range(rng.randint(1, 12)):
                event = rng.choice(["message", "start", "delta", "delta", "delta", "delta", "edit", "regenerate", "delete", None])
                text = None if event in ("regenerate", "delete") or rng.random() < 0.1 else "".join(rng.choice(pieces) for _ in range(4))
                log.append((conv, turn, seq, event, rng.choice(["user", "assistant", "a:b", None]), text))
    rng.shuffle(log)
    schema = "conv_id long, turn long, seq long, event string, role string, text string"
    parts = C.segments(spark.createDataFrame(log, schema).repartition(5))
    got = {r.conv_id: C.read_turns(r.formatted) for r in C.conversations(parts).collect()}
    want = folded_by_hand(log)
    assert got == want
    back = {r.conv_id: r for r in C.read_back(parts).collect()}
    for conv, messages in want.items():
        assert back[conv].n_turns == len(messages) and back[conv].loss_chars == sum(len(t) for r, t in messages if r == "assistant")


def test_a_very_long_message(spark):
    text = "### </turn>\\ word " * 60_000
    rows = [(1, 0, 0, "message", "assistant", text)]
    parts = C.segments(spark.createDataFrame(rows, "conv_id long, turn long, seq long, event string, role string, text string"))
    assert C.read_back(parts).first().loss_chars == len(text)
