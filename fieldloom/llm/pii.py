"""Personal data by anchor expansion.

An Aho-Corasick automaton finds the anchors (at-signs, plus signs, digits, schemes and identifier cues) in one pass
over a text. From each anchor a local parser expands to the left and right over the characters that its kind allows,
sets the boundaries and validates the candidate. No parser looks beyond its own run of characters, so the work is
linear in the text, and each kind goes from left to right and starts no candidate inside the one before.

Kinds: email, ip, card (Luhn) and phone are the base kinds. The anchors add: iban (a cue "iban", then an account number
whose check digits are right), ssn (a cue "ssn", then ddd-dd-dddd) and login (a scheme, then user:password before "@").
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

DIGITS = frozenset("0123456789")
LETTERS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
LOCAL = LETTERS | DIGITS | frozenset("._%+-")
LABEL = LETTERS | DIGITS | frozenset("-")
PHONE = DIGITS | frozenset(" ().-")
AUTHORITY_END = frozenset("/?#\"'<>\\ \t\n\x0b\x0c\r")
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "ssn", "login")
RANK = {k: i for i, k in enumerate(KINDS)}
IBAN_MOST, CUE_GAP = 34, 3

Span = tuple[int, int]


def run_end(text: str, at: int, allowed: frozenset) -> int:
    n = len(text)
    while at < n and text[at] in allowed:
        at += 1
    return at


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def email_at(text: str, at: int, floor: int) -> Span | None:
    """The address around the at-sign at position at, not reaching to the left of floor."""
    start = at
    while start > floor and text[start - 1] in LOCAL:
        start -= 1
    end = run_end(text, at + 1, LABEL)
    if start == at or end == at + 1:
        return None
    labels = 0
    while end < len(text) and text[end] == ".":
        after = run_end(text, end + 1, LABEL)
        if after == end + 1:
            break
        end, labels = after, labels + 1
    return (start, end) if labels else None


def ip_at(text: str, at: int) -> tuple[Span | None, bool]:
    """Four numbers from the digit at position at; whether they are valid."""
    end = run_end(text, at, DIGITS)
    for _ in range(3):
        if end >= len(text) or text[end] != ".":
            return None, False
        after = run_end(text, end + 1, DIGITS)
        if after == end + 1:
            return None, False
        end = after
    return (at, end), all(int(x) <= 255 if len(x) < 9 else not x.strip("0") or int(x.lstrip("0")[:4]) <= 255 and len(x.lstrip("0")) < 4 for x in text[at:end].split("."))


def card_at(text: str, at: int) -> tuple[Span, bool]:
    """The chain of digits, with single blanks or hyphens between them, from the digit at position at."""
    n, end, digits = len(text), at + 1, 1
    while end < n:
        if text[end] in DIGITS:
            end, digits = end + 1, digits + 1
        elif text[end] in " -" and end + 1 < n and text[end + 1] in DIGITS:
            end, digits = end + 2, digits + 1
        else:
            break
    return (at, end), 12 <= digits <= 19 and luhn(text[at:end].replace(" ", "").replace("-", ""))


def phone_at(text: str, at: int) -> tuple[Span | None, bool]:
    """The number from the plus sign at position at."""
    if at + 1 >= len(text) or text[at + 1] not in DIGITS:
        return None, False
    end = run_end(text, at + 2, PHONE)
    while end > at + 2 and text[end - 1] not in DIGITS:
        end -= 1
    if end < at + 4:  # a plus sign, a digit, something between, a digit
        return None, False
    return (at, end), 9 <= sum(c in DIGITS for c in text[at:end]) <= 15


def iban_after(text: str, cue_end: int) -> Span | None:
    start = cue_end
    while start < len(text) and start - cue_end < CUE_GAP and text[start] in " :=#":
        start += 1
    end, taken = start, ""
    while end < len(text) and len(taken) < IBAN_MOST and (text[end] in LETTERS or text[end] in DIGITS or text[end] == " " and end + 1 < len(text) and (text[end + 1] in DIGITS or "A" <= text[end + 1] <= "Z")):
        taken += text[end].strip()
        end += 1
        if len(taken) >= 15 and (end == len(text) or text[end] not in LETTERS and text[end] not in DIGITS):
            head = taken.upper()
            if head[:2].isalpha() and head[2:4].isdigit() and int("".join(str(int(c, 36)) for c in head[4:] + head[:4])) % 97 == 1:
                return start, end
    return None


def ssn_after(text: str, cue_end: int) -> Span | None:
    start = cue_end
    while start < len(text) and start - cue_end < CUE_GAP and text[start] in " :=#":
        start += 1
    x = text[start : start + 11]
    if len(x) == 11 and x[3] == x[6] == "-" and all(c in DIGITS for c in x[:3] + x[4:6] + x[7:]) and (start + 11 == len(text) or text[start + 11] not in DIGITS) and x[:3] not in ("000", "666") and x[0] != "9" and x[4:6] != "00" and x[7:] != "0000":
        return start, start + 11
    return None


def login_after(text: str, scheme_end: int) -> Span | None:
    end, sign, colon = scheme_end, -1, -1
    while end < len(text) and text[end] not in AUTHORITY_END:
        if text[end] == "@":
            sign = end
        elif text[end] == ":" and sign < 0 and colon < 0:
            colon = end
        end += 1
    return (scheme_end, sign) if scheme_end < colon < sign - 1 else None


def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for c in "0123456789":
        found.add_word(c, "digit")
    for word, kind in (("@", "at"), ("+", "plus"), ("://", "scheme"), ("iban", "iban"), ("IBAN", "iban"), ("Iban", "iban"), ("ssn", "ssn"), ("SSN", "ssn")):
        found.add_word(word, kind)
    found.make_automaton()
    return found


def find(text: str, anchors: ahocorasick.Automaton) -> list[tuple[int, str, int]]:
    """All spans of a text as (start, kind, end), by start, then kind; code points, end exclusive."""
    spans: list[tuple[int, str, int]] = []
    free = dict.fromkeys(KINDS, 0)  # per kind: where the last candidate ended
    for last, what in anchors.iter(text):
        if what == "digit":
            if last >= free["card"]:
                (start, end), ok = card_at(text, last)
                if end > start + 1:
                    free["card"] = end
                    if ok:
                        spans.append((start, "card", end))
            if last >= free["ip"]:
                span, ok = ip_at(text, last)
                if span:
                    free["ip"] = span[1]
                    if ok:
                        spans.append((last, "ip", span[1]))
                else:  # no start within these digits can do better
                    free["ip"] = run_end(text, last, DIGITS)
        elif what == "at":
            span = email_at(text, last, free["email"]) if last >= free["email"] else None
            if span:
                free["email"] = span[1]
                spans.append((span[0], "email", span[1]))
        elif what == "plus":
            span, ok = phone_at(text, last) if last >= free["phone"] else (None, False)
            if span:
                free["phone"] = span[1]
                if ok:
                    spans.append((last, "phone", span[1]))
        else:
            kind, after = {"iban": ("iban", iban_after), "ssn": ("ssn", ssn_after), "scheme": ("login", login_after)}[what]
            span = after(text, last + 1)
            if span and span[0] >= free[kind]:
                free[kind] = span[1]
                spans.append((span[0], kind, span[1]))
    spans.sort(key=lambda s: (s[0], RANK[s[1]]))
    return spans


def written(spans: list[tuple[int, str, int]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, kind, end in spans)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    anchors = automaton()
    for batch in batches:
        out = []
        for text in batch.column(1).to_pylist():
            spans = find(text or "", anchors)
            base = [s for s in spans if s[1] in BASE]
            n = {k: 0 for k in BASE}
            for s in base:
                n[s[1]] += 1
            out.append((*n.values(), hashlib.sha256(written(base).encode()).hexdigest(), written(spans)))
        kinds = (pa.int64(),) * 4 + (pa.string(),) * 2
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[i] for r in out], t) for i, t in enumerate(kinds))], ["_fl_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: id, n_email, n_ip, n_card, n_phone, base_sha256, spans ("kind:start:end", comma-joined).

    Null and empty texts have no spans. Spans of different kinds may overlap, those of one kind never do. Repeated rows
    give repeated results; an empty table gives none; other columns are ignored. Memory: one text and its spans.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    own = small_batches(docs).select(F.col(id_col).alias("_fl_id"), F.col(text_col).alias("_fl_text"))
    return own.mapInArrow(_scan, f"_fl_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string").withColumnRenamed("_fl_id", id_col)
