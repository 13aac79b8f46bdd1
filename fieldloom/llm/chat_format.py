"""Chat formatting from event logs.

A conversation is a log of events: whole messages, started messages with streamed deltas, edits, regenerations and
deletions, each with a sequence number. Logs are partitioned by conversation and turn, sorted by sequence and folded
into final messages, one message in memory at a time, so that one conversation with a third of all events is spread
over the tasks. Each message is rendered by itself; a conversation's text is its messages' texts in turn order.

Template, for each message::

    ### <role>: <text></turn>\\n

Texts never hold a control string: a backslash is doubled, and a backslash is put after a "#" that begins "###" and
after the "<" of "</turn>". Taking every backslash away together with its effect ("\\\\x" to "x") restores the text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

HEAD, NAME_END, TURN_END = "### ", ": ", "</turn>\n"
TO_ESCAPE = re.compile(r"\\|#(?=##)|<(?=/turn>)")
ESCAPED = re.compile(r"\\(.)", re.S)
TURN = re.compile(r"### ((?:\\.|[^:\\])*+): (.*?)</turn>\n", re.S)
LOSS_ROLE = "assistant"
EVENTS = ("message", "start", "delta", "edit", "regenerate", "delete")
OUT_ROWS, OUT_CHARS = 4096, 4_000_000


def escape(text: str) -> str:
    return TO_ESCAPE.sub(lambda m: "\\\\" if m[0] == "\\" else m[0] + "\\", text)


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1", text)


def render(role: str, text: str) -> tuple[str, int | None, int | None]:
    """The message's text and the span of it that counts for the loss (code points; None if nothing does)."""
    head = HEAD + escape(role).replace(":", "\\:") + NAME_END
    body = escape(text)
    mask = (len(head), len(head) + len(body)) if role == LOSS_ROLE else (None, None)
    return head + body + TURN_END, *mask


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted text; raises if anything else stands in it."""
    turns, at = [], 0
    while at < len(formatted):
        m = TURN.match(formatted, at)
        if m is None:
            raise ValueError(f"no turn at {at}")
        turns.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return turns


def fold(events: Iterator[tuple]) -> Iterator[tuple]:
    """(key, role, text) of final messages from (key, event, role, text) in order; key is (conv_id, turn).

    message is complete in itself; start opens a message; delta adds to the latest message of the key and opens one if
    there is none; edit replaces its text; regenerate empties it for new deltas; delete takes it away. An unknown event
    raises, a null one changes nothing. Null roles and texts count as empty.
    """
    key, role, parts, is_open = None, "", [], False
    for at, event, who, text in events:
        if is_open and (at != key or event in ("message", "start")):
            yield key, role, "".join(parts)
            is_open = False
        key = at
        if event is None:
            continue
        if event in ("message", "start"):
            role, parts, is_open = who or "", [text or ""], True
        elif event == "delta":
            if not is_open:
                role, parts, is_open = who or "", [], True
            parts.append(text or "")
        elif event == "edit":
            if is_open:
                parts = [text or ""]
        elif event == "regenerate":
            if is_open:
                parts = []
        elif event == "delete":
            is_open = False
        else:
            raise ValueError(f"unknown event {event!r}")
    if is_open:
        yield key, role, "".join(parts)


def _fold_and_render(id_type: pa.DataType):
    names = ["_fl_id", "_fl_turn", "_fl_nth", "formatted", "mask_start", "mask_end"]
    kinds = [id_type, pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def events():
            for b in batches:
                yield from ((((i, t)), e, r, x) for i, t, e, r, x in zip(*(b.column(k).to_pylist() for k in range(5)), strict=True))

        def batch(rows: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        rows, chars, last, nth = [], 0, None, 0
        for key, role, text in fold(events()):
            nth = nth + 1 if key == last else 0
            last = key
            formatted, start, end = render(role, text)
            rows.append((*key, nth, formatted, start, end))
            chars += len(formatted)
            if len(rows) >= OUT_ROWS or chars > OUT_CHARS:
                yield batch(rows)
                rows, chars = [], 0
        if rows:
            yield batch(rows)

    return run


def events_of_turns(turns: DataFrame, id_col="conv_id", turn_col="turn", role_col="role", text_col="text") -> DataFrame:
    """A table of finished turns as an event log: a message for each row."""
    return turns.select(F.col(id_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.lit(0).cast("long").alias("seq"), F.lit("message").alias("event"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))


def segments(events: DataFrame) -> DataFrame:
    """Rendered messages (conv_id, turn, nth, formatted, mask_start, mask_end) of events (conv_id, turn, seq, event, role, text).

    Events of a turn go by seq; equal seq by event, role, text, so that repeated rows and ties have one order. A null
    conv_id is a conversation of its own and a null turn comes first. Several messages in a turn are counted by nth.
    An empty log gives no rows; other columns are ignored.
    """
    rank = F.array_position(F.array(*[F.lit(e) for e in EVENTS]), F.col("event"))
    keys = ("conv_id", "turn", "seq", "_fl_rank", "role", "text")
    log = small_batches(events).withColumn("_fl_rank", rank).select(*keys, "event").repartition("conv_id", "turn").sortWithinPartitions(*keys)
    kind = events.schema["conv_id"].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    out = log.select("conv_id", "turn", "event", "role", "text").mapInArrow(_fold_and_render(to_arrow_type(kind)), f"_fl_id {kind.simpleString()}, _fl_turn long, _fl_nth long, formatted string, mask_start long, mask_end long")
    return out.withColumnsRenamed({"_fl_id": "conv_id", "_fl_turn": "turn", "_fl_nth": "nth"})


def conversations(parts: DataFrame) -> DataFrame:
    """conv_id, formatted: whole conversations as one text each (a text must fit in a row)."""
    row = F.sort_array(F.collect_list(F.struct("turn", "nth", "formatted")))
    return parts.groupBy("conv_id").agg(F.array_join(F.transform(row, lambda x: x.formatted), "").alias("formatted"))


class _Digest:
    def __init__(self):
        self.turns = self.loss = self.chars = 0
        self.turns_hash, self.loss_hash = hashlib.sha256(), hashlib.sha256()

    def add(self, formatted: str, start: int | None, end: int | None) -> None:
        for role, text in read_turns(formatted):
            self.turns += 1
            self.turns_hash.update(f"{role}\n{text}\n".encode())
        if start is not None:
            text = unescape(formatted[start:end])
            self.loss += len(text)
            self.loss_hash.update(text.encode())
        self.chars += len(formatted)


def _read_back(id_type: pa.DataType):
    names = ["_fl_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [id_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, key, d = [], None, None
        done = lambda: rows.append((key, d.turns, d.turns_hash.hexdigest(), d.loss, d.loss_hash.hexdigest(), d.chars))
        batch = lambda: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
        for b in batches:
            for conv, formatted, start, end in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                if d is None or conv != key:
                    if d is not None:
                        done()
                    key, d = conv, _Digest()
                d.add(formatted, start, end)
            if len(rows) >= OUT_ROWS:
                yield batch()
                rows = []
        if d is not None:
            done()
        if rows:
            yield batch()

    return run


def read_back(parts: DataFrame) -> DataFrame:
    """Per conversation what its formatted text says when parsed again; a conversation streams through a hash, never held."""
    from pyspark.sql.pandas.types import to_arrow_type

    kind = parts.schema["conv_id"].dataType
    ordered = parts.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "nth").select("conv_id", "formatted", "mask_start", "mask_end")
    out = ordered.mapInArrow(_read_back(to_arrow_type(kind)), f"_fl_id {kind.simpleString()}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
    return out.withColumnRenamed("_fl_id", "conv_id")


ORACLE = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), e AS (
  SELECT *, replace(replace(replace(replace(text, '\', '\\'), '###', '#\##'), '###', '#\##'), '</turn>', '<\/turn>') AS safe FROM t
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(4 + length(role) + 2 + length(safe) + 8) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
