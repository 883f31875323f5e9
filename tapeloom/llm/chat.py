"""Conversations as training text, by a template and a machine over roles.

The template is data: how a turn opens and closes, which roles carry loss, and which role may follow
which. Control strings can't appear inside a formatted text, as the characters that start them are
escaped by a backslash; reading back removes just these.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TEMPLATE = {
    "open": "### {role}: ",
    "close": "</turn>\n",  # begins with an escaped character, as texts end there
    "escape": "\\",
    "escaped": "\\#<",  # in texts
    "escaped_in_role": "\\#<:",
    "loss_roles": ["assistant"],
    "start": "start",
    "moves": {"start": ["system", "user"], "system": ["user"], "user": ["assistant"], "assistant": ["user"]},
    "ends": ["assistant"],
}
SEGMENTS = "conv_id long, seq long, turn_no long, part string, text string, loss boolean, state string"


def _escaper(chars: str):
    pattern = re.compile(f"[{re.escape(chars)}]")
    return lambda s: pattern.sub(lambda m: "\\" + m[0], s)


def unescape(s: str) -> str:
    return re.sub(r"\\(.)", r"\1", s, flags=re.S)


def _sorted_by(df: DataFrame, *keys: str) -> DataFrame:
    return df.repartition("conv_id").sortWithinPartitions("conv_id", *keys)


def _batched(rows: Iterator[tuple], schema: pa.Schema, size: int = 4096) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)


def format_conversations(turns: DataFrame, template: dict = TEMPLATE) -> DataFrame:
    """Segments (conv_id, seq, turn_no, part, text, loss, state) of ``turns`` (conv_id, turn, role, text).

    A turn gives three segments, part open, text and close; joined by seq they are the formatted
    text. state is the role that the machine stands in after the turn, or ``invalid`` from the first
    turn on that the template's moves don't allow; whether a conversation may end there is seen from
    its last state. Turns come by turn, then role and text, so ties and repeated rows have one
    order. Null texts and roles count as empty; roles that the template doesn't know are invalid,
    but formatted. Rows without conv_id make one conversation. A conversation is streamed, never
    held whole.
    """
    in_text, in_role = _escaper(template["escaped"]), _escaper(template["escaped_in_role"])
    schema = pa.schema([("conv_id", pa.int64()), ("seq", pa.int64()), ("turn_no", pa.int64()), ("part", pa.string()), ("text", pa.string()), ("loss", pa.bool_()), ("state", pa.string())])
    moves, loss_roles = {k: set(v) for k, v in template["moves"].items()}, set(template["loss_roles"])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        now, state, n = object(), "", 0
        for b in batches:
            for conv, role, text in zip(*(b.column(k).to_pylist() for k in range(3))):
                if conv != now:
                    now, state, n = conv, template["start"], 0
                role = role or ""
                state = role if role in moves.get(state, ()) else "invalid"
                yield conv, 3 * n, n, "open", template["open"].replace("{role}", in_role(role)), False, state
                yield conv, 3 * n + 1, n, "text", in_text(text or ""), role in loss_roles, state
                yield conv, 3 * n + 2, n, "close", template["close"], False, state
                n += 1

    ordered = _sorted_by(turns.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "text"), "turn", "role", "text")
    return ordered.select("conv_id", "role", "text").mapInArrow(lambda it: _batched(rows(it), schema), SEGMENTS)


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean"


def read_back(segments: DataFrame, template: dict = TEMPLATE) -> DataFrame:
    """One row for each conversation of ``format_conversations``, from the segments' text alone: the
    turns are found by the template's strings, not by the segments' bounds. valid: the machine
    allowed each turn and the end."""
    close = template["close"]
    head, tail = template["open"].split("{role}")
    turn = re.compile(rf"{re.escape(head)}([^\\#<:]*+(?:\\.[^\\#<:]*+)*+){re.escape(tail)}([^\\#<]*+(?:\\.[^\\#<]*+)*+){re.escape(close)}", re.S)
    ends = set(template["ends"])
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("valid", pa.bool_())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        now, row = object(), None
        for b in batches:
            for conv, text, loss, state in zip(*(b.column(k).to_pylist() for k in range(4))):
                if conv != now:
                    if row:
                        yield row.done()
                    now, row = conv, _Digest(conv, turn, ends)
                row.add(text, loss, state)
        if row:
            yield row.done()

    ordered = _sorted_by(segments.select("conv_id", "seq", "text", "loss", "state"), "seq")
    return ordered.select("conv_id", "text", "loss", "state").mapInArrow(lambda it: _batched(rows(it), schema), DIGEST)


class _Digest:
    def __init__(self, conv, turn: re.Pattern, ends: set[str]):
        self.conv, self.turn, self.ends = conv, turn, ends
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n = self.loss_chars = self.chars = 0
        self.rest, self.state, self.ok = "", "", True

    def add(self, text: str, loss: bool, state: str) -> None:
        self.chars += len(text)
        self.state, self.ok = state, self.ok and state != "invalid"
        if loss:
            said = unescape(text)
            self.loss_chars += len(said)
            self.loss.update(said.encode())
        self.rest += text
        if m := self.turn.fullmatch(self.rest):
            self.turns.update(f"{unescape(m[1])}\n{unescape(m[2])}\n".encode())
            self.n, self.rest = self.n + 1, ""

    def done(self) -> tuple:
        if self.rest:
            raise ValueError(f"conversation {self.conv} doesn't read back")
        return self.conv, self.n, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars, self.ok and self.state in self.ends
