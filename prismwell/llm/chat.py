"""Chat formatting: a declarative template, a finite-state machine over roles, loss flags by segment.

A template names the marks around a turn, the roles that are trained on and the machine's transitions.
Rows are sorted into ranges of (conversation, turn), so that a conversation of any length spreads over
as many tasks as it needs. The machine runs over ranges in parallel: each range is first summed up as
the map from the state it is entered with to the state it is left with, for the conversation that is
open at its end. Composing these maps, one a range, gives each range's first state; a second pass then
emits the segments. A mark's string inside a text is escaped by one backslash after its ``<``, and
escaped strings by one more, so that the text comes back exactly.

Edge cases: a null or empty text is an empty segment; a null role is the empty role, which no template
admits; a turn that the machine does not admit puts it into ``error`` for the rest of the conversation,
whose segments are emitted all the same, without loss from that turn on where ``strict`` is set; rows
that agree in conversation and turn follow by role and text, repeated rows are turns of their own; a
null turn comes first; rows with a null id are one conversation; an empty table gives no rows; extra
columns are not read. Digests of a whole conversation are serial by nature: ``conversation_digests``
streams a conversation's segments through one task in bounded memory and gathers none.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

ERROR = "error"
#: A range's number stands above the row's place in it.
RANGE_BITS = 33
_MARK, _ESCAPED = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")
_SEGMENT = "_id string, turn string, pos long, part int, text string, loss boolean, state string"
_DIGEST = "_id string, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, in_order boolean"


@dataclass(frozen=True)
class Template:
    """Marks around a turn, roles under the loss, and the machine: state -> {role: next state}."""

    opening: str = "<|im_start|>"
    after_role: str = "\n"
    closing: str = "<|im_end|>"
    between: str = "\n"
    loss_roles: tuple[str, ...] = ("assistant",)
    start: str = "start"
    transitions: dict[str, dict[str, str]] = field(
        default_factory=lambda: {
            "start": {"system": "briefed", "user": "asked"},
            "briefed": {"user": "asked"},
            "asked": {"assistant": "answered"},
            "answered": {"user": "asked", "tool": "asked"},
        }
    )
    accepting: tuple[str, ...] = ("asked", "answered")
    strict: bool = False

    def __post_init__(self):
        if not self.opening.startswith("<|") or not self.closing.startswith("<|"):
            raise ValueError("marks begin with <|, as that is what texts are escaped for")

    def step(self, state: str, role: str) -> str:
        return self.transitions.get(state, {}).get(role, ERROR)

    @property
    def states(self) -> list[str]:
        return [*self.transitions, ERROR]


CHATML = Template()


def escape(text: str) -> str:
    """The text with no ``<|`` left in it."""
    return _MARK.sub(r"<\\\1|", text) if "<" in text else text


def unescape(text: str) -> str:
    """What ``escape`` was given."""
    return _ESCAPED.sub(r"<\1|", text) if "<" in text else text


def _role_out(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def _role_in(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(text))


def _ordered(turns: DataFrame, id_col: str, turn: str, role: str, text: str) -> DataFrame:
    """Rows in ranges of (conversation, turn), numbered by range and place; written once, so that numbers stay.

    The row's own number is the last of the range's keys: even one turn said a million times is spread.
    """
    rows = turns.select(
        F.col(id_col).alias("_key"),
        F.col(turn).cast("long").alias("_turn"),
        F.coalesce(F.col(role).cast("string"), F.lit("")).alias("_role"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text"),
        F.monotonically_increasing_id().alias("_n"),
    )
    by = ["_key", "_turn", "_role", "_text", "_n"]
    placed = rows.repartitionByRange(*by).sortWithinPartitions(*by)
    return cut(placed.select(F.col("_key").cast("string").alias("_id"), F.col("_turn").cast("string").alias("_turn"), "_role", "_text", F.monotonically_increasing_id().alias("_pos")))


def format_turns(turns: DataFrame, template: Template = CHATML, id_col: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per segment, three to a turn: id, turn, pos (the turn's place among all), part (0 to 2), text, loss, state.

    A conversation's texts by (pos, part), one after the other, are its formatted string; ``state`` is
    the machine's after the turn.
    """
    id_type = turns.schema[id_col].dataType
    ordered = _ordered(turns, id_col, turn, role, text)
    states = template.states

    def outline(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Of a range: its first and last conversation and the last one's map of states, from the range's start or its own."""
        first = last = number = None
        ends: list[str] = []
        seen = False
        for pdf in batches:
            for key, said, pos in zip(pdf["_id"].tolist(), pdf["_role"].tolist(), pdf["_pos"].tolist(), strict=True):
                if not seen:
                    seen, first, last, number, ends = True, key, key, pos >> RANGE_BITS, list(states)
                elif key != last:
                    last, ends = key, [template.start] * len(states)
                ends = [template.step(s, said) for s in ends]
        if seen:
            yield pd.DataFrame({"range": [number], "first": [first], "last": [last], "ends": [ends]})

    # one row a range, which is as many as the shuffle has partitions
    ranges = sorted(ordered.mapInPandas(outline, "range long, first string, last string, ends array<string>").collect(), key=lambda r: r["range"])
    entered: dict[int, tuple] = {}
    open_id, state = object(), template.start
    for r in ranges:
        going_on = r["first"] == open_id
        entered[r["range"]] = (going_on, state if going_on else template.start)
        state = r["ends"][states.index(entered[r["range"]][1])]
        open_id = r["last"]

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, state, begun = None, template.start, False
        for pdf in batches:
            rows = []
            for key, at, said, body, pos in zip(pdf["_id"].tolist(), pdf["_turn"].tolist(), pdf["_role"].tolist(), pdf["_text"].tolist(), pdf["_pos"].tolist(), strict=True):
                if not begun:
                    state, begun = entered[pos >> RANGE_BITS][1], True
                elif key != last:
                    state = template.start
                last, state = key, template.step(state, said)
                trained = said in template.loss_roles and not (template.strict and state == ERROR)
                rows.append((key, at, pos, 0, template.opening + _role_out(said) + template.after_role, False, state))
                rows.append((key, at, pos, 1, escape(body), trained, state))
                rows.append((key, at, pos, 2, template.closing + template.between, False, state))
            yield pd.DataFrame(rows, columns=["_id", "turn", "pos", "part", "text", "loss", "state"])

    segments = ordered.mapInPandas(emit, _SEGMENT)
    return segments.select(F.col("_id").cast(id_type).alias(id_col), F.col("turn").cast("long").alias("turn"), "pos", "part", "text", "loss", "state")


class _Reader:
    """Reads turns back from a conversation's formatted string as it arrives."""

    def __init__(self, template: Template):
        self.template, self.held = template, ""
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n = self.chars = self.loss_chars = 0
        self.state = template.start

    def feed(self, segment: str, loss: bool, state: str) -> None:
        t = self.template
        self.chars += len(segment)
        self.state = state
        if loss:
            said = unescape(segment)
            self.loss_chars += len(said)
            self.loss.update(said.encode())
        self.held += segment
        end = t.closing + t.between
        if not segment.endswith(end):
            return
        while (at := self.held.find(end)) >= 0:
            turn, self.held = self.held[:at], self.held[at + len(end) :]
            if not turn.startswith(t.opening):
                raise ValueError("a turn does not begin with its mark")
            role, _, body = turn[len(t.opening) :].partition(t.after_role)
            self.turns.update(f"{_role_in(role)}\n{unescape(body)}\n".encode())
            self.n += 1

    def row(self, key) -> tuple:
        if self.held:
            raise ValueError("the last turn has no end")
        return key, self.n, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars, self.state in self.template.accepting


def conversation_digests(segments: DataFrame, template: Template = CHATML, id_col: str = "conv_id") -> DataFrame:
    """Per conversation, read back from its segments: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, in_order.

    ``turns_sha256`` is that of role, newline, text, newline a turn; the loss columns are of the text
    under the loss, unescaped; ``in_order`` says whether the machine admits every turn.
    """
    id_type = segments.schema[id_col].dataType
    by_id = segments.select(F.col(id_col).cast("string").alias("_id"), "pos", "part", "text", "loss", "state").repartition("_id").sortWithinPartitions("_id", "pos", "part")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in _DIGEST.split(", ")]
        key, reader = None, None
        for pdf in batches:
            done = []
            for k, text, loss, state in zip(pdf["_id"].tolist(), pdf["text"].tolist(), pdf["loss"].tolist(), pdf["state"].tolist(), strict=True):
                if reader is None or k != key:
                    if reader is not None:
                        done.append(reader.row(key))
                    key, reader = k, _Reader(template)
                reader.feed(text, loss, state)
            yield pd.DataFrame(done, columns=names)
        if reader is not None:
            yield pd.DataFrame([reader.row(key)], columns=names)

    found = by_id.mapInPandas(read, _DIGEST)
    return found.select(F.col("_id").cast(id_type).alias(id_col), *[x.split()[0] for x in _DIGEST.split(", ")[1:]])
