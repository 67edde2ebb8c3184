"""Chat formatting in budgeted windows.

Turns are written between control strings. A conversation longer than the budget becomes several windows of whole turns: prefix sums of the
turns' tokens say how far a window reaches; each later window repeats the system turn and the last turns before it, up to a history
budget, and only new assistant texts are targets, so every target is learned once.

Template: ``<|im_start|>`` role newline text ``<|im_end|>`` newline. Inside roles and texts ``<|`` becomes ``<\\|``, and a ``<`` before
backslashes and a bar gets one backslash more; a newline in a role becomes ``<|nl|>``. So control strings in the output are the template's own, and
``unescape`` gives back what was there.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txguard.llm.tokens import encoder

START, END, NEWLINE = "<|im_start|>", "<|im_end|>", "<|nl|>"
BUDGET, HISTORY = 1024, 256
WINDOWS = "conv_id long, window long, text string, targets array<struct<start: int, end: int>>, repeated int"
_SPAN = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
_WINDOWS = pa.schema([("conv_id", pa.int64()), ("window", pa.int64()), ("text", pa.string()), ("targets", _SPAN), ("repeated", pa.int32())])
_BAR, _ESCAPED = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")


def escape(text: str) -> str:
    return _BAR.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def written(role: str, text: str) -> tuple[str, str, str]:
    """Head, body and tail of a turn."""
    return f"{START}{escape(role).replace(chr(10), NEWLINE)}\n", escape(text), f"{END}\n"


@dataclass
class Turn:
    role: str
    head: str
    body: str
    tail: str
    tokens: int


@dataclass
class Windows:
    """Spans of one conversation, turn by turn; holds the open window and the history that the next may repeat."""

    budget: int
    history: int
    system: Turn | None = None
    open: list[Turn] = field(default_factory=list)
    repeated: int = 0
    used: int = 0
    number: int = 0
    seen: int = 0
    last: list[Turn] = field(default_factory=list)

    def add(self, turn: Turn) -> tuple[int, list[Turn], int] | None:
        """Takes a turn; gives the window that it closed, if it did."""
        closed = None
        if len(self.open) > self.repeated and self.used + turn.tokens > self.budget:
            closed = self.close()
            self._repeat(turn)
        if not self.seen and turn.role == "system":
            self.system = turn
        self.seen += 1
        self.open.append(turn)
        self.used += turn.tokens
        return closed

    def _repeat(self, turn: Turn) -> None:
        """Begin a window: the system turn, then as many of the last turns as the history and the budget allow."""
        head = [self.system] if self.system else []
        room = min(self.history, self.budget - turn.tokens - sum(t.tokens for t in head))
        kept: list[Turn] = []
        for past in reversed(self.last):
            if past is self.system or past.tokens > room:
                break
            room -= past.tokens
            kept.append(past)
        self.open = head + kept[::-1]
        self.repeated = len(self.open)
        self.used = sum(t.tokens for t in self.open)

    def close(self) -> tuple[int, list[Turn], int] | None:
        if len(self.open) == self.repeated:
            return None
        out = self.number, self.open, self.repeated
        self.number += 1
        self.last = self.open
        return out


def render(turns: list[Turn], repeated: int) -> tuple[str, list[dict[str, int]]]:
    """The window's text and the spans (code points) of its targets: new assistant texts."""
    parts: list[str] = []
    targets = []
    at = 0
    for i, t in enumerate(turns):
        if i >= repeated and t.role == "assistant":
            targets.append({"start": at + len(t.head), "end": at + len(t.head) + len(t.body)})
        parts += (t.head, t.body, t.tail)
        at += len(t.head) + len(t.body) + len(t.tail)
    return "".join(parts), targets


def _rows(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns))


def format_windows(conversations: DataFrame, vocabulary: str, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """conv_id, window (from 0), text, targets (spans of new assistant texts), repeated (turns at its head that earlier windows had).

    Turns come by (turn, role, text), nulls last; repeated rows are turns of their own. Null roles and texts count as empty; rows without
    conv_id are one conversation. A turn above the budget has a window without history. Tokens are those of ``vocabulary``, of head, body and tail. A task
    streams its conversations turn by turn and holds one window and its history, however long a conversation is.
    """

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary)
        out: list[tuple] = []

        def emit(conv: int | None, closed: tuple[int, list[Turn], int] | None) -> None:
            if closed:
                text, targets = render(closed[1], closed[2])
                out.append((conv, closed[0], text, targets, closed[2]))

        state: Windows | None = None
        current: int | None = None
        for conv, role, text in _rows(batches):
            if state is None or conv != current:
                if state:
                    emit(current, state.close())
                state, current = Windows(budget, history), conv
            head, body, tail = written(role or "", text or "")
            tokens = (len(encode(head)) + len(encode(body)) + len(encode(tail))) // 4
            emit(conv, state.add(Turn(role or "", head, body, tail, tokens)))
            if len(out) >= 500:
                yield _batch(out)
                out.clear()
        if state:
            emit(current, state.close())
        if out:
            yield _batch(out)

    order = [F.col("conv_id").asc_nulls_last(), F.col("turn").asc_nulls_last(), F.col("role").asc_nulls_last(), F.col("text").asc_nulls_last()]
    rows = conversations.select("conv_id", "turn", "role", "text").repartition("conv_id").sortWithinPartitions(*order)
    return rows.select("conv_id", "role", "text").mapInArrow(build, WINDOWS)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _WINDOWS.types)], schema=_WINDOWS)


def parse(text: str) -> Iterator[tuple[str, str, int, int]]:
    """role, text, and the span of the text as written, for each turn of a window."""
    at = 0
    while at < len(text):
        if not text.startswith(START, at):
            raise ValueError("not a formatted window")
        line = text.index("\n", at)
        end = text.index(END, line + 1)
        yield unescape(text[at + len(START) : line].replace(NEWLINE, "\n")), unescape(text[line + 1 : end]), line + 1, end
        at = end + len(END) + 1


def read_back(windows: DataFrame) -> DataFrame:
    """What the windows hold, per conversation: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_windows.

    Turns that a window repeats are skipped; the targets' text is read by their spans.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        current: object = read  # no conversation yet
        turns = loss = hashlib.sha256()
        n = chars = size = count = 0

        def done() -> None:
            if current is not read:
                out.append((current, n, turns.hexdigest(), chars, loss.hexdigest(), size, count))

        for conv, text, targets, repeated in _rows(batches):
            if conv != current or current is read:
                done()
                current, turns, loss, n, chars, size, count = conv, hashlib.sha256(), hashlib.sha256(), 0, 0, 0, 0
            size += len(text)
            count += 1
            for i, (role, body, _, _) in enumerate(parse(text)):
                if i >= repeated:
                    n += 1
                    turns.update(f"{role}\n{body}\n".encode())
            for t in targets:
                body = unescape(text[t["start"] : t["end"]])
                chars += len(body)
                loss.update(body.encode())
        done()
        if out:
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)

    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_windows"]
    rows = windows.repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_last(), "window")
    return rows.select("conv_id", "text", "targets", "repeated").mapInArrow(
        read, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_windows long")
