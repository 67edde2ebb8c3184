"""Stateful processors of the decision stream, with typed state.

Rows pass through a processor with their columns as they are, timestamps as microseconds. State is read where a key has new rows, and written back only
as far as it changed.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import deque
from collections.abc import Callable, Iterator, Sequence
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from txguard.operators.sliding import DAY, Sliding
from txguard.plans.banking import OUTCOME, STEP_INPUTS, CardStep
from txguard.plans.rules import Rule

ROWS = "ts long, amount double, merchant string, country string"
SCALARS = ("blocked_at long, day string, month string, day_spent long, month_spent long, manual_at long, lifted_at long, keep_until long")
OUTCOME_NAMES = [part.split()[0] for part in OUTCOME.split(", ")]


def without_timestamps(df: DataFrame) -> DataFrame:
    """Timestamps as microseconds, which a processor hands on unchanged."""
    return df.select(*(F.unix_micros(f.name).alias(f.name) if isinstance(f.dataType, T.TimestampType) else F.col(f.name) for f in df.schema.fields))


def with_timestamps(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The columns that are timestamps in ``schema``, back from microseconds."""
    stamps = {f.name for f in schema.fields if isinstance(f.dataType, T.TimestampType)}
    return df.select(*(F.timestamp_micros(c).alias(c) if c in stamps else F.col(c) for c in df.columns))


class _Rows(StatefulProcessor):
    """Takes rows of ``schema`` at once, or in event order as the watermark passes ``event_ms``.

    A subclass has ``process(rows) -> output rows`` for rows in order, ``keep_until()`` for when its state may go, and ``forget()``. ``kind`` names a column that
    tells rows from commands: commands far ahead hold no row back.
    """

    def __init__(self, schema: T.StructType, output: T.StructType, order: str, sort_by: Sequence[str], idle_ms: int | None, kind: str | None = None):
        self.schema, self.output, self.order, self.idle_ms = schema, output, order, idle_ms
        self.at = {f.name: i for i, f in enumerate(schema.fields)}
        self.whole = [isinstance(f.dataType, (T.LongType, T.IntegerType)) for f in schema.fields]
        self.sort_by = [self.at[c] for c in sort_by]
        self.kind = None if kind is None else self.at[kind]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.schema, self.ttl)

    @property
    def ttl(self) -> int | None:
        return self.idle_ms if self.order == "arrival" else None

    def _tuples(self, chunks: Iterator[pd.DataFrame]) -> list[tuple]:
        out: list[tuple] = []
        for chunk in chunks:
            frame = chunk[list(self.at)].astype(object)
            frame = frame.where(frame.notna(), None)
            out.extend(tuple(int(v) if w and v is not None else v for v, w in zip(r, self.whole)) for r in frame.itertuples(index=False, name=None))
        return out

    def _ordered(self, rows: list[tuple]) -> list[tuple]:
        return sorted(rows, key=lambda r: tuple((r[i] is not None, r[i]) if r[i] is not None else (False, 0) for i in self.sort_by))

    def _out(self, rows: list[tuple]) -> Iterator[pd.DataFrame]:
        made = list(zip(*rows)) or [()] * len(self.output.fields)
        kinds = {T.LongType: "Int64", T.IntegerType: "Int32"}
        yield pd.DataFrame({f.name: pd.Series(list(c), dtype=kinds.get(type(f.dataType), object)) for f, c in zip(self.output.fields, made)})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        fresh = self._tuples(rows)
        if not fresh:
            return
        if self.order == "arrival":
            yield from self._out(self.process(self._ordered(fresh)))
            return
        self.waiting.appendList(fresh)
        newest: dict[int | None, int] = {}
        for r in fresh:
            kind, ms = None if self.kind is None else r[self.kind], r[self.at["event_ms"]]
            newest[kind] = max(ms, newest.get(kind, ms))
        for ms in set(newest.values()):
            self.handle.registerTimer(ms + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        due = expiredTimerInfo.getExpiryTimeInMs()
        held = list(self.waiting.get()) if self.waiting.exists() else []
        ready, later = ([r for r in held if (r[self.at["event_ms"]] < due) is early] for early in (True, False))
        if ready:
            self.waiting.clear()
            if later:
                self.waiting.put(later)
            yield from self._out(self.process(self._ordered(ready)))
            until = self.keep_until()
            if until is not None:
                self.handle.registerTimer(max(until, due) + 1)
        elif not held:
            until = self.keep_until()
            if until is not None and until < due:
                self.forget()

    def close(self) -> None:
        pass


class DistinctProcessor(_Rows):
    """Distinct values of several columns over the last ``width_ms`` before each row of a key, rows of its time included.

    For each value the time it was last seen is kept, so a value enters with its first row and leaves with its last. ``counted`` names a boolean column: rows
    where it is not true take no part and get null.
    """

    def __init__(self, schema: T.StructType, output: T.StructType, specs: Sequence[Sliding], counted: str, order: str, idle_ms: int | None):
        super().__init__(schema, output, order, ["ts_ms"], idle_ms)
        self.specs, self.counted = list(specs), counted

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.seen = [handle.getMapState(f"seen_{i}", "value string", "last long", self.ttl) for i in range(len(self.specs))]

    def process(self, rows: list[tuple]) -> list[tuple]:
        ts, counted = self.at["ts_ms"], self.at[self.counted]
        times = [r[ts] for r in rows]
        found: list[list[int | None]] = [[None] * len(self.specs) for _ in rows]
        for s, (spec, state) in enumerate(zip(self.specs, self.seen)):
            value = self.at[spec.value]
            kept = {k[0]: v[0] for k, v in state.iterator()}
            last = dict(kept)
            queue = deque(sorted((t, v) for v, t in last.items()))
            i = 0
            while i < len(rows):
                end, now = bisect_right(times, times[i]), times[i]
                for r in rows[i:end]:
                    if r[counted] and r[value] is not None:
                        # State has text for values of any type. Late rows never make a value older than it is.
                        v = str(r[value])
                        last[v] = max(now, last.get(v, now))
                        queue.append((last[v], v))
                while queue and queue[0][0] < now - spec.width_ms:
                    t, v = queue.popleft()
                    if last.get(v) == t:
                        del last[v]
                for k in range(i, end):
                    found[k][s] = len(last) if rows[k][counted] else None
                i = end
            for v in kept.keys() - last.keys():
                state.removeKey((v,))
            for v, t in last.items():
                if kept.get(v) != t:
                    state.updateValue((v,), (t,))
        return [(*r, *f) for r, f in zip(rows, found)]

    def keep_until(self) -> int | None:
        ends = [v[0] + spec.width_ms for spec, state in zip(self.specs, self.seen) for _, v in state.iterator()]
        return max(ends, default=None)

    def forget(self) -> None:
        for state in self.seen:
            state.clear()


class AdmissionProcessor(_Rows):
    """Fixed windows of ``width_ms`` anchored at a client's first request, as :func:`txguard.operators.folds.admit_anchored`; adds the window's start, the
    weight used in it so far, and whether the request is allowed.

    ``weight`` names a column; rows where ``reset`` is true empty the window, and are not handed on.
    """

    def __init__(self, schema: T.StructType, output: T.StructType, order: str, idle_ms: int | None, rate: int, width_ms: int, ties: Sequence[str]):
        super().__init__(schema, output, order, ["ts_ms", "own_request", *ties], idle_ms, "own_request")
        self.rate, self.width = rate, width_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.window = handle.getValueState("window", "start long, used long", self.ttl)

    def process(self, rows: list[tuple]) -> list[tuple]:
        start, used = self.window.get() if self.window.exists() else (None, 0)
        ts, request, named, weight = (self.at[c] for c in ("ts_ms", "own_request", "own_named", "own_weight"))
        out = []
        for r in rows:
            if not r[request]:
                # A reset that comes late leaves a window that began after it.
                if start is not None and start <= r[ts]:
                    start, used = None, 0
                continue
            if not r[named]:
                out.append((*r, None, None, True))
                continue
            if start is None or r[ts] - start >= self.width:
                start, used = r[ts], 0
            used += r[weight] or 0
            out.append((*r, start, used, used <= self.rate))
        if start is None:
            self.window.clear()
        else:
            self.window.update((start, used))
        return out

    def keep_until(self) -> int | None:
        return self.window.get()[0] + self.width if self.window.exists() else None

    def forget(self) -> None:
        self.window.clear()


class BucketProcessor(_Rows):
    """A token bucket per client, as :func:`txguard.operators.folds.token_bucket`; adds whether the request is allowed, and the tokens left."""

    def __init__(self, schema: T.StructType, output: T.StructType, order: str, idle_ms: int | None, rate: float, burst: int, ties: Sequence[str]):
        super().__init__(schema, output, order, ["ts_ms", *ties], idle_ms)
        self.rate, self.burst = rate, float(burst)

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.bucket = handle.getValueState("bucket", "tokens double, last long", self.ttl)

    def process(self, rows: list[tuple]) -> list[tuple]:
        tokens, last = self.bucket.get() if self.bucket.exists() else (self.burst, None)
        ts, named = self.at["ts_ms"], self.at["own_named"]
        out = []
        for r in rows:
            if not r[named]:
                out.append((*r, True, None))
                continue
            # Late rows find what is left and give no time back.
            tokens = min(self.burst, tokens + max(0, r[ts] - last) / 1000.0 * self.rate) if last is not None else tokens
            last = r[ts] if last is None else max(last, r[ts])
            allowed = tokens >= 1.0
            tokens -= allowed
            out.append((*r, allowed, tokens))
        if last is not None:
            self.bucket.update((tokens, last))
        return out

    def keep_until(self) -> int | None:
        # A bucket that has filled up again needs no state.
        return self.bucket.get()[1] + int(-(-self.burst * 1000 // self.rate)) if self.bucket.exists() else None

    def forget(self) -> None:
        self.bucket.clear()


class CardProcessor(_Rows):
    """Decides the transactions of a card with the step of the batch fold; rows with a ``command`` block and unblock the card in between.

    The card's recorded rows of 24 hours are a list, its block and spending are values. All of it goes once the rows are old, the month is over and
    no block holds. ``versions`` gives the rules by their time, read anew by each task.
    """

    def __init__(self, schema: T.StructType, step: Callable[[], CardStep], outer: Sequence[str], order: str, block_ttl_ms: int | None, idle_ms: int | None,
                 versions: Callable[[], Sequence[Rule]] | None = None):
        output = T.StructType.fromDDL(f"transaction_id string, ts_ms long, {OUTCOME}")
        super().__init__(schema, output, order, ["ts_ms", "command_first", "seq", "transaction_id"], idle_ms, "command_first")
        self.step, self.block_ttl_ms, self.versions, self.rules = step, block_ttl_ms, versions, None
        self.inputs = [self.at[c] for c in (*STEP_INPUTS, *outer)]

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.recorded = handle.getListState("recorded", ROWS, self.ttl)
        self.scalars = handle.getValueState("scalars", SCALARS, self.ttl)
        # Each task of each micro-batch reads the versions there are then.
        self.rules = self.versions() if self.versions else None

    def process(self, rows: list[tuple]) -> list[tuple]:
        step = self.step() if self.rules is None else self.step().with_rules(self.rules)
        old = list(self.recorded.get()) if self.recorded.exists() else []
        if self.scalars.exists():
            step.restore(tuple(self.scalars.get())[:-1], [tuple(r) for r in old])
        ts, tx, command = self.at["ts_ms"], self.at["transaction_id"], self.at["command"]
        out = []
        before = step.n_recorded
        for r in rows:
            if r[command] is not None:
                # One that comes late does not undo a later one.
                if all(t is None or t <= r[ts] for t in (step.manual_at, step.lifted_at)):
                    step.command(r[ts], r[command] == "block")
            else:
                out.append((r[tx], r[ts], *step(*[r[i] for i in self.inputs])))
        new = list(step.recorded)[-(step.n_recorded - before):] if step.n_recorded > before else []
        # Rows that left are dropped once they are the larger part.
        if 2 * len(step.recorded) < len(old) + len(new):
            self.recorded.put(list(step.recorded))
        elif new:
            self.recorded.appendList(new)
        self.scalars.update((*step.scalars, self._until(step, rows[-1][ts])))
        return out

    def _until(self, step: CardStep, now: int) -> int | None:
        """When nothing of the card matters any more; None while a block holds for ever."""
        blocks = [b for b in (step.blocked_at, step.manual_at) if b is not None]
        if blocks and self.block_ttl_ms is None:
            return None
        day = datetime.fromtimestamp(now / 1000, timezone.utc)
        month = datetime(day.year + day.month // 12, day.month % 12 + 1, 1, tzinfo=timezone.utc)
        return max([now + DAY, int(month.timestamp() * 1000), *(b + (self.block_ttl_ms or 0) for b in blocks)])

    def keep_until(self) -> int | None:
        return self.scalars.get()[-1] if self.scalars.exists() else None

    def forget(self) -> None:
        self.recorded.clear()
        self.scalars.clear()


class DelayProcessor(_Rows):
    """Hands rows on unchanged once the processing time has reached their ``due_ms``."""

    def __init__(self, schema: T.StructType):
        super().__init__(schema, schema, "delay", [], None)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        now, due = timerValues.getCurrentProcessingTimeInMs(), self.at["due_ms"]
        fresh = self._tuples(rows)
        later = [r for r in fresh if r[due] > now]
        if later:
            self.waiting.appendList(later)
            for ms in {r[due] for r in later}:
                self.handle.registerTimer(ms)
        ready = [r for r in fresh if r[due] <= now]
        if ready:
            yield from self._out(ready)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        end, due = expiredTimerInfo.getExpiryTimeInMs(), self.at["due_ms"]
        held = [tuple(r) for r in self.waiting.get()] if self.waiting.exists() else []
        later = [r for r in held if r[due] > end]
        self.waiting.clear()
        if later:
            self.waiting.put(later)
        ready = [r for r in held if r[due] <= end]
        if ready:
            yield from self._out(ready)
