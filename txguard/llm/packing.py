"""Packing token sequences by dominance reduction and best fit.

The plan needs only how many pieces there are of each length, at most ``capacity`` numbers whatever the corpus, so it is exact and global:
sets of pieces that dominate every other way of packing their largest piece are fixed for good (the criterion of Martello and Toth), the
rest is packed longest first into the fullest sequence that still takes the piece. Equal sequences are kept as one pattern with a
count. Pieces then find their place by rank within their length, counted in (length, bucket) groups, so no length meets in one task.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from txguard.llm.common import stored
from txguard.llm.tokens import encoder

CAPACITY = 2048
BUCKETS = 1024
PIECES = "row long, doc_id long, piece int, start long, length long, ids binary"
_PIECES = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()),
                     ("ids", pa.binary())])
Pattern = tuple[int, ...]


def cut_points(n: int, capacity: int = CAPACITY) -> list[int]:
    """Starts of the pieces of ``n`` ids: full pieces, only the first may be shorter."""
    first = n % capacity or capacity
    return [0, *range(first, n, capacity)]


def pieces(docs: DataFrame, vocabulary: str, end_id: int, capacity: int = CAPACITY) -> DataFrame:
    """Token pieces of ``docs`` (doc_id, text), stored in the shared folder: row (a unique number), doc_id, piece, start, length, ids.

    ids are unsigned 32-bit, little-endian. Null text counts as empty, so every row gives one piece at least. Repeated rows stay.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(vocabulary), struct.pack("<I", end_id)
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            out: list[tuple] = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                ids = encode(text) + end
                starts = cut_points(len(ids) // 4, capacity)
                for i, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids) // 4])):
                    out.append((row, doc_id, i, a, b - a, ids[4 * a : 4 * b]))
                    row += 1
                if len(out) > 2000:
                    yield _batch(out)
                    out = []
            if out:
                yield _batch(out)

    return stored(docs.select("doc_id", "text").mapInArrow(cut, PIECES), "token-pieces")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _PIECES.types)], schema=_PIECES)


def reduce_by_dominance(counts: np.ndarray, capacity: int) -> list[tuple[Pattern, int]]:
    """Fix sets that dominate all others holding the same piece; ``counts`` (by length) keeps the rest.

    For a piece j, longest first: alone if nothing fits beside it; with a partner that fills the sequence exactly; with the longest
    partner that fits if no two further pieces fit beside j. Each is fixed for as many sequences as the counts allow.
    """
    fixed: list[tuple[Pattern, int]] = []
    for j in range(capacity, 0, -1):
        room = capacity - j
        while counts[j]:
            counts[j] -= 1
            others = np.flatnonzero(counts)
            first = int(others[0]) if len(others) else room + 1
            if first > room:
                n = int(counts[j]) + 1
                counts[j] = 0
                fixed.append(((j,), n))
                break
            second = first if counts[first] > 1 else int(others[1]) if len(others) > 1 else capacity
            partner = int(others[np.searchsorted(others, room, side="right") - 1])
            counts[j] += 1
            if partner < room and first + second <= room:
                break
            n = int(counts[j]) // 2 if partner == j else int(min(counts[j], counts[partner]))
            counts[j] -= n
            counts[partner] -= n
            fixed.append(((j, partner), n))
    return fixed


def best_fit(counts: np.ndarray, capacity: int) -> list[tuple[Pattern, int]]:
    """Longest piece first into the fullest open sequence that takes it; alike sequences move together."""
    open_: dict[int, list[tuple[Pattern, int]]] = {}
    free = np.zeros(capacity + 1, np.int64)
    done: list[tuple[Pattern, int]] = []

    def put(pattern: Pattern, n: int, room: int) -> None:
        if room:
            open_.setdefault(room, []).append((pattern, n))
            free[room] += n
        else:
            done.append((pattern, n))

    for length in range(capacity, 0, -1):
        left = int(counts[length])
        while left:
            fits = np.flatnonzero(free[length:])
            if len(fits):
                room = length + int(fits[0])
                pattern, n = open_[room].pop()
                used = min(left, n)
                free[room] -= n
                if n > used:
                    open_[room].append((pattern, n - used))
                    free[room] += n - used
                put((*pattern, length), used, room - length)
                left -= used
            else:
                # As many to a new sequence as fit, as best fit would put them one by one.
                each = capacity // length
                full, over = divmod(left, each)
                if full:
                    put((length,) * each, full, capacity - each * length)
                if over:
                    put((length,) * over, 1, capacity - over * length)
                left = 0
    return done + [x for group in open_.values() for x in group]


def plan(counts: np.ndarray, capacity: int = CAPACITY) -> list[tuple[Pattern, int]]:
    """Patterns (lengths in order) and how many sequences each has."""
    left = counts.copy()
    return reduce_by_dominance(left, capacity) + best_fit(left, capacity)


def _slots(patterns: list[tuple[Pattern, int]]) -> pd.DataFrame:
    """For each length, ranges of ranks and where they go."""
    rows, first_id = [], 0
    used: dict[int, int] = {}
    for pattern, n in patterns:
        offset = 0
        for length in pattern:
            at = used.get(length, 0)
            rows.append((length, at, at + n, first_id, offset))
            used[length] = at + n
            offset += length
        first_id += n
    return pd.DataFrame(rows, columns=["slot_length", "first", "last", "first_id", "offset"])


def place(found: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``found`` (row, length and other columns) with sequence_id and offset. ``row`` must be unique; stored tables only, as it is read twice.

    The histogram that reaches the driver has at most ``capacity`` rows. The ranges of ranks made from it go out as a broadcast: a few
    for each length and pattern, so their number follows the capacity and not the corpus (some thousand rows for 2048).
    """
    bucket = F.pmod(F.xxhash64("row"), F.lit(BUCKETS)).cast("int")
    keyed = found.withColumn("bucket", bucket)
    per_bucket = keyed.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    counts = np.zeros(capacity + 1, np.int64)
    for r in per_bucket.groupBy("length").agg(F.sum("n").alias("n")).collect():
        counts[r["length"]] = r["n"]
    slots = _slots(plan(counts, capacity))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_bucket.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    own = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("row")) - 1
    ranked = keyed.withColumn("own", own).join(offsets, ["length", "bucket"]).withColumn("rank", F.col("own") + F.col("before"))
    table = {int(k): g.sort_values("first")[["first", "first_id", "offset"]].to_numpy(np.int64) for k, g in slots.groupby("slot_length")}
    shared = found.sparkSession.sparkContext.broadcast(table)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, ranks = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            ids, offsets = np.zeros(len(ranks), np.int64), np.zeros(len(ranks), np.int64)
            for length in np.unique(lengths):
                own, ranges = lengths == length, shared.value[int(length)]
                at = np.searchsorted(ranges[:, 0], ranks[own], side="right") - 1
                ids[own], offsets[own] = ranges[at, 1] + ranks[own] - ranges[at, 0], ranges[at, 2]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids), pa.array(offsets)], [*batch.schema.names, "sequence_id", "offset"])

    ranked = ranked.drop("bucket", "own", "before")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema) + ", sequence_id long, offset long"
    return ranked.mapInArrow(assign, schema).drop("rank")


def sequences(placed: DataFrame) -> DataFrame:
    """The packed sequences themselves: sequence_id, ids (u32, little-endian) in order of offset. ``placed`` must hold ids."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(parts, F.lit(b"").cast("binary"), lambda all_, p: F.concat(all_, p["ids"]))
    return placed.groupBy("sequence_id").agg(joined.alias("ids"))
