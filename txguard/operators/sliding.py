"""Sliding-window features per key on event time."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from txguard.operators.running import running
from txguard.operators.skew import COLD, DEFAULT_SKEW, HOT, SLICE, Hot, Skew, find_hot, flag_hot, settle

MINUTE = 60_000
HOUR = 60 * MINUTE
DAY = 24 * HOUR

@dataclass(frozen=True)
class Sliding:
    """One feature: ``kind`` is ``count``, ``sum`` or ``distinct``; the frame is [ts - width, ts].

    ``prior`` leaves out the current timestamp: the frame becomes [ts - width, ts - 1].
    """

    name: str
    kind: str
    width_ms: int
    value: str | None = None
    prior: bool = False


def sliding(df: DataFrame, keys: Sequence[str], ts: str, specs: Sequence[Sliding], skew: Skew = DEFAULT_SKEW) -> DataFrame:
    """Add the features of ``specs``; counts and distincts are BIGINT, sums DOUBLE.

    Ordinary keys use one Window node: one exchange and one sort for all frames. A value-bounded frame costs its length
    per row, which is quadratic for a dense key, so keys with more than ``skew.frame_rows`` rows take linear forms instead: counts and
    distincts :func:`_by_deltas`, sums :func:`_by_slices`. Which form a key takes depends on its own rows only. Both add the same
    amounts and take none back, so sums differ by the order of additions at most.
    """
    keys = list(keys)
    hot = find_hot(df, keys, replace(skew, min_bytes=0, hot_rows=skew.frame_rows))
    if hot.frame is None:
        return _by_frames(df, keys, ts, specs, hot.spread_nulls)
    flagged = settle(flag_hot(df, hot, ts))
    cold = _by_frames(flagged.where(~F.col(HOT)).drop(HOT), keys, ts, specs, hot.spread_nulls)
    dense = flagged.where(F.col(HOT)).drop(HOT)
    sums = [s for s in specs if s.kind == "sum"]
    others = [s for s in specs if s.kind != "sum"]
    # The sums are looked up by key and time, so they do not care what the counts did to the rows.
    full = _by_deltas(dense, keys, ts, others, skew, hot) if others else dense
    if sums:
        full = full.join(_by_slices(dense, keys, ts, sums, skew), [*keys, ts], "left").withColumns(
            {s.name: F.coalesce(s.name, F.lit(0.0)) for s in sums})
    return cold.unionByName(full)


def _by_slices(df: DataFrame, keys: list[str], ts: str, specs: Sequence[Sliding], skew: Skew) -> DataFrame:
    """Sums of frames for each (keys, ts): the end of the frame's first slice, the whole slices between, the beginning of its last.

    Time is cut into slices no longer than any frame. Windows run within one slice, or over one row per slice, so a key spreads over as
    many tasks as it has slices. Only additions: infinities, NaN and amounts of any size behave as in a plain frame.
    """
    width = min(skew.slice_ms, *[s.width_ms for s in specs])
    slice_of = lambda c: F.floor(c / F.lit(width)).cast("long")
    t = F.col(ts)
    values = list(dict.fromkeys(s.value for s in specs))
    points = df.groupBy(*keys, ts).agg(*[F.sum(F.col(v).cast("double")).alias(f"__v_{v}") for v in values]).withColumn(SLICE, slice_of(t))
    inside = Window.partitionBy(*keys, SLICE).orderBy(ts)
    own = {}
    for s in specs:
        end = -1 if s.prior else Window.currentRow
        own[f"__p_{s.name}"] = F.sum(f"__v_{s.value}").over(inside.rowsBetween(Window.unboundedPreceding, end))
    prefixes = points.withColumns(own)

    totals = points.groupBy(*keys, SLICE).agg(*[F.sum(f"__v_{v}").alias(f"__z_{v}") for v in values])
    between = {}
    for s in specs:
        for steps in {s.width_ms // width, -(-s.width_ms // width)}:
            frame = Window.partitionBy(*keys).orderBy(SLICE).rangeBetween(1 - steps, -1)
            between[f"__b_{s.name}_{steps}"] = F.sum(f"__z_{s.value}").over(frame) if steps > 1 else F.lit(None).cast("double")
    middles = totals.select(*keys, SLICE, *[c.alias(n) for n, c in between.items()])

    # The start of each row's frame asks for what follows it in its slice; rows at that very time are inside.
    asks = points.select(*keys, t.alias("__t"), F.posexplode(F.array(*[t - s.width_ms for s in specs])).alias("__spec", "__at")).withColumn(
        SLICE, slice_of(F.col("__at")))
    known = points.withColumnRenamed(ts, "__at").unionByName(asks, allowMissingColumns=True)
    after = Window.partitionBy(*keys, SLICE).orderBy(F.desc("__at"), F.col("__spec").isNotNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    answered = known.withColumns({f"__s_{v}": F.sum(f"__v_{v}").over(after) for v in values}).where("__spec is not null")
    starts = answered.groupBy(*keys, F.col("__t").alias(ts)).agg(*[
        F.max(F.when(F.col("__spec") == i, F.col(f"__s_{s.value}"))).alias(f"__f_{s.name}") for i, s in enumerate(specs)])

    out = prefixes.join(middles, [*keys, SLICE]).join(starts, [*keys, ts])
    sums = []
    for s in specs:
        steps = F.col(SLICE) - slice_of(t - s.width_ms)
        low, high = s.width_ms // width, -(-s.width_ms // width)
        middle = F.when(steps == low, F.col(f"__b_{s.name}_{low}")).otherwise(F.col(f"__b_{s.name}_{high}"))
        parts = [F.col(f"__f_{s.name}"), middle, F.col(f"__p_{s.name}")]
        total = F.coalesce(parts[0], F.lit(0.0)) + F.coalesce(parts[1], F.lit(0.0)) + F.coalesce(parts[2], F.lit(0.0))
        sums.append(total.alias(s.name))
    return out.select(*keys, ts, *sums)


def _by_frames(df: DataFrame, keys: list[str], ts: str, specs: Sequence[Sliding], spread_nulls: bool = False) -> DataFrame:
    missing = " or ".join(f"`{k}` is null" for k in keys)
    parts = ", ".join(f"`{k}`" for k in keys)
    if spread_nulls:
        parts += f", case when {missing} then pmod(xxhash64(`{ts}`), 4096) end"

    def value_of(s: Sliding) -> str:
        end = "1 preceding" if s.prior else "current row"
        w = f"over (partition by {parts} order by `{ts}` range between {s.width_ms} preceding and {end})"
        if s.kind == "sum":
            return f"if({missing}, 0D, coalesce(sum(`{s.value}`) {w}, 0D)) as `{s.name}`"
        counted = f"count(1) {w}" if s.kind == "count" else f"cast(size(collect_set(`{s.value}`) {w}) as bigint)"
        return f"if({missing}, 0L, {counted}) as `{s.name}`"

    kept = [f"`{c}`" for c in df.columns if c not in {s.name for s in specs}]
    return df.selectExpr(*kept, *[value_of(s) for s in specs])


def _by_deltas(
    df: DataFrame, keys: list[str], ts: str, specs: Sequence[Sliding], skew: Skew, hot: Hot = COLD
) -> DataFrame:
    """Counts and distincts: every row adds its share when it enters a frame and takes it back when it leaves.

    The features are running sums of these changes, so the work is linear in the rows and the running sums split over
    time slices. A distinct value is covered during [ts, ts + width] of each of its rows; a row that comes while its
    value is still covered starts where the earlier cover ends, so each value counts once.
    """
    t = F.col(ts)
    needed = dict.fromkeys([*keys, ts, *[s.value for s in specs if s.value]])
    base = df.select(*needed, F.struct(*df.columns).alias("__row"))
    prevs: dict[str, str] = {}
    for s in specs:
        if s.kind == "distinct" and s.value not in prevs:
            prevs[s.value] = f"__prev_{s.value}"
            base = running(base, [*keys, s.value], ts, {prevs[s.value]: ("max", t)}, (), "before", skew, hot)

    changes: list[tuple[Column, dict[str, Column]]] = []
    for s in specs:
        enter = t + 1 if s.prior else t
        leave = t + s.width_ms + 1
        if s.kind == "distinct":
            prev = F.col(prevs[s.value])
            covered = prev.isNotNull() & (t - prev <= s.width_ms)
            present = F.col(s.value).isNotNull()
            enter = F.when(covered, prev + s.width_ms + 1).otherwise(enter)
            share = F.when(present, F.lit(1).cast("long"))
        else:
            share = F.lit(1).cast("long")
        changes.append((enter, {s.name: share}))
        changes.append((leave, {s.name: -share}))

    def entry(at: Column, deltas: dict[str, Column], row: Column) -> Column:
        cols = [at.alias("t"), row.alias("row")]
        for s in specs:
            cols.append(deltas.get(s.name, F.lit(None)).cast("long").alias(s.name))
        return F.struct(*cols)

    row_type = base.schema["__row"].dataType
    none = F.lit(None).cast(row_type)
    # Changes falling on the same instant for every row share one entry.
    merged: dict[str, tuple[Column, dict[str, Column]]] = {}
    for at, delta in changes:
        slot = merged.setdefault(str(at), (at, {}))
        slot[1].update({n: (slot[1][n] + c if n in slot[1] else c) for n, c in delta.items()})
    own = merged.pop(str(t), (t, {}))
    entries = [entry(t, own[1], F.col("__row"))] + [entry(at, d, none) for at, d in merged.values()]
    deltas = base.select(*keys, F.explode(F.array(*entries)).alias("e")).select(
        *keys, F.col("e.t").alias("__t"), F.col("e.row").alias("__row"), *[F.col(f"e.{s.name}").alias(s.name) for s in specs]
    )
    summed = running(
        deltas, keys, "__t", {f"__s_{s.name}": ("sum", F.col(s.name)) for s in specs}, (), "range", skew, hot
    ).where(F.col("__row").isNotNull())
    out = [F.coalesce(F.col(f"__s_{s.name}"), F.lit(0).cast("long")).alias(s.name) for s in specs]
    return summed.select(*[F.col(f"__row.{c}").alias(c) for c in df.columns], *out)
