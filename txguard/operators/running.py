"""Running aggregates, previous values, gap sessions and as-of reads per key."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from txguard.operators.skew import DEFAULT_SKEW, HOT, SLICE, Hot, Skew, find_hot, null_spread, sliced

_AGG = {"sum": F.sum, "min": F.min, "max": F.max}


def _combine(kind: str, within: Column, carry: Column) -> Column:
    if kind == "sum":
        return F.when(within.isNull(), carry).when(carry.isNull(), within).otherwise(within + carry)
    return F.least(within, carry) if kind == "min" else F.greatest(within, carry)


def running(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    aggs: Mapping[str, tuple[str, Column]],
    ties: Sequence[str] = (),
    frame: str = "rows",
    skew: Skew = DEFAULT_SKEW,
    hot: Hot | None = None,
) -> DataFrame:
    """Add running aggregates over all earlier rows of the key.

    ``hot`` is found unless given, and may name a subset of ``keys``: then everything below a hot key is sliced.
    ``aggs`` maps an output name to (``sum`` | ``min`` | ``max``, column). ``frame`` is ``rows`` (up to and including
    this row in (ts, ties) order), ``before`` (strictly before it in that order) or ``range`` (including all rows with
    an equal ``ts``). A hot key is computed slice by slice; the totals of its slices, at most one row per slice, give
    each slice what came before it.
    """
    keys = list(keys)
    hot = hot if hot is not None else find_hot(df, keys, skew)
    if hot.frame is None:
        w = _over([*keys, null_spread(keys, ts)] if hot.spread_nulls else keys, ts, ties, frame)
        return df.withColumns({n: _AGG[k](c).over(w) for n, (k, c) in aggs.items()})
    rows = sliced(df, keys, ts, skew, hot)
    out = _running_sliced(rows, _dealt(rows, keys), keys, ts, aggs, ties, frame)
    return out.select(*[c for c in df.columns if c not in aggs], *aggs)


def _over(parts: Sequence[str | Column], ts: str, ties: Sequence[str], frame: str) -> WindowSpec:
    if frame == "range":
        return Window.partitionBy(*parts).orderBy(ts).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return Window.partitionBy(*parts).orderBy(ts, *ties).rowsBetween(Window.unboundedPreceding, -1 if frame == "before" else Window.currentRow)


def _dealt(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The rows by key and slice in as many partitions as the session sets: AQE merges partitions by their compressed bytes, and rows of slices
    compress so well that tens of millions of them would be sorted by a few tasks."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys, SLICE)


def _running_sliced(
    rows: DataFrame, dealt: DataFrame, keys: list[str], ts: str, aggs: Mapping[str, tuple[str, Column]], ties: Sequence[str], frame: str
) -> DataFrame:
    """:func:`running` over rows that have their slices already, and ``dealt`` by them; they keep both, so that a second pass over the same keys
    needs no other exchange."""
    before = Window.partitionBy(*keys).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    carry = (
        rows.where(F.col(HOT))
        .groupBy(*keys, SLICE)
        .agg(*[_AGG[k](c).alias(f"__t_{n}") for n, (k, c) in aggs.items()])
        .select(*keys, SLICE, *[_AGG[k](f"__t_{n}").over(before).alias(f"__c_{n}") for n, (k, _) in aggs.items()])
    )
    w = _over([*keys, SLICE], ts, ties, frame)
    joined = dealt.withColumns({f"__w_{n}": _AGG[k](c).over(w) for n, (k, c) in aggs.items()}).join(
        carry, [*keys, SLICE], "left"
    )
    return joined.select(
        *[c for c in rows.columns if c not in aggs],
        *[_combine(k, F.col(f"__w_{n}"), F.col(f"__c_{n}")).alias(n) for n, (k, _) in aggs.items()],
    )


def gap_runs(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    gap_ms: int | Column,
    ties: Sequence[str] = (),
    start: str = "run_start",
    position: str = "run_position",
    skew: Skew = DEFAULT_SKEW,
    hot: Hot | None = None,
) -> DataFrame:
    """Split each key's rows where the idle time reaches ``gap_ms``.

    Adds ``start`` (the first ``ts`` of the run) and ``position`` (1, 2, ... inside it).
    """
    keys = list(keys)
    hot = hot if hot is not None else find_hot(df, keys, skew)
    before = {"__prev": ("max", F.col(ts)), "__seen": ("sum", F.lit(1).cast("long"))}
    if hot.frame is None:
        prev = running(df, keys, ts, before, ties, "before", skew, hot)
    else:
        rows = sliced(df, keys, ts, skew, hot)
        prev = _running_sliced(rows, _dealt(rows, keys), keys, ts, before, ties, "before")
    fresh = F.col("__prev").isNull() | (F.col(ts) - F.col("__prev") >= gap_ms)
    seen = F.coalesce(F.col("__seen"), F.lit(0).cast("long"))
    marks = {start: ("max", F.when(fresh, F.col(ts))), "__base": ("max", F.when(fresh, F.col("__seen")))}
    seen_rows = prev.withColumn("__seen", seen)
    marked = running(seen_rows, keys, ts, marks, ties, "rows", skew, hot) if hot.frame is None else _running_sliced(
        seen_rows, seen_rows, keys, ts, marks, ties, "rows").drop(HOT, SLICE)
    return marked.withColumn(position, F.col("__seen") - F.col("__base") + 1).drop("__prev", "__seen", "__base")


def distinct_in_run(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    value: str,
    gap_ms: int,
    out: str,
    ties: Sequence[str] = (),
    skew: Skew = DEFAULT_SKEW,
) -> DataFrame:
    """Distinct values seen so far in the current run, where a run ends after ``gap_ms`` without a value.

    A value counts at its first occurrence in the run, so the answer is a running sum of first-occurrence flags and no
    set is kept. Rows whose value is null read the run without adding to it or keeping it alive.
    """
    keys = list(keys)
    hot = find_hot(df, keys, skew)
    t, holds = F.col(ts), F.col(value).isNotNull()
    prev = running(df, keys, ts, {"__prev": ("max", F.when(holds, t))}, ties, "before", skew, hot)
    idle = F.col("__prev").isNull() | (t - F.col("__prev") >= gap_ms)
    runs = running(prev, keys, ts, {"__run": ("max", F.when(holds & idle, t))}, ties, "rows", skew, hot)
    earlier = running(runs, [*keys, "__run", value], ts, {"__before": ("max", t)}, ties, "before", skew, hot)
    new = F.when(holds & F.col("__before").isNull(), F.lit(1)).otherwise(F.lit(0)).cast("long")
    counted = running(earlier, [*keys, "__run"], ts, {"__n": ("sum", new)}, ties, "rows", skew, hot)
    alive = holds | ~idle
    return counted.withColumn(out, F.when(alive, F.col("__n")).otherwise(F.lit(0).cast("long"))).select(*df.columns, out)


def as_of(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    ts: str,
    values: Sequence[str],
    right_ts: str | None = None,
    inclusive: bool = True,
    matched_ts: str | None = None,
    skew: Skew = DEFAULT_SKEW,
) -> DataFrame:
    """For every left row the ``values`` of the latest right row of the key at or before its ``ts``.

    Union of both sides and a running max of (ts, values): one exchange, no join and no pair of rows per match.
    ``inclusive=False`` reads strictly before. Left rows without a match keep nulls. If several right rows share the
    latest ``ts``, the one with the greatest values wins. ``matched_ts`` names a column for the time of the match.
    """
    keys = list(keys)
    right_ts = right_ts or ts
    payload = [c for c in left.columns if c not in keys and c != ts]
    rank = 0 if inclusive else 1
    seen = F.struct(F.col(right_ts).alias("t"), *[F.col(v) for v in values])
    lhs = left.select(
        *keys, F.col(ts).alias("__ts"), F.lit(1 - rank).alias("__side"),
        F.struct(*[F.col(c) for c in payload]).alias("__row"),
        F.lit(True).alias("__left"),
    )
    rhs = right.where(F.col(right_ts).isNotNull()).select(
        *keys, F.col(right_ts).alias("__ts"), F.lit(rank).alias("__side"),
        F.lit(False).alias("__left"), seen.alias("__seen"),
    )
    both = lhs.unionByName(rhs, allowMissingColumns=True)
    read = running(both, keys, "__ts", {"__hit": ("max", F.col("__seen"))}, ["__side"], "rows", skew).where("__left")
    return read.select(
        *keys, F.col("__ts").alias(ts), *[F.col(f"__row.{c}").alias(c) for c in payload],
        *[F.col(f"__hit.{v}").alias(v) for v in values],
        *([F.col("__hit.t").alias(matched_ts)] if matched_ts else []),
    )
