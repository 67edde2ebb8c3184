"""Ordered folds: one small step per row, in order, with constant state per key."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from txguard.operators.running import as_of, gap_runs, running
from txguard.operators.skew import DEFAULT_SKEW, HOT, Skew, all_present, find_hot, flag_hot
from txguard.session_dirs import ensure_checkpoint_dir


def ordered_fold(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    inputs: Sequence[str],
    fold: Callable[[], Callable[..., tuple]],
    outputs: str,
) -> DataFrame:
    """Run ``fold`` over each key's rows in ``order`` and append its results as columns.

    ``fold()`` makes the step for a new key; the step takes the ``inputs`` of one row and returns the ``outputs`` (a DDL
    string). Spark shuffles by key and sorts on disk; a task streams Arrow batches and keeps one step alive, so the
    memory does not depend on the size of a key. Columns that are not inputs never become Python objects.
    """
    keys, inputs = list(keys), list(inputs)
    added = T.StructType.fromDDL(outputs)
    schema = T.StructType(df.schema.fields + added.fields)
    types = [to_arrow_type(f.dataType) for f in added.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step, current = None, None
        for batch in batches:
            key_rows = zip(*[batch.column(k).to_pylist() for k in keys])
            rows = zip(*[batch.column(c).to_pylist() for c in inputs])
            results = []
            for key, row in zip(key_rows, rows):
                if step is None or key != current:
                    step, current = fold(), key
                results.append(step(*row))
            if not results:
                continue
            made = [pa.array(c, type=t) for c, t in zip(zip(*results), types)]
            names = batch.schema.names + added.names
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=names)

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def _window_starts() -> Callable[..., tuple]:
    start = None

    def step(ts: int, ttl: int) -> tuple:
        nonlocal start
        if start is None or ts - start >= ttl:
            start = ts
        return (start,)

    return step


def _chain_by_jumps(times: DataFrame, keys: list[str], skew: Skew) -> DataFrame:
    """Window starts of very long runs, without visiting a run's rows one after another.

    Every time points to the first time at least one TTL later. Starts are the times reachable from the first one;
    doubling the pointers finds them in log2(starts) rounds of joins on (keys, time), which are unique and balanced.
    """
    spark = times.sparkSession
    ensure_checkpoint_dir(spark)
    flipped = times.select(*keys, (-F.col("__t")).alias("__neg"), F.col("__t").alias("__nxt"))
    probes = times.select(*keys, F.col("__t"), (-(F.col("__t") + F.col("__ttl"))).alias("__neg"))
    jump = (
        as_of(probes, flipped, keys, "__neg", ["__nxt"], skew=skew)
        .where(F.col("__nxt").isNotNull())
        .select(*keys, "__t", "__nxt")
        .checkpoint()
    )
    reach = times.groupBy(*keys).agg(F.min("__t").alias("__t")).checkpoint()
    while not jump.isEmpty():
        landed = reach.join(jump, [*keys, "__t"]).select(*keys, F.col("__nxt").alias("__t"))
        reach = reach.unionByName(landed).checkpoint()
        hop = jump.select(*keys, F.col("__t").alias("__nxt"), F.col("__nxt").alias("__far"))
        jump = jump.join(hop, [*keys, "__nxt"]).select(*keys, "__t", F.col("__far").alias("__nxt")).checkpoint()
    return reach


def anchored(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    ttl_ms: int | str,
    out: str = "anchor",
    ties: Sequence[str] = (),
    skew: Skew = DEFAULT_SKEW,
) -> DataFrame:
    """Fixed-length windows anchored at the first row: a row at or past the window's end opens the next window.

    ``ttl_ms`` is a number or names a column that is constant per key. Adds ``out``, the start of the row's window. An idle
    gap of one TTL always opens a window, so rows are first cut into runs at such gaps; the first window of each run is
    known from the run alone. Only rows beyond the first window of a long run need to be folded, run by run. If some key
    is hot, its long runs are folded as distinct times, by pointer doubling where a run holds more than
    ``skew.hot_rows`` of them, and rows then read their start as of their time. Rows without a key get no window.
    """
    keys = list(keys)
    run = [*keys, "__run"]
    ttl = F.col(ttl_ms) if isinstance(ttl_ms, str) else F.lit(ttl_ms).cast("long")
    hot = find_hot(df, keys, skew)
    runs = gap_runs(df, keys, ts, ttl, ties, "__run", "__pos", skew, hot).drop("__pos").withColumns({
        # Rows without a key are a run of their own, so that the filters below name no key: a filter on the key would move
        # below the exchange on one side only, and both sides could no longer share it.
        "__run": F.when(all_present(keys), F.col("__run")).otherwise(F.col(ts)), "__ttl": ttl,
    })
    beyond = F.col(ts) - F.col("__run") >= F.col("__ttl")
    if hot.frame is None:
        near = runs.where(~beyond).withColumn(out, F.when(all_present(keys), F.col("__run")))
        far = ordered_fold(runs.where(beyond), run, [ts, *ties], [ts, "__ttl"], _window_starts, f"{out} long")
        return near.unionByName(far).drop("__run", "__ttl")
    later = runs.where(beyond).select(*run, F.col(ts).alias("__t"), "__ttl").distinct()
    oversized = find_hot(later, run, skew)
    chain = later
    if oversized.frame is not None:
        flagged = flag_hot(later, oversized, "__t")
        chain = flagged.where(~F.col(HOT)).drop(HOT)
    starts = ordered_fold(chain, run, ["__t"], ["__t", "__ttl"], _window_starts, "__start long")
    starts = starts.where(F.col("__start") == F.col("__t")).select(*run, "__t")
    if oversized.frame is not None:
        starts = starts.unionByName(_chain_by_jumps(flagged.where(F.col(HOT)).drop(HOT), run, skew))
    placed = as_of(runs, starts.withColumn("__start", F.col("__t")), run, ts, ["__start"], right_ts="__t", skew=skew)
    return placed.select(*df.columns, F.when(all_present(keys), F.coalesce("__start", "__run")).alias(out))


def admit_anchored(
    df: DataFrame,
    client: str,
    ts: str,
    rate: int,
    window_ms: int = 1000,
    weight: str | None = None,
    resets: DataFrame | None = None,
    ties: Sequence[str] = (),
    skew: Skew = DEFAULT_SKEW,
) -> DataFrame:
    """Fixed-window rate limit anchored at the first request; rejected requests still use up the window.

    Adds ``used`` (weight seen in the window so far) and ``allowed``. ``resets`` is a frame of (client, ts) commands: a
    reset empties the client's window, taking effect on requests from that time on.
    """
    keys = [client]
    rows = df
    if resets is not None:
        marks = resets.select(client, F.col(ts).alias("__at")).withColumn("__reset", F.col("__at"))
        rows = as_of(df, marks, keys, ts, ["__reset"], right_ts="__at", skew=skew)
        rows = rows.withColumn("__reset", F.coalesce("__reset", F.lit(-(2**62))))
        keys = [client, "__reset"]
    placed = anchored(rows, keys, ts, window_ms, "window_start", ties, skew)
    cost = F.col(weight).cast("long") if weight else F.lit(1).cast("long")
    used = running(placed, [*keys, "window_start"], ts, {"used": ("sum", cost)}, ties, "rows", skew)
    return used.withColumn("allowed", F.col("used") <= rate).select(*df.columns, "window_start", "used", "allowed")


def token_bucket(
    df: DataFrame,
    client: str,
    ts: str,
    rate: float,
    burst: int,
    ties: Sequence[str] = (),
    skew: Skew = DEFAULT_SKEW,
) -> DataFrame:
    """Token bucket: ``rate`` tokens per second up to ``burst``; a request takes one token or is rejected.

    After ``burst / rate`` idle seconds the bucket is full again whatever happened before, so each client is cut into
    independent runs there, and runs are folded in parallel.
    """
    refill_ms = -int(-(burst * 1000) // rate)
    runs = gap_runs(df, [client], ts, refill_ms, ties, "__run", "__pos", skew).drop("__pos")

    def fold() -> Callable[..., tuple]:
        tokens, last = float(burst), None

        def step(now: int) -> tuple:
            nonlocal tokens, last
            if last is not None:
                tokens = min(float(burst), tokens + (now - last) / 1000.0 * rate)
            last = now
            allowed = tokens >= 1.0
            if allowed:
                tokens -= 1.0
            return (allowed, tokens)

        return step

    out = ordered_fold(runs, [client, "__run"], [ts, *ties], [ts], fold, "allowed boolean, tokens double")
    return out.drop("__run")
