"""Finding keys that are too big for one task.

A window partitioned by a key puts all rows of that key into one task. The operators of this package therefore spread
a hot key over time slices and carry the state at the start of each slice in a small side table. Large inputs are first
counted by key, with partial aggregation, to see whether any key is hot at all; where none is, which is the usual case,
the operators plan a single window.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txguard.session_dirs import ensure_checkpoint_dir, written

HOT = "__hot"
SLICE = "__slice"
_DEAL = "__deal"


@dataclass(frozen=True)
class Skew:
    """When to slice a key, and how finely.

    ``hot_rows``: keys with more rows are sliced. ``frame_rows``: the same for value-bounded frames, where a dense key costs the
    square of its rows. ``slice_ms``: width of one slice on the time axis. ``min_bytes``: running aggregates over inputs estimated below
    this are one task's work as a whole, so no key in them is looked for; they give the same result sliced or not, as they add integers
    or pick one of the values. The estimate is of compressed columns; rows in a task's memory may take fifty times as much. Value-bounded frames count their keys whatever the size.
    """

    hot_rows: int = 20_000
    slice_ms: int = 60_000
    min_bytes: int = 4 * 1024 * 1024
    frame_rows: int = 2_000


DEFAULT_SKEW = Skew()


# A plan reading its sources more often than this is written out before another pass doubles it.
MAX_LEAVES = 12
# Up to this many hot keys are held as a local table.
MAX_HOT = 10_000


def _leaves(df: DataFrame) -> list:
    seq = df._jdf.queryExecution().analyzed().collectLeaves()
    return [seq.apply(i) for i in range(seq.size())]


def input_bytes(df: DataFrame) -> int:
    """Catalyst's size of everything a frame reads."""
    return sum(int(str(leaf.stats().sizeInBytes())) for leaf in _leaves(df))


def settle(df: DataFrame) -> DataFrame:
    """Cut the lineage of a frame whose plan has grown: a reliable checkpoint, written once and read by every later pass."""
    return df if len(_leaves(df)) <= MAX_LEAVES else checkpointed(df)


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows of ``df`` written once to the shared checkpoint folder, for plans that read them more than once."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


@dataclass(frozen=True)
class Hot:
    """Keys to slice: their frame with the ``__hot`` column, or None; and whether rows without a key are too many.

    Where ``frame`` is too long for a local table, ``crowded`` is the local table of those keys whose rows must not meet in one task.
    """

    frame: DataFrame | None = None
    spread_nulls: bool = False
    crowded: DataFrame | None = None


COLD = Hot()


def find_hot(df: DataFrame, keys: Sequence[str], skew: Skew) -> Hot:
    """Keys holding more than ``skew.hot_rows`` rows.

    Runs one aggregation over the key columns, unless the whole input is small. Up to ``MAX_HOT`` keys come back as a
    local table, small enough to broadcast. More of them are written once and joined by shuffle, and those with more than a ``MAX_HOT``-th
    of all their rows, which are fewer than ``MAX_HOT``, come as a local table beside it.
    """
    keys = list(keys)
    if skew.min_bytes and input_bytes(df) < skew.min_bytes:
        return COLD
    big = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > skew.hot_rows)
    found = big.select(*keys).limit(MAX_HOT + 1).toArrow()
    spark = df.sparkSession
    if found.num_rows > MAX_HOT:
        # The column is read from the table: a literal would be taken out of the join's keys.
        many = written(big.where(all_present(keys)).withColumn(_DEAL, F.lit(0).cast("long")), "hot-keys")
        rows = many.agg(F.sum("__n")).first()[0] or 0
        crowded = many.where(F.col("__n") * MAX_HOT > rows).select(*keys).toArrow()
        return Hot(many.select(*keys, _DEAL, F.lit(True).alias(HOT)), True, spark.createDataFrame(crowded).withColumn(HOT, F.lit(True)))
    whole = found.drop_null()
    frame = spark.createDataFrame(whole).withColumn(HOT, F.lit(True)) if whole.num_rows else None
    return Hot(frame, whole.num_rows < found.num_rows)


def all_present(keys: Sequence[str]) -> Column:
    """True where no key column is null."""
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).isNotNull()
    return cond


def flag_hot(df: DataFrame, hot: Hot, ts: str) -> DataFrame:
    """Add the boolean ``__hot`` column. No key's rows meet in one task: local tables are broadcast, and the join by shuffle deals rows of crowded
    keys, which are flagged by then, and rows without a key out by ``ts``."""
    keys = [c for c in hot.frame.columns if c != HOT]
    if hot.crowded is None:
        return df.join(F.broadcast(hot.frame), keys, "left").withColumn(HOT, F.coalesce(F.col(HOT), F.lit(False)))
    keys.remove(_DEAL)
    settled = F.col(HOT).isNotNull() | ~all_present(keys)
    dealt = df.join(F.broadcast(hot.crowded), keys, "left").withColumn(_DEAL, F.when(settled, F.xxhash64(ts)).otherwise(F.lit(0).cast("long")))
    both = dealt.join(hot.frame.withColumnRenamed(HOT, "__many"), [*keys, _DEAL], "left")
    return both.select(*[F.col(c) for c in df.columns], F.coalesce(HOT, "__many", F.lit(False)).alias(HOT))


def slice_of(ts: Column, skew: Skew) -> Column:
    return F.floor(ts / F.lit(skew.slice_ms)).cast("long")


def null_spread(keys: Sequence[str], ts: str) -> Column:
    """A partition column that scatters rows without a key; their results are meaningless to begin with."""
    return F.when(~all_present(keys), F.pmod(F.xxhash64(ts), F.lit(4096)))


def with_slice(df: DataFrame, keys: Sequence[str], ts: str, skew: Skew) -> DataFrame:
    """Add ``__slice``: the time slice for hot keys, 0 for the others, a hash spread for rows without a key. Rows without a time come first."""
    first = F.lit(-(2**63)).cast("long")
    return df.withColumn(
        SLICE,
        F.coalesce(null_spread(keys, ts), F.when(F.col(HOT), F.coalesce(slice_of(F.col(ts), skew), first)), F.lit(0).cast("long")),
    )


def sliced(df: DataFrame, keys: Sequence[str], ts: str, skew: Skew, hot: Hot) -> DataFrame:
    """The rows with ``__hot`` and ``__slice``."""
    return with_slice(flag_hot(settle(df), hot, ts), keys, ts, skew)
