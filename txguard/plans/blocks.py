"""Card blocks: the command log, membership at a time, and blocks that follow from decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txguard.operators.folds import anchored
from txguard.operators.running import as_of, running
from txguard.operators.skew import DEFAULT_SKEW, Skew

DAY_MS = 24 * 3_600_000


def current_blocks(log: DataFrame, now_ms: int, ttl_ms: int | None = DAY_MS) -> DataFrame:
    """Cards blocked at ``now_ms``: the latest command is a block that has not expired.

    ``log`` has card_id, ts_ms, seq, command (``block`` | ``unblock``) and reason.
    """
    last = log.where(F.col("ts_ms") <= now_ms).groupBy("card_id").agg(
        F.max_by(F.struct("command", "reason", "ts_ms"), F.struct("ts_ms", "seq")).alias("last")
    )
    live = F.col("last.command") == "block"
    if ttl_ms is not None:
        live = live & (F.lit(now_ms) < F.col("last.ts_ms") + ttl_ms)
    return last.where(live).select("card_id", F.col("last.ts_ms").alias("blocked_at"), F.col("last.reason").alias("reason"))


def blocked_at(
    df: DataFrame, log: DataFrame, ttl_ms: int | None = DAY_MS, out: str = "blocked", skew: Skew = DEFAULT_SKEW
) -> DataFrame:
    """Whether the card is blocked when each row arrives; commands of the same time come first.

    An as-of read of the log, so the cost does not grow with the number of commands a row lies after.
    """
    commands = log.select("card_id", F.col("ts_ms").alias("__at"), F.col("seq").alias("__seq"),
                          (F.col("command") == "block").alias("__block"))
    read = as_of(df, commands, ["card_id"], "ts_ms", ["__seq", "__block"], right_ts="__at", matched_ts="__when", skew=skew)
    live = F.coalesce(F.col("__block"), F.lit(False))
    if ttl_ms is not None:
        live = live & (F.col("ts_ms") < F.col("__when") + ttl_ms)
    return read.withColumn(out, F.coalesce(live, F.lit(False))).select(*df.columns, out)


def split_by_list(df: DataFrame, blocklist: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Rows whose key is on the list, and the others."""
    listed = blocklist.select(key).distinct()
    return df.join(listed, key, "left_semi"), df.join(listed, key, "left_anti")


def block_feedback(
    df: DataFrame, blocks: Column, ttl_ms: int | None = None, skew: Skew = DEFAULT_SKEW
) -> DataFrame:
    """Given per-row decisions, which rows arrive while their card is blocked by an earlier one.

    ``blocks`` marks rows that block their card. Adds ``blocked_by_ms``, the time of the block in force, or null. Without
    a TTL the first block lasts for ever. With one, a block row inside a running block is itself refused, so blocks are
    windows anchored at their first row. Features are taken as given; the exact interplay, where refused rows also leave
    no trace in the features, is :func:`txguard.plans.banking.decide_in_order`.
    """
    ties = ["transaction_id"]
    if ttl_ms is None:
        mark = F.when(blocks, F.col("ts_ms"))
        return running(df, ["card_id"], "ts_ms", {"blocked_by_ms": ("min", mark)}, ties, "before", skew)
    firing = df.where(blocks).select("card_id", "ts_ms", "transaction_id")
    starts = anchored(firing, ["card_id"], "ts_ms", ttl_ms, "__start", ties, skew)
    # Only the first row at the start time places the block.
    starts = starts.where(F.col("ts_ms") == F.col("__start")).groupBy("card_id", "__start").agg(
        F.min("transaction_id").alias("__by")
    )
    read = as_of(df, starts.withColumn("__at", F.col("__start")), ["card_id"], "ts_ms", ["__start", "__by"], "__at", skew=skew)
    before = as_of(read, starts.withColumn("__at", F.col("__start")).select("card_id", "__at", F.col("__start").alias("__old")),
                   ["card_id"], "ts_ms", ["__old"], "__at", inclusive=False, skew=skew)
    own = (F.col("__start") == F.col("ts_ms")) & (F.col("transaction_id") <= F.col("__by"))
    start = F.when(own, F.col("__old")).otherwise(F.col("__start"))
    live = start.isNotNull() & (F.col("ts_ms") < start + ttl_ms)
    return before.withColumn("blocked_by_ms", F.when(live, start)).select(*df.columns, "blocked_by_ms")
