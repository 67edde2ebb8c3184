"""Rate limits and rule cooldowns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txguard.operators.folds import anchored
from txguard.operators.running import running
from txguard.operators.skew import DEFAULT_SKEW, Skew
from txguard.plans.rules import Rule


def admit_calendar(df: DataFrame, client: str, ts: str, rate: int, window_ms: int = 1000, ties: Sequence[str] = (),
                   skew: Skew = DEFAULT_SKEW) -> DataFrame:
    """At most ``rate`` requests per client and calendar window, first come first served."""
    placed = df.withColumn("window_start", F.col(ts) - F.pmod(F.col(ts), F.lit(window_ms)))
    used = running(placed, [client, "window_start"], ts, {"used": ("sum", F.lit(1).cast("long"))}, ties, "rows", skew)
    return used.withColumn("allowed", F.col("used") <= rate)


def with_cooldown(fired: DataFrame, rules: Sequence[Rule], skew: Skew = DEFAULT_SKEW) -> DataFrame:
    """Suppress a rule for its cooldown after it fired on a card.

    ``fired`` has one row per fired rule (card_id, ts_ms, transaction_id, rule_id). Adds ``suppressed``. A cooldown is a
    window anchored at the firing that opened it, of a length that depends on the rule only.
    """
    minutes = F.coalesce(*[F.when(F.col("rule_id") == r.id, F.lit(r.cooldown_minutes)) for r in rules], F.lit(0))
    keys = ["card_id", "rule_id"]
    rows = fired.withColumn("__ttl_ms", minutes.cast("long") * 60_000)
    placed = anchored(rows, keys, "ts_ms", "__ttl_ms", "__open", ["transaction_id"], skew)
    numbered = running(placed, [*keys, "__open"], "ts_ms", {"__nth": ("sum", F.lit(1).cast("long"))}, ["transaction_id"],
                       "rows", skew)
    suppressed = (F.col("__nth") > 1) & (F.col("__ttl_ms") > 0)
    return numbered.select(*fired.columns, suppressed.alias("suppressed"))
