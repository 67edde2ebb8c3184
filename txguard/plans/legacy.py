"""The older detector: fixed rules, best confidence wins."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txguard.operators.running import gap_runs, running
from txguard.operators.skew import DEFAULT_SKEW, Skew
from txguard.operators.sliding import HOUR, MINUTE, Sliding, sliding

# Merchant categories of high risk (gambling, crypto), and the auto-block confidence.
HIGH_RISK_MCC = ("7995", "6051")
AUTO_BLOCK_CONFIDENCE = 0.9


@dataclass(frozen=True)
class Verdict:
    """One detector rule: a match column, and what it says when it matches."""

    name: str
    match: Column
    confidence: float
    action: str
    reason: Column


def velocity(df: DataFrame, skew: Skew = DEFAULT_SKEW) -> DataFrame:
    """Transactions since the card was last idle for a minute."""
    return gap_runs(df, ["card_id"], "ts_ms", MINUTE, ["transaction_id"], "__run", "velocity_count", skew).drop("__run")


def previous_location(df: DataFrame, ttl_ms: int = HOUR, skew: Skew = DEFAULT_SKEW) -> DataFrame:
    """The card's location at its previous transaction, if that was less than ``ttl_ms`` ago."""
    order = df.withColumn("__at", F.struct("ts_ms", "transaction_id"))
    out = running(order, ["card_id"], "ts_ms", {"__last": ("max", F.struct("__at", "location"))}, ["transaction_id"], "before", skew)
    alive = F.col("ts_ms") - F.col("__last.__at.ts_ms") < ttl_ms
    return out.withColumn("previous_location", F.when(alive, F.col("__last.location"))).drop("__at", "__last")


def listed_ips(df: DataFrame, blacklist: DataFrame) -> DataFrame:
    """Mark rows whose address is on the list."""
    marks = blacklist.select("ip").distinct().withColumn("__bad", F.lit(True))
    return df.join(marks, "ip", "left").withColumn("ip_listed", F.coalesce("__bad", F.lit(False))).drop("__bad")


def default_verdicts(device_limit: int | None = None) -> list[Verdict]:
    """The seven rules, in the order that breaks ties.

    The multi-device rule is a placeholder that never matches unless ``device_limit`` is given; then the frame needs
    ``device_count`` from :func:`device_spread`.
    """
    amount_over = F.col("amount") > 100_000
    hour = F.hour("ts")
    devices = F.lit(False) if device_limit is None else F.col("device_count") > device_limit
    return [
        Verdict("velocity_check", F.col("velocity_count") > 5, 0.85, "block",
                F.concat(F.col("velocity_count").cast("string"), F.lit(" transactions in 1 minute"))),
        Verdict("location_anomaly", F.coalesce(F.col("previous_location") != F.col("location"), F.lit(False)), 0.75, "review",
                F.lit("Location changed too quickly")),
        Verdict("amount_anomaly", amount_over, 0.60, "review", F.lit("Unusually high amount")),
        Verdict("multi_device", devices, 0.70, "review", F.lit("Too many devices")),
        Verdict("unusual_time", (hour >= 2) & (hour < 5), 0.40, "alert", F.lit("Transaction at unusual time")),
        Verdict("blacklist", F.col("ip_listed"), 0.95, "block", F.lit("IP address in blacklist")),
        Verdict("high_risk_merchant", F.col("mcc").isin(*HIGH_RISK_MCC), 0.50, "review", F.lit("High-risk merchant category")),
    ]


def device_spread(df: DataFrame, width_ms: int = HOUR, skew: Skew = DEFAULT_SKEW) -> DataFrame:
    return sliding(df, ["card_id"], "ts_ms", [Sliding("device_count", "distinct", width_ms, "device_id")], skew)


def best_verdict(df: DataFrame, verdicts: Sequence[Verdict], blocked: Column | None = None) -> DataFrame:
    """Add is_fraud, confidence, triggered_rule, action and reason.

    A blocked card wins with confidence 1. Among matching rules the most confident wins, and the first of equals.
    """
    ranked = sorted(verdicts, key=lambda v: -v.confidence)
    blocked = F.lit(False) if blocked is None else blocked

    def pick(at_block, of, none) -> Column:
        out = F.when(blocked, at_block)
        for v in ranked:
            out = out.when(v.match, of(v))
        return out.otherwise(none)

    hit = blocked
    for v in ranked:
        hit = hit | v.match
    return df.withColumns({
        "is_fraud": F.coalesce(hit, F.lit(False)),
        "confidence": pick(F.lit(1.0), lambda v: F.lit(v.confidence), F.lit(0.0)),
        "triggered_rule": pick(F.lit("blocklist"), lambda v: F.lit(v.name), F.lit(None).cast("string")),
        "action": pick(F.lit("block"), lambda v: F.lit(v.action), F.lit("allow")),
        "reason": pick(F.lit("Card is blocked"), lambda v: v.reason, F.lit(None).cast("string")),
    })


def auto_block(df: DataFrame) -> Column:
    """Verdicts that block the card for later transactions."""
    return (F.col("confidence") >= AUTO_BLOCK_CONFIDENCE) & (F.col("action") == "block")


def detect(df: DataFrame, blacklist: DataFrame, blocked: Column | None = None, skew: Skew = DEFAULT_SKEW) -> DataFrame:
    """All seven rules and their combination. ``df`` has location, ip and mcc besides the transaction columns."""
    built = listed_ips(previous_location(velocity(df, skew), skew=skew), blacklist)
    return best_verdict(built, default_verdicts(), blocked)
