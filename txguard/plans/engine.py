"""The decision plan: pre-checks, features, rules, score."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txguard.functions.columns import blank_to_null
from txguard.operators.skew import DEFAULT_SKEW, Skew
from txguard.plans.baselines import with_baselines
from txguard.plans.blocks import blocked_at
from txguard.plans.features import snapshot
from txguard.plans.rules import DEFAULT_RULES, Rule
from txguard.plans.scoring import DEFAULT_THRESHOLDS, MAX_SCORE, Thresholds, score

DECISION_COLUMNS = (
    "risk_score", "action", "reason_codes", "triggered_rules", "contributing_features", "explain_lines",
)


def precheck_reason(blocked: Column | None = None, card: str = "card_id") -> Column:
    """The first failing pre-check, or null."""
    text = F.col(card).cast("string")
    out = (
        F.when(blank_to_null(F.col("transaction_id")).isNull(), "missing transaction_id")
        .when(blank_to_null(text).isNull(), "missing card_number")
        .when(F.col("amount").isNull() | (F.col("amount") <= 0),
              F.format_string("invalid amount %.2f", F.coalesce(F.col("amount"), F.lit(0.0))))
    )
    return out if blocked is None else out.when(blocked, F.concat(F.lit("card "), text, F.lit(" is blocked")))


def precheck_decision(df: DataFrame, reason: str = "precheck_reason") -> DataFrame:
    """Decision columns of rows that failed a pre-check."""
    return df.withColumns({
        "risk_score": F.lit(MAX_SCORE),
        "action": F.lit("block"),
        "reason_codes": F.array(F.lit("PRE_CHECK_FAILED")),
        "triggered_rules": F.array().cast("array<string>"),
        "contributing_features": F.create_map().cast("map<string,double>"),
        "explain_lines": F.array(F.concat(F.lit("Pre-check: "), F.col(reason))),
    })


def decide(
    df: DataFrame,
    rules: Sequence[Rule] = DEFAULT_RULES,
    thresholds: Thresholds = DEFAULT_THRESHOLDS,
    cards: DataFrame | None = None,
    merchants: DataFrame | None = None,
    block_log: DataFrame | None = None,
    block_ttl_ms: int | None = 24 * 3_600_000,
    skew: Skew = DEFAULT_SKEW,
) -> DataFrame:
    """Decide every transaction from the rows before it; rows failing a pre-check leave no trace in the features.

    ``block_log`` holds block and unblock commands known beforehand. Blocks that follow from the decisions themselves
    are the subject of :mod:`txguard.plans.banking`.
    """
    blocked = None
    columns = df.columns
    if block_log is not None:
        df = blocked_at(df, block_log, block_ttl_ms, "__blocked", skew)
        blocked = F.col("__blocked")
    checked = df.withColumn("precheck_reason", precheck_reason(blocked)).select(*columns, "precheck_reason")
    good = checked.where(F.col("precheck_reason").isNull())
    bad = checked.where(F.col("precheck_reason").isNotNull())
    scored = score(with_baselines(snapshot(good, skew), cards, merchants), rules, thresholds)
    keep = [*columns, "precheck_reason", *DECISION_COLUMNS]
    return scored.select(*keep).unionByName(precheck_decision(bad).select(*keep))
