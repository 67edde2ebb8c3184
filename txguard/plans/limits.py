"""Card spending limits: per transaction, per day, per month."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txguard.functions.columns import day_key, month_key, whole_units
from txguard.operators.folds import ordered_fold
from txguard.operators.running import running
from txguard.operators.skew import DEFAULT_SKEW, Skew

# Reasons of a limit decline.
TRANSACTION_REASON = "Transaction limit exceeded"
DAILY_REASON = "Daily limit exceeded"
MONTHLY_REASON = "Monthly limit exceeded"


@dataclass(frozen=True)
class Limits:
    transaction: float = 50_000.0
    daily: float = 100_000.0
    monthly: float = 1_000_000.0


DEFAULT_LIMITS = Limits()


def with_limits(df: DataFrame, custom: DataFrame | None = None, default: Limits = DEFAULT_LIMITS) -> DataFrame:
    """Add transaction_limit, daily_limit and monthly_limit; ``custom`` (card_id and the three limits) overrides."""
    names = {"transaction_limit": default.transaction, "daily_limit": default.daily, "monthly_limit": default.monthly}
    if custom is None:
        return df.withColumns({n: F.lit(float(v)) for n, v in names.items()})
    own = custom.select("card_id", *[F.col(n).alias(f"__{n}") for n in names])
    joined = df.join(own, "card_id", "left")
    return joined.select(*df.columns, *[F.coalesce(F.col(f"__{n}"), F.lit(float(v))).alias(n) for n, v in names.items()])


def with_periods(df: DataFrame) -> DataFrame:
    return df.withColumn("day", day_key(F.col("ts"))).withColumn("month", month_key(F.col("ts")))


def spend_counters(df: DataFrame, period: str) -> DataFrame:
    """Whole units spent per card and ``day`` or ``month``."""
    return with_periods(df).groupBy("card_id", period).agg(F.sum(whole_units(F.col("amount"))).alias("spent"))


def limits_status(
    df: DataFrame, day: str, custom: DataFrame | None = None, default: Limits = DEFAULT_LIMITS
) -> DataFrame:
    """Limits, spend and what remains per card, as of ``day`` and its month."""
    units = whole_units(F.col("amount"))
    spent = with_periods(df).groupBy("card_id").agg(
        F.coalesce(F.sum(F.when(F.col("day") == day, units)), F.lit(0)).cast("double").alias("daily_spent"),
        F.coalesce(F.sum(F.when(F.col("month") == day[:7], units)), F.lit(0)).cast("double").alias("monthly_spent"),
    )
    return with_limits(spent, custom, default).select(
        "card_id", "transaction_limit", "daily_limit", "daily_spent",
        (F.col("daily_limit") - F.col("daily_spent")).alias("daily_remaining"),
        "monthly_limit", "monthly_spent", (F.col("monthly_limit") - F.col("monthly_spent")).alias("monthly_remaining"),
    )


def attempted_spend(df: DataFrame, ts: str = "__us", skew: Skew = DEFAULT_SKEW, amount: str = "amount") -> DataFrame:
    """What a card had tried to spend before each row in its day and month, whether or not it was approved; null amounts are none."""
    rows = with_periods(df) if "day" not in df.columns else df
    if ts not in rows.columns:
        rows = rows.withColumn(ts, F.unix_micros("ts"))
    wide = replace(skew, slice_ms=skew.slice_ms * 1000)
    units = {"__units": whole_units(F.col(amount))}
    rows = rows.withColumns(units)
    monthly = running(rows, ["card_id", "month"], ts, {"month_before": ("sum", F.col("__units"))}, ["transaction_id"],
                      "before", wide)
    daily = running(monthly, ["card_id", "month", "day"], ts, {"day_before": ("sum", F.col("__units"))}, ["transaction_id"],
                    "before", wide)
    zero = F.lit(0).cast("long")
    return daily.withColumns({c: F.coalesce(c, zero) for c in ("month_before", "day_before")}).drop("__units")


def limit_check(amount: Column, day_spent: Column, month_spent: Column) -> Column:
    return (
        F.when(amount > F.col("transaction_limit"), TRANSACTION_REASON)
        .when(day_spent + amount > F.col("daily_limit"), DAILY_REASON)
        .when(month_spent + amount > F.col("monthly_limit"), MONTHLY_REASON)
    )


def attempted_check(df: DataFrame, skew: Skew = DEFAULT_SKEW) -> DataFrame:
    """The limit check against attempted spend: a window, not a fold; stricter than :func:`enforce`."""
    rows = attempted_spend(df, skew=skew)
    return rows.withColumn("limit_reason", limit_check(F.col("amount"), F.col("day_before"), F.col("month_before"))).drop("__us")


def greedy_step() -> Callable[..., tuple]:
    """One card and month: spend counts only when approved. Amounts above the transaction limit do not get here."""
    day, day_spent, month_spent = None, 0, None

    def step(today, amount, daily, monthly, day_before, month_before) -> tuple:
        nonlocal day, day_spent, month_spent
        if month_spent is None:
            month_spent, day, day_spent = month_before, today, day_before
        if today != day:
            day, day_spent = today, 0
        reason = None
        if day_spent + amount > daily:
            reason = DAILY_REASON
        elif month_spent + amount > monthly:
            reason = MONTHLY_REASON
        seen = (reason, day_spent, month_spent)
        if reason is None:
            day_spent += int(amount)
            month_spent += int(amount)
        return seen

    return step


def enforce(df: DataFrame, skew: Skew = DEFAULT_SKEW) -> DataFrame:
    """Approve or decline in order; a declined transaction does not use up the limit.

    ``df`` carries the limits. Adds ``limit_reason`` (null when approved), ``day_spent`` and ``month_spent`` (before the
    row). Both counters restart with the month, so months are independent. Until a card's attempted spend first breaks a
    limit in a month, attempted and approved spend are the same and windows answer; only the rest of that month is
    folded, one task streaming each (card, month).
    """
    columns = df.columns
    rows = with_periods(df).withColumn("__us", F.unix_micros("ts"))
    small = rows.where(F.col("amount") <= F.col("transaction_limit"))
    tried = attempted_spend(small, skew=skew)
    over = F.when(limit_check(F.col("amount"), F.col("day_before"), F.col("month_before")).isNotNull(), 1).otherwise(0)
    wide = replace(skew, slice_ms=skew.slice_ms * 1000)
    marked = running(tried.withColumn("__over", over), ["card_id", "month"], "__us", {"__bound": ("max", F.col("__over"))},
                     ["transaction_id"], "rows", wide)
    keep = [*columns, "limit_reason", "day_spent", "month_spent"]
    free = marked.where(F.col("__bound") == 0).select(
        *columns, F.lit(None).cast("string").alias("limit_reason"),
        F.col("day_before").alias("day_spent"), F.col("month_before").alias("month_spent"),
    )
    folded = ordered_fold(
        marked.where(F.col("__bound") == 1), ["card_id", "month"], ["__us", "transaction_id"],
        ["day", "amount", "daily_limit", "monthly_limit", "day_before", "month_before"], greedy_step,
        "limit_reason string, day_spent long, month_spent long",
    ).select(*keep)
    large = rows.where(F.col("amount") > F.col("transaction_limit")).select(
        *columns, F.lit(TRANSACTION_REASON).alias("limit_reason"),
        F.lit(None).cast("long").alias("day_spent"), F.lit(None).cast("long").alias("month_spent"),
    )
    return free.unionByName(folded).unionByName(large)
