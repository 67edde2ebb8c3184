"""Long-horizon card and merchant baselines, one pass for all entities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txguard.functions.columns import safe_ratio

CARD_COLUMNS = (
    "card__tx_count_30d", "card__amount_sum_30d", "card__amount_avg_30d", "card__tx_count_7d", "card__unique_merchants_30d",
)
MERCHANT_COLUMNS = ("merchant__tx_count_30d", "merchant__fraud_count_30d", "merchant__fraud_rate_30d")


def _since(as_of: str, days: int, strict: bool) -> Column:
    day = F.to_date("ts")
    end = F.to_date(F.lit(as_of))
    return (day >= F.date_sub(end, days)) & ((day < end) if strict else (day <= end))


def _period(df: DataFrame, as_of: str, strict: bool) -> DataFrame:
    """Rows of the 30 days, by plain bounds of ``ts`` that reach the scan."""
    day = F.lit(as_of).cast("date")
    start, end = F.date_sub(day, 30).cast("timestamp"), (day if strict else F.date_add(day, 1)).cast("timestamp")
    return df.where((F.col("ts") >= start) & (F.col("ts") < end))


def card_baselines(df: DataFrame, as_of: str, strict: bool = False, exact: bool = True, every: DataFrame | None = None) -> DataFrame:
    """30-day and 7-day baselines per card. ``strict`` leaves out the day of ``as_of``.

    Only the 30 days are read, so cards without a row in them are absent, unless ``every`` (card_id) lists the cards to answer for.
    ``exact=False`` counts merchants with a HyperLogLog sketch, which needs no second aggregation by merchant.
    """
    if every is not None:
        found = card_baselines(df, as_of, strict, exact)
        counts = [c for c in CARD_COLUMNS if c != "card__amount_avg_30d"]
        return every.select("card_id").join(found, "card_id", "left").fillna(0, counts)
    df = _period(df, as_of, strict)
    month, week = _since(as_of, 30, strict), _since(as_of, 7, strict)
    merchant = F.when(month, F.col("merchant_id"))
    merchants = F.count_distinct(merchant) if exact else F.approx_count_distinct(merchant, 0.015)
    return df.groupBy("card_id").agg(
        F.count_if(month).alias("card__tx_count_30d"),
        F.coalesce(F.sum(F.when(month, F.col("amount"))), F.lit(0.0)).alias("card__amount_sum_30d"),
        F.avg(F.when(month, F.col("amount"))).alias("card__amount_avg_30d"),
        F.count_if(week).alias("card__tx_count_7d"),
        merchants.alias("card__unique_merchants_30d"),
    )


def merchant_risk(df: DataFrame, as_of: str, strict: bool = False) -> DataFrame:
    """Confirmed-fraud rate per merchant over 30 days; merchants without a transaction in them are absent."""
    df = _period(df, as_of, strict)
    month = _since(as_of, 30, strict)
    counted = df.where(F.col("merchant_id").isNotNull()).groupBy("merchant_id").agg(
        F.count_if(month).alias("merchant__tx_count_30d"),
        F.count_if(month & (F.col("fraud_label") == "confirmed")).alias("merchant__fraud_count_30d"),
    )
    rate = safe_ratio(F.col("merchant__fraud_count_30d"), F.col("merchant__tx_count_30d"))
    return counted.withColumn("merchant__fraud_rate_30d", rate)


def with_baselines(df: DataFrame, cards: DataFrame | None = None, merchants: DataFrame | None = None) -> DataFrame:
    """Merge baselines into the feature columns; missing entities keep nulls, which rules read as 0.

    Unhinted left joins: Catalyst broadcasts a baseline table when its size allows, and otherwise AQE splits the hot side.
    """
    if merchants is not None:
        df = df.join(merchants.select("merchant_id", *MERCHANT_COLUMNS), "merchant_id", "left")
    if cards is not None:
        df = df.join(cards.select("card_id", *CARD_COLUMNS), "card_id", "left")
        ratio = safe_ratio(F.col("amount"), F.col("card__amount_avg_30d"))
        df = df.withColumn("card__amount_ratio_vs_avg30d", ratio)
    return df
