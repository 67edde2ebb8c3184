"""Baselines from daily partials: a transaction is read once, on the day it comes, and answers add up days.

A partial is one row per entity and day of one batch: counts, a sum, and a sketch of the merchants. Partials of several batches, or of rows that came
late for an old day, add up, so nothing stored is ever rewritten for new rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from txguard.functions.columns import safe_ratio
from txguard.sources.event_table import Layout, append_batch, read

SKETCH_BITS = 12
CARD_DAYS = Layout("card_id string, timestamp timestamp, n long, n_amounts long, amount_sum double, merchants binary", ("timestamp", "card_id"))
MERCHANT_DAYS = Layout("merchant_id string, timestamp timestamp, n long, n_fraud long", ("timestamp", "merchant_id"))


def _days(df: DataFrame, key: str, *partials: Column) -> DataFrame:
    dated = df.where(F.col("ts").isNotNull()).withColumns({"__key": F.col(key).cast("string"), "__day": F.date_trunc("day", "ts")})
    return dated.groupBy(F.col("__key").alias(key), F.col("__day").alias("timestamp")).agg(*partials)


def card_days(df: DataFrame) -> DataFrame:
    """Partials of transactions (card_id, ts, amount, merchant_id) per card and day; rows without time belong to no day."""
    return _days(df, "card_id", F.count(F.lit(1)).alias("n"), F.count("amount").alias("n_amounts"),
                 F.coalesce(F.sum(F.col("amount").cast("double")), F.lit(0.0)).alias("amount_sum"),
                 F.hll_sketch_agg(F.col("merchant_id").cast("string"), SKETCH_BITS).alias("merchants"))


def merchant_days(df: DataFrame) -> DataFrame:
    """Partials per merchant and day; rows without merchant count for none."""
    return _days(df.where(F.col("merchant_id").isNotNull()), "merchant_id", F.count(F.lit(1)).alias("n"),
                 F.count_if(F.coalesce(F.col("fraud_label") == "confirmed", F.lit(False))).alias("n_fraud"))


def add_batch(df: DataFrame, path: str, batch: int) -> None:
    """Add a batch of transactions to the partials under ``path``; a batch that is repeated changes nothing."""
    append_batch(card_days(df), f"{path}/cards", batch, "days", CARD_DAYS)
    append_batch(merchant_days(df), f"{path}/merchants", batch, "days", MERCHANT_DAYS)


def _stored(spark: SparkSession, path: str, as_of: str, strict: bool, layout: Layout) -> tuple[DataFrame, Column]:
    """Partials of the 30 days, whose other months are not listed, and whether a row is of the last 7."""
    start, week, end = spark.range(1).select(*(
        F.date_add(F.lit(as_of).cast("date"), n).cast("string") for n in (-30, -7, 0 if strict else 1))).first()
    return read(spark, path, start, end, layout), F.col("timestamp") >= F.lit(week).cast("timestamp")


def card_baselines(spark: SparkSession, path: str, as_of: str, strict: bool = False) -> DataFrame:
    """The columns of :func:`txguard.plans.baselines.card_baselines` from the stored partials; merchants by sketch (relative error about 1.6 %).

    ``card_id`` is text. Sums are added up by day, so their last bits may differ from sums over all rows.
    """
    df, week = _stored(spark, f"{path}/cards", as_of, strict, CARD_DAYS)
    return df.groupBy("card_id").agg(
        F.sum("n").alias("card__tx_count_30d"), F.sum("amount_sum").alias("card__amount_sum_30d"),
        safe_ratio(F.sum("amount_sum"), F.sum("n_amounts")).alias("card__amount_avg_30d"),
        F.coalesce(F.sum(F.when(week, F.col("n"))), F.lit(0)).alias("card__tx_count_7d"),
        F.hll_sketch_estimate(F.hll_union_agg("merchants")).alias("card__unique_merchants_30d"))


def merchant_risk(spark: SparkSession, path: str, as_of: str, strict: bool = False) -> DataFrame:
    """The columns of :func:`txguard.plans.baselines.merchant_risk` from the stored partials; ``merchant_id`` is text."""
    df, _ = _stored(spark, f"{path}/merchants", as_of, strict, MERCHANT_DAYS)
    counted = df.groupBy("merchant_id").agg(F.sum("n").alias("merchant__tx_count_30d"), F.sum("n_fraud").alias("merchant__fraud_count_30d"))
    return counted.withColumn("merchant__fraud_rate_30d", safe_ratio(F.col("merchant__fraud_count_30d"), F.col("merchant__tx_count_30d")))
