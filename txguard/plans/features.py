"""Point-in-time feature vectors per card, customer and device."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txguard.operators.running import distinct_in_run
from txguard.operators.skew import DEFAULT_SKEW, Skew
from txguard.operators.sliding import DAY, HOUR, MINUTE, Sliding, sliding

CARD = (
    Sliding("card__tx_count_1m", "count", MINUTE),
    Sliding("card__tx_count_5m", "count", 5 * MINUTE),
    Sliding("card__tx_count_1h", "count", HOUR),
    Sliding("card__tx_count_24h", "count", DAY),
    Sliding("card__amount_sum_1h", "sum", HOUR, "amount"),
    Sliding("card__amount_sum_24h", "sum", DAY, "amount"),
    Sliding("card__unique_merchants_1h", "distinct", HOUR, "merchant_id"),
    Sliding("card__unique_countries_24h", "distinct", DAY, "country"),
)
PRIOR = (
    Sliding("__prior_n", "count", DAY, prior=True),
    Sliding("__prior_sum", "sum", DAY, "amount", prior=True),
)
CUSTOMER = (
    Sliding("customer__device_count", "distinct", 30 * DAY, "device_id"),
    Sliding("customer__country_count", "distinct", 30 * DAY, "country"),
)
DEVICE = (Sliding("device__card_count", "distinct", 30 * DAY, "card_id"),)
TTL_SESSIONS = {
    "card__unique_merchants_1h": (["card_id"], "merchant_id", HOUR),
    "card__unique_countries_24h": (["card_id"], "country", DAY),
    "customer__device_count": (["customer_id"], "device_id", 30 * DAY),
    "customer__country_count": (["customer_id"], "country", 30 * DAY),
    "device__card_count": (["device_id"], "card_id", 30 * DAY),
}


def column_of(feature: str) -> str:
    """Column holding a feature such as ``card:tx_count_1m``."""
    return feature.replace(":", "__")


def feature_of(column: str) -> str:
    return column.replace("__", ":", 1)


def merge_features(*maps: str) -> Column:
    """Merge feature maps; the later map wins on a shared key (``mapKeyDedupPolicy`` is LAST_WIN in our sessions)."""
    return F.map_concat(*[F.coalesce(m, F.create_map().cast("map<string,double>")) for m in maps])


def feature_map(columns: Sequence[str]) -> Column:
    """Wide feature columns as one map under their feature names."""
    return F.create_map(*[x for c in columns for x in (F.lit(feature_of(c)), F.col(c).cast("double"))])


def card_features(df: DataFrame, specs: Sequence[Sliding] = CARD, skew: Skew = DEFAULT_SKEW) -> DataFrame:
    return sliding(df, ["card_id"], "ts_ms", specs, skew)


def customer_features(df: DataFrame, skew: Skew = DEFAULT_SKEW) -> DataFrame:
    return sliding(df, ["customer_id"], "ts_ms", CUSTOMER, skew)


def device_features(df: DataFrame, skew: Skew = DEFAULT_SKEW) -> DataFrame:
    return sliding(df, ["device_id"], "ts_ms", DEVICE, skew)


def amount_ratio(df: DataFrame, skew: Skew = DEFAULT_SKEW) -> DataFrame:
    """Amount over the card's average of the previous 24 hours; 0 without previous rows."""
    return with_amount_ratio(card_features(df, PRIOR, skew))


def with_amount_ratio(df: DataFrame) -> DataFrame:
    average = F.col("__prior_sum") / F.col("__prior_n")
    ratio = F.when((F.col("__prior_n") > 0) & (average > 0), F.col("amount") / average).otherwise(F.lit(0.0))
    return df.withColumn("card__amount_ratio_vs_avg24h", ratio).drop("__prior_n", "__prior_sum")


def snapshot(df: DataFrame, skew: Skew = DEFAULT_SKEW) -> DataFrame:
    """All sliding features of a transaction as of its own time.

    Three exchanges, one per entity; the card family comes last so that card-keyed work after it needs no further one.
    """
    out = customer_features(device_features(df, skew), skew)
    return with_amount_ratio(card_features(out, CARD + PRIOR, skew))


def ttl_sessions(df: DataFrame, feature_columns: Sequence[str] = tuple(TTL_SESSIONS), skew: Skew = DEFAULT_SKEW) -> DataFrame:
    """The distinct features under idle-expiry semantics: a set lives until it was idle for its TTL."""
    for name in feature_columns:
        keys, value, ttl = TTL_SESSIONS[name]
        df = distinct_in_run(df, keys, "ts_ms", value, ttl, name, ["transaction_id"], skew)
    return df


def recent_declines(df: DataFrame, declined: Column, width_ms: int = 30 * MINUTE, skew: Skew = DEFAULT_SKEW) -> DataFrame:
    """Declines of the card in the 30 minutes before this transaction."""
    spec = Sliding("__declines", "sum", width_ms, "__declined", prior=True)
    flagged = df.withColumn("__declined", F.when(declined, 1.0).otherwise(0.0))
    out = sliding(flagged, ["card_id"], "ts_ms", [spec], skew)
    return out.withColumn("card__declines_30m", F.col("__declines").cast("long")).drop("__declined", "__declines")
