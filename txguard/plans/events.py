"""Generic events: validation, serialisation, queries, feeds and routing."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txguard.functions.columns import blank_to_null


def reject_reason() -> Column:
    """Why an event is refused, or null."""
    return F.when(blank_to_null(F.col("id")).isNull(), "event id is required").when(
        blank_to_null(F.col("type")).isNull(), "event type is required"
    )


def validate(df: DataFrame) -> DataFrame:
    return df.withColumn("reject_reason", reject_reason())


def split_valid(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid events, and rejected ones with their reason."""
    checked = validate(df)
    return checked.where("reject_reason is null").drop("reject_reason"), checked.where("reject_reason is not null")


def default_timestamp(df: DataFrame, ingest_ts: Column) -> DataFrame:
    return df.withColumn("timestamp", F.coalesce("timestamp", ingest_ts))


def client_id(header: Column, source: Column, address: Column) -> Column:
    """Who is rate limited: the client header, else the source, else the address."""
    return F.coalesce(blank_to_null(header), blank_to_null(source), address)


def partition_key(card: Column, account: Column) -> Column:
    """Topic key: the card, or the account where there is no card."""
    return F.coalesce(blank_to_null(card), account)


def to_text_map(df: DataFrame, column: str = "data") -> DataFrame:
    """A map with any values as a map of strings; a missing map becomes an empty one."""
    empty = F.create_map().cast("map<string,string>")
    return df.withColumn(column, F.coalesce(F.transform_values(column, lambda _, v: v.cast("string")), empty))


def json_to_map(df: DataFrame, column: str = "data") -> DataFrame:
    return df.withColumn(column, F.from_json(column, T.MapType(T.StringType(), T.StringType())))


def processed(df: DataFrame, processed_at: Column) -> DataFrame:
    """Events in the shape of the events table: maps as JSON text."""
    def text(name: str) -> Column:
        return F.col(name) if isinstance(df.schema[name].dataType, T.StringType) else F.to_json(name)

    return df.select(
        "id", "type", "source", "timestamp", processed_at.alias("processed_at"),
        text("data").alias("data"), text("metadata").alias("metadata"),
    )


def query(df: DataFrame, event_type: str | None = None, source: str | None = None, limit: int = 100) -> DataFrame:
    """The latest events of a type and source."""
    if event_type:
        df = df.where(F.col("type") == event_type)
    if source:
        df = df.where(F.col("source") == source)
    return df.orderBy(F.col("timestamp").desc(), F.col("id")).limit(limit)


def feed(df: DataFrame, subscribed_type: str | None = None) -> DataFrame:
    """Events a subscriber receives."""
    return df.where(F.col("type") == subscribed_type) if subscribed_type else df


def route(df: DataFrame, routes: Mapping[str, Column], other: str = "default") -> DataFrame:
    """Name the first route whose condition holds."""
    target = F.lit(None).cast("string")
    for name, condition in reversed(routes.items()):
        target = F.when(condition, name).otherwise(target)
    return df.withColumn("route", F.coalesce(target, F.lit(other)))


def deduplicate(df: DataFrame, key: str = "id", ts: str = "timestamp") -> DataFrame:
    """The first event of each id, whole; copies of one time are told apart by a hash of their fields. Events without id are no copies.

    ``min_by`` combines on the map side, so copies of one id collapse before the shuffle; a row_number window would bring
    all copies to one task.
    """
    others = [c for c in df.columns if c not in (key, ts)]
    plain = [f.name for f in df.schema.fields if f.name in others and not isinstance(f.dataType, T.MapType)]
    order = F.struct(F.col(ts), F.xxhash64(*plain) if plain else F.lit(0))
    first = F.min_by(F.struct(ts, *others), order).alias("__first")
    named = df.where(F.col(key).isNotNull()).groupBy(key).agg(first).select(key, f"__first.{ts}", *[f"__first.{c}" for c in others])
    return named.unionByName(df.where(F.col(key).isNull()))


def batch_summary(df: DataFrame, batch: str = "batch_id") -> DataFrame:
    """Accepted, failed and total per submitted batch."""
    ok = reject_reason().isNull()
    return df.groupBy(batch).agg(
        F.count_if(ok).alias("accepted"), F.count_if(~ok).alias("failed"), F.count(F.lit(1)).alias("total")
    )
