"""Reading and writing events, decisions and dead letters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txguard.functions.columns import blank_to_null, month_partition
from txguard.schemas import EVENT, TRANSACTION

CORRUPT = "_corrupt_record"
RETENTION_DAYS = 90


def _with_corrupt(schema: T.StructType) -> T.StructType:
    return T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])


def read_json_events(spark: SparkSession, path: str, schema: T.StructType = EVENT, streaming: bool = False) -> DataFrame:
    """One JSON event per line; lines that do not parse keep their text in ``_corrupt_record``."""
    reader = spark.readStream if streaming else spark.read
    return (
        reader.schema(_with_corrupt(schema))
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", CORRUPT)
        .json(path)
    )


def decode(df: DataFrame, value: str = "value", schema: T.StructType = TRANSACTION) -> DataFrame:
    """Parse a JSON payload column; rows that do not parse keep the payload in ``_corrupt_record``."""
    parsed = F.from_json(F.col(value).cast("string"), _with_corrupt(schema),
                         {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
    broken = F.col("__p").isNull() | F.col(f"__p.{CORRUPT}").isNotNull()
    return df.withColumn("__p", parsed).select(
        *[c for c in df.columns if c != value], *[F.col(f"__p.{f.name}").alias(f.name) for f in schema.fields],
        F.when(broken, F.col(value).cast("string")).alias(CORRUPT),
    )


def split_decoded(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Decoded rows, and ``{error, payload}`` rows for the dead-letter topic."""
    good = df.where(F.col(CORRUPT).isNull()).drop(CORRUPT)
    bad = df.where(F.col(CORRUPT).isNotNull()).select(F.lit("cannot decode payload").alias("error"), F.col(CORRUPT).alias("payload"))
    return good, bad


def explode_batches(df: DataFrame, body: str = "body", schema: T.StructType = EVENT) -> tuple[DataFrame, DataFrame]:
    """Bodies holding a JSON array of events: the events, and the bodies that are empty or no array."""
    rest = [c for c in df.columns if c != body]
    parsed = df.withColumn("__a", F.from_json(body, T.ArrayType(schema)))
    full = F.coalesce(F.size("__a"), F.lit(0)) > 0
    items = parsed.where(full).select(*rest, F.inline("__a"))
    reason = F.when(F.col("__a").isNull(), "invalid batch").otherwise("empty batch")
    return items, parsed.where(~full).select(*rest, body, reason.alias("reject_reason"))


def read_event_file(spark: SparkSession, path: str, now: Column | None = None) -> DataFrame:
    """Events of a JSON document file; a missing timestamp becomes ``now``."""
    raw = spark.read.schema(EVENT).json(path, multiLine=True)
    return raw.withColumn("timestamp", F.coalesce("timestamp", now if now is not None else F.current_timestamp()))


def append_events(df: DataFrame, path: str) -> None:
    """Append to the events table: one folder per month, files sorted for reads by type and source.

    Rows are rebalanced by month: AQE cuts a month that holds most rows into many tasks, and joins small ones, so that
    files come out near the advisory size.
    """
    (
        df.withColumn("yyyymm", month_partition(F.col("timestamp")))
        .hint("rebalance", "yyyymm")
        .sortWithinPartitions("yyyymm", "type", "source", "timestamp")
        .write.mode("append").option("compression", "lz4").partitionBy("yyyymm").parquet(path)
    )


def read_events(spark: SparkSession, path: str, since: str | None = None, until: str | None = None) -> DataFrame:
    """The events table. Time bounds also prune month folders."""
    df = spark.read.option("basePath", path).schema("id string, type string, source string, timestamp timestamp, "
                                                    "processed_at timestamp, data string, metadata string, yyyymm string").parquet(path)
    if since:
        df = df.where((F.col("timestamp") >= F.lit(since).cast("timestamp")) & (F.col("yyyymm") >= since[:7].replace("-", "")))
    if until:
        df = df.where((F.col("timestamp") < F.lit(until).cast("timestamp")) & (F.col("yyyymm") <= until[:7].replace("-", "")))
    return df


def retained(df: DataFrame, as_of: str, days: int = RETENTION_DAYS) -> DataFrame:
    """Rows younger than the retention period."""
    return df.where(F.to_date("timestamp") >= F.date_sub(F.lit(as_of).cast("date"), days))


def apply_retention(spark: SparkSession, source: str, target: str, as_of: str, days: int = RETENTION_DAYS) -> None:
    """Write the retained part of the events table to ``target``; expired months are pruned without being read."""
    first = spark.range(1).select(month_partition(F.date_sub(F.lit(as_of).cast("date"), days)).alias("m")).first()["m"]
    live = retained(spark.read.parquet(source).where(F.col("yyyymm").cast("string") >= first), as_of, days)
    live.write.mode("overwrite").partitionBy("yyyymm").parquet(target)


def to_topic(df: DataFrame, key: Column | str) -> DataFrame:
    """Rows as (key, value) with a JSON value."""
    key = F.col(key) if isinstance(key, str) else key
    return df.select(key.cast("string").alias("key"), F.to_json(F.struct(*df.columns)).alias("value"))


def card_key(card: str = "card_number", account: str = "account_id") -> Column:
    return F.coalesce(blank_to_null(F.col(card)), F.col(account))


def kafka_source(spark: SparkSession, servers: str, topics: Sequence[str], max_per_trigger: int = 500_000) -> DataFrame:
    """A topic from its beginning; needs the Kafka connector on the class path."""
    return (
        spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers)
        .option("subscribe", ",".join(topics)).option("startingOffsets", "earliest")
        .option("maxOffsetsPerTrigger", max_per_trigger).load()
    )


def kafka_sink(df: DataFrame, servers: str, topic: str, checkpoint: str):
    """Stream (key, value) rows to a topic; needs the Kafka connector on the class path."""
    return (
        df.writeStream.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic)
        .option("checkpointLocation", checkpoint).start()
    )
