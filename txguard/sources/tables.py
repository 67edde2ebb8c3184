"""Views over the test tables in the shapes the engine works on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txguard.session import configure


# Known schemas save the job that would read a footer to infer them.
SCHEMAS = {
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, "
              "o_orderpriority string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "region": "r_regionkey int, r_name string",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    configure(spark)
    reader = spark.read.schema(SCHEMAS[name]) if name in SCHEMAS else spark.read
    return reader.parquet(f"{sf_dir}/{name}.parquet")


TRANSACTION_COLUMNS = {
    "transaction_id": "concat('tx-', cast(event_id as string))",
    "event_id": "event_id",
    "card_id": "user_id",
    "customer_id": "user_id div 2",
    "device_id": "case when user_id % 25 = 0 then 100000 + event_id % 8"
                 " when user_id % 10 = 3 then 200000 + user_id div 50 else user_id div 3 end",
    "amount": "value",
    "merchant_id": "cast(get_json_object(props, '$.k') as bigint)",
    "country": "concat('C', cast(case when user_id % 3 = 0 then event_id % 4 else user_id % 4 end as string))",
    "fraud_label": "case when event_type = 'error' and cast(get_json_object(props, '$.k') as bigint) < 10"
                   " then 'confirmed' end",
    "ts_ms": "unix_micros(cast(ts as timestamp)) div 1000000",
    "ts": "cast(ts as timestamp)",
}


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events read as card transactions; ``ts_ms`` reads epoch seconds as milliseconds to make them dense."""
    return table(spark, sf_dir, "events").selectExpr(*[f"{e} as {n}" for n, e in TRANSACTION_COLUMNS.items()])


EVENT_COLUMNS = {
    "id": "cast(event_id as string)",
    "type": "event_type",
    "source": "case event_id % 3 when 0 then 'web' when 1 then 'mobile' else 'api' end",
    "timestamp": "cast(ts as timestamp)",
    "user_id": "user_id",
    "event_id": "event_id",
    "value": "value",
    "props": "props",
    "ts_ms": "unix_micros(cast(ts as timestamp)) div 1000000",
    "ip_num": "185L * 16777216 + (user_id % 30) * 65536 + event_id % 256",
    "user_agent": "case event_id % 3"
                  " when 0 then 'Mozilla/5.0 (Windows NT 10.0; Win64; x64) Chrome/120.0 Safari/537.36'"
                  " when 1 then 'Mozilla/5.0 (iPhone; CPU iPhone OS 17_0 like Mac OS X) Version/17.0 Mobile Safari/604.1'"
                  " else 'curl/8.4.0' end",
    "processed_at": "cast(ts as timestamp) + make_interval(0, 0, 0, 0, 0, 0, (event_id % 137) * 0.1)",
}


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events in the generic event shape, with the client fields the enrichers read."""
    return table(spark, sf_dir, "events").selectExpr(*[f"{e} as {n}" for n, e in EVENT_COLUMNS.items()])


def geo_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IP ranges per nation, one /16 block each."""
    nation = table(spark, sf_dir, "nation")
    region = table(spark, sf_dir, "region")
    start = F.lit(185 * 16777216) + F.col("n_nationkey") * 65536
    return nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        start.cast("long").alias("start_num"), (start + 65535).cast("long").alias("end_num"),
        F.col("n_name").alias("country"), F.col("r_name").alias("city"),
    )


def failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error events as a dead-letter ledger."""
    return events(spark, sf_dir).where("type = 'error'").select(
        "id", F.to_json(F.struct("id", "type", "source", "props")).alias("payload"),
        F.lit("write failed").alias("error"), "source", F.col("timestamp").alias("failed_at"),
        (F.col("event_id") % 5).cast("int").alias("retry_count"),
        (F.col("event_id") % 2 == 0).alias("recovered"),
    )
