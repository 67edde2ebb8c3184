"""The dead-letter ledger: capture, retry schedule, outcomes and statistics."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txguard.functions.columns import blank_to_null
from txguard.schemas import EVENT

MAX_RETRIES = 3
# Payloads keep microseconds, which JSON text drops by default.
EXACT_TIME = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}
# Delays of the retry topics, in seconds.
RETRY_TIERS = (60, 300)


def delay_seconds(retry: Column, base: int = 60, backoff: str = "linear") -> Column:
    """Wait before retry number ``retry`` (1, 2, ...)."""
    if backoff == "linear":
        return retry * base
    return F.lit(base) * F.pow(F.lit(2), retry - 1).cast("long")


def tier_seconds(retry: Column, tiers: Sequence[int] = RETRY_TIERS) -> Column:
    """Delay of the retry topic for retry number ``retry``; the last tier repeats."""
    return F.element_at(F.array(*[F.lit(t) for t in tiers]), F.least(F.greatest(retry, F.lit(1)), F.lit(len(tiers))))


def later(ts: Column, seconds: Column) -> Column:
    return F.timestamp_micros(F.unix_micros(ts) + (seconds * 1_000_000).cast("long"))


def capture(failed: DataFrame, error: Column, source: Column, now: Column, base: int = 60, backoff: str = "linear",
            payload: Column | None = None) -> DataFrame:
    """New ledger rows for failed events; the whole event is kept as payload unless another is given."""
    payload = F.to_json(F.struct(*failed.columns), EXACT_TIME) if payload is None else payload
    return failed.select(
        "id", payload.alias("payload"), error.alias("error"), source.alias("source"), now.alias("failed_at"),
        F.lit(0).alias("retry_count"), F.lit(None).cast("timestamp").alias("last_retry_at"),
        later(now, delay_seconds(F.lit(1), base, backoff)).alias("next_retry_at"), F.lit(False).alias("recovered"),
    )


def schedule(ledger: DataFrame, base: int = 60, backoff: str = "linear", max_retries: int = MAX_RETRIES) -> DataFrame:
    """Add when each row is retried next, or null where it is recovered or exhausted, and its state."""
    nxt = F.col("retry_count") + 1
    open_ = ~F.col("recovered") & (F.col("retry_count") < max_retries)
    return ledger.withColumns({
        "next_retry_at": F.when(open_, later(F.coalesce("last_retry_at", "failed_at") if "last_retry_at" in ledger.columns
                                             else F.col("failed_at"), delay_seconds(nxt, base, backoff))),
        "state": F.when(F.col("recovered"), "recovered").when(open_, "waiting").otherwise("exhausted"),
    })


def due(ledger: DataFrame, now: Column, max_retries: int = MAX_RETRIES) -> DataFrame:
    """Rows to retry at ``now``."""
    return ledger.where(~F.col("recovered") & (F.col("retry_count") < max_retries) & (F.col("next_retry_at") <= now))


def attempted(ran: DataFrame, ok: Column, now: Column, wait: Callable[[Column], Column], max_retries: int = MAX_RETRIES) -> DataFrame:
    """Ledger rows after one more attempt: ``ok`` says whether it worked (null: no), ``wait`` gives the seconds before retry number n."""
    count = F.col("retry_count") + 1
    return ran.withColumn("__ok", F.coalesce(ok, F.lit(False))).withColumns({
        "recovered": F.col("__ok"),
        "last_retry_at": now,
        "next_retry_at": F.when(~F.col("__ok") & (count < max_retries), later(now, wait(count + 1))),
        "retry_count": count.cast("int"),
        "source": F.when(F.col("__ok") | F.endswith("source", F.lit("_retry")), F.col("source"))
                   .otherwise(F.concat("source", F.lit("_retry"))),
    }).drop("__ok")


def retry(
    ledger: DataFrame, succeeds: Callable[[DataFrame], Column], now: Column, base: int = 60, backoff: str = "linear",
    max_retries: int = MAX_RETRIES,
) -> DataFrame:
    """The ledger after one retry run at ``now``.

    ``succeeds`` gives, for the due rows, whether the replay worked; the others wait. Counts and payloads are kept, so a
    row ends after ``max_retries`` failures.
    """
    is_due = ~F.col("recovered") & (F.col("retry_count") < max_retries) & (F.col("next_retry_at") <= now)
    ran = ledger.where(is_due)
    idle = ledger.where(~F.coalesce(is_due, F.lit(False)))
    done = attempted(ran, succeeds(ran), now, lambda n: delay_seconds(n, base, backoff), max_retries)
    return idle.unionByName(done.select(*idle.columns))


def stats(ledger: DataFrame, max_retries: int = MAX_RETRIES) -> DataFrame:
    """Failed, retried, recovered, and rows still waiting."""
    open_ = ~F.col("recovered") & (F.col("retry_count") < max_retries)
    zero = F.lit(0).cast("long")
    return ledger.agg(
        F.count(F.lit(1)).alias("total_failed"), F.coalesce(F.sum(F.col("retry_count").cast("long")), zero).alias("total_retried"),
        F.count_if("recovered").alias("total_recovered"), F.count_if(open_).alias("current_size"),
    )


def recent(ledger: DataFrame, limit: int = 100) -> DataFrame:
    return ledger.orderBy(F.col("failed_at").desc(), F.col("id")).limit(limit)


def reprocess(ledger: DataFrame, event_id: str) -> DataFrame:
    """The ledger rows of one event, to be replayed from their payload."""
    return ledger.where(F.col("id") == event_id)


def clear(ledger: DataFrame) -> DataFrame:
    """What stays after clearing: recovered rows, as history."""
    return ledger.where("recovered")


def replay(ledger: DataFrame, stored: DataFrame, now: Column, schema: T.StructType = EVENT) -> tuple[DataFrame, DataFrame]:
    """Events of ledger rows (such as :func:`reprocess` picks) that are still to be stored, and those rows afterwards.

    Payloads are decoded to ``schema``. An event whose id is in ``stored`` is not stored again, and one with several rows once: that of the row that failed
    first, then by payload. Rows of such events are recovered, as the event is stored; payloads that are no event, or none that passes the checks of
    ingestion, leave their row as it is. So a second replay stores nothing.
    """
    read = ledger.withColumn("__e", F.from_json("payload", schema))
    good = F.coalesce(~(_blank("__e.id") | _blank("__e.type")), F.lit(False))
    first = read.where(good).groupBy(F.col("__e.id").alias("__id")).agg(F.min(F.struct("failed_at", "payload")).alias("__f"))
    new = first.join(stored.select(F.col("id").alias("__id")), "__id", "left_anti").select(F.from_json("__f.payload", schema).alias("__e")).select("__e.*")
    after = read.withColumns({
        "recovered": F.coalesce("recovered", F.lit(False)) | good,
        "next_retry_at": F.when(~good, F.col("next_retry_at")),
        "last_retry_at": F.when(good, now).otherwise(F.col("last_retry_at")),
    })
    return new, after.select(*ledger.columns)


def _blank(name: str) -> Column:
    return blank_to_null(F.col(name)).isNull()
