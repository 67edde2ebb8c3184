"""Streaming jobs: ingestion, statistics, decisions and feeds."""

from __future__ import annotations

import threading
from collections.abc import Callable, Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener

from txguard.functions.columns import blank_to_null
from txguard.plans import dlq, enrich, events
from txguard.plans.baselines import with_baselines
from txguard.plans.limits import Limits, DEFAULT_LIMITS, with_limits, with_periods
from txguard.plans.banking import OUTCOME, STEP_INPUTS, card_step, outer_features, transaction_context
from txguard.operators.running import gap_runs, running
from txguard.operators.skew import DEFAULT_SKEW, Skew
from txguard.operators.sliding import Sliding
from txguard.plans.engine import precheck_reason
from txguard.plans.features import CUSTOMER, DEVICE
from txguard.plans.rules import DEFAULT_RULES, Rule, load_rules, read_versions, valid_from
from txguard.plans.scoring import DEFAULT_THRESHOLDS, Thresholds
from txguard.schemas import DEAD_LETTER
from txguard.sources import event_table
from txguard.sources.storage import CORRUPT, decode, split_decoded
from txguard.streaming import state

Sink = Callable[[DataFrame, int], None]
# What a batch leaves for the next one is kept for so many batches; Spark replays the last one at most.
KEPT_MARKS = 10
DECISIONS = event_table.Layout(f"transaction_id string, ts_ms long, {OUTCOME}, timestamp timestamp", ("timestamp", "transaction_id"))


def micro_batches(df: DataFrame, write: Sink, checkpoint: str, every: str | None = "5 seconds", mode: str = "append",
                  name: str | None = None) -> StreamingQuery:
    """Start a job that hands each micro-batch to ``write``; ``every=None`` processes what is there and stops."""
    writer = df.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode(mode)
    if name:
        writer = writer.queryName(name)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def batch_folder(path: str) -> Sink:
    """Write each micro-batch to its own folder, so a batch replayed after a failure overwrites itself."""
    def write(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return write


def decision_sink(path: str, writer: str = "decisions") -> Sink:
    """Append the rows of :func:`decisions` to a table of decisions by month; a replayed batch changes nothing."""
    def write(df: DataFrame, batch: int) -> None:
        event_table.append_batch(df.withColumn("timestamp", F.timestamp_millis("ts_ms")), path, batch, writer, DECISIONS)

    return write


def ingest(
    raw: DataFrame, events_path: str, dlq_path: str, checkpoint: str, enrichers: Sequence[Callable[[DataFrame], DataFrame]] = (),
    now: Callable[[], Column] = F.current_timestamp, every: str | None = "5 seconds",
) -> StreamingQuery:
    """JSON events to the events table (:mod:`txguard.sources.event_table`); undecodable and invalid ones to the dead-letter ledger, ready for its retries.

    ``raw`` comes from :func:`txguard.sources.storage.read_json_events`. A replayed batch changes nothing: the table knows it as committed, the ledger's
    folder of that batch is overwritten. ``PipelineCounters`` adds up the job's ``written``, ``rejected`` and ``undecoded`` rows.
    """
    if any(getattr(e, "stateful", False) for e in enrichers):
        raise ValueError("sessions and counters need state that outlives a batch: apply with_sessions_and_counters to the stream")

    def write(batch: DataFrame, batch_id: int) -> None:
        columns = [c for c in batch.columns if c != CORRUPT]
        # Read and parsed once for the three writes.
        batch = batch.persist()
        try:
            checked = events.validate(events.default_timestamp(batch.where(F.col(CORRUPT).isNull()).select(*columns), now()))
            good = checked.where("reject_reason is null").drop("reject_reason")
            for enricher in enrichers:
                good = good.transform(enricher)
            failed = checked.where("reject_reason is not null")
            rejected = dlq.capture(failed, F.col("reject_reason"), F.lit("validation"), now(), payload=F.to_json(F.struct(*columns), dlq.EXACT_TIME))
            broken = batch.where(F.col(CORRUPT).isNotNull()).select(F.lit(None).cast("string").alias("id"), F.col(CORRUPT).alias("payload"))
            undecoded = dlq.capture(broken, F.lit("cannot decode payload"), F.lit("decode"), now(), payload=F.col("payload"))
            rejected.unionByName(undecoded).write.mode("overwrite").parquet(f"{dlq_path}/batch={batch_id}")
            # Last, so that a batch known as committed has its dead letters too.
            event_table.append_batch(events.processed(good, now()), events_path, batch_id)
        finally:
            batch.unpersist()

    return micro_batches(counted(raw), write, checkpoint, every)


def counted(raw: DataFrame) -> DataFrame:
    """Observe how many rows of a source are to be written, rejected or undecoded, by the checks that :func:`ingest` makes."""
    undecoded, rejected = F.col(CORRUPT).isNotNull(), F.coalesce(events.reject_reason().isNotNull(), F.lit(False))
    return raw.observe("ingest", F.count_if(~undecoded & ~rejected).alias("written"), F.count_if(~undecoded & rejected).alias("rejected"),
                       F.count_if(undecoded).alias("undecoded"))


class _Runs(StatefulProcessor):
    """Per key, the running window (its start) or the running count, kept for ``ttl_ms`` after its last event."""

    def __init__(self, fixed: bool, width_ms: int, ttl_ms: int):
        self.fixed, self.width, self.ttl = fixed, width_ms, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.run = handle.getValueState("run", "start long, last long, n long", self.ttl)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows)).sort_values(["ms", "id"], kind="stable")
        start, last, n = self.run.get() if self.run.exists() else (None, None, 0)
        values = []
        for ms in frame["ms"].tolist():
            if start is None or (ms - start >= self.width if self.fixed else ms - last >= self.width):
                start, n = ms, 0
            last, n = ms, n + 1
            values.append(start if self.fixed else n)
        self.run.update((start, last, n))
        yield pd.DataFrame({"row": frame["row"].tolist(), "value": values})

    def close(self) -> None:
        pass


def _with_runs(df: DataFrame, key: Column, fixed: bool, width_ms: int, ttl_ms: int, out: str) -> DataFrame:
    """Add ``out``: the start of the key's fixed window, or its count since the last idle time. Events without key get null and no state to share."""
    alone = F.concat(F.lit("\0"), F.coalesce("id", F.lit("")))
    # Text keeps milliseconds only, so timestamps travel as microseconds.
    plain = [F.unix_micros(f.name).alias(f.name) if isinstance(f.dataType, T.TimestampType) else F.col(f.name) for f in df.schema.fields]
    keyed = df.select(F.coalesce(key, alone).alias("key"), F.floor(F.unix_micros("timestamp") / 1000).alias("ms"), "id",
                      F.to_json(F.struct(*plain, key.alias("__key")), {"ignoreNullFields": "false"}).alias("row"))
    placed = keyed.groupBy("key").transformWithStateInPandas(
        _Runs(fixed, width_ms, ttl_ms), outputStructType="row string, value long", outputMode="Append", timeMode="ProcessingTime")
    fields = [T.StructField(f.name, T.LongType() if isinstance(f.dataType, T.TimestampType) else f.dataType) for f in df.schema.fields]
    parsed = F.from_json("row", T.StructType([*fields, T.StructField("__key", T.StringType())]))
    return state.with_timestamps(placed.select(parsed.alias("r"), "value").select("r.*", "value"), df.schema).select(
        *df.columns, F.when(F.col("__key").isNotNull(), F.col("value")).alias(out))


def with_sessions_and_counters(df: DataFrame, user_field: str = "user_id", session_ms: int = 1_800_000, idle_ms: int = 3_600_000,
                               slack_ms: int = 3_600_000) -> DataFrame:
    """The stateful enrichers over a stream of events: session ids, and counts per type and per source.

    State per user, type and source outlives the micro-batches and goes when its key was idle for the window and ``slack_ms`` more of
    processing time. Equal to the batch enrichers where batches arrive in event order.
    """
    user = blank_to_null(F.get_json_object("data", f"$.{user_field}"))
    started = _with_runs(df, user, True, session_ms, session_ms + slack_ms, "__start")
    name = F.concat(F.lit("session_"), user, F.lit("_"), F.floor(F.col("__start") / 1000).cast("string"))
    typed = _with_runs(enrich.add_metadata(started, {"session_id": name}).drop("__start"), F.col("type"), False, idle_ms, idle_ms + slack_ms, "__n")
    typed = enrich.add_metadata(typed, {"event_count": F.col("__n")}).drop("__n")
    sourced = _with_runs(typed, F.col("source"), False, idle_ms, idle_ms + slack_ms, "__n")
    return enrich.add_metadata(sourced, {"source_count": F.col("__n")}).drop("__n")


def deduplicated(df: DataFrame, delay: str, ts: str = "timestamp") -> DataFrame:
    """The first event of each id, with state kept for ``delay``; events without id are no copies and pass."""
    timed = df.withWatermark(ts, delay)
    return timed.where(F.col("id").isNotNull()).dropDuplicatesWithinWatermark(["id"]).unionByName(timed.where(F.col("id").isNull()))


def tumbling(df: DataFrame, by: str, window: str, delay: str, slide: str | None = None) -> DataFrame:
    """Counts per ``by`` and event-time window."""
    w = F.window("timestamp", window, slide) if slide else F.window("timestamp", window)
    return df.withWatermark("timestamp", delay).groupBy(w, by).agg(F.count(F.lit(1)).alias("count")).select(
        F.col("window.start").alias("window_start"), by, "count")


def gap_sessions(df: DataFrame, user: str, gap: str, delay: str) -> DataFrame:
    """Sessions that end after ``gap`` without an event. Events exactly one gap apart fall into one session here."""
    return df.withWatermark("timestamp", delay).groupBy(F.session_window("timestamp", gap).alias("s"), user).agg(
        F.count(F.lit(1)).alias("events")).select(user, F.col("s.start").alias("session_start"), "events")


def split_late(df: DataFrame, ts: str, delay: str, on_time: Sink, late: Sink, marks: str, checkpoint: str, every: str | None = "5 seconds") -> StreamingQuery:
    """Hand rows at or before the watermark to ``late``, and all others to ``on_time``, from where stateful jobs with that delay lose none of them.

    The watermark of a batch is the greatest time of the batches before it less ``delay``. It is kept in ``marks``, one small file a batch, of which the last few stay;
    so a replayed batch is split alike. Rows without time are on time.
    """
    lag = F.expr(f"interval {delay}")

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        seen = spark.read.schema("top long, batch long").parquet(marks).where(F.col("batch") < batch_id).agg(F.max("top")).first()[0]
        rows = batch.persist()
        try:
            behind = F.lit(False) if seen is None else F.coalesce(F.col(ts) <= F.timestamp_micros(F.lit(seen)) - lag, F.lit(False))
            late(rows.where(behind), batch_id)
            on_time(rows.where(~behind), batch_id)
            top = rows.agg(F.greatest(F.max(F.unix_micros(ts)), F.lit(seen).cast("long")).alias("top"))
            top.coalesce(1).write.mode("overwrite").parquet(f"{marks}/batch={batch_id}")
            event_table.delete(spark, f"{marks}/batch={batch_id - KEPT_MARKS}")
        finally:
            rows.unpersist()

    df.sparkSession.createDataFrame([], "top long").write.mode("overwrite").parquet(f"{marks}/batch=-1")
    return micro_batches(df, write, checkpoint, every)


def late_sink(path: str, now: Callable[[], Column] = F.current_timestamp) -> Sink:
    """Late events (``id`` and others) as dead letters, a folder a batch."""
    def write(df: DataFrame, batch: int) -> None:
        dlq.capture(df, F.lit("behind the watermark"), F.lit("late"), now()).write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return write


def count_hits(df: DataFrame, write: Sink, carries: str, checkpoint: str, idle_ms: int = 3_600_000, every: str | None = "5 seconds",
               skew: Skew = DEFAULT_SKEW) -> StreamingQuery:
    """Add ``event_count`` and ``source_count`` to a stream of events, as ``enrich.hit_counters`` does, however few types and sources there are.

    A micro-batch is counted by the batch operator, which spreads a crowded key over time slices; one row per type and source, kept in ``carries`` by batch, brings the
    counts so far. So no key is counted in one task. Equal to the batch counters where batches arrive in event order; a replayed batch counts alike. Counts idle for
    twice ``idle_ms`` are forgotten. Events without type or source get null.
    """
    schema = "key string, kind string, last long, n long, batch long"

    def counted(rows: DataFrame, carry: DataFrame, key: str, out: str) -> DataFrame:
        fresh = rows.where(F.col(key).isNotNull()).withColumns({"own_n": F.lit(1).cast("long"), "own_new": F.lit(True)})
        tail = carry.where(F.col("kind") == key).select(F.col("key").alias(key), F.col("last").alias("own_ms"), F.col("n").alias("own_n"), F.lit(False).alias("own_new"))
        ties = ["own_new", "id"]
        runs = gap_runs(fresh.unionByName(tail, allowMissingColumns=True), [key], "own_ms", idle_ms, ties, "own_run", "own_pos", skew)
        added = running(runs, [key, "own_run"], "own_ms", {out: ("sum", F.col("own_n"))}, ties, "rows", skew).where("own_new").select(*rows.columns, out)
        return added.unionByName(rows.where(F.col(key).isNull()), allowMissingColumns=True)

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        kept = spark.read.schema(schema).parquet(carries).where(F.col("batch") < batch_id)
        before = kept.where(F.col("batch") == (kept.agg(F.max("batch")).first()[0])).drop("batch")
        rows = batch.withColumn("own_ms", F.floor(F.unix_micros("timestamp") / 1000))
        done = counted(counted(rows, before, "type", "event_count"), before, "source", "source_count").persist()
        try:
            write(done.drop("own_ms"), batch_id)
            newest = [done.where(F.col(k).isNotNull()).select(F.col(k).alias("key"), F.lit(k).alias("kind"), F.col("own_ms").alias("last"), F.col(n).alias("n"))
                      for k, n in (("type", "event_count"), ("source", "source_count"))]
            states = before.unionByName(newest[0]).unionByName(newest[1]).groupBy("kind", "key").agg(F.max(F.struct("last", "n")).alias("s")).select("key", "kind", "s.*")
            newest_ms = done.agg(F.max("own_ms")).first()[0]
            states.where(F.lit(newest_ms) - F.col("last") < 2 * idle_ms).coalesce(1).write.mode("overwrite").parquet(f"{carries}/batch={batch_id}")
            event_table.delete(spark, f"{carries}/batch={batch_id - KEPT_MARKS}")
        finally:
            done.unpersist()

    df.sparkSession.createDataFrame([], schema.rsplit(",", 1)[0]).write.mode("overwrite").parquet(f"{carries}/batch=-1")
    return micro_batches(df, run, checkpoint, every)


def live_stats(df: DataFrame, write: Sink, checkpoint: str, by: str = "type", seconds: int = 60, every: str | None = "2 seconds",
               delay: str = "1 hour") -> StreamingQuery:
    """The stats feed: changed counters every two seconds. Windows older than the watermark are dropped from the state."""
    counts = df.withWatermark("timestamp", delay).groupBy(F.window("timestamp", f"{seconds} seconds").alias("w"), by).agg(
        F.count(F.lit(1)).alias("count")).select(F.col("w.start").alias("window_start"), by, "count")
    return micro_batches(counts, write, checkpoint, every, "update")


def event_feed(df: DataFrame, write: Sink, checkpoint: str, subscribed_type: str | None = None, every: str | None = "2 seconds") -> StreamingQuery:
    """Events of one type, or all, to a subscriber."""
    return micro_batches(events.feed(df, subscribed_type), write, checkpoint, every)


def routed(df: DataFrame, routes: Mapping[str, Column], sinks: Mapping[str, Sink], checkpoint: str, every: str | None = "5 seconds") -> StreamingQuery:
    """Send each event to the sink of the first route it matches; ``default`` takes the rest."""
    def write(batch: DataFrame, batch_id: int) -> None:
        named = events.route(batch, routes).persist()
        try:
            for name, sink in sinks.items():
                sink(named.where(F.col("route") == name).drop("route"), batch_id)
        finally:
            named.unpersist()

    return micro_batches(df, write, checkpoint, every)


def with_distinct_features(df: DataFrame, key: str, specs: Sequence[Sliding], counted: Column | None = None, order: str = "arrival", delay: str = "1 minute",
                           idle_ms: int | None = None) -> DataFrame:
    """Add the distinct counts of ``specs`` per ``key`` to a stream of transactions (``ts``, ``ts_ms``, atomic columns).

    ``order="event_time"`` holds rows back until the watermark has passed them and equals the batch columns; state goes when its last value has left. It must be
    the last stateful step of a job. ``order="arrival"`` counts each micro-batch at once, sorted in itself, and may be followed by others; with ``idle_ms``
    state goes after so much processing time. Rows without key, and those where ``counted`` is not true, get null and are not counted.
    """
    # Names that begin with an underscore do not reach a processor.
    mine = F.col(key).isNotNull() & (F.lit(True) if counted is None else F.coalesce(counted, F.lit(False)))
    rows = df.withColumns({"own_counted": mine, "own_key": _state_key(F.col(key), F.col("transaction_id"))})
    found = _with_state(rows, ", ".join(f"{s.name} long" for s in specs), lambda schema, output: state.DistinctProcessor(schema, output, specs, "own_counted", order, idle_ms),
                        order, "ts", delay, idle_ms)
    return found.select(*df.columns, *(s.name for s in specs))


def _state_key(key: Column, row_id: Column) -> Column:
    """The key as text; a row without key is a key of its own, so that such rows share no task."""
    return F.coalesce(key.cast("string"), F.concat(F.lit("\0"), F.coalesce(row_id.cast("string"), F.lit(""))))


def _with_state(rows: DataFrame, added: str, processor: Callable[[T.StructType, T.StructType], StatefulProcessor], order: str, ts: str, delay: str,
                idle_ms: int | None) -> DataFrame:
    """Run rows through a processor per ``own_key`` that hands their columns on and adds those of ``added``."""
    timed = order == "event_time"
    if timed:
        known = F.col("event_ms") if "event_ms" in rows.columns else F.lit(0)
        rows = rows.withColumn("event_ms", F.coalesce(F.unix_millis(ts), known, F.lit(0))).withWatermark(ts, delay)
    # The watermark's column stays beside the microseconds that travel.
    micros = state.without_timestamps(rows)
    if timed:
        micros = rows.select(F.col(ts).alias("own_ts"), *(F.unix_micros(f.name).alias(f.name) if isinstance(f.dataType, T.TimestampType) else F.col(f.name) for f in rows.schema.fields))
    schema = T.StructType([f for f in micros.schema.fields if f.name not in ("own_key", "own_ts")])
    output = T.StructType([*schema.fields, *T.StructType.fromDDL(added).fields])
    mode = "EventTime" if timed else "ProcessingTime" if idle_ms else "None"
    out = micros.groupBy("own_key").transformWithStateInPandas(processor(schema, output), outputStructType=output, outputMode="Append", timeMode=mode)
    return state.with_timestamps(out, rows.schema)


def admitted(df: DataFrame, client: str, rate: int, window_ms: int = 1000, weight: str | None = None, resets: DataFrame | None = None, row_id: str = "id",
             ts: str = "timestamp", order: str = "arrival", delay: str = "1 minute", idle_ms: int | None = None) -> DataFrame:
    """Rate-limit a stream of requests (``ts_ms``, ``ts``, atomic columns): add ``window_start``, ``used`` and ``allowed``, as ``admit_anchored`` does.

    ``resets`` is a stream of (client, ts_ms, ts): a reset empties the client's window for requests from its time on. ``order="arrival"`` admits each micro-batch
    at once, sorted in itself, and drops a client's state after ``idle_ms`` of processing time; ``order="event_time"`` holds requests back until the watermark has passed
    them, drops state once its window is over, and must be the last stateful step. Requests without client or time are allowed and use up no window.
    """
    cost = F.coalesce(F.col(weight).cast("long"), F.lit(0)) if weight else F.lit(1)
    rows = df.withColumns({"own_request": F.lit(1), "own_weight": cost.cast("long")})
    if resets is not None:
        # Commands have no time for the watermark, so they neither move it nor fall behind it.
        marks = resets.where(F.col(client).isNotNull() & F.col("ts_ms").isNotNull()).select(
            client, "ts_ms", F.lit(None).cast("timestamp").alias(ts), F.unix_millis(ts).alias("event_ms"), F.lit(0).alias("own_request"))
        rows = rows.withColumn("event_ms", F.unix_millis(ts)).unionByName(marks, allowMissingColumns=True)
    rows = rows.withColumns({"own_named": F.col(client).isNotNull() & F.col("ts_ms").isNotNull(), "own_key": _state_key(F.col(client), F.col(row_id))})
    added = "window_start long, used long, allowed boolean"
    found = _with_state(rows, added, lambda schema, output: state.AdmissionProcessor(schema, output, order, idle_ms, rate, window_ms, [row_id]), order, ts, delay, idle_ms)
    return found.select(*df.columns, "window_start", "used", "allowed")


def token_bucket(df: DataFrame, client: str, rate: float, burst: int, row_id: str = "id", ts: str = "timestamp", order: str = "arrival", delay: str = "1 minute",
                 idle_ms: int | None = None) -> DataFrame:
    """Token buckets over a stream of requests: add ``allowed`` and ``tokens``, as the batch operator does; ``order`` and ``idle_ms`` as in :func:`admitted`.

    In event order a bucket's state goes once it is full again.
    """
    rows = df.withColumns({"own_named": F.col(client).isNotNull() & F.col("ts_ms").isNotNull(), "own_key": _state_key(F.col(client), F.col(row_id))})
    found = _with_state(rows, "allowed boolean, tokens double", lambda schema, output: state.BucketProcessor(schema, output, order, idle_ms, rate, burst, [row_id]),
                        order, ts, delay, idle_ms)
    return found.select(*df.columns, "allowed", "tokens")


def customer_and_device_features(tx: DataFrame, counted: Column | None = None, **how: object) -> DataFrame:
    """The 30-day distinct features of customers and devices, in order of arrival."""
    return with_distinct_features(with_distinct_features(tx, "customer_id", CUSTOMER, counted, **how), "device_id", DEVICE, counted, **how)


def decisions(
    tx: DataFrame,
    rules: Sequence[Rule] = DEFAULT_RULES,
    thresholds: Thresholds = DEFAULT_THRESHOLDS,
    block_ttl_ms: int | None = 86_400_000,
    custom_limits: DataFrame | None = None,
    default_limits: Limits = DEFAULT_LIMITS,
    merchants: DataFrame | None = None,
    order: str = "arrival",
    delay: str = "1 minute",
    commands: DataFrame | None = None,
    features: bool = True,
    idle_ms: int | None = None,
    rule_versions: str | None = None,
) -> DataFrame:
    """Full banking decisions over a stream of transactions, one state per card.

    ``tx`` has the transaction columns and ``ts``. Customer and device features are computed on the way, in order of arrival, unless ``tx`` brings them or ``features``
    is off. Merchant risk and limits are static tables joined to each micro-batch. ``commands`` is a stream of blocks and unblocks (card_id, ts_ms, seq,
    command, ts); they are kept as the card's state, and come before transactions of their time. They neither move the watermark nor fall behind it. ``order="event_time"`` decides rows in event order as the watermark
    passes them and drops a card's state when nothing of it matters any more; ``order="arrival"`` decides each micro-batch at once, and drops state after ``idle_ms``
    of processing time. ``rules`` are fixed while the query runs; ``rule_versions`` names a shared folder of versions instead (``rules.publish_rules``), to which
    versions may be added meanwhile. A row is decided by the version of its own time, so one must be published before the first row of its time is decided; then a
    batch that is replayed decides alike.
    """
    tx = tx.withColumn("precheck_reason", precheck_reason())
    missing = features and not any(s.name in tx.columns for s in (*CUSTOMER, *DEVICE))
    if missing:
        tx = customer_and_device_features(tx, F.col("precheck_reason").isNull(), idle_ms=idle_ms if order == "arrival" else None)
    rows = with_periods(with_limits(with_baselines(tx, None, merchants), custom_limits, default_limits))
    # The log of commands as of each row may come with the transactions, as for instance from a join to the log's table.
    rows = rows.withColumns({c: F.lit(None).cast("long") for c in ("manual_block_ms", "unblock_ms") if c not in rows.columns})
    outer = outer_features(rows.columns)
    rows = rows.select(*STEP_INPUTS, *outer, "ts", F.lit(None).cast("string").alias("command"), F.lit(None).cast("long").alias("seq"), F.lit(1).alias("command_first"))
    if commands is not None:
        log = commands.select("card_id", F.col("ts_ms").cast("long").alias("ts_ms"), F.col("seq").cast("long").alias("seq"), "command",
                              F.lit(None).cast("timestamp").alias("ts"), F.unix_millis("ts").alias("event_ms"), F.lit(0).alias("command_first"))
        rows = rows.withColumn("event_ms", F.unix_millis("ts")).unionByName(log, allowMissingColumns=True)
    else:
        rows = rows.withColumn("event_ms", F.unix_millis("ts"))
    rows = rows.withColumn("event_ms", F.coalesce("event_ms", F.lit(0)))
    if order == "event_time":
        rows = rows.withWatermark("ts", delay)
    schema = T.StructType([f for f in rows.schema.fields if f.name != "ts"])
    processor = state.CardProcessor(schema, card_step(rules, thresholds, block_ttl_ms, outer), outer, order, block_ttl_ms, idle_ms,
                                    None if rule_versions is None else lambda: valid_from(read_versions(rule_versions)))
    mode = "EventTime" if order == "event_time" else "ProcessingTime" if idle_ms else "None"
    return rows.groupBy("card_id").transformWithStateInPandas(processor, outputStructType=processor.output, outputMode="Append", timeMode=mode)


def stateless_decisions(tx: DataFrame, rules_path: str, decide_batch: Callable[[DataFrame, list[Rule]], DataFrame], write: Sink,
                        checkpoint: str, every: str | None = "5 seconds") -> StreamingQuery:
    """Decide each micro-batch with the rules read anew, so that edited rules take effect with the next batch."""
    def run(batch: DataFrame, batch_id: int) -> None:
        write(decide_batch(batch, load_rules(batch.sparkSession, rules_path)), batch_id)

    return micro_batches(tx, run, checkpoint, every)


def transactions_from_topic(raw: DataFrame, accept: Sink, dead_letters: Sink, checkpoint: str, every: str | None = "5 seconds") -> StreamingQuery:
    """Decode transaction payloads (column ``value``): good ones as feature contexts to ``accept``, bad ones to ``dead_letters``.

    A bad payload never holds up the batch. ``accept`` usually appends to the table the decision job reads.
    """
    def run(batch: DataFrame, batch_id: int) -> None:
        good, bad = split_decoded(decode(batch.select("value")))
        accept(transaction_context(events.default_timestamp(good, F.current_timestamp())), batch_id)
        dead_letters(bad, batch_id)

    return micro_batches(raw, run, checkpoint, every)


def with_retry_delays(failures: DataFrame, tiers: Sequence[int] = dlq.RETRY_TIERS, max_retries: int = dlq.MAX_RETRIES) -> DataFrame:
    """Open rows of a stream of ledger rows, each once the delay of its next retry is over in processing time. Rows wait in the state of their event."""
    count = F.coalesce("retry_count", F.lit(0))
    due = dlq.later(F.coalesce("last_retry_at", "failed_at"), dlq.tier_seconds(count + 1, tiers))
    key = F.coalesce(blank_to_null(F.col("id")), F.sha2(F.coalesce("payload", F.lit("")), 256))
    rows = failures.where(~F.coalesce("recovered", F.lit(False)) & (count < max_retries)).select(
        *(c for c in DEAD_LETTER.names if c not in ("recovered", "next_retry_at", "retry_count")), count.alias("retry_count"), due.alias("next_retry_at"),
        key.alias("own_key"), F.coalesce(F.unix_millis(due), F.lit(0)).alias("due_ms"))
    schema = T.StructType([f for f in state.without_timestamps(rows).schema.fields if f.name != "own_key"])
    released = state.without_timestamps(rows).groupBy("own_key").transformWithStateInPandas(
        state.DelayProcessor(schema), outputStructType=schema, outputMode="Append", timeMode="ProcessingTime")
    return state.with_timestamps(released, rows.schema).select(
        *(F.lit(False).alias(c) if c == "recovered" else F.col(c) for c in DEAD_LETTER.names))


def retry_loop(failures: DataFrame, attempt: Callable[[DataFrame], Column], accept: Sink, ledger: Sink, retries_path: str, checkpoint: str,
               tiers: Sequence[int] = dlq.RETRY_TIERS, max_retries: int = dlq.MAX_RETRIES, every: str | None = "5 seconds") -> StreamingQuery:
    """Replay failed events after their delays, until they succeed or have failed ``max_retries`` times.

    ``failures`` is a stream of ledger rows, as :func:`ingest` writes them. ``attempt`` gives for released rows whether the replay works; those go to
    ``accept``, which stores them by batch number. Rows that failed again go to ``retries_path``, which this job reads as its second source, as a retry topic.
    Rows that are done, recovered or exhausted, go to ``ledger``. Each batch is written to folders of its own, so one that is replayed overwrites itself.
    """
    spark = failures.sparkSession
    spark.createDataFrame([], DEAD_LETTER).write.mode("append").parquet(f"{retries_path}/none")
    again = spark.readStream.schema(DEAD_LETTER).option("recursiveFileLookup", "true").parquet(retries_path)

    def write(batch: DataFrame, batch_id: int) -> None:
        at = F.lit(batch.sparkSession.range(1).select(F.current_timestamp()).first()[0])
        ran = dlq.attempted(batch, attempt(batch), at, lambda n: dlq.tier_seconds(n, tiers), max_retries).persist()
        try:
            done = F.col("recovered") | (F.col("retry_count") >= max_retries)
            accept(ran.where("recovered"), batch_id)
            ledger(ran.where(done), batch_id)
            ran.where(~done).write.mode("overwrite").parquet(f"{retries_path}/batch-{batch_id}")
        finally:
            ran.unpersist()

    rows = failures.select(*DEAD_LETTER.names).unionByName(again)
    return micro_batches(with_retry_delays(rows, tiers, max_retries), write, checkpoint, every)


class PipelineCounters(StreamingQueryListener):
    """Counters of every job of a session, added up report by report, so that no number of batches is too long for them.

    Register with ``spark.streams.addListener``; reports arrive shortly after their batch. Late rows are those that stateful operators
    dropped behind the watermark; ``observed`` adds up the metrics of ``observe`` (such as rows written or rejected).
    """

    def __init__(self) -> None:
        self._lock = threading.Lock()
        self._jobs: dict[str, dict[str, float]] = {}

    def onQueryStarted(self, event) -> None:
        with self._lock:
            self._jobs.setdefault(str(event.id), dict.fromkeys(("batches", "rows", "ms", "late_rows", "errors"), 0))

    def onQueryProgress(self, event) -> None:
        p = event.progress
        with self._lock:
            job = self._jobs.setdefault(str(p.id), dict.fromkeys(("batches", "rows", "ms", "late_rows", "errors"), 0))
            job["batches"] += 1
            job["rows"] += p.numInputRows
            job["ms"] += p.durationMs.get("triggerExecution", 0)
            job["late_rows"] += sum(o.numRowsDroppedByWatermark for o in p.stateOperators)
            for row in p.observedMetrics.values():
                for name, value in row.asDict().items():
                    job[name] = job.get(name, 0) + (value or 0)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        with self._lock:
            if event.exception and str(event.id) in self._jobs:
                self._jobs[str(event.id)]["errors"] += 1

    def of(self, query: StreamingQuery) -> dict[str, float]:
        """batches, rows, rows_per_second, late_rows, errors (failed runs) and observed metrics of a job."""
        with self._lock:
            job = dict(self._jobs.get(str(query.id), dict.fromkeys(("batches", "rows", "ms", "late_rows", "errors"), 0)))
        ms = job.pop("ms")
        return {**job, "rows_per_second": job["rows"] * 1000.0 / ms if ms else 0.0}
