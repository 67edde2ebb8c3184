"""Streaming jobs give the batch result over the same files."""

import json
import os
import time

import pytest
from pyspark.sql import functions as F

from txguard.plans import banking, dlq, enrich, features
from txguard.plans.limits import Limits
from txguard.plans.engine import precheck_reason
from txguard.schemas import DEAD_LETTER
from txguard.sources import event_table, tables
from txguard.sources.storage import read_json_events
from txguard.streaming import jobs

SF = "/root/testdata/sf0.001"
LIMITS = Limits(150.0, 200.0, 1500.0)


@pytest.fixture(scope="module")
def split(spark, tmp_path_factory):
    """The transactions as several files, in time order."""
    root = tmp_path_factory.mktemp("split")
    tx = tables.transactions(spark, SF)
    tx.repartitionByRange(4, "ts_ms").sortWithinPartitions("ts_ms").write.parquet(str(root / "tx"))
    ev = tables.events(spark, SF).select("id", "type", "source", "timestamp")
    ev.repartitionByRange(4, "timestamp").write.parquet(str(root / "ev"))
    # The file source takes files by modification time.
    for folder in ("tx", "ev"):
        for i, f in enumerate(sorted((root / folder).glob("*.parquet"))):
            os.utime(f, (1_700_000_000 + i * 10, 1_700_000_000 + i * 10))
    return root


def stream(spark, path, files=1):
    schema = spark.read.parquet(str(path)).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(str(path))


def run(df, spark, tmp_path, mode="append"):
    out = str(tmp_path / "out")
    jobs.micro_batches(df, jobs.batch_folder(out), str(tmp_path / "ckpt"), None, mode).awaitTermination()
    return spark.read.parquet(out)


def decided(df):
    return {r["transaction_id"]: (r["status"], r["limit_reason"], r["risk_score"], r["action"], tuple(r["triggered_rules"]))
            for r in df.collect()}


def batch_features(spark):
    """The batch columns, rows that fail a pre-check apart."""
    tx = tables.transactions(spark, SF)
    return {r["transaction_id"]: (r["customer__device_count"], r["customer__country_count"], r["device__card_count"]) for r in banking.prepare(tx).collect()}


def batch_decisions(spark, commands=None, **how):
    return banking.decide_in_order(banking.prepare(tables.transactions(spark, SF), default_limits=LIMITS, commands=commands), **how)


def test_customer_and_device_features_over_batches(spark, split, tmp_path):
    want = batch_features(spark)
    names = ["customer__device_count", "customer__country_count", "device__card_count"]
    checked = stream(spark, split / "tx").withColumn("precheck_reason", precheck_reason())
    out = run(jobs.customer_and_device_features(checked, F.col("precheck_reason").isNull()), spark, tmp_path / "a")
    got = {r["transaction_id"]: tuple(r[n] for n in names) for r in out.collect()}
    named = {r["transaction_id"] for r in tables.transactions(spark, SF).where("customer_id is not null and device_id is not null").collect()}
    assert got.keys() == want.keys() and len(named) > 500 and all(got[k] == want[k] for k in named)
    # Timestamps come through to the microsecond.
    stamps = {r["transaction_id"]: r["us"] for r in tables.transactions(spark, SF).select("transaction_id", F.unix_micros("ts").alias("us")).collect()}
    assert stamps == {r["transaction_id"]: r["us"] for r in out.select("transaction_id", F.unix_micros("ts").alias("us")).collect()}
    # In event order, whatever the order of arrival within the delay.
    timed = jobs.with_distinct_features(checked, "customer_id", features.CUSTOMER, F.col("precheck_reason").isNull(), "event_time", "0 seconds")
    held = {r["transaction_id"]: tuple(r[n] for n in names[:2]) for r in run(timed, spark, tmp_path / "b").collect()}
    assert len(held) > 0.7 * len(want) and all(held[k] == want[k][:2] for k in held if k in named)


def test_commands_in_the_stream(spark, split, tmp_path):
    """Blocks and unblocks arrive as a stream of their own; decisions equal the batch ones over the whole log."""
    tx = tables.transactions(spark, SF)
    log = tx.where("pmod(xxhash64(transaction_id), 7) = 0").select(
        "card_id", (F.col("ts_ms") - 1).alias("ts_ms"), F.xxhash64("transaction_id").alias("seq"), F.when(F.pmod(F.xxhash64("transaction_id"), F.lit(3)) == 0, "unblock").otherwise("block").alias("command"),
        (F.col("ts") - F.expr("interval 1 millisecond")).alias("ts"))
    bounds = [r[0] for r in spark.read.parquet(str(split / "tx")).groupBy(F.input_file_name()).agg(F.max("ts_ms").alias("m")).orderBy("m").select("m").collect()]
    (tmp_path / "log").mkdir()
    for i, high in enumerate(bounds):
        low = bounds[i - 1] if i else -1
        part = tmp_path / "part" / str(i)
        log.where(f"ts_ms > {low} and ts_ms <= {high}").coalesce(1).write.parquet(str(part))
        file = next(part.glob("*.parquet"))
        file.rename(tmp_path / "log" / f"{i}.parquet")
        os.utime(tmp_path / "log" / f"{i}.parquet", (1_700_000_000 + i * 10, 1_700_000_000 + i * 10))
    want = decided(batch_decisions(spark, log, block_ttl_ms=600_000))
    calm = decided(batch_decisions(spark, block_ttl_ms=600_000))
    out = run(jobs.decisions(stream(spark, split / "tx"), default_limits=LIMITS, block_ttl_ms=600_000, commands=stream(spark, tmp_path / "log")), spark, tmp_path / "c")
    got = decided(out)
    assert got.keys() == want.keys() and sum(want[k] != calm[k] for k in want) > 20
    assert [(k, want[k], got[k]) for k in want if want[k] != got[k]] == []


def test_decisions_by_arrival(spark, split, tmp_path):
    out = run(jobs.decisions(stream(spark, split / "tx"), default_limits=LIMITS), spark, tmp_path)
    got, want = decided(out), decided(batch_decisions(spark))
    assert len(got) == len(want)
    assert [(k, want[k], got[k]) for k in want if want[k] != got[k]] == []


def test_decisions_by_event_time(spark, split, tmp_path):
    df = jobs.decisions(stream(spark, split / "tx"), default_limits=LIMITS, order="event_time", delay="0 seconds")
    got, want = decided(run(df, spark, tmp_path)), decided(batch_decisions(spark))
    assert len(got) > 0.7 * len(want)  # the tail waits for the watermark
    assert all(want[k] == v for k, v in got.items())


def test_tumbling_counts(spark, split, tmp_path):
    out = run(jobs.tumbling(stream(spark, split / "ev"), "type", "1 hour", "1 hour"), spark, tmp_path)
    got = {(r[0], r[1]): r[2] for r in out.select("window_start", "type", "count").collect()}
    want = {}
    for r in tables.events(spark, SF).groupBy(F.window("timestamp", "1 hour").start.alias("w"), "type").count().collect():
        want[(r[0], r[1])] = r[2]
    assert len(got) >= len(want) - 20 and all(want[k] == v for k, v in got.items())


def test_dedup_and_feed(spark, split, tmp_path):
    twice = stream(spark, split / "ev").unionByName(stream(spark, split / "ev"))
    out = run(jobs.deduplicated(twice, "1 hour"), spark, tmp_path)
    assert out.count() == 1000 == out.select("id").distinct().count()


def test_live_stats_keep_the_last_count(spark, split, tmp_path):
    last = {}

    def write(df, batch):
        for r in df.collect():
            last[(r["window_start"], r["type"])] = r["count"]

    jobs.live_stats(stream(spark, split / "ev"), write, str(tmp_path / "c"), seconds=86400, every=None).awaitTermination()
    assert sum(last.values()) == 1000


def test_ingest_and_routes(spark, tmp_path):
    src = tmp_path / "src"
    src.mkdir()
    good = [{"id": f"e{i}", "type": "view", "source": "web", "timestamp": "2024-01-05T00:00:00Z", "data": "{}"} for i in range(5)]
    lines = [json.dumps(e) for e in good] + ['{"id": "", "type": "view"}', '{"id": "x", "type": null}', "{not json"]
    (src / "a.json").write_text("\n".join(lines))
    raw = read_json_events(spark, str(src), streaming=True)
    jobs.ingest(raw, str(tmp_path / "ev"), str(tmp_path / "dlq"), str(tmp_path / "c"), every=None).awaitTermination()
    stored, dead = event_table.read(spark, str(tmp_path / "ev")), spark.read.parquet(str(tmp_path / "dlq"))
    assert stored.count() == 5 and {r[0] for r in stored.select("yyyymm").collect()} == {"202401"}
    assert sorted(r["error"] for r in dead.collect()) == ["cannot decode payload", "event id is required", "event type is required"]
    assert "{not json" in {r["payload"] for r in dead.collect()}
    assert dlq.schedule(dead).where("state = 'waiting'").count() == 3
    again = dlq.retry(dead, lambda due: F.col("id") == "x", F.expr("timestamp_seconds(unix_seconds(current_timestamp()) + 3600)"))
    assert {r["recovered"] for r in again.where("id = 'x'").collect()} == {True}
    with pytest.raises(ValueError):
        jobs.ingest(raw, "e", "d", "c", [enrich.counters()])

    seen = {}
    routes = {"a": F.col("id") == "e1"}
    sinks = {n: (lambda n: lambda df, b: seen.setdefault(n, []).extend(r["id"] for r in df.collect()))(n) for n in ("a", "default")}
    jobs.routed(read_json_events(spark, str(src), streaming=True), routes, sinks, str(tmp_path / "c2"), None).awaitTermination()
    assert seen["a"] == ["e1"] and "e1" not in seen["default"] and len(seen["default"]) >= 6


def test_rules_reload_between_batches(spark, split, tmp_path):
    path = tmp_path / "rules.json"

    def save(points):
        path.write_text(json.dumps([{"id": "r", "name": "n", "priority": 1, "risk_points": points, "action": "alert",
                                     "reason_code": "R", "enabled": True,
                                     "conditions": [{"feature": "amount", "operator": ">", "threshold": 0}]}]))

    seen = []
    save(100)

    def decide_batch(batch, loaded):
        from txguard.plans.scoring import score
        return score(batch, loaded)

    def write(df, batch):
        seen.append(df.agg(F.max("risk_score")).first()[0])
        save(200)

    jobs.stateless_decisions(stream(spark, split / "tx"), str(path), decide_batch, write, str(tmp_path / "c"), None).awaitTermination()
    assert seen[0] == 100 and seen[-1] == 200 and len(seen) == 4


def test_bad_payloads_do_not_hold_up_the_topic(spark, tmp_path):
    src = tmp_path / "src"
    src.mkdir()
    tx = {"transaction_id": "t1", "card_number": "4532", "amount": 5000.0, "timestamp": "2024-01-05T14:00:00Z", "device_id": "",
          "location": {"country": "RU", "city": "Moscow"}}
    (src / "a.txt").write_text(json.dumps(tx) + "\nnot json\n")
    raw = spark.readStream.schema("value string").text(str(src))
    out, dead = str(tmp_path / "ok"), str(tmp_path / "dead")
    jobs.transactions_from_topic(raw, jobs.batch_folder(out), jobs.batch_folder(dead), str(tmp_path / "c"), None).awaitTermination()
    row = spark.read.parquet(out).first()
    assert (row["card_id"], row["country"], row["device_id"], row["ts_ms"]) == ("4532", "RU", None, 1704463200000)
    assert [r["payload"] for r in spark.read.parquet(dead).collect()] == ["not json"]


def test_counters_add_up_beyond_the_kept_reports(spark, tmp_path):
    src = tmp_path / "many"
    src.mkdir()
    for i in range(110):
        (src / f"{i:03d}.json").write_text(f'{{"id": {i}}}\n{{"id": {i}}}\n')
    listener = jobs.PipelineCounters()
    spark.streams.addListener(listener)
    try:
        raw = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).json(str(src)).observe("written", F.count(F.lit(1)).alias("events_written"))
        query = jobs.micro_batches(raw, lambda df, b: df.write.format("noop").mode("overwrite").save(), str(tmp_path / "cc"), None)
        query.awaitTermination()
        for _ in range(100):
            if listener.of(query)["batches"] >= 110:
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(listener)
    got = listener.of(query)
    assert (got["batches"], got["rows"], got["events_written"], got["late_rows"]) == (110, 220, 220, 0) and got["rows_per_second"] > 0


def test_null_ids_are_no_copies(spark, tmp_path):
    src = tmp_path / "ids"
    src.mkdir()
    (src / "a.json").write_text("".join(json.dumps({"id": i, "timestamp": "2024-01-05T00:00:00Z"}) + "\n" for i in ("a", "a", None, None)))
    stream_of = spark.readStream.schema("id string, timestamp timestamp").json(str(src))
    assert sorted(str(r["id"]) for r in run(jobs.deduplicated(stream_of, "1 hour"), spark, tmp_path).collect()) == ["None", "None", "a"]


def test_stateful_enrichment_over_batches(spark, tmp_path):
    ev = tables.events(spark, SF).select(
        "id", "type", "source", "timestamp", F.to_json(F.struct(F.when(F.col("user_id") % 5 != 0, F.col("user_id").cast("string")).alias("user_id"))).alias("data"),
        F.create_map(F.lit("old"), F.col("id")).alias("metadata"))
    ev.repartitionByRange(3, "timestamp").sortWithinPartitions("timestamp").write.parquet(str(tmp_path / "in"))
    for i, f in enumerate(sorted((tmp_path / "in").glob("*.parquet"))):
        os.utime(f, (1_700_000_000 + i * 10, 1_700_000_000 + i * 10))
    seen = str(tmp_path / "out")
    # State with a lifetime keeps an available-now trigger from ending, so the job is stopped once it has read everything.
    query = jobs.micro_batches(jobs.with_sessions_and_counters(stream(spark, tmp_path / "in")), jobs.batch_folder(seen), str(tmp_path / "c"), "1 second")
    try:
        for _ in range(90):
            time.sleep(1)
            if query.exception() or os.path.exists(seen) and spark.read.schema("id string").option("recursiveFileLookup", "true").parquet(seen).count() >= 1000:
                break
    finally:
        query.stop()
    out = spark.read.parquet(seen)
    want = enrich.run_enrichers(ev, [enrich.sessions(), enrich.counters()])
    got, batch = ({r["id"]: r["metadata"] for r in df.select("id", "metadata").collect()} for df in (out, want))
    assert len(got) == 1000 and got == batch


def test_failures_are_retried_until_they_succeed_or_are_exhausted(spark, tmp_path):
    """a works at once, b at the second attempt, c never; d has no id, e was recovered before."""
    now = F.current_timestamp()
    failed = spark.createDataFrame([("a", "{}"), ("b", "{}"), ("c", "{}"), (None, "{"), ("e", "{}")], "id string, payload string")
    failed.select("id", "payload", F.lit("boom").alias("error"), F.lit("web").alias("source"), now.alias("failed_at"), F.lit(0).alias("retry_count"),
                  F.lit(None).cast("timestamp").alias("last_retry_at"), now.alias("next_retry_at"), F.coalesce(F.col("id") == "e", F.lit(False)).alias("recovered")
                  ).select(*DEAD_LETTER.names).coalesce(1).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(DEAD_LETTER).parquet(str(tmp_path / "in"))
    works = lambda rows: (F.col("id") == "a") | ((F.col("id") == "b") & (F.col("retry_count") == 1))
    ok, done = str(tmp_path / "ok"), str(tmp_path / "done")
    query = jobs.retry_loop(source, works, jobs.batch_folder(ok), jobs.batch_folder(done), str(tmp_path / "again"), str(tmp_path / "c"), tiers=(1, 2), every="1 second")
    read = lambda path: spark.read.schema(DEAD_LETTER).option("recursiveFileLookup", "true").parquet(path).collect()
    try:
        for _ in range(90):
            time.sleep(1)
            if query.exception() or os.path.exists(done) and len(read(done)) >= 4:
                break
    finally:
        query.stop()
    ended = {r["id"]: r for r in read(done)}
    assert {k: (r["recovered"], r["retry_count"], r["source"]) for k, r in ended.items()} == {
        "a": (True, 1, "web"), "b": (True, 2, "web_retry"), "c": (False, 3, "web_retry"), None: (False, 3, "web_retry")}
    assert sorted(r["id"] for r in read(ok)) == ["a", "b"] and all(r["next_retry_at"] is None for r in ended.values())
    waited = (ended["c"]["last_retry_at"] - ended["c"]["failed_at"]).total_seconds()
    assert waited >= 1 + 2 + 2


def test_decision_sink(spark, tmp_path):
    made = banking.decide_in_order(banking.prepare(tables.transactions(spark, SF))).limit(50).persist()
    write = jobs.decision_sink(str(tmp_path / "d"))
    write(made, 0)
    write(made, 0)
    write(made.limit(5), 1)
    back = event_table.read(spark, str(tmp_path / "d"), layout=jobs.DECISIONS)
    assert back.count() == 55 and {r["transaction_id"] for r in back.collect()} == {r["transaction_id"] for r in made.collect()}


def test_replay_stores_an_event_once(spark):
    rows = [("x", '{"id":"x","type":"t","timestamp":"2024-01-05T00:00:00.123456Z"}', 1), ("x", '{"id":"x","type":"u"}', 2), ("y", '{"id":"y","type":"t"}', 3),
            ("z", "{broken", 4), (None, '{"type":"t"}', 5), ("n", None, 6)]
    ledger = spark.createDataFrame(rows, "id string, payload string, n int").select(
        "id", "payload", F.lit("e").alias("error"), F.lit("s").alias("source"), F.timestamp_seconds("n").alias("failed_at"), F.lit(3).alias("retry_count"),
        F.lit(None).cast("timestamp").alias("last_retry_at"), F.lit(None).cast("timestamp").alias("next_retry_at"), F.lit(None).cast("boolean").alias("recovered"))
    stored = spark.createDataFrame([("y",)], "id string")
    new, after = dlq.replay(ledger, stored, F.lit("2024-02-01").cast("timestamp"))
    assert [(r["id"], r["type"], r["us"]) for r in new.withColumn("us", F.unix_micros("timestamp")).collect()] == [("x", "t", 1704412800123456)]
    assert sorted((str(r["id"]), r["recovered"]) for r in after.collect()) == [("None", False), ("n", False), ("x", True), ("x", True), ("y", True), ("z", False)]
    assert dlq.replay(after, stored.unionByName(new.select("id")), F.current_timestamp())[0].count() == 0
    assert dlq.replay(ledger.limit(0), stored, F.current_timestamp())[0].count() == 0
