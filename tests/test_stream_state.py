"""State that outlives micro-batches: rate limits, versions of rules, watermarks and counts, against the batch operators."""

import os
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from txguard.operators.folds import admit_anchored, token_bucket
from txguard.operators.skew import Skew
from txguard.plans import banking, enrich, rules
from txguard.plans.limits import Limits
from txguard.sources import tables
from txguard.streaming import jobs

SF = "/root/testdata/sf0.001"
BASE = datetime(2024, 1, 5)
LIMITS = Limits(150.0, 200.0, 1500.0)


def in_files(df, root, order, n=4):
    """``df`` as ``n`` files in order, which the file source takes by modification time."""
    df.repartitionByRange(n, order).sortWithinPartitions(order).write.parquet(str(root))
    for i, f in enumerate(sorted(root.glob("*.parquet"))):
        os.utime(f, (1_700_000_000 + i * 10, 1_700_000_000 + i * 10))
    return root


def stream(spark, path):
    return spark.readStream.schema(spark.read.parquet(str(path)).schema).option("maxFilesPerTrigger", 1).parquet(str(path))


def run(df, spark, tmp_path):
    jobs.micro_batches(df, jobs.batch_folder(str(tmp_path / "out")), str(tmp_path / "ckpt"), None).awaitTermination()
    return spark.read.parquet(str(tmp_path / "out")).drop("batch")


@pytest.fixture(scope="module")
def requests(spark, tmp_path_factory):
    """Requests of few clients at few times, some without client; clashing and extra columns."""
    rows = spark.range(900).select(
        F.col("id").cast("string").alias("id"), F.expr("case when id % 11 <> 0 then concat('c', pmod(xxhash64(id), 5)) end").alias("client"), (F.col("id") * 40).alias("at"),
        (F.col("id") % 3).alias("weight"), F.lit("x").alias("used_before"))
    rows = rows.withColumn("timestamp", F.expr("timestamp'2024-01-05' + make_dt_interval(0, 0, 0, at div 100)")).withColumn("ts_ms", F.unix_millis("timestamp")).drop("at")
    return in_files(rows, tmp_path_factory.mktemp("requests") / "r", "ts_ms")


@pytest.mark.parametrize("order", ["arrival", "event_time"])
def test_anchored_limits(spark, requests, tmp_path, order):
    batch = spark.read.parquet(str(requests))
    marks = batch.where("id % 50 = 7 and client is not null").select("client", "ts_ms", "timestamp")
    in_files(marks, tmp_path / "resets", "ts_ms", 1)
    # All resets come with the first batch; in order of arrival they would empty windows that have not begun.
    resets = stream(spark, tmp_path / "resets") if order == "event_time" else None
    out = run(jobs.admitted(stream(spark, requests), "client", 6, 20_000, "weight", resets, order=order, delay="0 seconds"), spark, tmp_path)
    want = admit_anchored(batch, "client", "ts_ms", 6, 20_000, "weight", marks.select("client", "ts_ms") if resets is not None else None, ["id"])
    columns = ["id", "client", "window_start", "used", "allowed"]
    wanted, got = ({r["id"]: tuple(r) for r in df.select(*columns).collect()} for df in (want, out))
    assert out.columns == [*batch.columns, "window_start", "used", "allowed"]
    assert len(got) == out.count() and (len(got) == 900 if order == "arrival" else len(got) > 600)
    named = {k for k, r in got.items() if r[1] is not None}
    assert all(got[k] == wanted[k] for k in named) and len({got[k][4] for k in named}) == 2
    assert {got[k][2:] for k in got.keys() - named} == {(None, None, True)}


def test_commands_far_ahead_hold_back_and_lose_nothing(spark, tmp_path):
    """All blocks come with the first file; rows of the later files are neither late nor waiting for the last block."""
    tx = tables.transactions(spark, SF).withColumn("ts_ms", F.unix_millis("ts"))
    path = in_files(tx, tmp_path / "tx", "ts_ms")
    log = tx.where("pmod(xxhash64(transaction_id), 9) = 0").select("card_id", (F.col("ts_ms") - 1000).alias("ts_ms"), F.xxhash64("transaction_id").alias("seq"), F.lit("block").alias("command"),
                                                                    (F.col("ts") - F.expr("interval 1 second")).alias("ts"))
    in_files(log, tmp_path / "log", "ts_ms", 1)
    made = jobs.decisions(stream(spark, path), default_limits=LIMITS, block_ttl_ms=2 * 86_400_000, commands=stream(spark, tmp_path / "log"), order="event_time", delay="0 seconds")
    want = banking.decide_in_order(banking.prepare(tx, default_limits=LIMITS, commands=log), block_ttl_ms=2 * 86_400_000)
    got, wanted = ({r["transaction_id"]: (r["status"], r["risk_score"], tuple(r["explain_lines"])) for r in df.collect()} for df in (run(made, spark, tmp_path), want))
    assert [(k, wanted[k], v) for k, v in got.items() if wanted[k] != v] == []
    assert len(got) > 700 and sum("is blocked" in str(v) for v in got.values()) > 20


def test_resets_by_arrival(spark, tmp_path):
    rows = spark.createDataFrame([("1", "a", 0), ("2", "a", 1), ("3", "a", 2), ("4", "a", 3)], "id string, client string, ts_ms long")
    rows = rows.withColumn("timestamp", F.timestamp_millis("ts_ms"))
    in_files(rows, tmp_path / "in", "ts_ms", 1)
    in_files(rows.where("id = '3'").drop("id").unionByName(rows.where("id = '3'").drop("id").withColumn("client", F.lit(None).cast("string"))), tmp_path / "resets", "ts_ms", 1)
    out = run(jobs.admitted(stream(spark, tmp_path / "in"), "client", 1, 1000, resets=stream(spark, tmp_path / "resets")), spark, tmp_path)
    assert sorted((r["id"], r["used"], r["allowed"]) for r in out.collect()) == [("1", 1, True), ("2", 2, False), ("3", 1, True), ("4", 2, False)]


@pytest.mark.parametrize("order", ["arrival", "event_time"])
def test_token_buckets(spark, requests, tmp_path, order):
    batch = spark.read.parquet(str(requests))
    out = run(jobs.token_bucket(stream(spark, requests), "client", 0.25, 3, order=order, delay="0 seconds"), spark, tmp_path)
    wanted, got = ({r["id"]: (r["client"], r["allowed"], r["tokens"]) for r in df.collect()} for df in (token_bucket(batch, "client", "ts_ms", 0.25, 3, ["id"]), out))
    named = {k for k, r in got.items() if r[0] is not None}
    assert len(named) > 500 and all(got[k][1] == wanted[k][1] and abs(got[k][2] - wanted[k][2]) < 1e-6 for k in named)
    assert len({got[k][1] for k in named}) == 2 and {got[k][1:] for k in got.keys() - named} == {(True, None)}


def _rules(points, above):
    return [rules.Rule("r", "n", 1, (rules.Condition("card:tx_count_24h", ">=", 1.0), rules.Condition("card:amount_sum_24h", ">", above)), points, "alert", "R")]


def test_versions_published_while_the_job_runs(spark, tmp_path):
    tx = tables.transactions(spark, SF)
    path = in_files(tx, tmp_path / "tx", "ts_ms")
    starts = [r[0] for r in spark.read.parquet(str(path)).groupBy(F.input_file_name()).agg(F.min("ts_ms").alias("m")).orderBy("m").select("m").collect()]
    versions = {0: _rules(100, 0.0), starts[2]: _rules(900, 50.0), starts[3] + 5: _rules(300, 20.0)}
    folder = str(tmp_path / "rules")
    rules.publish_rules(spark, folder, versions[0], 0)
    out = str(tmp_path / "out")

    def write(df, batch):
        df.write.mode("overwrite").parquet(f"{out}/batch={batch}")
        if batch < 2:
            at = sorted(versions)[batch + 1]
            rules.publish_rules(spark, folder, versions[at], at)

    decided = jobs.decisions(stream(spark, path), default_limits=LIMITS, rule_versions=folder)
    jobs.micro_batches(decided, write, str(tmp_path / "c"), None).awaitTermination()
    assert rules.read_versions(folder) == versions == rules.read_versions(f"file://{folder}")
    want = banking.decide_in_order(banking.prepare(tx, default_limits=LIMITS), rules.valid_from(versions))
    scores = [{r["transaction_id"]: (r["status"], r["risk_score"], r["action"]) for r in df.collect()} for df in (want, spark.read.parquet(out))]
    assert scores[0] == scores[1] and {100, 300, 900} <= {s[1] for s in scores[0].values()}
    with pytest.raises(Exception, match="already exists|ALREADY_EXISTS"):
        rules.publish_rules(spark, folder, versions[0], 0)


def test_versions_that_are_not_complete(spark, tmp_path):
    assert rules.read_versions(str(tmp_path / "none")) == {} and rules.valid_from({}) == []
    (tmp_path / "v" / "from_ms=5").mkdir(parents=True)
    (tmp_path / "v" / "from_ms=5" / "part.json").write_text('{"id": "half')
    rules.publish_rules(spark, str(tmp_path / "v"), [], 9)
    assert rules.read_versions(str(tmp_path / "v")) == {9: []}
    with pytest.raises(rules.InvalidRules):
        rules.publish_rules(spark, str(tmp_path / "v"), [rules.Rule("", "", 1)], 10)


def test_late_rows_are_kept_apart(spark, tmp_path):
    batches = [[("a", 0), ("b", 100)], [("c", 41), ("d", 40), ("e", 300), (None, None)], [("f", 240), ("g", 241)]]
    for i, rows in enumerate(batches):
        df = spark.createDataFrame([(k, None if s is None else BASE + timedelta(seconds=s)) for k, s in rows], "id string, timestamp timestamp").coalesce(1)
        df.write.mode("append").parquet(str(tmp_path / "in"))
        newest = max((tmp_path / "in").glob("*.parquet"), key=lambda f: f.stat().st_mtime_ns)
        os.utime(newest, (1_700_000_000 + i * 10, 1_700_000_000 + i * 10))
    good, bad = str(tmp_path / "good"), str(tmp_path / "bad")
    jobs.split_late(stream(spark, tmp_path / "in"), "timestamp", "60 seconds", jobs.batch_folder(good), jobs.late_sink(bad), str(tmp_path / "marks"), str(tmp_path / "c"), None).awaitTermination()
    late = spark.read.parquet(bad).collect()
    assert sorted(r["id"] for r in late) == ["d", "f"] and {(r["error"], r["source"], r["retry_count"]) for r in late} == {("behind the watermark", "late", 0)}
    assert sorted(str(r["id"]) for r in spark.read.parquet(good).collect()) == ["None", "a", "b", "c", "e", "g"]


@pytest.mark.parametrize("skew", [Skew(), Skew(hot_rows=50, min_bytes=0, slice_ms=3_600_000)])
def test_counts_of_few_keys(spark, tmp_path, skew):
    ev = tables.events(spark, SF).select(
        F.when(F.col("event_id") % 40 != 0, F.col("type")).alias("type"), F.when(F.col("event_id") % 50 != 0, F.col("source")).alias("source"), "id", "timestamp")
    path = in_files(ev, tmp_path / "in", "timestamp")
    out = str(tmp_path / "out")
    jobs.count_hits(stream(spark, path), jobs.batch_folder(out), str(tmp_path / "carry"), str(tmp_path / "c"), every=None, skew=skew).awaitTermination()
    got = {r["id"]: (r["event_count"], r["source_count"]) for r in spark.read.parquet(out).collect()}
    timed = ev.withColumn("ms", F.floor(F.unix_micros("timestamp") / 1000))
    want = {r["id"]: (r["event_count"] if r["type"] else None, r["source_count"] if r["source"] else None) for r in enrich.hit_counters(timed, "ms").collect()}
    assert got == want and len(got) == 1000
