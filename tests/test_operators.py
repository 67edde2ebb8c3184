"""Operators against plain Python replays, with and without the hot-key path."""

import random

import pytest
from pyspark.sql import functions as F

from txguard.operators.folds import admit_anchored, anchored, token_bucket
from txguard.operators.running import as_of, distinct_in_run, gap_runs, running
from txguard.operators import skew as skew_module
from txguard.operators.skew import DEFAULT_SKEW, HOT, Skew, find_hot, flag_hot
from txguard.operators.sliding import Sliding, sliding
from txguard.plans.enrich import hit_counters

PLAIN = Skew(min_bytes=1 << 80, frame_rows=1 << 62)
SLICED = Skew(hot_rows=8, frame_rows=8, slice_ms=40, min_bytes=0)
BOTH = pytest.mark.parametrize("skew", [PLAIN, SLICED], ids=["plain", "sliced"])


def make_rows(n=160, seed=3):
    """One key holds most rows; times repeat; some keys and values are null."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        key = rng.choice(["hot"] * 6 + ["a", "b", "c", None])
        value = rng.choice(["x", "y", "z", "w", None])
        rows.append((f"t{i:04d}", key, rng.randrange(0, 600), value, round(rng.uniform(0.01, 90), 2)))
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "id string, k string, ts long, v string, amount double")


def by_id(df, *cols):
    return {r["id"]: tuple(r[c] for c in cols) for r in df.collect()}


@BOTH
def test_sliding(spark, skew):
    rows = make_rows()
    specs = [
        Sliding("n50", "count", 50), Sliding("n200", "count", 200), Sliding("s50", "sum", 50, "amount"),
        Sliding("d50", "distinct", 50, "v"), Sliding("d200", "distinct", 200, "v"),
        Sliding("p50", "count", 50, prior=True), Sliding("ps50", "sum", 50, "amount", prior=True),
        Sliding("pd50", "distinct", 50, "v", prior=True),
    ]
    got = by_id(sliding(frame(spark, rows), ["k"], "ts", specs, skew), *[s.name for s in specs])
    assert len(got) == len(rows)
    for rid, key, ts, _, _ in rows:
        for s, value in zip(specs, got[rid]):
            hi = ts - 1 if s.prior else ts
            seen = [r for r in rows if key is not None and r[1] == key and ts - s.width_ms <= r[2] <= hi]
            if s.kind == "count":
                assert value == len(seen), (rid, s.name)
            elif s.kind == "sum":
                assert value == pytest.approx(sum(r[4] for r in seen), abs=1e-6), (rid, s.name)
            else:
                assert value == len({r[3] for r in seen if r[3] is not None}), (rid, s.name)


@BOTH
@pytest.mark.parametrize("mode", ["rows", "before", "range"])
def test_running(spark, skew, mode):
    rows = [r for r in make_rows() if r[1] is not None]
    aggs = {"s": ("sum", F.col("amount")), "lo": ("min", F.col("amount")), "hi": ("max", F.col("amount"))}
    got = by_id(running(frame(spark, rows), ["k"], "ts", aggs, ["id"], mode, skew), "s", "lo", "hi")
    for rid, key, ts, _, _ in rows:
        if mode == "range":
            seen = [r[4] for r in rows if r[1] == key and r[2] <= ts]
        else:
            seen = [r[4] for r in rows if r[1] == key and ((r[2], r[0]) < (ts, rid) or (mode == "rows" and r[0] == rid))]
        if not seen:
            assert got[rid] == (None, None, None)
        else:
            assert got[rid] == (pytest.approx(sum(seen)), min(seen), max(seen))


def replay_runs(rows, gap):
    out, last = {}, {}
    for rid, key, ts, _, _ in sorted(rows, key=lambda r: (r[2], r[0])):
        start, pos, prev = last.get(key, (None, 0, None))
        start, pos = (ts, 1) if prev is None or ts - prev >= gap else (start, pos + 1)
        last[key] = (start, pos, ts)
        out[rid] = (start, pos)
    return out


@BOTH
@pytest.mark.parametrize("gap", [5])
def test_gap_runs(spark, skew, gap):
    rows = [r for r in make_rows() if r[1] is not None]
    got = by_id(gap_runs(frame(spark, rows), ["k"], "ts", gap, ["id"], skew=skew), "run_start", "run_position")
    assert got == replay_runs(rows, gap)


@BOTH
@pytest.mark.parametrize("gap", [20])
def test_distinct_in_run(spark, skew, gap):
    rows = [r for r in make_rows() if r[1] is not None]
    state, want = {}, {}
    for rid, key, ts, v, _ in sorted(rows, key=lambda r: (r[2], r[0])):
        values, last = state.get(key, (set(), None))
        if last is not None and ts - last >= gap:
            values = set()
        if v is not None:
            values = values | {v}
            last = ts
        state[key] = (values, last)
        want[rid] = (len(values),)
    got = by_id(distinct_in_run(frame(spark, rows), ["k"], "ts", "v", gap, "d", ["id"], skew), "d")
    assert got == want


@BOTH
@pytest.mark.parametrize("inclusive", [True, False])
def test_as_of(spark, skew, inclusive):
    rows = [r for r in make_rows() if r[1] is not None]
    facts = [(k, t, f"{k}{t}") for k in ("hot", "a", "zz") for t in range(0, 600, 37)]
    right = spark.createDataFrame(facts, "k string, at long, fact string")
    out = as_of(frame(spark, rows), right, ["k"], "ts", ["fact"], "at", inclusive, skew=skew)
    got = by_id(out, "fact", "amount")
    for rid, key, ts, _, amount in rows:
        seen = [f for f in facts if f[0] == key and (f[1] <= ts if inclusive else f[1] < ts)]
        assert got[rid] == (max(seen, key=lambda f: f[1])[2] if seen else None, amount)


def replay_anchored(rows, ttl):
    out, start = {}, {}
    for rid, key, ts, _, _ in sorted(rows, key=lambda r: (r[2], r[0])):
        if key not in start or ts - start[key] >= ttl:
            start[key] = ts
        out[rid] = (start[key],)
    return out


@BOTH
@pytest.mark.parametrize("ttl", [17])
def test_anchored(spark, skew, ttl):
    rows = [r for r in make_rows() if r[1] is not None]
    got = by_id(anchored(frame(spark, rows), ["k"], "ts", ttl, "start", ["id"], skew), "start")
    assert got == replay_anchored(rows, ttl)


@BOTH
def test_admit_anchored_with_resets(spark, skew):
    rows = [r for r in make_rows() if r[1] is not None]
    resets = [("hot", 150), ("hot", 151), ("a", 300)]
    got = by_id(
        admit_anchored(
            frame(spark, rows).withColumn("w", (F.col("amount") % 3).cast("long") + 1), "k", "ts", 4, 20, "w",
            spark.createDataFrame(resets, "k string, ts long"), ["id"], skew,
        ),
        "used", "allowed",
    )
    state = {}
    todo = [(r[2], 1, r[0], r) for r in rows] + [(t, 0, "", (None, k, t)) for k, t in resets]
    for ts, _, rid, row in sorted(todo, key=lambda x: x[:3]):
        key = row[1]
        if rid == "":
            state.pop(key, None)
            continue
        weight = int(row[4] % 3) + 1
        start, used = state.get(key, (None, 0))
        if start is None or ts - start >= 20:
            start, used = ts, 0
        used += weight
        state[key] = (start, used)
        assert got[rid] == (used, used <= 4), rid


@BOTH
def test_token_bucket(spark, skew):
    rows = [r for r in make_rows() if r[1] is not None]
    got = by_id(token_bucket(frame(spark, rows), "k", "ts", 50.0, 2, ["id"], skew), "allowed", "tokens")
    state = {}
    for rid, key, ts, _, _ in sorted(rows, key=lambda r: (r[2], r[0])):
        tokens, last = state.get(key, (2.0, ts))
        tokens = min(2.0, tokens + (ts - last) / 1000.0 * 50.0)
        ok = tokens >= 1.0
        tokens -= 1.0 if ok else 0.0
        state[key] = (tokens, ts)
        assert got[rid] == (ok, pytest.approx(tokens))


@pytest.mark.parametrize("amounts", [[1e-9] * 12, [1e17] * 12, [1.0, float("nan"), 2.0, 3.0, 4.0] + [5.0] * 7, [1.0, float("inf"), None, -3.0] * 3,
                                     [None] * 12], ids=["tiny", "huge", "nan", "inf", "none"])
def test_sliced_sums_add_like_plain_frames(spark, amounts):
    rows = [(1, 10 * i + i % 3, a) for i, a in enumerate(amounts)] + [(1, 40, 7.0), (2, 5, 1.0)]
    df = spark.createDataFrame(rows, "k long, t long, v double")
    specs = [Sliding("a", "sum", 25, "v"), Sliding("b", "sum", 90, "v"), Sliding("c", "sum", 25, "v", prior=True), Sliding("n", "count", 25)]
    plain, sliced = (sorted(map(repr, sliding(df, ["k"], "t", specs, Skew(slice_ms=w, min_bytes=0, hot_rows=4, frame_rows=f)).collect()))
                     for w, f in ((40, 1 << 62), (7, 4)))
    assert plain == sliced


def test_few_keys_of_a_table_small_on_disk_are_hot(spark, tmp_path):
    """Columns compress: a table far below what a task may hold in memory on disk still holds too many rows of one type."""
    ids = spark.range(150_000).withColumns({f"c{i}": F.xxhash64("id", F.lit(i)) for i in range(5)})
    ids.select(F.col("id").cast("string").alias("id"), F.when(F.col("id") % 3 > 0, "view").otherwise("error").alias("type"), F.lit("web").alias("source"),
               (F.col("id") * 7000 + F.col("c0") % 9_000_000).alias("ts_ms"), "c1", "c2", "c3", "c4").write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t")
    assert all(find_hot(df, [k], DEFAULT_SKEW).frame is not None for k in ("type", "source"))
    idle = 30_000
    got, want = (hit_counters(df, "ts_ms", idle, skew=s).select("id", "event_count", "source_count", "c4") for s in (DEFAULT_SKEW, PLAIN))
    assert want.agg(F.max("event_count")).first()[0] > 2
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


@pytest.mark.parametrize("check", [
    lambda s: test_sliding(s, SLICED), lambda s: test_gap_runs(s, SLICED, 5), lambda s: test_distinct_in_run(s, SLICED, 20),
    lambda s: test_anchored(s, SLICED, 17), lambda s: test_as_of(s, SLICED, True)], ids=["sliding", "gap_runs", "distinct", "anchored", "as_of"])
def test_more_hot_keys_than_a_local_table_holds(spark, monkeypatch, check):
    monkeypatch.setattr(skew_module, "MAX_HOT", 1)
    check(spark)


def test_crowded_key_among_very_many_hot_ones_meets_in_no_task(spark, monkeypatch):
    monkeypatch.setattr(skew_module, "MAX_HOT", 3)
    keys = [(0, t) for t in range(2000)] + [(None, t) for t in range(2000)] + [(k, t) for k in range(1, 9) for t in range(20)] + [(9, 1)]
    df = spark.createDataFrame(keys, "k long, ts long").repartition(3)
    hot = find_hot(df, ["k"], Skew(min_bytes=0, hot_rows=10))
    kept = {c: spark.conf.get(c) for c in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        rows = flag_hot(df, hot, "ts").withColumn("p", F.spark_partition_id()).collect()
    finally:
        for c, v in kept.items():
            spark.conf.set(c, v)
    assert sorted((r["k"], r["ts"]) for r in rows if r["k"] is not None) == sorted(r for r in keys if r[0] is not None)
    assert len(rows) == len(keys)
    assert all(r[HOT] == (r["k"] is not None and r["k"] < 9) for r in rows)
    for k in (0, None):
        at = [r["p"] for r in rows if r["k"] == k]
        assert max(at.count(p) for p in set(at)) < 1000
