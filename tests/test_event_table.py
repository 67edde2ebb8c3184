"""The table of micro-batches: replays, compaction, retention, folding of the log."""

import pytest
from pyspark.sql import functions as F

from txguard.sources import event_table as et


def rows(spark, low, high, day="2024-01-05"):
    return spark.range(low, high).select(
        F.col("id").cast("string").alias("id"), F.lit("view").alias("type"), F.lit("web").alias("source"),
        (F.lit(day).cast("timestamp") + F.make_dt_interval(F.col("id"))).alias("timestamp"), F.lit(None).cast("timestamp").alias("processed_at"),
        F.lit("{}").alias("data"), F.lit(None).cast("string").alias("metadata"), F.lit(1).alias("more"))


def ids(df):
    return sorted(int(r["id"]) for r in df.select("id").collect())


def test_a_replayed_batch_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "t")
    assert ids(et.read(spark, path)) == []
    assert et.append_batch(rows(spark, 0, 3), path, 0) and et.append_batch(rows(spark, 3, 5), path, 1)
    assert not et.append_batch(rows(spark, 3, 9), path, 1) and not et.append_batch(rows(spark, 0, 3), path, 0)
    # Another writer has its own numbers; an attempt that was not committed is invisible and overwritten.
    et._write(rows(spark, 50, 99), path, "l0-retry-0", et.EVENTS)
    assert ids(et.read(spark, path)) == [0, 1, 2, 3, 4]
    assert et.append_batch(rows(spark, 5, 6), path, 0, "retry")
    assert ids(et.read(spark, path)) == [0, 1, 2, 3, 4, 5]
    # An empty batch is committed without rows.
    assert et.append_batch(rows(spark, 0, 0), path, 2) and not et.append_batch(rows(spark, 0, 9), path, 2)
    with pytest.raises(ValueError):
        et.append_batch(rows(spark, 0, 1), path, 0, "a/b")


def test_compaction_keeps_rows_and_few_folders(spark, tmp_path):
    path = str(tmp_path / "t")
    for batch in range(14):
        et.append_batch(rows(spark, batch * 4, batch * 4 + 4, "2024-01-01"), path, batch)
    before = sorted(map(tuple, et.read(spark, path).collect()), key=str)
    merged = et.compact(spark, path, 3)
    now = et.snapshot(spark, path)
    assert merged >= 12 and sorted(map(tuple, et.read(spark, path).collect()), key=str) == before
    assert all(sum(et._month(f) == m and et._level(f) == lv for f in now.live) < 3 for m in ("202401", "202402") for lv in range(5))
    # A batch that was merged is still known as committed, also once the log is folded and old folders are gone.
    assert et.vacuum(spark, path) == len(now.removed) > 0 and et.vacuum(spark, path) == 0
    assert len(et.snapshot(spark, path).entries) == 1 and et.snapshot(spark, path).last == {"ingest": 13}
    assert not et.append_batch(rows(spark, 0, 4), path, 13) and et.append_batch(rows(spark, 900, 901, "2023-01-01"), path, 14)
    assert len(ids(et.read(spark, path))) == 57
    assert ids(et.read(spark, path, "2024-01-02", "2024-01-04")) == [1, 2]
    with pytest.raises(ValueError):
        et.compact(spark, path, 1)


def test_retention_drops_months_unread(spark, tmp_path):
    path = str(tmp_path / "t")
    et.append_batch(rows(spark, 0, 60, "2024-01-01"), path, 0)  # January and February
    et.append_batch(rows(spark, 60, 90, "2024-01-01"), path, 1)  # the first of March and on
    # Expired rows are not read: their files are no longer readable.
    for f in (tmp_path / "t" / "rows").glob("part=*/yyyymm=202401/*.parquet"):
        f.write_bytes(b"broken")
    assert et.retain(spark, path, "2024-04-10", 60) == (1, 1)  # from the 10th of February
    assert ids(et.read(spark, path)) == list(range(40, 90))
    assert et.retain(spark, path, "2024-04-10", 60) == (0, 0)
    # A limit at the first of a month writes nothing anew.
    assert et.retain(spark, path, "2024-03-31", 30) == (1, 0)
    assert ids(et.read(spark, path)) == list(range(60, 90))
