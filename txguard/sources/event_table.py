"""A table that micro-batches append to: parts that are written once, and a log of what was committed.

    <path>/rows/part=<name>/yyyymm=<month>/   rows of one batch or one compaction
    <path>/log/entry=<name>/                  the month folders that it added and removed

The table is what the log's entries add, less what they remove, whatever their order; so batches and maintenance may run at a time. Every write has a
folder of its own: one that failed is invisible, and a batch that is replayed overwrites itself, or changes nothing where it was committed.
One maintenance job (``compact``, ``retain``, ``vacuum``) runs at a time. The driver reads the log only: names of live folders and of entries since
the last ``vacuum``.
"""

from __future__ import annotations

import re
import uuid
from collections import defaultdict
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txguard.functions.columns import month_partition
from txguard.sources.storage import RETENTION_DAYS, retained

LOG = "added array<string>, removed array<string>, last map<string,long>, covers array<string>, entry string"


@dataclass(frozen=True)
class Layout:
    """Columns of a table with a ``timestamp``, and how its files are sorted."""

    schema: str
    sort_by: Sequence[str] = ("timestamp",)


EVENTS = Layout("id string, type string, source string, timestamp timestamp, processed_at timestamp, data string, metadata string",
                ("type", "source", "timestamp"))


@dataclass(frozen=True)
class Snapshot:
    """Live month folders, those no longer used, the last batch of each writer, and the log's entries."""

    live: tuple[str, ...]
    removed: tuple[str, ...]
    last: dict[str, int]
    entries: tuple[str, ...]


def _folder(spark: SparkSession, path: str):
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), folder


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder, if it is there."""
    fs, folder = _folder(spark, path)
    fs.delete(folder, True)


def _month(folder: str) -> str:
    return folder.rsplit("yyyymm=", 1)[1]


def _level(folder: str) -> int:
    return int(re.match(r"part=l(\d+)-", folder)[1])


def snapshot(spark: SparkSession, path: str) -> Snapshot:
    """The table as it is committed now; empty where nothing was written yet."""
    fs, folder = _folder(spark, f"{path}/log")
    rows = spark.read.schema(LOG).json(f"{path}/log").collect() if fs.exists(folder) else []
    covered = {name for r in rows for name in r["covers"]}
    removed, last = set(), {}
    held = [r for r in rows if r["entry"] not in covered]
    for r in held:
        removed.update(r["removed"])
        for writer, batch in r["last"].items():
            last[writer] = max(batch, last.get(writer, batch))
    live = {f for r in held for f in r["added"]} - removed
    return Snapshot(tuple(sorted(live)), tuple(sorted(removed)), last, tuple(sorted(r["entry"] for r in rows)))


def _commit(spark: SparkSession, path: str, entry: str, added: Sequence[str] = (), removed: Sequence[str] = (), last: dict[str, int] | None = None,
            covers: Sequence[str] = ()) -> None:
    # One row, one file: the entry is there or it is not.
    row = spark.createDataFrame([(list(added), list(removed), dict(last or {}), list(covers))], LOG.rsplit(",", 1)[0])
    row.coalesce(1).write.mode("overwrite").json(f"{path}/log/entry={entry}")


def _write(df: DataFrame, path: str, part: str, layout: Layout) -> list[str]:
    """Write a part, and name its month folders. Big months are cut into files near the advisory size."""
    root = f"{path}/rows/part={part}"
    names = [f.split()[0] for f in layout.schema.split(", ")]
    (
        df.select(*names, month_partition(F.col("timestamp")).alias("yyyymm"))
        .hint("rebalance", "yyyymm").sortWithinPartitions("yyyymm", *layout.sort_by)
        .write.mode("overwrite").option("compression", "lz4").partitionBy("yyyymm").parquet(root)
    )
    fs, pattern = _folder(df.sparkSession, f"{root}/yyyymm=*")
    return [f"part={part}/{s.getPath().getName()}" for s in fs.globStatus(pattern) or []]


def _rows(spark: SparkSession, path: str, folders: Sequence[str], layout: Layout) -> DataFrame:
    if not folders:
        return spark.createDataFrame([], f"{layout.schema}, yyyymm string")
    reader = spark.read.option("basePath", f"{path}/rows").schema(f"{layout.schema}, part string, yyyymm string")
    return reader.parquet(*(f"{path}/rows/{f}" for f in folders)).drop("part")


def append_batch(df: DataFrame, path: str, batch: int, writer: str = "ingest", layout: Layout = EVENTS) -> bool:
    """Append a batch of a writer, whose batches are numbered upwards; false where that batch, or a later one, is committed."""
    if not re.fullmatch(r"\w+", writer):
        raise ValueError("a writer's name has letters, digits and underscores")
    spark = df.sparkSession
    if batch <= snapshot(spark, path).last.get(writer, -1):
        return False
    added = _write(df, path, f"l0-{writer}-{batch}", layout)
    _commit(spark, path, f"batch-{writer}-{batch}", added, last={writer: batch})
    return True


def read(spark: SparkSession, path: str, since: str | None = None, until: str | None = None, layout: Layout = EVENTS) -> DataFrame:
    """The committed rows. Months outside the bounds are not even listed."""
    low, high = ((b or "")[:7].replace("-", "") for b in (since, until))
    folders = [f for f in snapshot(spark, path).live if _month(f) >= low and (not high or _month(f) <= high)]
    df = _rows(spark, path, folders, layout)
    if since:
        df = df.where(F.col("timestamp") >= F.lit(since).cast("timestamp"))
    if until:
        df = df.where(F.col("timestamp") < F.lit(until).cast("timestamp"))
    return df


def compact(spark: SparkSession, path: str, at_least: int = 8, layout: Layout = EVENTS) -> int:
    """Merge the parts of a month wherever ``at_least`` of one level are there, into one of the next level; the number of parts merged.

    A row is written anew once a level, so the logarithm of the number of batches in all, and a month keeps fewer than ``at_least`` parts a level.
    """
    if at_least < 2:
        raise ValueError("at_least is 2 or more")
    merged = 0
    while True:
        groups: dict[tuple[int, str], list[str]] = defaultdict(list)
        for f in snapshot(spark, path).live:
            groups[_level(f), _month(f)].append(f)
        full = {k: folders for k, folders in groups.items() if len(folders) >= at_least}
        if not full:
            return merged
        level = min(lv for lv, _ in full)
        old = [f for (lv, _), folders in full.items() if lv == level for f in folders]
        part = f"l{level + 1}-{uuid.uuid4().hex}"
        _commit(spark, path, f"compact-{part}", _write(_rows(spark, path, old, layout), path, part, layout), old)
        merged += len(old)


def retain(spark: SparkSession, path: str, as_of: str, days: int = RETENTION_DAYS, layout: Layout = EVENTS) -> tuple[int, int]:
    """Drop what is older than ``days``: whole months by their folders, unread; rows of the month in which the limit falls by writing that month anew.

    Gives the number of folders dropped and written anew. Rows without a time stay.
    """
    limit = F.date_sub(F.lit(as_of).cast("date"), days)
    first, whole = spark.range(1).select(month_partition(limit), F.dayofmonth(limit) == 1).first()
    live = snapshot(spark, path).live
    expired = [f for f in live if _month(f) < first]
    edge = [] if whole else [f for f in live if _month(f) == first]
    if edge and _rows(spark, path, edge, layout).where(F.col("timestamp") < limit.cast("timestamp")).isEmpty():
        edge = []
    part = f"l1-{uuid.uuid4().hex}"
    added = _write(retained(_rows(spark, path, edge, layout), as_of, days), path, part, layout) if edge else []
    if expired or edge:
        _commit(spark, path, f"retain-{part}", added, [*expired, *edge])
    return len(expired), len(edge)


def vacuum(spark: SparkSession, path: str) -> int:
    """Delete the folders that the log has removed and fold the log into one entry; the number of folders deleted.

    Reads that began before the removal must be over. Parts of failed compactions, which no entry names, stay.
    """
    now = snapshot(spark, path)
    if not now.entries:
        return 0
    for f in now.removed:
        delete(spark, f"{path}/rows/{f}")
    _commit(spark, path, f"fold-{uuid.uuid4().hex}", now.live, (), now.last, now.entries)
    for name in now.entries:
        delete(spark, f"{path}/log/entry={name}")
    return len(now.removed)
