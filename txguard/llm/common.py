"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txguard.session_dirs import ensure_checkpoint_dir

#: ASCII white space; everything else belongs to a word. ``bytes.split()`` splits at the same characters.
WORD = r"[^\x20\x09-\x0D]+"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one that ``spark.checkpoint.dir`` names, deleted when this process ends."""
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"
    atexit.register(_delete, spark, path)
    return path


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # noqa: BLE001  the session may be gone; the folder then stays
        pass


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows of ``df`` as a table in the shared folder: computed once, safe against lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of those that are equal in doc_id and text; any one, if they differ elsewhere. Rows without doc_id count as equal by text.

    Only ids and hashes move to find out which rows are repeated; those are thinned out before they move.
    """
    names = [fresh(docs.columns, n) for n in ("own_id", "own_hash", "own_many")]
    keyed = docs.withColumns({names[0]: F.coalesce(F.col("doc_id").cast("string"), F.lit("")), names[1]: F.xxhash64("text")})
    doubled = stored(keyed.groupBy(*names[:2]).agg(F.count(F.lit(1)).alias(names[2])).where(F.col(names[2]) > 1).drop(names[2]), "repeated-documents")
    if doubled.isEmpty():
        return docs
    first = keyed.join(doubled, names[:2], "left_semi").groupBy(*names[:2]).agg(F.first(F.struct(*docs.columns)).alias(names[2])).select(f"{names[2]}.*")
    single = keyed.join(doubled, names[:2], "left_anti").select(*docs.columns)
    return stored(single.unionByName(first.select(*docs.columns)), "distinct-documents")


def fresh(columns: Iterable[str], name: str) -> str:
    """``name``, lengthened until none of ``columns`` has it in any case."""
    used = {c.lower() for c in columns}
    while name.lower() in used:
        name += "_"
    return name
