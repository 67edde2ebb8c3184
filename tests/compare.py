"""Run registered queries and their SQL side by side."""

import math
import sys
import time
from pathlib import Path

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _cell(v):
    if isinstance(v, float):
        return None if math.isnan(v) else f"{v:.6f}"
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return v
    if isinstance(v, int):
        return v
    return f"{float(v):.6f}" if hasattr(v, "as_tuple") else str(v)


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(_cell(r[i]) for i in order) for r in rows]
    return [cols[i] for i in order], sorted(out, key=repr)


def diff(spark, con, fn, sql, sf_dir):
    """None when equal, else a short description of the difference."""
    df = fn(spark, sf_dir)
    got_cols, got = _rows(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    want_cols, want = _rows([d[0] for d in cur.description], cur.fetchall())
    if got_cols != want_cols:
        return f"columns {got_cols} != {want_cols}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    return f"{len(bad)} rows differ, e.g. {bad[0]}" if bad else None


def main(argv):
    sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
    from __spark_entry__ import oracle_sql, queries
    from pyspark.sql import SparkSession

    sf_dir = argv[0]
    names = argv[1:] or list(queries())
    # A session without any of our settings, in another time zone: queries must bring what they rely on.
    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "America/New_York").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, sqls = connect(sf_dir), oracle_sql()
    failed = 0
    for name in names:
        start = time.time()
        try:
            if name in sqls:
                result = diff(spark, con, queries()[name], sqls[name], sf_dir) or "ok"
            else:
                result = f"ok (rows only: {queries()[name](spark, sf_dir).count()})"
        except Exception as e:  # noqa: BLE001
            result = f"{type(e).__name__}: {str(e)[:600]}"
        failed += not result.startswith("ok")
        print(f"{name:32s} {time.time() - start:6.1f}s {result}", flush=True)
    print("failed:", failed, "missing sql:", [n for n in queries() if n not in sqls], "extra:", [n for n in sqls if n not in queries()])


if __name__ == "__main__":
    main(sys.argv[1:])
