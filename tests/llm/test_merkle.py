"""The Merkle manifest against a tree built in plain Python, and its SQL on tables of its own."""

import hashlib
import zlib

import duckdb
import pytest
from cases import ODD
from pyspark.sql import functions as F

from txguard.llm import merkle
from txguard.llm.queries import all_sql

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, text):
    d, _, lang, source, n = row
    return h(*("-" if x is None else f"{len(str(x).encode())}:{x}" for x in (d, source, lang, n, text)))


def tree(leaves):
    """Root, and each leaf's path of (place, run)."""
    paths, level, members = [[] for _ in leaves], list(leaves), [[i] for i in range(len(leaves))]
    while len(level) > 1:
        runs = [range(i, min(i + 16, len(level))) for i in range(0, len(level), 16)]
        for run in runs:
            kids = [level[i] for i in run]
            for place, i in enumerate(run):
                for m in members[i]:
                    paths[m].append((place, kids))
        level, members = [h(*(level[i] for i in run)) for run in runs], [[m for i in run for m in members[i]] for run in runs]
    return level[0], paths


def lowered(d, text):
    if d is None or text is None or zlib.crc32(str(d).encode()) % 5:
        return text
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def brute(rows):
    by = {}
    for r in rows:
        by.setdefault(r[3], []).append(r)
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    for s in names:
        by[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[1])))
    trees = {s: tree([leaf(r, r[1]) for r in by[s]]) for s in names}
    root, above = tree([trees[s][0] for s in names]) if names else (None, [])
    out = []
    for s, up in zip(names, above):
        for r, path in zip(by[s], trees[s][1]):
            proof, now = [], leaf(r, lowered(r[0], r[1]))
            for place, kids in path + up:
                proof += kids[:place] + kids[place + 1 :]
                now = h(*kids[:place], now, *kids[place + 1 :])
            out.append((r[0], leaf(r, r[1]), trees[s][0], root, tuple(proof), h(*proof), now, now == root))
    return sorted(out, key=repr)


def many():
    rows = [(i, f"Text {i}", "en", "hot", i % 7) for i in range(4500)]
    rows += [(10_000 + i, f"T {i}", None, f"s{i % 40}", 1) for i in range(300)] + [(20_000 + i, "Ab", "de", f"only {i}", 2) for i in range(17)]
    return rows + [(5, "Text 5", "en", "hot", 5)] * 20


@pytest.mark.parametrize("rows", [
    many(), [(1, "A", "en", "s", 1)], [], [(i, "Xy", "en", "s", 1) for i in range(17)],
    [(d, t, "en" if i % 2 else None, ("é", None, "", "a")[i % 4], None if i % 3 else i) for i, (d, t) in enumerate(ODD)],
], ids=["many", "one", "none", "seventeen", "odd"])
def test_manifest(spark, rows):
    docs = spark.createDataFrame(rows, DOCS).withColumn("tree", F.lit(1)).withColumn("leaf", F.lit("x")).repartition(5)
    got = merkle.manifest(docs, merkle.lowered_where(F.col("doc_id"), F.col("text"))).collect()
    want = brute(rows)
    assert sorted(((*r[:4], tuple(r[4]), *r[5:]) for r in got), key=repr) == want
    if len(rows) > 1000:
        assert {len(r.proof) for r in got} != {0} and not all(r.verified for r in got) and any(r.verified for r in got)


def test_untampered_rows_verify(spark):
    docs = spark.createDataFrame([(i, f"T{i}", "en", f"s{i % 3}", i) for i in range(100)], DOCS)
    got = merkle.manifest(docs).collect()
    assert all(r.verified and r.folded_root == r.root for r in got)


def test_sql_agrees(spark):
    rows = many()
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?, ?)", rows[::3] + [(None, None, None, None, None)])
    sql = sorted(con.execute(f"SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, verified FROM ({all_sql()['op12_merkle_manifest']})").fetchall(), key=repr)
    assert sql == sorted((r[:4] + r[5:] for r in brute(rows[::3] + [(None, None, None, None, None)])), key=repr)
