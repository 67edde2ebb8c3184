"""Hard negatives against scoring every row for every anchor."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from txguard.llm import hard_negatives as hn

COLUMNS = "vec_id long, embedding array<double>, label int"
SF = "/root/testdata/sf0.001"


def brute(rows, every=100, n_pos=5, n_neg=10):
    taking = {}
    for i, v, label in rows:
        if i is None or v is None or label is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        whole = tuple(math.floor(256 * x) for x in v)
        taking[i] = min(taking.get(i, (len(v), whole, label)), (len(v), whole, label))
    out = []
    for a, (dim, u, label) in taking.items():
        if a % every:
            continue
        scored = [(-sum(x * y for x, y in zip(u, v)), i, other == label) for i, (d, v, other) in taking.items() if i != a and d == dim]
        for p, positive, _ in sorted(x for x in scored if x[2])[:n_pos]:
            ranked = sorted(x for x in scored if not x[2] and -30 * p <= -100 * x[0] <= -90 * p)[:n_neg]
            out += [(a, positive, k + 1, i, -p, -s) for k, (s, i, _) in enumerate(ranked)]
    return sorted(out)


def check(spark, rows, **how):
    df = spark.createDataFrame(rows, COLUMNS).withColumn("v", F.lit("x")).withColumn("need", F.lit(1)).repartition(3)
    got = hn.mine(df, **how)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    found = sorted(tuple(r) for r in got.collect())
    assert found == brute(rows)
    return found


def clustered(n, dim, groups, seed, noise=0.4):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, dim))
    home = rng.integers(groups, size=n)
    size = rng.uniform(0.2, 3, size=n)
    vectors = (centres[home] + noise * rng.normal(size=(n, dim))) * size[:, None]
    return vectors, home


def test_clusters_and_ties(spark):
    vectors, home = clustered(1500, 12, 9, 0)
    rows = [(20 * i, v.tolist(), int(h) % 4) for i, (v, h) in enumerate(zip(vectors, home))]
    # Equal vectors under many ids, and a label with few rows.
    rows += [(20 * i + 1, rows[7][1], i % 4) for i in range(300)] + [(100 * i + 7, rows[i][1], 77) for i in range(3)] + [(100_000, rows[3][1], 78)]
    assert len(check(spark, rows)) > 1000


def test_odd_rows(spark):
    v = [0.5, -0.25, 1.0]
    rows = [(0, v, 1), (100, [0.0, 0.0, 0.0], 1), (200, [0.001, 0.0, 0.0], 2), (300, None, 1), (400, [None, 1.0, 1.0], 1), (500, [float("nan"), 0.0, 1.0], 1),
            (600, [float("inf"), 0.0, 1.0], 2), (700, v, None), (None, v, 1), (800, [1.0], 1), (801, [0.5], 1), (802, [0.4], 2), (803, [], 1), (900, [], 1), (901, [], 2),
            (1, [0.4, -0.2, 0.9], 1), (2, [0.1, 0.0, 0.5], 2), (3, [-1.0, 0.0, 0.0], 1), (4, [0.2, 0.0, 0.4], 2), (4, [0.2, 0.0, 0.4], 2), (4, [0.1, 0.0, 0.4], 3), (5, v, 1),
            (0, v, 1)]
    assert check(spark, rows)
    check(spark, [])
    check(spark, [(100, v, 1)])


def test_scores_beyond_the_doubles_whole_numbers(spark):
    rng = np.random.default_rng(3)
    rows = [(25 * i, (rng.normal(size=3) * 1e6 + 1e6).tolist(), i % 3) for i in range(60)]
    check(spark, rows)


def test_tables(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding, r.label) for r in df.collect()]
    assert sorted(tuple(r) for r in hn.mine(df).collect()) == brute(rows)


@pytest.mark.parametrize("k", [1, 8])
def test_walks_end_early_and_miss_nothing(k):
    vectors, _ = clustered(4000, 8, 6, 1, noise=0.2)
    rows = np.floor(256 * vectors)
    anchors = rows[::100]
    centres = hn.fit_centres(anchors, k, 0)
    off = hn.angles(anchors, centres)
    home, widths = off.argmin(1), np.array([max(off.min(1)[off.argmin(1) == c], default=0.0) for c in range(len(centres))]) + hn.SLACK
    bounds = hn.upper_bounds(rows, centres, widths)
    scores = anchors @ rows.T
    assert (scores <= hn.norms(anchors)[:, None] * bounds.T[home] + 1e-6).all()
    far = []
    for c in range(len(centres)):
        own = np.flatnonzero(home == c)
        order = np.argsort(-bounds[:, c], kind="stable")
        searches = [[hn.Search(5, -math.inf)] for _ in own]
        far += hn.walk(anchors[own], searches, rows[order], order, bounds[order, c], lambda i, some: np.ones(len(order[some]), bool))
        for i, s in zip(own, searches):
            assert s[0].rows == sorted((-int(x), j) for j, x in enumerate(scores[i]))[:5]
    if k > 1:
        assert np.mean(far) < 0.7 * len(rows)
