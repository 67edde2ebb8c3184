"""Near copies among vectors by a pivot-permutation index.

Reference points are drawn from the vectors. A vector is described by its nearest points in order and stands in the inverted list of each.
Two vectors are a candidate pair if their descriptions share enough points; candidates are verified by their cosine in double precision.
Lists are worked through in square blocks inside tasks: each member brings its description and its vector, and a pair belongs to the
smallest point both share, so it is verified once and no pair is ever written. What leaves a task is each member's number of links and a
spanning forest. Equal vectors are one class and are compared once.

Where vectors resemble each other without being near copies, all nearest points lie in one crowd and their order says little. Crowds are found
among the reference points; a vector in a crowd's ball stands in no list but is compared with every vector of that ball and with all that the
triangle inequality allows to be near one of it, so no link with an end in a crowd is lost. That costs the square of a crowd's size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from txguard.llm.common import stored
from txguard.llm.components import components

# Reference points: PER_ROOT for each unit of the root of the number of vectors, so that lists grow with the root; they are broadcast, so
# their number is bounded. The sample they come from is the same number of vectors.
PER_ROOT, MIN_PIVOTS, MAX_PIVOTS = 4.0, 64, 16_384
NEAREST, SHARED = 12, 4
BLOCK = 512
COSINE = 0.9
# A crowd: NEAREST reference points, so that they can fill a description, within such a cosine of their mean. The next radius is taken if there are
# more crowds than MAX_CROWDS, as a vector stands in the shell of each; the last makes one crowd of all vectors.
CROWD_COSINES, MAX_CROWDS, CROWD_BLOCK = (0.5, 0.3, 0.1, -1.0), 32, 4096


def unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def describe(vectors: np.ndarray, pivots: np.ndarray, nearest: int) -> np.ndarray:
    """The numbers of the nearest pivots, nearest first."""
    near = vectors @ pivots.T
    k = min(nearest, len(pivots))
    some = np.argpartition(-near, k - 1, axis=1)[:, :k]
    order = np.argsort(-np.take_along_axis(near, some, axis=1), axis=1, kind="stable")
    return np.take_along_axis(some, order, axis=1)


def links_in_block(vectors: np.ndarray, lists: np.ndarray, pivot: int, side: np.ndarray, within: bool, weights: np.ndarray, shared: int,
                   cosine: float) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Links of each member of a block of one pivot's list, counted by the other end's weight, and a spanning forest."""
    n = len(vectors)
    common = np.zeros((n, n), np.uint8)
    taken = np.zeros((n, n), bool)
    # The lists of the other points, within this block.
    order = np.argsort(lists, axis=None, kind="stable")
    values, starts = np.unique(lists.ravel()[order], return_index=True)
    for value, members in zip(values, np.split(order // lists.shape[1], starts[1:])):
        common[members[:, None], members] += 1
        if value < pivot:
            taken[members[:, None], members] = True
    candidate = (common >= shared) & ~taken
    if not within:
        candidate &= side[:, None] != side[None, :]
    np.fill_diagonal(candidate, False)
    counts = np.zeros(n, np.int64)
    parent = list(range(n))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    forest = []
    i, j = np.nonzero(np.triu(candidate, 1))
    for at in range(0, len(i), 100_000):
        a, b = i[at : at + 100_000], j[at : at + 100_000]
        near = np.einsum("ij,ij->i", vectors[a], vectors[b]) >= cosine
        a, b = a[near], b[near]
        np.add.at(counts, a, weights[b])
        np.add.at(counts, b, weights[a])
        for x, y in zip(a.tolist(), b.tolist()):
            x, y = root(x), root(y)
            if x != y:
                parent[max(x, y)] = min(x, y)
                forest.append((x, y))
    return counts, forest


def spread_out(points: np.ndarray, cosine: float) -> np.ndarray:
    """The points without those that are near copies of an earlier one: many points in one dense group would describe it by chance."""
    left = np.ones(len(points), bool)
    for i in range(len(points)):
        if left[i]:
            left[i + 1 :] &= points[i + 1 :] @ points[i] < cosine
    return points[left]


def crowds(points: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Centres of crowds among ``points`` and the angle that each one's ball reaches."""
    for near in CROWD_COSINES:
        centres, reach, free = [], [], np.ones(len(points), bool)
        for i in range(len(points)):
            if not free[i]:
                continue
            centre = points[points @ points[i] >= near].mean(axis=0)
            if not np.linalg.norm(centre) > 1e-9:
                centre = points[i]
            centre = centre / np.linalg.norm(centre)
            members = points @ centre >= near
            free[i] = False
            if (members & free).sum() + 1 >= least:
                free &= ~members
                centres.append(centre)
                # Somewhat more than the points reach, as they are a sample.
                reach.append(math.pi if near <= -1 else math.acos(max(near, float((points[members] @ centre).min()) - 0.05)))
        if len(centres) <= MAX_CROWDS:
            break
    return np.array(centres).reshape(-1, points.shape[1]), np.array(reach)


def place(vectors: np.ndarray, centres: np.ndarray, reach: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Each vector's crowd (-1: none), and by crowd whether it can be near a member."""
    if not len(centres):
        return np.full(len(vectors), -1), np.zeros((len(vectors), 0), bool)
    angles = np.arccos(np.clip(vectors @ centres.T, -1, 1))
    inside = angles <= reach
    home = np.where(inside.any(axis=1), np.where(inside, angles, np.inf).argmin(axis=1), -1)
    return home, angles <= reach + math.acos(cosine) + 1e-6


def links_in_crowd(vectors: np.ndarray, home: np.ndarray, crowd: int, side: np.ndarray, within: bool, weights: np.ndarray,
                   cosine: float) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """As links_in_block, of all pairs of two blocks of a crowd; a pair with ends in two crowds belongs to the smaller number."""
    counts, label, forest = np.zeros(len(vectors), np.int64), np.arange(len(vectors)), []
    left, right = (np.arange(len(vectors)),) * 2 if within else (np.flatnonzero(side == side.min()), np.flatnonzero(side != side.min()))
    owner = np.where(home < 0, np.iinfo(np.int64).max, home)
    for at in range(0, len(left), 256):
        rows = left[at : at + 256]
        near = vectors[rows] @ vectors[right].T >= cosine
        near &= np.minimum(owner[rows][:, None], owner[right][None, :]) == crowd
        if within:
            near &= rows[:, None] < right[None, :]
        counts[rows] += near @ weights[right]
        counts[right] += weights[rows] @ near
        for k in np.flatnonzero(near.any(axis=1)):
            ends = label[right[near[k]]]
            own = label[rows[k]]
            others = np.unique(ends[ends != own])
            if len(others):
                forest += [(int(own), int(x)) for x in others]
                label[np.isin(label, others)] = own
    return counts, forest


def _pivots(classes: DataFrame, n: int, seed: int, per_root: float, cosine: float) -> np.ndarray:
    """A bounded sample, by hash, of the distinct vectors, as unit vectors that are no near copies of each other."""
    wanted = int(min(MAX_PIVOTS, max(MIN_PIVOTS, per_root * math.sqrt(n))))
    rows = classes.orderBy(F.xxhash64(F.lit(seed), "c1"), "c1", "c2").limit(wanted).select("embedding").collect()
    return spread_out(unit(np.array([r[0] for r in rows], np.float64)), cosine)


def _valid(embeddings: DataFrame) -> DataFrame:
    """vec_id, the vector where it can be compared (else null), its length, and two hashes that name its class."""
    v = F.col("embedding")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    good = F.col("vec_id").isNotNull() & v.isNotNull() & finite & F.exists(v, lambda x: x != 0)
    kept = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(good, v).alias("embedding"))
    named = [F.when(F.col("embedding").isNotNull(), F.xxhash64(F.lit(i), "embedding")).alias(f"c{i}") for i in (1, 2)]
    return kept.select("vec_id", "embedding", F.when(F.col("embedding").isNotNull(), F.size("embedding")).alias("dim"), *named)


def _links(classes: DataFrame, n: int, cosine: float, nearest: int, shared: int, per_root: float, seed: int) -> DataFrame:
    """c1, c2, links (weights of the linked classes found by one block) and forest edges a, b, for classes of one dimension."""
    pivots = _pivots(classes, n, seed, per_root, cosine)
    known = classes.sparkSession.sparkContext.broadcast((pivots, *crowds(pivots, nearest)))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                vectors = unit(np.array(batch.column("embedding").to_pylist(), np.float64))
                points, centres, reach = known.value
                home, close = place(vectors, centres, reach, cosine)
                lists = [x if h < 0 else x[:0] for x, h in zip(describe(vectors, points, nearest).astype(np.int32), home)]
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(lists, pa.list_(pa.int32())), pa.array(home, pa.int64()),
                     pa.array([np.flatnonzero(x).astype(np.int32) for x in close], pa.list_(pa.int32()))], [*batch.schema.names, "lists", "home", "crowds"])

    columns = classes.select("c1", "c2", "rep", "size", "embedding")
    schema = StructType(columns.schema.fields + [
        StructField("lists", ArrayType(IntegerType())), StructField("home", LongType()), StructField("crowds", ArrayType(IntegerType()))])
    described = stored(columns.mapInArrow(index, schema), "pivot-lists")
    sizes = described.select(F.explode("lists").alias("pivot")).groupBy("pivot").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    # One row per reference point, so at most MAX_PIVOTS.
    spread = described.withColumn("pivot", F.explode("lists")).join(F.broadcast(sizes), "pivot").withColumn(
        "block", F.pmod("c1", F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn(
        "low", F.least("block", "other")).withColumn("high", F.greatest("block", "other")).drop("other", "blocks", "home", "crowds")

    def links(rows: pd.DataFrame, counts: np.ndarray, forest: list[tuple[int, int]]) -> pd.DataFrame:
        c1, c2, rep = (rows[c].to_numpy(np.int64) for c in ("c1", "c2", "rep"))
        some = np.flatnonzero(counts)
        ends = np.array(forest, np.int64).reshape(-1, 2)
        size = max(len(some), len(ends))
        out = {"c1": c1[some], "c2": c2[some], "links": counts[some], "a": rep[ends[:, 0]], "b": rep[ends[:, 1]]}
        return pd.DataFrame({k: pd.array([*v, *[None] * (size - len(v))], "Int64") for k, v in out.items()})

    def verify(group: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        pivot, low, high = group
        rows = rows.sort_values(["c1", "c2"])
        counts, forest = links_in_block(unit(np.stack(rows["embedding"]).astype(np.float64)), np.stack(rows["lists"]), pivot, rows["block"].to_numpy(),
                                        low == high, rows["size"].to_numpy(np.int64), min(shared, len(rows["lists"].iloc[0])), cosine)
        return links(rows, counts, forest)

    result = "c1 long, c2 long, links long, a long, b long"
    listed = spread.groupBy("pivot", "low", "high").applyInPandas(verify, result)
    if not len(known.value[1]):
        return listed
    # Members of a crowd meet all blocks of it, those of its shell only the members' blocks.
    near = described.select("c1", "c2", "rep", "size", "embedding", "home", F.explode("crowds").alias("crowd"))
    member = F.col("home") == F.col("crowd")
    counted = near.groupBy("crowd").agg(*(F.ceil(F.sum(c.cast("int")) / CROWD_BLOCK).cast("int").alias(name) for c, name in ((member, "inner"), (~member, "outer"))))
    dealt = near.join(F.broadcast(counted.where("inner > 0")), "crowd").withColumn("block", F.when(member, F.pmod("c1", F.col("inner"))).otherwise(
        F.col("inner") + F.pmod("c1", F.greatest("outer", F.lit(1)))).cast("int")).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.when(member, F.col("inner") + F.col("outer")).otherwise(F.col("inner")) - 1))).withColumn(
        "low", F.least("block", "other")).withColumn("high", F.greatest("block", "other")).drop("other", "inner", "outer")

    def compare(group: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        crowd, low, high = group
        rows = rows.sort_values(["c1", "c2"])
        return links(rows, *links_in_crowd(unit(np.stack(rows["embedding"]).astype(np.float64)), rows["home"].to_numpy(np.int64), crowd,
                                           rows["block"].to_numpy(), low == high, rows["size"].to_numpy(np.int64), cosine))

    return listed.unionByName(dealt.groupBy("crowd", "low", "high").applyInPandas(compare, result))


def near_vectors(embeddings: DataFrame, cosine: float = COSINE, nearest: int = NEAREST, shared: int = SHARED, per_root: float = PER_ROOT,
                 seed: int = 0) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row.

    Rows whose id or vector is null, and vectors that are zero or hold null or non-finite components, link with nothing. Only vectors of
    one length are compared. n_links counts other rows, repeated ones included; component_id is the smallest vec_id reachable; kept:
    vec_id equals component_id, null ids included. Other columns are ignored; an empty table gives no rows.
    """
    rows = stored(_valid(embeddings), "vectors")
    valid = rows.where("dim is not null")
    classes = stored(valid.groupBy("c1", "c2", "dim").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("size"),
                                                          F.first("embedding").alias("embedding")), "vector-classes")
    alone = rows.where("dim is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    dims = classes.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).orderBy("dim").collect()
    if not dims:
        return alone.withColumn("kept", F.lit(True))
    found = _links(classes.where(F.col("dim") == dims[0]["dim"]), dims[0]["n"], cosine, nearest, shared, per_root, seed)
    for d in dims[1:]:
        found = found.unionByName(_links(classes.where(F.col("dim") == d["dim"]), d["n"], cosine, nearest, shared, per_root, seed))
    found = stored(found, "vector-links")
    links = found.where("links is not null").groupBy("c1", "c2").agg(F.sum("links").alias("links"))
    labels = components(found.where("a is not null").select("a", "b"))
    labelled = classes.join(links, ["c1", "c2"], "left").join(labels, F.col("rep") == F.col("node"), "left").select(
        "c1", "c2", (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    # A class of very many equal vectors is one row on the right side; Spark splits the left one.
    linked = valid.select("vec_id", "c1", "c2").join(labelled, ["c1", "c2"]).select("vec_id", "n_links", "component_id")
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
