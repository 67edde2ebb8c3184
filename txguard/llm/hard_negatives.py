"""Hard negatives by lists that the anchors of a cluster share.

Anchors are clustered by direction. For a cluster with centre ``c`` whose members lie within the angle ``w`` of it, no member ``u`` scores a row ``x``
higher than ``|u| |x| cos(max(0, angle(x, c) - w))``. Rows are sorted by this bound once for a cluster, and each member walks the sorted
list until the bound, times its own norm, is below what it still needs: then nothing that follows can change its result.

What a member needs is known before lists are made. A bounded number of rows of its own label gives a fifth best score that its positives
must reach; its positives' scores give the range of its negatives, and a bounded sample of all rows a tenth best score within that range. So a
cluster's list holds only the rows whose bound reaches the least need of its members, cut into pieces of bounded size, and
the walks of a cluster's members over one piece are one task. The best of all pieces are merged by anchor.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from txguard.llm.common import stored

# Rows of a list's piece, anchors that walk it together, rows scored at one step of a walk.
PIECE, WALKERS, STEP = 8192, 1024, 256
# Clusters, and anchors of the bounded sample that they are fitted on.
MAX_CLUSTERS, FIT_SAMPLE, FIT_ROUNDS = 256, 8192, 10
# Rows of each label that give a first bound of its positives, and rows of the sample that does so for negatives.
LABEL_SEEDS, SAMPLE = 64, 2048
# Arc cosines near 1 are good to about 1e-8; bounds are raised by more than that.
SLACK = 1e-7
# Rows with components at or above it take no part, as their scores would leave the doubles.
GREATEST = 1e150
_LONG = (1 << 63) - 1


def dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of whole-numbered vectors: as floats where no sum can pass 2**53, else as Python's integers."""
    if not len(a) or not len(b):
        return np.zeros((len(a), len(b)))
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if most < 2**53:
        return a @ b.T
    whole = [[[int(x) for x in row] for row in m] for m in (a, b)]
    return np.array([[sum(x * y for x, y in zip(u, v)) for v in whole[1]] for u in whole[0]], object)


def norms(vectors: np.ndarray) -> np.ndarray:
    return np.sqrt((vectors.astype(np.float64) ** 2).sum(axis=1))


def angles(vectors: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Angles of vectors to unit centres; a zero vector has a right angle to all."""
    size = norms(vectors)
    return np.arccos(np.clip(vectors / np.where(size > 0, size, 1)[:, None] @ centres.T, -1, 1))


def upper_bounds(vectors: np.ndarray, centres: np.ndarray, widths: np.ndarray) -> np.ndarray:
    """What a member of norm 1 of each cluster can score at most, by vector and cluster."""
    size = norms(vectors)
    return size[:, None] * (np.cos(np.maximum(0.0, angles(vectors, centres) - widths)) + SLACK)


def fit_centres(vectors: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Unit centres of ``k`` clusters by direction at most."""
    size = norms(vectors)
    unit = vectors[size > 0] / size[size > 0][:, None]
    if not len(unit):
        return np.zeros((0, vectors.shape[1]))
    rng = np.random.default_rng(seed)
    centres = unit[rng.choice(len(unit), min(k, len(unit)), replace=False)]
    for _ in range(FIT_ROUNDS):
        home = (unit @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, home, unit)
        size = norms(sums)
        centres = np.where((size > 1e-9)[:, None], sums / np.where(size > 1e-9, size, 1)[:, None], centres)
    return centres


def not_above(score: int) -> float:
    """The score as a float, rounded down."""
    out = float(score)
    return out if out <= score else math.nextafter(out, -math.inf)


class Search:
    """The ``k`` greatest scores, then smaller ids, from ``lowest`` to ``highest``; none below ``need`` can be among them."""

    def __init__(self, k: int, need: float, lowest: float = -math.inf, highest: float = math.inf):
        self.k, self.need, self.lowest, self.highest = k, max(need, lowest), lowest, highest
        self.rows: list[tuple[int, int]] = []

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        hit = (scores >= self.need) & (scores <= self.highest)
        if hit.any():
            self.rows = sorted(self.rows + [(-int(s), int(i)) for s, i in zip(scores[hit], ids[hit])])[: self.k]
            if len(self.rows) == self.k:
                self.need = max(self.need, not_above(-self.rows[-1][0]))


def walk(anchors: np.ndarray, searches: list[list[Search]], vectors: np.ndarray, ids: np.ndarray, bounds: np.ndarray, may: Callable[[int, slice], np.ndarray]) -> list[int]:
    """Walk a list sorted by ``bounds``, greatest first, for the searches of each anchor; ``may(anchor, places)`` tells which rows an anchor takes.

    All anchors that still walk score the next rows together. An anchor ends before the first row whose bound shows that it and all after it score less
    than each of its searches needs; equal scores still matter, as ids part them. Returns how far each went.
    """
    size, went = norms(anchors), [0] * len(anchors)
    walking = [i for i in range(len(anchors)) if searches[i]]
    for at in range(0, len(ids), STEP):
        # The needs are whole numbers; the product is raised to cover its rounding.
        walking = [i for i in walking if size[i] * bounds[at] + abs(size[i] * bounds[at]) * 1e-12 + 1e-6 >= min(s.need for s in searches[i])]
        if not walking:
            break
        some = slice(at, at + STEP)
        for i, scores in zip(walking, dots(anchors[walking], vectors[some])):
            went[i] = min(at + STEP, len(ids))
            hit = np.flatnonzero(may(i, some) & (scores >= min(s.need for s in searches[i])))
            if len(hit):
                for search in searches[i]:
                    search.add(scores[hit], ids[some][hit])
    return went


def taking_part(embeddings: DataFrame, label: Column, scale: int = 256) -> DataFrame:
    """vec_id, label, dim and v (``floor(scale * x)``) of the rows that can be compared."""
    v = F.col("embedding")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < GREATEST))
    good = F.col("vec_id").isNotNull() & label.isNotNull() & v.isNotNull() & finite

    def whole(x: Column) -> Column:
        y = x.cast("double") * scale
        # floor() gives a long; doubles beyond are whole.
        return F.when(F.abs(y) < 2.0**53, F.floor(y).cast("double")).otherwise(y)

    rows = embeddings.where(good).select(
        F.col("vec_id").cast("long").alias("vec_id"), label.cast("long").alias("label"), F.size(v).alias("dim"), F.transform(v, whole).alias("v"))
    rows = stored(rows, "mining-rows")
    # Only ids move to find out which are not unique.
    doubled = stored(rows.groupBy("vec_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("vec_id"), "mining-doubled")
    if doubled.isEmpty():
        return rows
    least = rows.join(doubled, "vec_id", "left_semi").groupBy("vec_id").agg(F.min(F.struct("dim", "v", "label")).alias("least")).select(
        "vec_id", "least.label", "least.dim", "least.v")
    return stored(rows.join(doubled, "vec_id", "left_anti").unionByName(least), "mining-rows")


def _matrix(part: pa.RecordBatch, dim: int) -> np.ndarray:
    return part.column("v").flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, dim)


def _each_dim(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    dims = batch.column("dim").to_numpy(zero_copy_only=False)
    for dim in np.unique(dims):
        yield int(dim), batch.filter(pa.array(dims == dim))


def _assign(anchors: DataFrame, seed: int) -> tuple[DataFrame, dict[int, np.ndarray], dict[int, np.ndarray]]:
    """``anchors`` with cell, norm and angle to its centre, stored; centres and widths by dim. Cell -1 has no centre: zero vectors, and lengths that the sample lacks."""
    total = anchors.count()
    sample = anchors.orderBy(F.xxhash64(F.lit(seed), "vec_id"), "vec_id").limit(FIT_SAMPLE).select("dim", "v").collect()
    # A cluster is worth a list of its own if it fills a batch of walkers: each list holds most rows where the anchors point everywhere.
    k = max(1, min(MAX_CLUSTERS, math.ceil(total / WALKERS)))
    by_dim: dict[int, list] = {}
    for r in sample:
        by_dim.setdefault(r["dim"], []).append(r["v"])
    centres = {d: fit_centres(np.array(v, np.float64), max(1, k * len(v) // len(sample)), seed) for d, v in by_dim.items() if d}

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, part in _each_dim(batch):
                vectors = _matrix(part, dim)
                size, cell, angle = norms(vectors), np.full(len(vectors), -1), np.zeros(len(vectors))
                if len(centres.get(dim, ())):
                    off = angles(vectors, centres[dim])
                    cell = np.where(size > 0, off.argmin(axis=1), -1)
                    angle = np.where(size > 0, off.min(axis=1), 0.0)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cell, pa.int32()), pa.array(size), pa.array(angle)], [*part.schema.names, "cell", "norm", "angle"])

    schema = f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in anchors.schema)}, cell int, norm double, angle double"
    found = stored(anchors.mapInArrow(assign, schema), "anchors")
    # At most MAX_CLUSTERS rows and one per length of the sample.
    widths = {d: np.zeros(len(c)) for d, c in centres.items()}
    for r in found.where("cell >= 0").groupBy("dim", "cell").agg(F.max("angle").alias("w")).collect():
        widths[r["dim"]][r["cell"]] = r["w"] + SLACK
    return found, centres, widths


def _needs(anchors: DataFrame) -> dict[tuple[int, int], float]:
    """The least bound that matters to a member of each cluster; anchors have ``need``, a score. No more rows than there are clusters."""
    ratio = F.when((F.col("norm") > 0) & F.col("need").isNotNull(), F.col("need") / F.col("norm")).otherwise(float("-inf"))
    return {(r["dim"], r["cell"]): r["least"] for r in anchors.where("cell >= 0").groupBy("dim", "cell").agg(F.min(ratio).alias("least")).collect()}


def _lists(rows: DataFrame, anchors: DataFrame, centres: dict[int, np.ndarray], widths: dict[int, np.ndarray]) -> DataFrame:
    """The rows of each cluster's list: cell, bound and the row. Cell -1 has a list of all rows of a length, sorted by norm, if the length has no centres or a zero
    anchor."""
    needs = _needs(anchors)
    least = {d: np.array([needs.get((d, i), math.inf) for i in range(len(c))]) for d, c in centres.items()}
    # No more than the lengths of the sample.
    whole = {r["dim"] for r in anchors.where((F.col("cell") < 0) & F.col("dim").isin([0, *centres])).select("dim").distinct().collect()}

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, part in _each_dim(batch):
                vectors = _matrix(part, dim)
                plain = np.arange(len(vectors) if dim in whole or dim not in centres else 0)
                at, cell, bound = plain, np.full(len(plain), -1), norms(vectors)[plain]
                if len(centres.get(dim, ())):
                    every = upper_bounds(vectors, centres[dim], widths[dim])
                    floor = least[dim]
                    i, j = np.nonzero(every >= np.where(np.isfinite(floor), floor - np.abs(floor) * 1e-9 - 1e-9, floor))
                    at, cell, bound = np.concatenate([at, i]), np.concatenate([cell, j]), np.concatenate([bound, every[i, j]])
                taken = part.take(pa.array(at))
                yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(cell, pa.int32()), pa.array(bound)], [*taken.schema.names, "cell", "bound"])

    schema = f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in rows.schema)}, cell int, bound double"
    return rows.mapInArrow(emit, schema)


def _walked(listed: DataFrame, anchors: DataFrame, group: list[str], same: bool, searches_of: Callable, names: list[str]) -> DataFrame:
    """What the walks over each piece of each group's list find for each batch of its anchors, among rows of the same label or of others.

    ``searches_of(anchor)`` gives (values of the output's first columns, search) pairs; ``names`` are anchor_id, these, and the found row's id and score.

    Only groups with anchors keep their list. Pieces are dealt by hash and stay below ``PIECE`` rows on average; batches of anchors below
    ``WALKERS``; so a hot cluster or label is many tasks.
    """
    sizes = anchors.groupBy(*group).agg(F.ceil(F.count(F.lit(1)) / WALKERS).cast("int").alias("batches"))
    wanted = stored(listed.join(sizes, group), "negative-lists")
    pieces = wanted.groupBy(*group).agg(F.ceil(F.count(F.lit(1)) / PIECE).cast("int").alias("pieces"))
    ids = F.xxhash64("vec_id")
    left = wanted.join(pieces, group).withColumn("piece", F.pmod(ids, F.col("pieces")).cast("int")).withColumn(
        "batch", F.explode(F.sequence(F.lit(0), F.col("batches") - 1))).drop("batches", "pieces")
    right = anchors.join(sizes, group).join(pieces, group).withColumn("batch", F.pmod(ids, F.col("batches")).cast("int")).withColumn(
        "piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))).drop("batches", "pieces")
    key = [*group, "piece", "batch"]

    def task(rows: pd.DataFrame, walkers: pd.DataFrame) -> pd.DataFrame:
        if rows.empty or walkers.empty:
            return _frame([], names)
        rows = rows.sort_values(["bound", "vec_id"], ascending=[False, True], kind="stable")
        ids, labels = rows["vec_id"].to_numpy(np.int64), rows["label"].to_numpy(np.int64)
        own = walkers["vec_id"].to_numpy(np.int64)
        searches = [searches_of(w) for w in walkers.itertuples(index=False)]
        walk(np.stack(walkers["v"]), [[s for _, s in x] for x in searches], np.stack(rows["v"]), ids, rows["bound"].to_numpy(np.float64),
             lambda i, some: (ids[some] != own[i]) & ((labels[some] == walkers["label"].iat[i]) == same))
        return _frame([(int(own[i]), *head, j, -s) for i, x in enumerate(searches) for head, search in x for s, j in search.rows], names)

    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(task, ", ".join(f"{n} long" for n in names))


def _frame(rows: list[tuple], columns: list[str]) -> pd.DataFrame:
    return pd.DataFrame({c: pd.Series([max(-_LONG - 1, min(_LONG, r[i])) for r in rows], dtype="int64") for i, c in enumerate(columns)})


def _positives(rows: DataFrame, anchors: DataFrame, centres: dict, widths: dict, seed: int, n_positives: int) -> DataFrame:
    """anchor_id, positive_id, positive_score: each anchor's best other rows of its label."""
    group = ["dim", "label"]
    # Ranked before the exchange, so that a hot label sends no more than LABEL_SEEDS rows from a task.
    place = F.row_number().over(Window.partitionBy(*group).orderBy(F.xxhash64(F.lit(seed), "vec_id"), "vec_id"))
    seeds = rows.withColumn("place", place).where(F.col("place") <= LABEL_SEEDS).groupBy(*group).agg(F.collect_list("v").alias("seeds"), F.collect_list("vec_id").alias("seed_ids"))
    joined = anchors.join(seeds, group)

    def first_need(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            needs = []
            for own, v, several, ids in zip(*(batch.column(c).to_pylist() for c in ("vec_id", "v", "seeds", "seed_ids"))):
                kept = [x for x, i in zip(several, ids) if i != own]
                others = np.array(kept, np.float64).reshape(len(kept), len(v))
                scores = sorted((not_above(int(s)) for s in dots(np.array([v], np.float64).reshape(1, len(v)), others)[0]), reverse=True)
                needs.append(scores[n_positives - 1] if len(scores) >= n_positives else None)
            slim = batch.drop_columns(["seeds", "seed_ids"])
            yield pa.RecordBatch.from_arrays([*slim.columns, pa.array(needs, pa.float64())], [*slim.schema.names, "need"])

    schema = f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in joined.drop('seeds', 'seed_ids').schema)}, need double"
    needy = stored(joined.mapInArrow(first_need, schema), "anchor-needs")

    def searches_of(anchor: tuple) -> list[tuple[tuple, Search]]:
        return [((), Search(n_positives, -math.inf if pd.isna(anchor.need) else anchor.need))]

    # Lists of a cluster by label: only rows of one label can be positives.
    found = _walked(_lists(rows, needy, centres, widths), needy, ["dim", "cell", "label"], True, searches_of, ["anchor_id", "positive_id", "positive_score"])
    best = F.row_number().over(Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id"))
    return stored(found.withColumn("place", best).where(F.col("place") <= n_positives).drop("place"), "positives")


def mine(embeddings: DataFrame, is_anchor: Column | None = None, label: Column | None = None, n_positives: int = 5, n_negatives: int = 10, low: int = 30, high: int = 90,
         scale: int = 256, seed: int = 0) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    A score is the inner product of the vectors' ``floor(scale * x)``. An anchor's positives are its ``n_positives`` best other rows of the same label; for each, the
    ``n_negatives`` best rows of other labels with ``low * positive_score <= 100 * negative_score <= high * positive_score``; ties by smaller id. All
    are exact: a walk ends only where the bound proves that nothing is missed.

    Rows with a null id or label, a null vector, or null or non-finite components take no part. Vectors of different lengths are not compared. Of
    rows with one id the smallest by length, vector and label counts. Scores beyond a long are given as the nearest long. A positive without negatives, and an anchor without positives, gives no rows; so
    does an empty table. Other columns are ignored.
    """
    label = F.col("label") if label is None else label
    is_anchor = F.col("vec_id") % 100 == 0 if is_anchor is None else is_anchor
    rows = taking_part(embeddings, label, scale)
    anchors, centres, widths = _assign(rows.where(is_anchor), seed)
    positives = _positives(rows, anchors, centres, widths, seed, n_positives)
    wanted = positives.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.collect_list(F.struct("positive_id", "positive_score")).alias("positives"))
    # A bounded sample of all rows, to learn how high negatives go.
    sample = rows.orderBy(F.xxhash64(F.lit(seed + 1), "vec_id"), "vec_id").limit(SAMPLE).collect()
    by_dim: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
    for d in {r["dim"] for r in sample}:
        some = [r for r in sample if r["dim"] == d]
        by_dim[d] = (np.array([r["v"] for r in some], np.float64).reshape(len(some), d), np.array([r["vec_id"] for r in some]), np.array([r["label"] for r in some]))
    known = rows.sparkSession.sparkContext.broadcast(by_dim)
    joined = anchors.join(wanted, "vec_id")

    def limits(score: int) -> tuple[int, int]:
        """The least and the greatest negative score that goes with a positive one."""
        return -(-low * score // 100), high * score // 100

    def first_need(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            needs, each = [], []
            for row in batch.to_pylist():
                least = []
                vectors, ids, labels = known.value.get(row["dim"], (np.zeros((0, row["dim"])), np.zeros(0), np.zeros(0)))
                other = (labels != row["label"]) & (ids != row["vec_id"])
                scores = dots(np.array([row["v"]], np.float64).reshape(1, row["dim"]), vectors[other])[0]
                for p in row["positives"]:
                    bottom, top = limits(p["positive_score"])
                    inside = sorted((not_above(int(s)) for s in scores if bottom <= s <= top), reverse=True)
                    least.append(inside[n_negatives - 1] if len(inside) >= n_negatives else not_above(bottom))
                each.append(least)
                # Searches with an empty range need nothing.
                open_ = [x for x, p in zip(least, row["positives"]) if limits(p["positive_score"])[0] <= limits(p["positive_score"])[1]]
                needs.append(min(open_, default=math.inf))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(needs, pa.float64()), pa.array(each, pa.list_(pa.float64()))], [*batch.schema.names, "need", "each"])

    schema = f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in joined.schema)}, need double, each array<double>"
    needy = stored(joined.mapInArrow(first_need, schema), "anchor-ranges").where(F.col("need") < math.inf)

    def searches_of(anchor: tuple) -> list[tuple[tuple, Search]]:
        ranges = [(p, need, *limits(int(p["positive_score"]))) for p, need in zip(anchor.positives, anchor.each)]
        return [((int(p["positive_id"]), int(p["positive_score"])), Search(n_negatives, need, bottom, top)) for p, need, bottom, top in ranges if bottom <= top]

    names = ["anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"]
    found = _walked(_lists(rows, needy, centres, widths), needy, ["dim", "cell"], False, searches_of, names)
    rank = F.row_number().over(Window.partitionBy("anchor_id", "positive_id", "positive_score").orderBy(F.desc("negative_score"), "negative_id"))
    ranked = found.withColumn("rank", rank).where(F.col("rank") <= n_negatives)
    return ranked.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
