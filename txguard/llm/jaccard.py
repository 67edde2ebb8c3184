"""Exact similarity join of documents on word shingles, with adaptive multi-match prefixes.

Shingles have one order for all documents: those in few documents first. Two sets as alike as the threshold asks share, among the first
``size - least overlap + l`` shingles of each, at least ``l``. A document picks ``l`` by its estimated costs: a longer prefix reads
more postings, and more shared shingles leave fewer candidates to verify. A pair is verified if it shares as many as the smaller ``l``
of the two. Documents with the same set are one class and are compared once.

Shingles that many documents have would join all of them with each other. They stand last in the order, so that only near copies share
them within their prefixes; such long postings give no pairs but are verified in square blocks inside tasks, which give a spanning forest of
links at most. Nothing is capped: every pair that shares enough of its prefixes is verified.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txguard.llm.common import fresh, one_of_each, stored
from txguard.llm.components import components

# Postings longer than this are verified in blocks instead of pair by pair.
LONG_POSTING = 48
# Documents and shingles of a block; a task holds two.
BLOCK, BLOCK_ITEMS = 512, 1 << 20
MAX_DEPTH = 4
# Shingles ranked by their counts and broadcast, at most (16 bytes each).
RANKED = 1 << 18
# Shingles counted together in one task before what occurs once is forgotten.
CHUNK = 4_000_000
# Costs of verifying a pair and of another document with a shingle that is not ranked, in postings read.
VERIFY_COST, PLAIN_COST = 50.0, 0.1
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], np.uint64)


def shingles(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles, A-Z in lower case; fewer words are one shingle, none is empty."""
    words = text.encode().lower().split() if text else []
    if not words:
        return np.zeros(0, np.int64)
    digest = xxhash.xxh3_64_intdigest
    if len(words) < k:
        return np.array([digest(b" ".join(words), len(words))], np.uint64).view(np.int64)
    h = np.array([digest(w) for w in words], np.uint64)
    n = len(h) - k + 1
    total = np.zeros(n, np.uint64)
    for i in range(k):
        total ^= total >> np.uint64(29)
        total = total * _ODD[0] + h[i : n + i] * _ODD[1 + i % 5]
    total ^= total >> np.uint64(31)
    total *= _ODD[2]
    total ^= total >> np.uint64(29)
    return np.unique(total).view(np.int64)


def class_key(found: np.ndarray) -> int:
    return int(np.array([xxhash.xxh3_64_intdigest(found.tobytes(), len(found))], np.uint64).view(np.int64)[0])


def least_overlap(size: int, percent: int) -> int:
    """Shingles that any partner must share."""
    return -(-percent * size // 100)


def _scan(docs: DataFrame, k: int) -> DataFrame:
    """One row per document (doc_id, text_hash, key, n), and partial counts of shingles (token, seen)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: set[int] = set()
        held: list[np.ndarray] = []
        size = 0

        def counts() -> pa.RecordBatch:
            values, n = np.unique(np.concatenate(held), return_counts=True)
            often = n > 1
            none = pa.nulls(int(often.sum()), pa.int64())
            return pa.RecordBatch.from_arrays([none, none, none, none, pa.array(values[often]), pa.array(n[often].astype(np.int64))], names=names)

        names = ["doc_id", "text_hash", "key", "n", "token", "seen"]
        for batch in batches:
            rows = []
            for doc_id, text_hash, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text_hash", "text"))):
                found = shingles(text, k)
                key = class_key(found)
                rows.append((doc_id, text_hash, key, len(found)))
                if key not in keys and len(found):
                    keys.add(key)
                    held.append(found)
                    size += len(found)
                if size > CHUNK:
                    yield counts()
                    held, size = [], 0
            if rows:
                none = pa.nulls(len(rows), pa.int64())
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in zip(*rows)), none, none], names=names)
        if held:
            yield counts()

    return stored(docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(
        scan, "doc_id long, text_hash long, key long, n long, token long, seen long"), "shingle-scan")


def _ranks(scan: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent shingles and their counts, as many as ``RANKED`` allows.

    The least count that is ranked follows from how many shingles have each count. Any order gives the same links; a good one keeps
    shingles that many documents share out of their prefixes.
    """
    often = stored(scan.where("token is not null").groupBy("token").agg(F.sum("seen").alias("seen")), "shingle-counts")
    # Counts above 1,000 are ranked in any case where they fit, so the histogram is short.
    sizes = often.groupBy(F.least("seen", F.lit(1000)).alias("seen")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("seen")).collect()
    least, total = None, 0
    for r in sizes:
        total += r["n"]
        if total > RANKED:
            break
        least = r["seen"]
    if least is None:
        # So many are frequent: those above the share that at most ``RANKED`` can have.
        whole = scan.agg(F.sum("n")).first()[0] or 0
        least = max(1000, whole // RANKED + 1)
    rows = often.where(F.col("seen") >= int(least)).toPandas().sort_values("token")
    return rows["token"].to_numpy(np.int64), rows["seen"].to_numpy(np.int64)


def choose_depth(costs: np.ndarray, base: int, most: int) -> int:
    """How many shared shingles to ask for: postings read plus candidates to verify, each sharing that many, is least."""
    ends = np.cumsum(costs)[base - 1 : base - 1 + most]
    depth = np.arange(1, len(ends) + 1)
    return int(np.argmin(ends + depth + VERIFY_COST * ends / depth)) + 1


def _postings(docs: DataFrame, k: int, percent: int, ranks: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """token, key, meta for the prefix of each class; meta packs the set's size, the token's level and the document's depth."""
    shared = docs.sparkSession.sparkContext.broadcast(ranks)

    def prefix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, seen = shared.value
        keys: set[int] = set()
        for batch in batches:
            out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            for text in batch.column("text").to_pylist():
                found = shingles(text, k)
                key = class_key(found)
                if not len(found) or key in keys:
                    continue
                keys.add(key)
                weight = np.zeros(len(found), np.int64)
                if len(often):
                    at = np.minimum(np.searchsorted(often, found), len(often) - 1)
                    weight = np.where(often[at] == found, seen[at], 0)
                order = np.lexsort((found, weight))
                least = least_overlap(len(found), percent)
                base = len(found) - least + 1
                depth = choose_depth(np.maximum(weight[order], PLAIN_COST), base, min(MAX_DEPTH, least))
                tokens = found[order[: base + depth - 1]]
                level = np.maximum(np.arange(len(tokens)) - base + 2, 1)
                out.append((tokens, np.full(len(tokens), key), (len(found) << 16) + (level << 8) + depth))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in zip(*out)], names=["token", "key", "meta"])

    return docs.select("text").mapInArrow(prefix, "token long, key long, meta long")


def _alike_sizes(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    return 100 * np.minimum(a, b) >= percent * np.maximum(a, b)


def _candidates(postings: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b, need) from short postings, one row per shared token; rows (token, a, meta) of long ones."""

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["token", "a", "b", "need"]
        rest = np.zeros((0, 3), np.int64)
        long_token = None

        def batch_of(token: np.ndarray, a: np.ndarray, b: np.ndarray | None, need: np.ndarray) -> pa.RecordBatch:
            second = pa.nulls(len(a), pa.int64()) if b is None else pa.array(b)
            return pa.RecordBatch.from_arrays([pa.array(token), pa.array(a), second, pa.array(need)], names=names)

        def runs(rows: np.ndarray, last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal rest, long_token
            new = np.ones(len(rows), bool)
            new[1:] = (rows[1:, :2] != rows[:-1, :2]).any(axis=1)  # the same class from another task
            rows = rows[new]
            starts = np.flatnonzero(np.concatenate([[True], rows[1:, 0] != rows[:-1, 0]])) if len(rows) else np.zeros(0, np.int64)
            ends = np.append(starts[1:], len(rows))
            rest = np.zeros((0, 3), np.int64)
            pairs: list[np.ndarray] = []
            for s, e in zip(starts[(ends - starts > 1) | (ends == len(rows))], ends[(ends - starts > 1) | (ends == len(rows))]):
                token = rows[s, 0]
                if e - s > LONG_POSTING or token == long_token:
                    long_token = token
                    yield batch_of(rows[s:e, 0], rows[s:e, 1], None, rows[s:e, 2])
                elif e == len(rows) and not last:
                    rest = rows[s:e]
                elif e - s > 1:
                    i, j = np.triu_indices(e - s, 1)
                    x, y = rows[s + i], rows[s + j]
                    need = np.minimum(x[:, 2] & 255, y[:, 2] & 255)
                    ok = (np.maximum(x[:, 2] >> 8 & 255, y[:, 2] >> 8 & 255) <= need) & _alike_sizes(x[:, 2] >> 16, y[:, 2] >> 16, percent)
                    pairs.append(np.stack([x[ok, 0], x[ok, 1], y[ok, 1], need[ok]]))
            if pairs:
                token, a, b, need = np.concatenate(pairs, axis=1)
                yield batch_of(token, a, b, need)

        for batch in batches:
            rows = np.stack([batch.column(c).to_numpy() for c in ("token", "key", "meta")], axis=1)
            yield from runs(np.concatenate([rest, rows]), False)
        yield from runs(rest, True)

    ordered = postings.repartition("token").sortWithinPartitions("token", "key")
    return stored(ordered.mapInArrow(pair, "token long, a long, b long, need long"), "shingle-candidates")


def linked_in_block(keys: list[int], side: np.ndarray, items: list[np.ndarray], within: bool, percent: int, tokens: list[np.ndarray] | None = None,
                    token: int = 0) -> list[tuple[int, int]]:
    """A spanning forest of the links in one block.

    Pairs are of one side each, or any ``within`` one block. With ``tokens``, the long postings that each document stands in, a pair belongs
    to the smallest that both stand in.
    """
    n = len(keys)

    def shared(lists: list[np.ndarray]) -> np.ndarray:
        values, inverse, counts = np.unique(np.concatenate(lists), return_inverse=True, return_counts=True)
        owner = np.repeat(np.arange(n), [len(x) for x in lists])
        use = counts > 1
        column = np.cumsum(use) - 1
        both = use[inverse]
        owner, place = owner[both], column[inverse[both]]
        order = np.argsort(place, kind="stable")
        owner, place = owner[order], place[order]
        total, width = np.zeros((n, n), np.float32), int(use.sum())
        for at in range(0, width, 4096):
            a, b = np.searchsorted(place, [at, at + 4096])
            m = np.zeros((n, min(4096, width - at)), np.float32)
            m[owner[a:b], place[a:b] - at] = 1
            total += m @ m.T
        return total

    size = np.array([len(x) for x in items])
    inter = shared(items)
    link = 100 * inter >= percent * (size[:, None] + size[None, :] - inter)
    earlier = [t[t < token] for t in tokens] if tokens else []
    if any(len(t) for t in earlier):
        link &= shared(earlier) == 0
    if not within:
        link &= side[:, None] != side[None, :]
    parent = list(range(n))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    forest = []
    for i, j in np.argwhere(np.triu(link, 1)):
        a, b = root(int(i)), root(int(j))
        if a != b:
            parent[max(a, b)] = min(a, b)
            forest.append((keys[i], keys[j]))
    return forest


def _blocks() -> F.Column:
    return F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("n") / BLOCK_ITEMS)).cast("int").alias("blocks")


def _plan(pairs: DataFrame, members: DataFrame, classes: DataFrame) -> DataFrame:
    """Where each class is verified: rows (key, kind, id, block, low, high, tokens), one for each pair of blocks that it takes part in.

    Candidates that hang together are a family. A family is verified as a whole (kind 0) where that moves fewer sets than its pairs and long
    postings would one by one; else its postings (kind 1) and its pairs (kind 2) are verified each for itself.
    """
    leads = members.groupBy("token").agg(F.min("key").alias("lead"))
    ties = members.join(leads, "token").select(F.col("key").alias("a"), F.col("lead").alias("b")).where("a <> b").distinct()
    inner = components(pairs.unionByName(ties))
    family = inner.select(F.col("node").alias("key"), F.col("component").alias("family")).unionByName(
        inner.select(F.col("component").alias("key"), F.col("component").alias("family")).distinct())
    family = stored(family.join(classes.select("key", "n"), "key"), "shingle-families")
    sizes = family.groupBy("family").agg(F.count(F.lit(1)).alias("size"), _blocks())
    pair_costs = pairs.join(family.select(F.col("key").alias("a"), "family"), "a").groupBy("family").agg((2 * F.count(F.lit(1))).alias("moved"))
    weighed = members.join(family, "key")
    lists = weighed.groupBy("family", "token").agg((F.count(F.lit(1)) * _blocks()).alias("moved"))
    costs = pair_costs.unionByName(lists.select("family", "moved")).groupBy("family").agg(F.sum("moved").alias("moved"))
    plans = sizes.join(costs, "family").select("family", "blocks", (F.col("size") * F.col("blocks") <= F.col("moved")).alias("whole"))
    planned = stored(family.join(plans, "family"), "shingle-planned")
    whole = planned.where("whole").select(F.lit(0).alias("kind"), F.col("family").alias("id"), "key", "blocks")
    single = planned.where("not whole").select("key", "n")
    rest = members.join(single, "key")
    postings = rest.join(rest.groupBy("token").agg(_blocks()), "token").select(F.lit(1).alias("kind"), F.col("token").alias("id"), "key", "blocks")
    twos = pairs.join(single.select(F.col("key").alias("a")), "a").select(
        F.lit(2).alias("kind"), F.xxhash64("a", "b").alias("id"), F.explode(F.array("a", "b")).alias("key"), F.lit(1).alias("blocks"))
    dealt = whole.unionByName(postings).unionByName(twos).withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    own = rest.groupBy("key").agg(F.collect_list("token").alias("tokens"))
    return dealt.select("key", "kind", "id", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high")).join(
        own, "key", "left")


def _verified(docs: DataFrame, k: int, plan: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) of classes that connect all that candidates link. Texts move once, and each set to the blocks where it is compared."""
    schema = "kind int, id long, low int, high int, key long, block int, tokens array<long>, items array<long>"
    kinds = [pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64())]
    names = ["kind", "id", "low", "high", "key", "block", "tokens", "items"]

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            size = 0
            for key, text, places in zip(*(batch.column(c).to_pylist() for c in ("key", "text", "places"))):
                found = shingles(text, k)
                if class_key(found) != key:  # another text under the representative's id
                    continue
                for p in places:
                    out.append((p["kind"], p["id"], p["low"], p["high"], key, p["block"], p["tokens"], found))
                    size += len(found)
                    # Few long texts make a batch of their own.
                    if size > BLOCK_ITEMS:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)
                        out, size = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)

    places = plan.groupBy("key").agg(F.collect_list(F.struct("kind", "id", "block", "low", "high", "tokens")).alias("places"))
    texts = places.join(classes.select("key", "rep"), "key").join(docs.select(F.col("doc_id").alias("rep"), "text"), "rep")
    dealt = texts.select("key", "text", "places").mapInArrow(sets, schema)

    def verify(group: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        kind, token, low, high = group
        rows = rows.drop_duplicates("key")
        links = []
        if len(rows) > 1:
            tokens = list(rows["tokens"]) if kind == 1 else None
            links = linked_in_block(rows["key"].tolist(), rows["block"].to_numpy(), list(rows["items"]), low == high, percent, tokens, token)
        return pd.DataFrame(links, columns=["a", "b"], dtype="int64")

    return stored(dealt.groupBy("kind", "id", "low", "high").applyInPandas(verify, "a long, b long"), "shingle-links")


def similar_documents(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id of every row: documents link if ``100 * shared >= percent * all`` of their k-word shingles.

    component_id is the smallest doc_id reachable by links, itself included. Null and empty texts have no shingles and link with nothing.
    Rows without doc_id get no component and link nothing. Repeated rows are one document; rows of one id and different texts each link
    on their own under that id. Other columns are ignored; an empty table gives no rows.
    """
    documents, classes, links = _linked(docs, k, percent)
    ids = links.join(classes.select(F.col("key").alias("a"), F.col("rep").alias("ra")), "a").join(
        classes.select(F.col("key").alias("b"), F.col("rep").alias("rb")), "b").select(F.col("ra").alias("a"), F.col("rb").alias("b"))
    labels = components(ids)
    labelled = classes.join(labels, F.col("rep") == F.col("node"), "left").select(
        F.col("key"), F.coalesce("component", "rep").alias("component_id"))
    alone = F.col("n") == 0
    return documents.where(~alone & F.col("doc_id").isNotNull()).join(labelled, "key").select(
        "doc_id", F.col("n").alias("n_shingles"), "component_id").unionByName(
        documents.where(alone | F.col("doc_id").isNull()).select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def _linked(docs: DataFrame, k: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Every row (doc_id, text_hash, key of its set, n), the sets (key, rep: the smallest doc_id, n) and links between them (a, b: keys)."""
    scan = _scan(docs, k)
    documents = scan.where("key is not null").select("doc_id", "text_hash", "key", "n")
    classes = stored(documents.where("n > 0 and doc_id is not null").groupBy("key").agg(
        F.min("doc_id").alias("rep"), F.max("n").alias("n"), F.min(F.struct("doc_id", "text_hash")).alias("first")), "shingle-classes")
    found = _candidates(_postings(docs.where("doc_id is not null"), k, percent, _ranks(scan)), percent)
    pairs = stored(found.where("b is not null").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.min("need").alias("need")).where(
        "n >= need").select("a", "b"), "shingle-pairs")
    members = stored(found.where("b is null").select("token", F.col("a").alias("key")).distinct(), "shingle-members")
    return documents, classes, _verified(docs, k, _plan(pairs, members, classes), classes, percent)


def without_near_copies(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One document of each group of linked ones, the one with the smallest doc_id and, of several texts with that id, the smallest hash.

    Texts link, not ids: of an id with several texts only those go that are near copies. Rows equal in doc_id and text are one document and stay once. Documents
    without shingles link with nothing; rows without doc_id go only if they are repeated.
    """
    docs = one_of_each(docs)
    documents, classes, links = _linked(docs, k, percent)
    labels = components(links)
    grouped = stored(classes.join(labels, F.col("key") == F.col("node"), "left").select("key", "first", F.coalesce("component", "key").alias("group")), "shingle-groups")
    kept = stored(grouped.groupBy("group").agg(F.min("first").alias("kept")), "kept-documents")
    # Written, so that Spark splits what a large class or group makes of the other side.
    known = stored(grouped.join(kept, "group").select("key", "kept"), "kept-by-class")
    own = [fresh(docs.columns, "own_id"), fresh(docs.columns, "own_hash")]
    gone = documents.where("n > 0 and doc_id is not null").join(known, "key").where(F.struct("doc_id", "text_hash") != F.col("kept")).select("doc_id", "text_hash").distinct()
    gone = stored(gone.toDF(*own), "near-copies")
    # What goes grows with the table, so it is not broadcast where it happens to be small.
    return docs.join(gone.hint("merge"), (docs["doc_id"] == F.col(own[0])) & (F.xxhash64(docs["text"]) == F.col(own[1])), "left_anti")
