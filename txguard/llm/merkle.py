"""Merkle manifest of a table by time-forward processing.

Every row is a leaf; the leaves of a source make a tree, and the sources' roots make one more. A node's label is (last leaf below it, level), so
a node's label is greater than those of all its descendants. The upward sweep visits labels in ascending order: a priority queue ordered by label
holds the digests sent to parents, and a parent takes its children's digests from the queue when its label is the next. The downward sweep visits
labels in descending order: a parent sends each child the proof suffix from there to the root, and a leaf takes its whole proof from the queue.

The queue lies outside memory as far as it grows with the table: a tree is cut into blocks of ``FAN ** LEVELS`` consecutive nodes, messages within
a block pass through a small heap while its rows stream by in label order, and messages between blocks are rows of a table that Spark sorts by
label for the next round. So rounds are the logarithm of the table to the base of a block, a hot source is many blocks, and a task holds
no more than the digests on one path.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from txguard.llm.common import stored

# Children of a node, and levels of a block.
FAN, LEVELS = 16, 2
_LAST = (1 << 63) - 1
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A node of the upward sweep: its label within the round, and its children's digests. The root of a block has ``top``, its own digest.
_UP = "tree string, block long, last long, level int, n long, kids binary, top binary, next_n long"
_UP_ARROW = pa.schema([("tree", pa.string()), ("block", pa.int64()), ("last", pa.int64()), ("level", pa.int32()), ("n", pa.int64()), ("kids", pa.binary()),
                       ("top", pa.binary()), ("next_n", pa.int64())])
_SUFFIX = "tree string, idx long, suffix binary, subroot binary, root binary"
_SUFFIX_ARROW = pa.schema([("tree", pa.string()), ("idx", pa.int64()), ("suffix", pa.binary()), ("subroot", pa.binary()), ("root", pa.binary())])
_PROOF = "doc_id long, leaf string, subroot string, root string, proof array<string>, proof_sha256 string, folded_root string, verified boolean"
_PROOF_ARROW = pa.schema([("doc_id", pa.int64()), ("leaf", pa.string()), ("subroot", pa.string()), ("root", pa.string()), ("proof", pa.list_(pa.string())),
                          ("proof_sha256", pa.string()), ("folded_root", pa.string()), ("verified", pa.bool_())])


def digest_of(kids: bytes) -> bytes:
    """The digest of a node from its children's digests, as hex text one after another."""
    return hashlib.sha256(kids.hex().encode()).digest()


def height(n: int) -> int:
    """Levels above ``n`` nodes within a block's levels."""
    h = 0
    while n > 1 and h < LEVELS:
        n, h = -(-n // FAN), h + 1
    return h


def last_below(idx: int, level: int, n: int) -> int:
    """The last of ``n`` nodes below the ancestor of node ``idx`` at ``level``."""
    width = FAN**level
    return min((idx // width + 1) * width, n) - 1


def leaf_columns(docs: DataFrame, seen_text: Column | None = None) -> DataFrame:
    """doc_id, source, leaf and seen (digests; ``seen`` with ``seen_text`` for text, else null) of every row."""

    def digest(text: Column) -> Column:
        fields = [F.col(c).cast("string") for c in ("doc_id", "source", "lang", "n_chars")] + [text]
        parts = [F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in fields]
        return F.unhex(F.sha2(F.concat(*parts), 256))

    seen = F.lit(None).cast("binary") if seen_text is None else F.when(~seen_text.eqNullSafe(F.col("text")), digest(seen_text))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), digest(F.col("text")).alias("leaf"),
                       seen.alias("seen"))


def _numbered(rows: DataFrame, tree: Column, order: list[str]) -> DataFrame:
    """``rows`` with tree, idx (place in its tree by ``order``) and n (nodes of the tree). The exchange by ranges splits a hot tree like any other.

    A task's rows of one tree are a run; one row per run is summed up over the runs before it.
    """
    by = ["tree", *order]
    sort = stored(rows.withColumn("tree", tree).repartitionByRange(*by).sortWithinPartitions(*by).withColumn("mid", F.monotonically_increasing_id()),
                  "merkle-order").withColumn("pid", F.shiftright("mid", 33))
    runs = sort.groupBy("tree", "pid").agg(F.min("mid").alias("first"), F.count(F.lit(1)).alias("size"))
    whole = Window.partitionBy("tree")
    before = F.sum("size").over(whole.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1))
    placed = runs.select("tree", "pid", "first", F.coalesce(before, F.lit(0)).alias("before"), F.sum("size").over(whole).alias("n"))
    return sort.join(placed, ["tree", "pid"]).withColumn("idx", F.col("mid") - F.col("first") + F.col("before")).drop("mid", "pid", "first", "before", *(
        c for c in order if c == "row"))


def _blocked(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("block", F.floor(F.col("idx") / (FAN**LEVELS)).cast("long"))


def _up(nodes: DataFrame) -> DataFrame:
    """The upward sweep of one round over nodes (tree, idx, n, digest): the nodes above them, block by block."""

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queue: list[tuple[int, int, int, bytes]] = []  # (last, level, child, digest), least label first
        for batch in batches:
            out = []
            for tree, block, idx, n, digest in zip(*(batch.column(c).to_pylist() for c in ("tree", "block", "idx", "n", "digest"))):
                top = height(n)
                above = -(-n // FAN**top)
                if not top:
                    out.append((tree, block, idx, 0, n, None, digest, above))
                    continue
                heapq.heappush(queue, (last_below(idx, 1, n), 1, idx, digest))
                while queue and queue[0][0] == idx:
                    last, level = queue[0][:2]
                    kids = []
                    while queue and queue[0][:2] == (last, level):
                        kids.append(heapq.heappop(queue)[3])
                    joined = b"".join(kids)
                    own = digest_of(joined)
                    out.append((tree, block, last, level, n, joined, own if level == top else None, above))
                    if level < top:
                        heapq.heappush(queue, (last_below(idx, level + 1, n), level + 1, last, own))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _UP_ARROW.types)], schema=_UP_ARROW) if out else _none(_UP_ARROW)

    spread = _blocked(nodes).select("tree", "block", "idx", "n", "digest").repartition("tree", "block").sortWithinPartitions("tree", "block", "idx")
    return stored(spread.mapInArrow(sweep, _UP), "merkle-nodes")


def _none(schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([], schema=schema)


def _sweep_down(finish: Callable[[dict, bytes, list[tuple[int, bytes]]], tuple], schema: pa.Schema) -> Callable:
    """Deliver proof suffixes: ``finish(row, block's suffix row, groups)`` makes a leaf's output from (child, digests) groups, lowest first."""

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queue: list[tuple[int, int, tuple]] = []  # (-last, -level, suffix), greatest label first; labels are unique
        head: dict = {}
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                last, level, n = row["last"], row["level"], row["n"]
                if row["suffix"] is not None:  # the first row of a block
                    head, queue = row, []
                    end = last_below(row["block"] * FAN**LEVELS, LEVELS, n)
                    heapq.heappush(queue, (-end, -height(n), ()))
                    continue
                key, _, groups = heapq.heappop(queue)
                if -key != last:
                    raise ValueError("labels out of order")
                if level:
                    kids = row["kids"]
                    width = FAN ** (level - 1)
                    first = last // FAN**level * FAN
                    for child in range(len(kids) // 32):
                        end = min((first + child + 1) * width - 1, last)
                        heapq.heappush(queue, (-end, 1 - level, ((child, kids), groups)))
                else:
                    path = []
                    while groups:
                        path.append(groups[0])
                        groups = groups[1]
                    out.append(finish(row, head, path))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema) if out else _none(schema)

    return sweep


def _down(leaves: DataFrame, nodes: DataFrame, suffixes: DataFrame, finish: Callable, schema: pa.Schema, ddl: str) -> DataFrame:
    """The downward sweep of one round; ``suffixes`` has the suffix of each block's root (tree, idx: the block)."""
    carried = [c for c in leaves.columns if c not in ("tree", "idx", "n", "digest")]
    rows = _blocked(leaves).select("tree", "block", F.col("idx").alias("last"), F.lit(0).alias("level"), "n", "digest", *carried)
    inner = nodes.where("kids is not null").select("tree", "block", "last", "level", "n", "kids")
    # The number of nodes of a tree stands with each block's root.
    sizes = nodes.where("top is not null").select("tree", "block", "n")
    heads = sizes.join(suffixes.withColumnRenamed("idx", "block"), ["tree", "block"]).select(
        "tree", "block", F.lit(_LAST).alias("last"), F.lit(LEVELS + 1).alias("level"), "n", "suffix", "subroot", "root")
    every = rows.unionByName(inner, allowMissingColumns=True).unionByName(heads, allowMissingColumns=True)
    order = ["tree", "block", F.desc("last"), F.desc("level")]
    return every.repartition("tree", "block").sortWithinPartitions(*order).mapInArrow(_sweep_down(finish, schema), ddl)


def _packed(path: list[tuple[int, bytes]]) -> bytes:
    return b"".join(bytes((child, len(kids) // 32)) + kids for child, kids in path)


def _unpacked(suffix: bytes) -> list[tuple[int, bytes]]:
    out, at = [], 0
    while at < len(suffix):
        end = at + 2 + 32 * suffix[at + 1]
        out.append((suffix[at], suffix[at + 2 : end]))
        at = end
    return out


def _pass_on(row: dict, head: dict, path: list[tuple[int, bytes]]) -> tuple:
    return row["tree"], row["last"], _packed(path) + head["suffix"], head["subroot"], head["root"]


def _proof(row: dict, head: dict, path: list[tuple[int, bytes]]) -> tuple:
    """A leaf's output: its proof, and the root that the seen leaf folds to along it."""
    path = path + _unpacked(head["suffix"])
    now = row["seen"] or row["digest"]
    proof = []
    for child, kids in path:
        at = 32 * child
        proof += [kids[i : i + 32].hex() for i in range(0, len(kids), 32) if i != at]
        now = digest_of(kids[:at] + now + kids[at + 32 :])
    return (row["doc_id"], row["digest"].hex(), head["subroot"].hex(), head["root"].hex(), proof, hashlib.sha256("".join(proof).encode()).hexdigest(), now.hex(),
            now == head["root"])


def _climb(nodes: DataFrame) -> tuple[list[tuple[DataFrame, DataFrame]], DataFrame]:
    """(nodes, nodes above them) of each round, and the roots of all trees: tree, round, digest."""
    rounds, roots = [], None
    while True:
        above = _up(nodes)
        rounds.append((nodes, above))
        tops = above.where("top is not null")
        done = tops.where("next_n = 1").select("tree", F.lit(len(rounds) - 1).alias("round"), F.col("top").alias("digest"))
        roots = done if roots is None else roots.unionByName(done)
        rest = tops.where("next_n > 1")
        if rest.isEmpty():
            return rounds, roots
        nodes = rest.select("tree", F.col("block").alias("idx"), F.col("next_n").alias("n"), F.col("top").alias("digest"))


def _descend(rounds: list[tuple[DataFrame, DataFrame]], ends: DataFrame, finish: Callable, schema: pa.Schema, ddl: str) -> DataFrame:
    """Deliver the suffixes of the trees' roots (``ends``: tree, round and the columns of a suffix) to the nodes of the first round."""
    given = None
    for i in range(len(rounds) - 1, -1, -1):
        own = ends.where(F.col("round") == i).select("tree", F.lit(0).cast("long").alias("idx"), "suffix", "subroot", "root")
        given = own if given is None else given.unionByName(own)
        if i:
            given = stored(_down(*rounds[i], given, _pass_on, _SUFFIX_ARROW, _SUFFIX), "merkle-suffixes")
    return _down(*rounds[0], given, finish, schema, ddl)


def manifest(docs: DataFrame, seen_text: Column | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, leaf, subroot (of its source), root, proof (the siblings' digests from the leaf to the root, left to right on
    each level), proof_sha256, folded_root and verified (whether it is the root).

    A leaf is the digest of doc_id, source, lang, n_chars and text, ``-`` for a null and else byte length, ``:``, value. Leaves of a source ascend by
    doc_id, null first; rows of one doc_id by their digest, and equal rows take their places in any order, as they give the same rows. Null is a source of its own and the
    first. ``folded_root`` is recomputed with ``seen_text``, the text as it is found when the proof is checked; without it, with the text itself.
    Texts are read once and never move. An empty table gives no rows; a table with one row has its leaf for a root. Other columns are ignored.
    """
    leaves = stored(leaf_columns(docs, seen_text).withColumn("row", F.monotonically_increasing_id()), "merkle-leaves")
    # Null before all names, and no null in the key.
    key = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))
    placed = _numbered(leaves, key, ["doc_id", "leaf", "row"]).select("tree", "idx", "n", "doc_id", "seen", F.col("leaf").alias("digest"))
    first = stored(placed, "merkle-first")
    rounds, subroots = _climb(first)
    subroots = stored(subroots, "merkle-subroots")
    # The sources' roots are the leaves of one more tree.
    upper = _numbered(subroots.withColumnRenamed("tree", "name"), F.lit("top"), ["name"])
    upper = stored(upper.select("tree", "idx", "n", "name", "round", "digest"), "merkle-upper")
    upper_rounds, root = _climb(upper.select("tree", "idx", "n", "digest"))
    ends = root.select("tree", "round", F.lit(b"").alias("suffix"), F.lit(b"").alias("subroot"), F.col("digest").alias("root"))
    suffixes = _descend(upper_rounds, ends, _pass_on, _SUFFIX_ARROW, _SUFFIX)
    below = upper.join(suffixes.select("idx", "suffix", "root"), "idx").select(
        F.col("name").alias("tree"), "round", "suffix", F.col("digest").alias("subroot"), "root")
    return _descend(rounds, stored(below, "merkle-ends"), _proof, _PROOF_ARROW, _PROOF)


def lowered_where(doc_id: Column, text: Column, divisor: int = 5) -> Column:
    """A tampering to try a manifest with: A-Z in lower case where ``divisor`` divides the crc32 of the id's decimal text; null ids are left alone."""
    hit = F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % divisor == 0, F.lit(False))
    return F.when(hit, F.translate(text, _UPPER, _LOWER)).otherwise(text)
