"""Token-id files with directly addressable codes.

An id is split into 8-bit chunks, lowest first, on as many levels as it needs. Level 0 has one chunk for each token; a bit beside it
tells whether the token goes on at the next level, and its place there is the number of set bits before it. A directory of such counts
for every 512 bits makes that rank a lookup and a popcount of at most 64 bytes. So any token is read from a few known places, and no
block is decoded.

File layout, little-endian: ``DACTOK01``; n_docs, n_tokens, n_levels (u64); for each level its number of chunks (u64); then doc ids
(i64), null flags of doc ids (u8), token offsets of documents (u64, n_docs + 1); then, level by level, chunks (u8), continuation bits
(u8, lowest bit first, padded to 64 bytes) and the directory (u64, for every 512 bits).
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from txguard.llm.common import scratch_path, stored
from txguard.llm.tokens import encoder

MAGIC = b"DACTOK01"
BLOCK_BITS = 512
# A file is closed once it has so many tokens; a document is never cut.
SHARD_TOKENS = 4_000_000
MANIFEST = "path string, part int, seq int, n_docs long, n_tokens long"
# Tasks that read back share the files evenly.
MAX_READ_TASKS = 20_000
TOKENS = "doc_id long, start long, n_tokens long, ids binary, shard string"


def _ranks(bits: np.ndarray) -> np.ndarray:
    """Set bits before each block of ``BLOCK_BITS``."""
    counts = np.bitwise_count(bits.reshape(-1, BLOCK_BITS // 8)).sum(axis=1, dtype="<u8")
    return np.concatenate([np.zeros(1, "<u8"), np.cumsum(counts, dtype="<u8")[:-1]])


def encode_levels(ids: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Chunks, continuation bits and directory of each level."""
    levels = []
    rest = ids.astype("<u4", copy=False)
    while True:
        more = rest > 0xFF
        bits = np.packbits(more, bitorder="little")
        bits = np.pad(bits, (0, max(1, -(-len(bits) * 8 // BLOCK_BITS)) * (BLOCK_BITS // 8) - len(bits)))
        levels.append(((rest & 0xFF).astype("u1"), bits, _ranks(bits)))
        if not more.any():
            return levels
        rest = rest[more] >> 8


def shard_bytes(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray) -> bytes:
    """One file's content."""
    levels = encode_levels(ids)
    head = [MAGIC, struct.pack("<3Q", len(doc_ids), len(ids), len(levels)), struct.pack(f"<{len(levels)}Q", *(len(c) for c, _, _ in levels))]
    docs = [np.array([d or 0 for d in doc_ids], "<i8"), np.array([d is None for d in doc_ids], "u1"),
            np.concatenate([[0], np.cumsum(lengths)]).astype("<u8")]
    return b"".join([*head, *(x.tobytes() for x in docs + [part for level in levels for part in level])])


def write_shard(store: fs.FileSystem, path: str, content: bytes) -> None:
    """Write under a name of the attempt's own, then move into place, so that a repeated task does no harm."""
    own = f"{path}.{TaskContext.get().taskAttemptId()}"
    with store.open_output_stream(own) as out:
        out.write(content)
    store.move(own, path)


class Shard:
    """Random access to one file; reads only the bytes a request needs."""

    def __init__(self, file: pa.NativeFile) -> None:
        self.file = file
        if file.read_at(8, 0) != MAGIC:
            raise ValueError("not a token file")
        self.n_docs, self.n_tokens, n_levels = struct.unpack("<3Q", file.read_at(24, 8))
        sizes = struct.unpack(f"<{n_levels}Q", file.read_at(8 * n_levels, 32))
        at = 32 + 8 * n_levels
        self.docs_at = at
        at += self.n_docs * 9 + 8 * (self.n_docs + 1)
        self.levels = []
        for n in sizes:
            blocks = max(1, -(-n // BLOCK_BITS))
            self.levels.append((at, at + n, at + n + blocks * (BLOCK_BITS // 8)))
            at += n + blocks * (BLOCK_BITS // 8) + 8 * blocks

    def _get(self, at: int, n: int, kind: str) -> np.ndarray:
        return np.frombuffer(self.file.read_at(n * np.dtype(kind).itemsize, at), kind)

    def documents(self) -> tuple[list[int | None], np.ndarray]:
        ids, nulls = self._get(self.docs_at, self.n_docs, "<i8"), self._get(self.docs_at + 8 * self.n_docs, self.n_docs, "u1")
        return [None if x else int(d) for d, x in zip(ids, nulls)], self._get(self.docs_at + 9 * self.n_docs, self.n_docs + 1, "<u8")

    def token(self, i: int) -> int:
        """The i-th token of the file."""
        return int(self.tokens(i, i + 1)[0])

    def tokens(self, start: int, end: int) -> np.ndarray:
        """Tokens ``start`` to ``end``: on each level one run of chunks, found by rank."""
        out = np.zeros(end - start, "<u4")
        where, shift = np.arange(end - start), 0
        for chunks_at, bits_at, ranks_at in self.levels:
            if start >= end:
                break
            out[where] |= self._get(chunks_at + start, end - start, "u1").astype("<u4") << shift
            first = start // BLOCK_BITS
            raw = self._get(bits_at + first * BLOCK_BITS // 8, (end - first * BLOCK_BITS + 7) // 8, "u1")
            bits = np.unpackbits(raw, bitorder="little").astype(bool)
            own = bits[start - first * BLOCK_BITS : end - first * BLOCK_BITS]
            before = int(self._get(ranks_at + 8 * first, 1, "<u8")[0]) + int(bits[: start - first * BLOCK_BITS].sum())
            where, start, end, shift = where[own], before, before + int(own.sum()), shift + 8
        return out


def write_token_files(docs: DataFrame, vocabulary: str, end_id: int, folder: str | None = None, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Encode ``docs`` (doc_id, text) in ascending doc_id order, nulls last, into files below ``folder``; returns their manifest: path, part, seq,
    n_docs, n_tokens, start (tokens before).

    Null text counts as empty; each document ends with ``end_id``. Rows of equal doc_id follow each other by text hash. The exchange by
    ranges of (doc_id, hash) splits even one doc_id with very many rows. A task holds one file's ids, at most ``shard_tokens`` and the
    last document. ``folder`` must be shared by all executors; without it a new one below ``spark.checkpoint.dir`` is taken.
    An empty table gives an empty manifest. Other columns are ignored.
    """
    spark = docs.sparkSession
    folder = folder or scratch_path(spark, "token-files")
    uri = "file://" + folder[5:] if folder.startswith("file:/") and not folder.startswith("file://") else folder

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri)
        store.create_dir(base, recursive=True)
        encode, end = encoder(vocabulary), struct.pack("<I", end_id)
        part, seq = TaskContext.get().partitionId(), 0
        doc_ids: list[int | None] = []
        lengths: list[int] = []
        held: list[bytes] = []

        def close() -> pa.RecordBatch:
            nonlocal seq
            path = f"{base}/part-{part:06d}-{seq:06d}.dac"
            write_shard(store, path, shard_bytes(doc_ids, lengths, np.frombuffer(b"".join(held), "<u4")))
            row = pa.RecordBatch.from_pylist([{"path": f"{uri}/part-{part:06d}-{seq:06d}.dac", "part": part, "seq": seq, "n_docs": len(doc_ids),
                                               "n_tokens": sum(lengths)}], schema=_MANIFEST_ARROW)
            doc_ids.clear(), lengths.clear(), held.clear()
            seq += 1
            return row

        total = 0
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                ids = encode(text) + end
                doc_ids.append(doc_id)
                lengths.append(len(ids) // 4)
                held.append(ids)
                total += len(ids) // 4
                if total >= shard_tokens:
                    yield close()
                    total = 0
        if doc_ids:
            yield close()

    order = [F.col("doc_id").isNull(), F.col("doc_id"), F.xxhash64("text")]
    rows = docs.select("doc_id", "text").repartitionByRange(*order).sortWithinPartitions(*order)
    manifest = stored(rows.mapInArrow(write, MANIFEST), "token-manifest")
    # One row per file of SHARD_TOKENS goes through this window, not the tokens.
    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


_MANIFEST_ARROW = pa.schema([("path", pa.string()), ("part", pa.int32()), ("seq", pa.int32()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())])
_TOKENS_ARROW = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary()), ("shard", pa.string())])


def _open(path: str) -> pa.NativeFile:
    store, where = fs.FileSystem.from_uri(path)
    return store.open_input_file(where)


def read_token_files(manifest: DataFrame) -> DataFrame:
    """Documents read back from the files: doc_id, start (tokens of all documents before it), n_tokens, ids (u32, little-endian), shard."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, before in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist()):
                with _open(path) as file:
                    shard = Shard(file)
                    doc_ids, offsets = shard.documents()
                    for i in range(0, len(doc_ids), 500):
                        some = doc_ids[i : i + 500]
                        ids = shard.tokens(int(offsets[i]), int(offsets[i + len(some)])).tobytes()
                        at = [int(x) for x in offsets[i : i + len(some) + 1]]
                        own = [ids[4 * (a - at[0]) : 4 * (b - at[0])] for a, b in zip(at, at[1:])]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(some, pa.int64()), pa.array([before + x for x in at[:-1]], pa.int64()), pa.array([len(x) // 4 for x in own], pa.int64()),
                             pa.array(own, pa.binary()), pa.array([path] * len(some), pa.string())], schema=_TOKENS_ARROW)

    # The manifest is small but each row is megabytes of work, so its rows are dealt out one by one.
    tasks = max(1, min(manifest.count(), MAX_READ_TASKS))
    return manifest.repartitionByRange(tasks, "part", "seq").mapInArrow(read, TOKENS)
