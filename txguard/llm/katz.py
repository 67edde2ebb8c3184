"""Language-model scores by Katz backoff.

Counts of n-grams are discounted after Good and Turing; what a context saves goes to the words not seen after it, in proportion to the next
shorter context's probabilities, with a weight that makes the whole exactly one. The last level shares its savings with one unknown word.

The corpus is cut into chunks of tokens, kept as files. For each level, a chunk asks for its distinct n-grams, once each however often it holds them;
asks meet in parts by context, where counts are added up and the level's table is written, one row per part; answers go back to
the chunk. An n-gram is named by its context's number and its word's number, both given by the level before, so nothing rests on hashes of n-grams.
With all answers a chunk evaluates each of its tokens from the shortest context up. A context with very many tokens is dealt over several parts by
word, and its sums are added up in a table of such contexts.
"""

from __future__ import annotations

import math
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txguard.llm.common import scratch_path, stored

ORDER = 2
# Counts up to it are discounted.
LOW_COUNTS = 5
# Tokens of a chunk; n-grams asked for that meet in a part, on average; tokens of a context from which it is dealt over parts.
CHUNK, PART, HOT = 1_500_000, 1_000_000, 1 << 20
# Places in a chunk's list of words: before a document's first word, and its end; neither can be a word.
_BEGIN, _END = 0, 1
_HEAD = np.dtype([("row", "<i8"), ("doc", "<i8"), ("null", "u1"), ("held", "u1"), ("piece", "<i4"), ("past", "<i4"), ("n", "<i4")])
_CHUNK = "chunk long, path string, n_words long, n_tokens long"
_ASK = "part int, chunk long, words binary, contexts binary, repeats binary, ids binary, n binary, low binary, hot binary"
_COUNTED = ("kind string, part int, chunk long, ids binary, counts binary, sums binary, context long, table_context array<long>, table_word array<long>, "
            "table_text array<string>, table_count array<long>, stats array<long>")
_SCORES = "row long, piece int, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"
_TYPES = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "double": pa.float64(), "boolean": pa.bool_(),
          "array<long>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string())}
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def _arrow(ddl: str) -> pa.Schema:
    return pa.schema([(p.split()[0], _TYPES[p.split()[1]]) for p in ddl.split(", ")])


def _table(ddl: str, rows: list[dict]) -> pa.Table:
    return pa.Table.from_pylist(rows, schema=_arrow(ddl))


def _pack(values: np.ndarray) -> bytes:
    """Whole numbers in as few bytes as the greatest needs, or doubles, compressed."""
    if values.dtype.kind != "f":
        top = int(values.max(initial=0))
        values = values.astype("u1" if top < 1 << 8 else "<u2" if top < 1 << 16 else "<u4" if top < 1 << 32 else "<u8")
    return values.dtype.str.encode()[-2:] + zstandard.ZstdCompressor(level=1).compress(values.tobytes())


def _unpack(data: bytes) -> np.ndarray:
    kind = data[:2].decode()
    out = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[2:]), kind)
    return out if kind == "f8" else out.astype(np.int64)


def crc_held_out(doc_id: int | None) -> bool:
    """Whether a document is kept from training: the remainder of its id's checksum. Those without id are trained on."""
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2


def discounts(counts_of_counts: list[int]) -> list[float]:
    """Good-Turing discounts of counts 1, 2, ... from how many n-grams have each.

    The greatest number of them, up to ``LOW_COUNTS``, for which all are above 0 and below 1 is discounted; if none is, the list is empty.
    """
    n = [0, *counts_of_counts]
    for k in range(min(LOW_COUNTS, len(n) - 2), 0, -1):
        if min(n[1 : k + 2]) <= 0:
            continue
        rest = (k + 1) * n[k + 1] / n[1]
        if rest == 1:
            continue
        out = [((r + 1) * n[r + 1] / n[r] / r - rest) / (1 - rest) for r in range(1, k + 1)]
        if all(0 < d < 1 for d in out):
            return out
    return []


@dataclass(frozen=True)
class Level:
    """What a level's discounts and sizes make of counts; ``seen``: how many types have count 1, 2, ..."""

    discounts: tuple[float, ...]
    types: int
    tokens: int
    seen: tuple[int, ...]

    def discounted(self, counts: np.ndarray) -> np.ndarray:
        by = np.ones(LOW_COUNTS + 2)
        by[1 : len(self.discounts) + 1] = self.discounts
        return counts * by[np.minimum(counts, LOW_COUNTS + 1)]

    def context(self, sums: np.ndarray, floor: float) -> tuple[np.ndarray, np.ndarray]:
        """Denominator and backoff weight of contexts from their sums: words seen once, twice, ..., tokens of words seen more often, and the shorter
        context's probability of all words seen. A context that saves nothing is given one more token, for words not seen."""
        r = np.arange(1, LOW_COUNTS + 1)
        total = sums[:, :LOW_COUNTS] @ r + sums[:, LOW_COUNTS]
        saved = sums[:, :LOW_COUNTS] @ (r - self.discounted(r))
        nothing = saved <= 0
        whole = np.where(nothing, total + 1, total)
        return whole, np.where(nothing, 1.0, saved) / whole / np.maximum(1 - sums[:, LOW_COUNTS + 1], floor)


@dataclass(frozen=True)
class Words:
    """The last level: every known word, and one unknown."""

    level: Level
    whole: float
    unknown: float

    def probability(self, counts: np.ndarray) -> np.ndarray:
        return np.where(counts > 0, self.level.discounted(counts) / self.whole, self.unknown)


@dataclass
class Chunk:
    """Tokens of a chunk as places in its list of words; each piece of a document brings the tokens before it."""

    words: list[bytes]
    tokens: np.ndarray
    pieces: np.ndarray

    def layout(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """By token: its piece, its place in it with the past, and whether it is counted in training."""
        sizes = self.pieces["past"] + self.pieces["n"]
        piece = np.repeat(np.arange(len(sizes)), sizes)
        place = np.arange(len(piece)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        return piece, place, (place >= self.pieces["past"][piece]) & (self.pieces["held"][piece] == 0)


def _write_chunk(chunk: Chunk) -> bytes:
    parts = [b" ".join(chunk.words[2:]), chunk.tokens.astype("<u4").tobytes(), chunk.pieces.tobytes()]
    squeezed = [zstandard.ZstdCompressor(level=1).compress(p) for p in parts]
    return b"".join([*(len(p).to_bytes(8, "little") for p in squeezed), *squeezed])


def _read_chunk(path: str) -> Chunk:
    store, where = fs.FileSystem.from_uri(path)
    with store.open_input_file(where) as file:
        data = file.read()
    sizes = [int.from_bytes(data[8 * i : 8 * i + 8], "little") for i in range(3)]
    at = np.cumsum([24, *sizes])
    words, tokens, pieces = (zstandard.ZstdDecompressor().decompress(data[a:b]) for a, b in zip(at, at[1:]))
    return Chunk([b"", b"\n", *(words.split(b" ") if words else [])], np.frombuffer(tokens, "<u4").astype(np.int64), np.frombuffer(pieces, _HEAD))


def _cut(docs: DataFrame, order: int, held_out: Callable[[int | None], bool], chunk_tokens: int) -> DataFrame:
    """Write the chunks; returns their manifest. A document longer than a chunk is continued in the next, which knows the words before."""
    folder = scratch_path(docs.sparkSession, "katz-chunks")
    uri = "file://" + folder[5:] if folder.startswith("file:/") and not folder.startswith("file://") else folder
    uri = uri if "://" in uri else "file://" + uri

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(uri)
        store.create_dir(base, recursive=True)
        context = TaskContext.get()
        part, attempt, seq, row = context.partitionId(), context.taskAttemptId(), 0, 0
        places: defaultdict[bytes, int] = defaultdict(lambda: len(places) + 2)
        tokens: list[np.ndarray] = []
        heads: list[tuple] = []
        size = 0

        def close() -> pa.RecordBatch:
            nonlocal seq, size
            chunk = Chunk([b"", b"\n", *places], np.concatenate(tokens), np.array(heads, _HEAD))
            name = f"chunk-{part:06d}-{seq:06d}-{attempt}"
            with store.open_output_stream(f"{base}/{name}") as out:
                out.write(_write_chunk(chunk))
            found = {"chunk": (part << 32) + seq, "path": f"{uri}/{name}", "n_words": len(chunk.words), "n_tokens": size}
            seq, size = seq + 1, 0
            places.clear(), tokens.clear(), heads.clear()
            return pa.RecordBatch.from_pylist([found], schema=_arrow(_CHUNK))

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                words = text.encode().translate(_LOWER).split() if text else []
                at, piece = 0, 0
                while at <= len(words):
                    end = min(len(words) + 1, at + chunk_tokens - size)
                    past = words[max(0, at - order + 1) : at]
                    first = [_BEGIN] if at < order - 1 else []
                    last = [_END] if end > len(words) else []
                    some = past + words[at:end]
                    tokens.append(np.concatenate([first, np.fromiter(map(places.__getitem__, some), np.int64, len(some)), last]).astype(np.int64))
                    heads.append(((part << 32) + row, doc_id or 0, doc_id is None, held_out(doc_id), piece, len(first) + len(past), end - at))
                    size += end - at
                    at, piece = end, piece + 1
                    if size >= chunk_tokens:
                        yield close()
                row += 1
        if heads:
            yield close()

    return stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, _CHUNK), "katz-manifest")


def _word_parts(words: list[bytes], parts: int) -> np.ndarray:
    """The part of each word; the place before a document is in none."""
    return np.array([-1, *(xxhash.xxh3_64_intdigest(w) % parts for w in words[1:])], np.int64)


def _mixed(contexts: np.ndarray, salts: np.ndarray, parts: int) -> np.ndarray:
    h = contexts.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + salts.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return ((h ^ (h >> np.uint64(29))) % np.uint64(parts)).astype(np.int64)


def _ask_words(chunk_id: int, chunk: Chunk, parts: int) -> list[dict]:
    _, _, counted = chunk.layout()
    n = np.bincount(chunk.tokens, weights=counted, minlength=len(chunk.words)).astype(np.int64)
    part = _word_parts(chunk.words, parts)
    order = np.argsort(part, kind="stable")
    out = []
    for own in np.split(order, np.flatnonzero(np.diff(part[order])) + 1):
        if part[own[0]] >= 0:
            out.append({"part": int(part[own[0]]), "chunk": chunk_id, "words": b" ".join(chunk.words[i].strip(b"\n") for i in own), "n": _pack(n[own])})
    return out


def _count_words(part: int, rows: list[dict], parts: int) -> list[dict]:
    """Numbers and counts of the words of one part; a word's number is above 0, and 0 if it is unknown in training."""
    words = pa.array([w for r in rows for w in r["words"].split(b" ")], pa.binary()).dictionary_encode()
    at, names = words.indices.to_numpy(), words.dictionary.to_pylist()
    n = np.concatenate([_unpack(r["n"]) for r in rows])
    total = np.bincount(at, weights=n, minlength=len(names)).astype(np.int64)
    order = sorted(range(len(names)), key=lambda i: (-total[i], names[i]))
    # Numbers of frequent words are small; the remainder tells the part.
    number = np.empty(len(names), np.int64)
    number[order] = np.arange(len(names)) * parts + part + 1
    number[total == 0] = 0
    out, start = [], 0
    for r in rows:
        own = at[start : start + r["words"].count(b" ") + 1]
        start += len(own)
        out.append({"kind": "answer", "part": part, "chunk": r["chunk"], "ids": _pack(number[own]), "counts": _pack(total[own])})
    known = [i for i in order if total[i] > 0]
    out.append({"kind": "table", "part": part, "table_text": [names[i].decode() for i in known], "table_word": number[known], "table_count": total[known]})
    out.append({"kind": "stats", "part": part, "stats": _stats(total)})
    return out


def _stats(total: np.ndarray) -> list[int]:
    """Types, tokens, and types with count 1, 2, ..."""
    return [int((total > 0).sum()), int(total.sum()), *np.bincount(np.minimum(total, LOW_COUNTS + 2), minlength=LOW_COUNTS + 3)[1 : LOW_COUNTS + 2].tolist()]


def _count_ngrams(part: int, rows: list[dict], parts: int, last: bool) -> list[dict]:
    """Counts of one part's n-grams, and the sums of their contexts; a number above 0 for each if a level follows."""
    asked = []
    for r in rows:
        contexts, repeats = _unpack(r["contexts"]), _unpack(r["repeats"])
        asked.append((np.repeat(contexts, repeats), _unpack(r["ids"]), _unpack(r["n"]), _unpack(r["low"]), contexts, repeats, _unpack(r["hot"])))
    context, word, n, low = (np.concatenate([a[i] for a in asked]) for i in range(4))
    order = np.lexsort((word, context))
    new = np.ones(len(order), bool)
    new[1:] = (np.diff(context[order]) != 0) | (np.diff(word[order]) != 0)
    group = np.cumsum(new) - 1
    total = np.bincount(group, weights=n[order]).astype(np.int64)
    first = order[new]
    at = np.empty(len(order), np.int64)
    at[order] = group
    own_context, own_word, own_low = context[first], word[first], low[first]
    # Sums by context of what was seen in training.
    names, where = np.unique(own_context, return_inverse=True)
    sums = np.zeros((len(names), LOW_COUNTS + 2))
    some = (total > 0) & (total <= LOW_COUNTS)
    np.add.at(sums, (where[some], total[some] - 1), 1)
    many = total > LOW_COUNTS
    np.add.at(sums[:, LOW_COUNTS], where[many], total[many])
    np.add.at(sums[:, LOW_COUNTS + 1], where[total > 0], own_low[total > 0])
    number = np.where(total > 0, np.arange(len(total)) * parts + part + 1, 0)
    out, start, hot = [], 0, set()
    for r, a in zip(rows, asked):
        own = at[start : start + len(a[0])]
        start += len(a[0])
        mine = sums[np.searchsorted(names, a[4])]
        hot.update(a[4][a[6] > 0].tolist())
        out.append({"kind": "answer", "part": part, "chunk": r["chunk"], "ids": None if last else _pack(number[own]), "counts": _pack(total[own]),
                    "sums": b"".join(len(p).to_bytes(4, "little") + p for p in (_pack(mine[:, i].astype(np.int64) if i <= LOW_COUNTS else mine[:, i]) for i in range(LOW_COUNTS + 2)))})
        out += [{"kind": "want", "chunk": r["chunk"], "context": int(c)} for c in a[4][a[6] > 0]]
    out += [{"kind": "hot", "part": part, "context": c, "sums": sums[np.searchsorted(names, c)].tobytes()} for c in sorted(hot)]
    known = total > 0
    out.append({"kind": "table", "part": part, "table_context": own_context[known], "table_word": own_word[known], "table_count": total[known]})
    out.append({"kind": "stats", "part": part, "stats": _stats(total)})
    return out


def _unpack_sums(data: bytes) -> np.ndarray:
    out, at = [], 0
    while at < len(data):
        size = int.from_bytes(data[at : at + 4], "little")
        out.append(_unpack(data[at + 4 : at + 4 + size]).astype(np.float64))
        at += 4 + size
    return np.stack(out, axis=1)


@dataclass
class _Asked:
    """One level's distinct n-grams of a chunk, in the order of asking, and where its tokens find theirs."""

    tokens: np.ndarray  # tokens with an n-gram
    at: np.ndarray  # their n-grams
    context: np.ndarray
    word: np.ndarray
    part: np.ndarray
    salts: np.ndarray


def _asked(contexts: np.ndarray, words: np.ndarray, context_counts: np.ndarray, valid: np.ndarray, parts: int, hot: int) -> _Asked:
    tokens = np.flatnonzero(valid)
    c, w = contexts[tokens], words[tokens]
    order = np.lexsort((w, c))
    new = np.ones(len(order), bool)
    new[1:] = (np.diff(c[order]) != 0) | (np.diff(w[order]) != 0)
    at = np.empty(len(order), np.int64)
    at[order] = np.cumsum(new) - 1
    first = order[new]
    salts = -(-context_counts[tokens][first] // hot)
    return _Asked(tokens, at, c[first], w[first], _mixed(c[first], np.where(salts > 1, w[first] % np.maximum(salts, 1), 0), parts), salts)


class _Reader:
    """Evaluates a chunk level by level from its answers."""

    def __init__(self, chunk: Chunk, answers: list[dict], settings: _Settings):
        self.chunk, self.settings = chunk, settings
        self.piece, self.place, self.counted = chunk.layout()
        self.by_level: dict[int, dict[int, dict]] = {}
        self.hot: dict[tuple[int, int], np.ndarray] = {}
        for a in answers:
            if a["kind"] == "answer":
                self.by_level.setdefault(a["level"], {})[a["part"]] = a
            else:
                self.hot[a["level"], a["context"]] = np.frombuffer(a["sums"], np.float64)
        part = _word_parts(chunk.words, settings.parts[0])
        ids, counts = np.zeros(len(chunk.words), np.int64), np.zeros(len(chunk.words), np.int64)
        for p, a in self.by_level[1].items():
            own = np.flatnonzero(part == p)
            ids[own], counts[own] = _unpack(a["ids"]), _unpack(a["counts"])
        self.words, self.word_counts = ids[chunk.tokens], counts[chunk.tokens]
        begin = chunk.tokens == _BEGIN
        # Numbers of the n-grams that end here, 0 if unknown; as a context, a document's beginning has the number -1.
        self.ids, self.counts = np.where(begin, -1, self.words), np.where(begin, settings.documents, self.word_counts)
        self.p = settings.words.probability(self.word_counts) if settings.words else None

    def ask(self, level: int) -> _Asked:
        contexts, counts = np.zeros_like(self.ids), np.zeros_like(self.counts)
        contexts[1:], counts[1:] = self.ids[:-1], self.counts[:-1]
        # Unknown words are asked for as well, as they need their contexts' weights.
        valid = (self.place >= level - 1) & (contexts != 0) & (counts > 0)
        return _asked(contexts + 1, self.words, counts, valid, self.settings.parts[level - 1], self.settings.hot)

    def rows(self, level: int, chunk_id: int) -> list[dict]:
        asked = self.ask(level)
        n = np.bincount(asked.at, weights=self.counted[asked.tokens], minlength=len(asked.word)).astype(np.int64)
        low = np.zeros(len(asked.word))
        low[asked.at] = self.p[asked.tokens]
        order = np.argsort(asked.part, kind="stable")
        out = []
        for own in np.split(order, np.flatnonzero(np.diff(asked.part[order])) + 1) if len(order) else []:
            contexts, start, repeats = np.unique(asked.context[own], return_index=True, return_counts=True)
            out.append({"part": int(asked.part[own[0]]), "chunk": chunk_id, "contexts": _pack(contexts), "repeats": _pack(repeats), "ids": _pack(asked.word[own]),
                        "n": _pack(n[own]), "low": _pack(low[own]), "hot": _pack((asked.salts[own][start] > 1).astype(np.int64))})
        return out

    def take(self, level: int) -> None:
        """Go one level up: probabilities of all tokens, and numbers of their n-grams."""
        asked, model = self.ask(level), self.settings.levels[level - 1]
        counts, ids = np.zeros(len(asked.word), np.int64), np.zeros(len(asked.word), np.int64)
        context_sums: list[np.ndarray] = []
        names: list[np.ndarray] = []
        order = np.argsort(asked.part, kind="stable")
        for own in np.split(order, np.flatnonzero(np.diff(asked.part[order])) + 1) if len(order) else []:
            a = self.by_level[level][int(asked.part[own[0]])]
            counts[own] = _unpack(a["counts"])
            if a["ids"] is not None:
                ids[own] = _unpack(a["ids"])
            contexts, start = np.unique(asked.context[own], return_index=True)
            sums = _unpack_sums(a["sums"])
            for i in np.flatnonzero(asked.salts[own][start] > 1):
                sums[i] = self.hot[level, int(contexts[i])]
            names.append(contexts)
            context_sums.append(sums)
        self._tokens(asked, counts, names, context_sums, model, level)
        found_ids, found_counts = np.zeros_like(self.ids), np.zeros_like(self.counts)
        found_ids[asked.tokens], found_counts[asked.tokens] = ids[asked.at], counts[asked.at]
        self.ids, self.counts = found_ids, found_counts

    def _tokens(self, asked: _Asked, counts: np.ndarray, names: list[np.ndarray], context_sums: list[np.ndarray], model: Level, level: int) -> None:
        if not names:
            return
        every, first = np.unique(np.concatenate(names), return_index=True)
        whole, weight = model.context(np.concatenate(context_sums)[first], self.settings.words.unknown if level == 2 else 1e-12)
        at = np.searchsorted(every, asked.context)[asked.at]
        c = counts[asked.at]
        p = self.p.copy()
        p[asked.tokens] = np.where(c > 0, model.discounted(c) / whole[at], weight[at] * self.p[asked.tokens])
        self.p = p


@dataclass(frozen=True)
class _Settings:
    parts: tuple[int, ...]
    documents: int
    hot: int
    levels: tuple[Level, ...] = ()
    words: Words | None = None


def _level(counted: DataFrame) -> Level:
    """Discounts and sizes of a level; one short row per part is added up."""
    sums = counted.where("kind = 'stats'").select(F.posexplode("stats")).groupBy("pos").agg(F.sum("col").alias("n")).collect()
    n = [0] * (LOW_COUNTS + 3)
    for r in sums:
        n[r["pos"]] = r["n"]
    return Level(tuple(discounts(n[2:])), n[0], n[1], tuple(n[2:]))


def _words(level: Level) -> Words:
    saved = sum(r * level.seen[r - 1] * (1 - d) for r, d in enumerate(level.discounts, 1))
    whole = level.tokens if saved > 0 else level.tokens + 1
    return Words(level, float(whole), (saved if saved > 0 else 1.0) / whole)


def _count(asks: DataFrame, parts: int, level: int, last: bool) -> DataFrame:
    def count(key: tuple, table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["chunk"])
        part = key[0].as_py()
        return _table(_COUNTED, _count_words(part, rows, parts) if level == 1 else _count_ngrams(part, rows, parts, last))

    return stored(asks.groupBy("part").applyInArrow(count, _COUNTED), f"katz-level-{level}")


def _answers(counted: DataFrame, level: int) -> DataFrame:
    """What goes back to the chunks: answers, and the sums of dealt contexts that a chunk has tokens of."""
    columns = ["chunk", F.lit(level).alias("level"), "kind", "part", "ids", "counts", "sums", "context"]
    plain = counted.where("kind = 'answer'").select(*columns)
    if level == 1:
        return plain

    def added(key: tuple, table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x, np.float64) for x in table.sort_by("part").column("sums").to_pylist())
        return pa.Table.from_pylist([{"context": key[0].as_py(), "sums": total.tobytes()}], schema=pa.schema([("context", pa.int64()), ("sums", pa.binary())]))

    # One row per part of a dealt context.
    totals = counted.where("kind = 'hot'").select("context", "part", "sums").groupBy("context").applyInArrow(added, "context long, sums binary")
    wanted = counted.where("kind = 'want'").select("context", "chunk").distinct().join(totals, "context")
    return plain.unionByName(wanted.select(*columns[:1], F.lit(level).alias("level"), F.lit("hot").alias("kind"), F.lit(None).cast("int").alias("part"),
                                           F.lit(None).cast("binary").alias("ids"), F.lit(None).cast("binary").alias("counts"), "sums", "context"))


def _by_chunk(manifest: DataFrame, answers: list[DataFrame], tasks: int, work: Callable[[int, Chunk, list[dict]], list[dict]], ddl: str) -> DataFrame:
    """``work(number, chunk, answers)`` for every chunk."""
    if not answers:
        def plain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for r in batch.to_pylist():
                    yield from _table(ddl, work(r["chunk"], _read_chunk(r["path"]), [])).to_batches()

        return manifest.repartitionByRange(tasks, "chunk").mapInArrow(plain, ddl)
    every = answers[0]
    for a in answers[1:]:
        every = every.unionByName(a)

    def joined(left: pa.Table, right: pa.Table) -> pa.Table:
        return _table(ddl, [row for r in left.to_pylist() for row in work(r["chunk"], _read_chunk(r["path"]), right.to_pylist())])

    return manifest.repartition(tasks, "chunk").groupBy("chunk").cogroup(every.repartition(tasks, "chunk").groupBy("chunk")).applyInArrow(joined, ddl)


@dataclass
class Scored:
    """Scores of all documents, and the model: tables by level, one row per part, and the levels' discounts and sizes."""

    scores: DataFrame
    tables: list[DataFrame]
    levels: list[Level]


def train_and_score(docs: DataFrame, order: int = ORDER, held_out: Callable[[int | None], bool] = crc_held_out, chunk_tokens: int = CHUNK, part_size: int = PART,
                    hot: int = HOT) -> Scored:
    """Train on the documents that are not held out and score all.

    Scores: doc_id, held_out, n_tokens (words, A-Z in lower case, and one end), n_known (tokens seen in training), train_tokens, base_score (log10 of
    add-one unigrams with one unknown word) and score (log10 of the backoff model of ``order`` words); one row per row of ``docs``.

    Null text counts as empty: its end alone is scored. Repeated rows count as often as they stand there. Documents of any length are cut
    and scored whole. If all are held out every word is the unknown one. An empty table gives no rows. Other columns are ignored.
    """
    if order < 2:
        raise ValueError("a backoff model needs contexts")
    manifest = _cut(docs, order, held_out, chunk_tokens)
    sizes = manifest.agg(F.count(F.lit(1)).alias("chunks"), F.sum("n_words").alias("words"), F.sum("n_tokens").alias("tokens")).first()
    chunks, tokens = sizes["chunks"], sizes["tokens"] or 0
    tasks = max(1, min(chunks, 20_000))
    parts = (max(1, math.ceil((sizes["words"] or 0) / part_size)), *(max(1, math.ceil(tokens / part_size)) for _ in range(order - 1)))
    counted = [_count(_by_chunk(manifest, [], tasks, lambda number, chunk, _: _ask_words(number, chunk, parts[0]), _ASK), parts[0], 1, False)]
    levels = [_level(counted[0])]
    words = _words(levels[0])
    # Every document has one end, so ends are documents trained on.
    ends = counted[0].where("kind = 'table'").select(F.explode(F.arrays_zip("table_text", "table_count")).alias("t")).where("t.table_text = ''").select("t.table_count").first()
    documents = ends[0] if ends else 0
    answers = [_answers(counted[0], 1)]
    for level in range(2, order + 1):
        settings = _Settings(parts, documents, hot, tuple(levels), words)

        def ask(number: int, chunk: Chunk, given: list[dict], level: int = level, settings: _Settings = settings) -> list[dict]:
            reader = _Reader(chunk, given, settings)
            for below in range(2, level):
                reader.take(below)
            return reader.rows(level, number)

        counted.append(_count(_by_chunk(manifest, answers, tasks, ask, _ASK), parts[level - 1], level, level == order))
        levels.append(_level(counted[-1]))
        answers.append(_answers(counted[-1], level))
    settings = _Settings(parts, documents, hot, tuple(levels), words)
    log_whole = math.log10(levels[0].tokens + levels[0].types + 1)

    def score(number: int, chunk: Chunk, given: list[dict]) -> list[dict]:
        reader = _Reader(chunk, given, settings)
        for level in range(2, order + 1):
            reader.take(level)
        own = reader.place >= chunk.pieces["past"][reader.piece]
        piece, p, c = reader.piece[own], np.log10(reader.p[own]), reader.word_counts[own]
        sums = [np.bincount(piece, weights=x, minlength=len(chunk.pieces)) for x in (np.ones(len(c)), c > 0, np.log10(c + 1.0) - log_whole, p)]
        return [{"row": int(h["row"]), "piece": int(h["piece"]), "doc_id": None if h["null"] else int(h["doc"]), "held_out": bool(h["held"]), "n_tokens": int(a), "n_known": int(b),
                 "base_score": float(x), "score": float(y)} for h, a, b, x, y in zip(chunk.pieces, *sums)]

    found = _by_chunk(manifest, answers, tasks, score, _SCORES)
    # Only documents that were cut have more than one row; they are added up in order.
    parts_of = F.array_sort(F.collect_list(F.struct("piece", "base_score", "score")))
    whole = found.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("held_out").alias("held_out"), F.sum("n_tokens").alias("n_tokens"),
                                     F.sum("n_known").alias("n_known"), parts_of.alias("pieces"))
    added = [F.aggregate(F.col(f"pieces.{c}"), F.lit(0.0), lambda total, x: total + x).alias(c) for c in ("base_score", "score")]
    scores = whole.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(levels[0].tokens).cast("long").alias("train_tokens"), *added)
    tables = [c.where("kind = 'table'").select("part", "table_text" if i == 0 else "table_context", "table_word", "table_count") for i, c in enumerate(counted)]
    return Scored(scores, tables, levels)
