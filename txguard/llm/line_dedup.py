"""Line deduplication by pairwise alignment.

A common block of two documents is a run of lines that follow each other in both, blank lines aside, with enough words. It goes from the later one.

Documents that have a block in common are found through rare lines. The shortest runs with enough words that begin or end at each line of a document
are its windows; every line of a common block lies in a window that is common, too. A window is known by its rarest line, the one that the
fewest documents have, and by a hash of the whole. As line counts are the same for all documents, those that share a window share its rarest line.
A window with a line that no other document has cannot be common and is left out before anything is joined. Of the holders of a window the
earliest is the partner of all others: one row for each, and not one per pair of holders, so a line of any frequency costs its holders.

Each pair of partners is then aligned by patience diff: the lines that stand once in both are anchors, the longest run of anchors that rises on both
sides is kept and extended to the equal lines around it, and what is left of the later document is aligned again, so that moved and
repeated blocks are found. Windows that are still left are extended from where they stand. Words count per pair and block: short lines that
a document shares with many others make no block.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator, Sequence

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, LongType, StructField, StructType

from txguard.llm.common import fresh, one_of_each, stored

# A common block is deleted if it has so many words.
MIN_BLOCK_WORDS = 40
# A document: whether its id is null, the id, the hash of its text; in this order.
_DOC = ["z", "d", "t"]
_LINES = "z boolean, d long, t long, pos int, h long, words int"
_WINDOWS = "z boolean, d long, t long, h long, w1 long, w2 long, pos int, size int"
Line = tuple[int, int, int]  # place among the lines with a word, hash, words


def line_hashes(lines: Sequence[bytes]) -> list[Line]:
    """Place, hash and words of each line with a word; white space around a line does not count."""
    out: list[Line] = []
    for line in lines:
        line = line.strip()
        if line:
            out.append((len(out), xxhash.xxh3_64_intdigest(line) - (1 << 63), len(line.split())))
    return out


def windows(lines: Sequence[Line], min_words: int) -> list[tuple[int, int]]:
    """(first, last) places in ``lines`` of the shortest runs of ``min_words`` words that begin or end at a line; lines of a run follow each other."""
    out = set()
    start, words = 0, 0
    for i, (pos, _, n) in enumerate(lines):
        if i and pos != lines[i - 1][0] + 1:
            start, words = i, 0
        words += n
        # The shortest run that ends here, and the runs that end here first.
        while words - lines[start][2] >= min_words:
            out.add((start, i))
            words -= lines[start][2]
            start += 1
        if words >= min_words:
            out.add((start, i))
    return sorted(out)


def patience(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """A longest subset of (place, other place) pairs that rises on both sides; pairs come by first place."""
    tails: list[int] = []
    at: list[int] = []
    back: list[int] = []
    for i, (_, other) in enumerate(pairs):
        k = bisect_left(tails, other)
        back.append(at[k - 1] if k else -1)
        if k == len(tails):
            tails.append(other)
            at.append(i)
        else:
            tails[k], at[k] = other, i
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(pairs[i])
        i = back[i]
    return out[::-1]


def common_lines(later: Sequence[Line], earlier: Sequence[Line], marks: Sequence[tuple[int, int]], min_words: int) -> set[int]:
    """Places of the lines of ``later`` in blocks that it has in common with ``earlier``. ``marks``: (place, other place) where common windows begin."""
    words = {pos: n for pos, _, n in later}
    own = {pos: h for pos, h, _ in later}
    other = {pos: h for pos, h, _ in earlier}
    gone: set[int] = set()

    def extend(pos: int, there: int) -> None:
        """The block around two equal lines goes if it has enough words."""
        first, last = pos, pos
        while first - 1 in own and own[first - 1] == other.get(there - (pos - first) - 1):
            first -= 1
        while last + 1 in own and own[last + 1] == other.get(there + (last - pos) + 1):
            last += 1
        if sum(words[x] for x in range(first, last + 1)) >= min_words:
            gone.update(range(first, last + 1))

    there = Counter(h for _, h, _ in earlier)
    place = {h: pos for pos, h, _ in earlier}
    before = -1
    while len(gone) > before:
        before = len(gone)
        left = [(pos, h) for pos, h, _ in later if pos not in gone]
        here = Counter(h for _, h in left)
        for pos, at in patience([(pos, place[h]) for pos, h in left if here[h] == 1 and there[h] == 1]):
            if pos not in gone:
                extend(pos, at)
    for pos, at in marks:
        if pos not in gone:
            extend(pos, at)
    return gone


def _document(docs: DataFrame) -> list[Column]:
    doc_id = docs["doc_id"].cast("long")
    return [doc_id.isNull().alias("z"), F.coalesce(doc_id, F.lit(0)).alias("d"), F.xxhash64(docs["text"]).alias("t")]


def common_blocks(docs: DataFrame, min_words: int = MIN_BLOCK_WORDS) -> DataFrame:
    """z, d, t (a document's key) and gone: places, among its lines with a word, of those in common blocks with earlier documents. Others are absent.

    Earlier means the smaller (doc_id, text hash); null ids come last. Rows equal in both are one document and share nothing.
    """

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(z, d, t, *line) for z, d, t, text in zip(*(batch.column(c).to_pylist() for c in (*_DOC, "text"))) if text
                    for line in line_hashes(text.encode().split(b"\n"))]
            if rows:
                types = [pa.bool_(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), types)], names=[*_DOC, "pos", "h", "words"])

    lines = stored(docs.select(*_document(docs), "text").mapInArrow(split, _LINES), "lines")
    counts = lines.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*_DOC)).alias("low"), F.max(F.struct(*_DOC)).alias("high"))
    # Written, so that the join below has an exchange on either side and Spark splits partitions that a frequent line makes large.
    shared = stored(counts.where("low <> high").select("h", "n"), "shared-lines")
    # A group is one document's lines.
    kept = lines.join(shared, "h").groupBy(*_DOC).agg(F.array_sort(F.collect_list(F.struct("pos", "h", "words", "n"))).alias("lines"))
    kept = stored(kept.where(F.aggregate("lines", F.lit(0).cast("long"), lambda total, x: total + x["words"]) >= min_words), "kept-lines")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for z, d, t, found in zip(*(batch.column(c).to_pylist() for c in (*_DOC, "lines"))):
                own = sorted({(x["pos"], x["h"], x["words"]) for x in found})
                often = {x["h"]: x["n"] for x in found}
                for first, last in windows(own, min_words):
                    run = [h for _, h, _ in own[first : last + 1]]
                    whole = xxhash.xxh3_128_intdigest(b"".join(h.to_bytes(8, "little", signed=True) for h in run))
                    rows.append((z, d, t, min(run, key=lambda h: (often[h], h)), (whole >> 64) - (1 << 63), (whole & (1 << 64) - 1) - (1 << 63), own[first][0], last - first + 1))
            if rows:
                types = [pa.bool_(), *[pa.int64()] * 5, pa.int32(), pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), types)], names=[*_DOC, "h", "w1", "w2", "pos", "size"])

    key = ["h", "w1", "w2"]
    found = stored(kept.mapInArrow(cut, _WINDOWS), "line-windows")
    holders = found.groupBy(*key).agg(F.min(F.struct(*_DOC, "pos")).alias("first"), F.max(F.struct(*_DOC)).alias("last"))
    firsts = stored(holders.where(F.struct("first.z", "first.d", "first.t") < F.col("last")).select(*key, "first"), "first-windows")
    later = F.struct(*_DOC) > F.struct("first.z", "first.d", "first.t")
    marks = found.join(firsts, key).where(later).select(
        *_DOC, *(F.col(f"first.{c}").alias(f"e{c}") for c in _DOC), F.struct("pos", F.col("first.pos").alias("there")).alias("mark"))
    partner = [f"e{c}" for c in _DOC]
    pairs = stored(marks.groupBy(*_DOC, *partner).agg(F.collect_list("mark").alias("marks")), "line-pairs")
    other = kept.select(*(F.col(c).alias(f"e{c}") for c in _DOC), F.col("lines").alias("other"))
    aligned = pairs.join(other, partner).join(kept, _DOC)

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gone = []
            for own, their, at in zip(*(batch.column(c).to_pylist() for c in ("lines", "other", "marks"))):
                sides = [sorted({(x["pos"], x["h"], x["words"]) for x in side}) for side in (own, their)]
                gone.append(sorted(common_lines(*sides, sorted((m["pos"], m["there"]) for m in at), min_words)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in _DOC), pa.array(gone, pa.list_(pa.int32()))], names=[*_DOC, "gone"])

    dropped = aligned.select(*_DOC, "lines", "other", "marks").mapInArrow(align, "z boolean, d long, t long, gone array<int>")
    return dropped.groupBy(*_DOC).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("gone")))).alias("gone"))


def lines_to_drop(lines: list[bytes], gone: set[int]) -> list[int]:
    """Places of the deleted lines in the text; ``gone`` counts lines with a word. Blank lines between two that follow each other go with them."""
    drop: list[int] = []
    blank: list[int] = []
    number, inside = 0, False
    for pos, line in enumerate(lines):
        if not line.strip():
            blank.append(pos)
            continue
        if number in gone:
            drop += blank if inside else []
            drop.append(pos)
        inside = number in gone
        blank.clear()
        number += 1
    return drop


def deduplicated_lines(docs: DataFrame, min_words: int = MIN_BLOCK_WORDS) -> DataFrame:
    """``docs`` without the common blocks of later documents.

    ``text`` is the text left; added are n_lines (lines before), dropped (places of the deleted lines, array) and emptied (a text with words
    has none left). Null and empty texts pass unchanged. Names that ``docs`` has already are lengthened by ``_``.
    """
    names = {c: fresh(docs.columns, f"line_{c}") for c in (*_DOC, "gone")}
    own = [fresh(docs.columns, c) for c in ("n_lines", "dropped", "emptied")]
    marks, key = names["gone"], [names[c] for c in _DOC]
    # Written, so that Spark can split what a large group of equal rows makes of the texts' side.
    found = stored(common_blocks(docs, min_words).withColumnsRenamed(names), "line-blocks")
    keyed = docs.withColumns(dict(zip(key, _document(docs))))
    # The list of documents with blocks grows with the table, so it is not broadcast where it happens to be small.
    joined = keyed.join(found.hint("merge"), key, "left").select(*docs.columns, marks)
    at = docs.columns.index("text")

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, sizes, dropped, emptied = [], [], [], []
            for text, found in zip(batch.column(at).to_pylist(), batch.column(marks).to_pylist()):
                lines = text.encode().split(b"\n") if text else []
                gone: list[int] = []
                if found:
                    gone = lines_to_drop(lines, set(found))
                if gone:
                    out = set(gone)
                    left = b"\n".join(x for i, x in enumerate(lines) if i not in out).decode()
                else:
                    left = text
                texts.append(left)
                sizes.append(len(lines))
                dropped.append(gone)
                emptied.append(bool(gone) and not left.split())
            columns = list(batch.columns[:-1])
            columns[at] = pa.array(texts, columns[at].type)
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sizes, pa.int64()), pa.array(dropped, pa.list_(pa.int64())), pa.array(emptied, pa.bool_())],
                                             names=[*batch.schema.names[:-1], *own])

    schema = StructType(docs.schema.fields + [StructField(own[0], LongType()), StructField(own[1], ArrayType(LongType())), StructField(own[2], BooleanType())])
    return joined.mapInArrow(rewrite, schema)


def deduplicated_documents(docs: DataFrame, min_words: int = MIN_BLOCK_WORDS) -> DataFrame:
    """``docs`` with the text left, one row of those equal in doc_id and text; documents of which nothing is left go, those that were empty before stay.

    Of rows equal in doc_id and text that differ elsewhere any one is kept. Rows without doc_id that are equal in text count as equal.
    """
    docs = one_of_each(docs)
    emptied = fresh(docs.columns, "emptied")
    return deduplicated_lines(docs, min_words).where(~F.col(emptied)).select(*docs.columns)
