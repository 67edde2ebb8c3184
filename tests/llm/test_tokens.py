"""Encoding, token files and packing against plain encoding."""

import zlib
from array import array

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from cases import ODD
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from txguard.llm import packing, token_files
from txguard.llm.tokens import Encoder

WORD, BYTE = (public_tokenizers.path(f) for f in ("word_bpe_49k.json", "byte_bpe_50k.json"))
ENCODERS = {WORD: Encoder(WORD, True), BYTE: Encoder(BYTE, False)}
PLAIN = {p: Tokenizer.from_file(p) for p in ENCODERS}
SF = "/root/testdata/sf0.001"


def plain(path, text):
    return PLAIN[path].encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("path", ENCODERS)
@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a", "Zb", "é", "é", "́", " ", "  ", "\n", " \n", "\t", "'s", "'", "12", "!", "..", ".", ",", "Σ", "İ", "ß", "漢", "😀",
                                 "\x0b", "\x1c", "\x85", "\xa0", "　", "​", "<|endoftext|>", "<|"]), max_size=14))
def test_parts_give_the_ids_of_the_whole(path, parts):
    text = "".join(parts)
    assert list(array("I", ENCODERS[path](text))) == plain(path, text)


def test_levels_give_every_token(tmp_path):
    rng = np.random.default_rng(0)
    for n in (0, 1, 511, 512, 513, 5000):
        ids = rng.choice(np.array([3, 255, 256, 49_000, 70_000, 2**31], "<u4"), n)
        path = str(tmp_path / f"{n}.dac")
        levels = token_files.encode_levels(ids)
        assert sum(len(c) for c, _, _ in levels) == sum(max(1, (int(i).bit_length() + 7) // 8) for i in ids)
        with open(path, "wb") as f:
            f.write(token_files.shard_bytes([None, 7], [n // 2, n - n // 2], ids))
        with pa.OSFile(path) as f:
            shard = token_files.Shard(f)
            assert shard.documents()[0] == [None, 7]
            assert shard.tokens(0, n).tolist() == ids.tolist()
            for i in rng.integers(0, n, 50) if n else []:
                assert shard.token(int(i)) == ids[i]
                assert shard.tokens(int(i), n).tolist() == ids[i:].tolist()


def test_files_read_back(spark, documents):
    for docs in (documents(ODD), spark.read.parquet(f"{SF}/documents.parquet"), documents([])):
        manifest = token_files.write_token_files(docs, WORD, 1, shard_tokens=20_000)
        rows = token_files.read_token_files(manifest).collect()
        want = sorted(((r.doc_id is None, r.doc_id or 0), plain(WORD, r.text) + [1]) for r in docs.collect())
        got = sorted(((r.doc_id is None, r.doc_id or 0), list(array("I", r.ids))) for r in rows)
        assert got == want
        at = 0
        for r in sorted(rows, key=lambda r: r.start):
            assert r.start == at and r.n_tokens * 4 == len(r.ids)
            at += r.n_tokens
        known = [r.doc_id for r in sorted(rows, key=lambda r: r.start)]
        assert known == sorted(known, key=lambda d: (d is None, d or 0))


def test_packing_keeps_every_token(spark, documents):
    for docs in (documents(ODD), spark.read.parquet(f"{SF}/documents.parquet"), documents([])):
        cut = packing.pieces(docs, BYTE, 0)
        rows = packing.place(cut).collect()
        whole = sorted(((r.doc_id is None, r.doc_id or 0), plain(BYTE, r.text) + [0]) for r in docs.collect())
        parts = {}
        for r in sorted(rows, key=lambda r: r.row):
            assert r.length * 4 == len(r.ids) and 1 <= r.length <= 2048
            if r.piece == 0:
                parts.setdefault(r.doc_id, []).append([])
                assert r.start == 0
            else:
                assert r.length == 2048
            own = parts[r.doc_id][-1]
            assert len(own) == r.start
            own += array("I", r.ids)
        assert sorted(((d is None, d or 0), x) for d, xs in parts.items() for x in xs) == whole
        boxes = {}
        for r in rows:
            boxes.setdefault(r.sequence_id, []).append((r.offset, r.length))
        for box in boxes.values():
            at = 0
            for offset, length in sorted(box):
                assert offset == at
                at += length
            assert at <= 2048
        total = sum(r.length for r in rows)
        assert len(boxes) <= max(-(-total // 2048) * 1.02 + 1, 1 if rows else 0)
        packed = {r.sequence_id: r.ids for r in packing.sequences(packing.place(cut)).collect()}
        assert sum(map(len, packed.values())) == 4 * total


def brute_bins(sizes, capacity):
    best = [len(sizes)]

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(sizes):
            best[0] = len(bins)
            return
        for k in range(len(bins)):
            if bins[k] + sizes[i] <= capacity and bins[k] not in bins[:k]:
                go(i + 1, [*bins[:k], bins[k] + sizes[i], *bins[k + 1 :]])
        go(i + 1, [*bins, sizes[i]])

    go(0, [])
    return best[0]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=9))
def test_reduction_keeps_the_optimum(sizes):
    counts = np.bincount(sizes, minlength=21) if sizes else np.zeros(21, np.int64)
    left = counts.copy()
    fixed = packing.reduce_by_dominance(left, 20)
    rest = [s for s, n in enumerate(left) for _ in range(n)]
    assert sum(n for _, n in fixed) + brute_bins(sorted(rest, reverse=True), 20) == brute_bins(sorted(sizes, reverse=True), 20)
    planned = packing.plan(counts, 20)
    assert all(sum(p) <= 20 for p, _ in planned)
    assert sorted(x for p, n in planned for x in p * n) == sorted(sizes)


def test_queries(spark):
    from txguard.llm.queries import all_queries

    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    at = 0
    for r in sorted(all_queries()["op8_token_files"](spark, SF).collect(), key=lambda r: r.doc_id):
        ids = array("I", plain(WORD, docs[r.doc_id]) + [1])
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    for r in all_queries()["op9_packing"](spark, SF).collect():
        ids = array("I", plain(BYTE, docs[r.doc_id]) + [0])
        assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
