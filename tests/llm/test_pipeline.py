"""The pipeline's stages in a row, and what they do to planted documents."""

import random
from collections import Counter

import pytest

import corpus_pipeline

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    """Tables of clean texts with copies, near copies, shared passages and junk."""
    root = tmp_path_factory.mktemp("planted")
    rng = random.Random(0)
    syllables = ["ta", "re", "mi", "no", "ku", "sel", "dra", "vo", "pin", "lo"]

    def word():
        return "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))

    def text(n=200, line=20):
        return "\n".join(" ".join(word() for _ in range(line)) + "." for _ in range(n // line))

    rows = [(i, text()) for i in range(60)]
    passage = text(60)
    rows += [(100 + i, rows[i][1]) for i in range(5)]
    near = [w.split(" ") for w in (rows[i][1].replace("\n", " ") for i in range(10, 15))]
    for i, words in enumerate(near):
        words[7] = "changed"
        rows.append((200 + i, " ".join(words)))
    rows += [(300 + i, text(100) + "\n" + passage + "\n" + text(60)) for i in range(3)]
    rows += [(400 + i, " ".join(word() + "###" for _ in range(100))) for i in range(5)] + [(500, "too short"), (501, None), (502, "")]
    docs = [(d, t, "en", f"src{d % 3}", len(t or "")) for d, t in rows]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(root / "documents.parquet"))
    spark.createDataFrame([(d, int(d < 400), 0) for d, _ in rows], "doc_id long, quality int, toxic int").write.parquet(str(root / "labels.parquet"))
    return str(root), dict(rows), passage


def test_stages_catch_what_is_planted(spark, planted):
    root, texts, passage = planted
    docs = spark.read.parquet(f"{root}/documents.parquet")
    columns = docs.columns
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, root)
        rows = out.collect()
        seen[name] = rows
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == columns
            docs = spark.createDataFrame(rows, docs.schema)
    ids = {n: Counter(r["doc_id"] for r in rows) for n, rows in seen.items()}
    assert set(ids["quality rules"]) == {d for d in texts if d < 500} or set(ids["quality rules"]) == {d for d in texts if d < 400}
    kept = {r["doc_id"]: r["text"] for r in seen["line dedup"]}
    assert not set(range(100, 105)) & set(kept)
    assert passage in kept[300] and all(passage.split("\n")[0] not in kept[d] for d in (301, 302))
    assert all(kept[d] == texts[d] for d in range(60))
    single = ids["near duplicates"]
    assert all(single[d] == 1 for d in range(60)) and not any(single[d] for d in range(200, 205))
    assert all(n <= 2 for n in ids["mixing"].values())
    pieces = seen["packing"]
    assert {r["doc_id"] for r in pieces} == set(ids["mixing"])
    boxes = {}
    for r in pieces:
        boxes.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for box in boxes.values():
        at = 0
        for offset, length in sorted(box):
            assert offset == at
            at += length
        assert at <= 2048


def test_run_over_tables(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 0 and "sequence_id" in out.columns
    assert corpus_pipeline.ORACLE_SQL is None and len(corpus_pipeline.STAGES) == 5
