"""Similarity operators against brute force."""

import random

import numpy as np
import pytest
import xxhash
from cases import ODD

from txguard.llm import jaccard, line_dedup, pivots
from txguard.llm.components import components

SF = "/root/testdata/sf0.001"


def reachable(nodes, links):
    near = {n: set() for n in nodes}
    for a, b in links:
        near[a].add(b)
        near[b].add(a)
    out = {}
    for n in sorted(nodes):
        todo = [n]
        while todo:
            x = todo.pop()
            if x not in out:
                out[x] = n
                todo += near[x]
    return out


def sets_of(text, k):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = lowered.encode().split()
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def brute(rows, k, percent):
    """doc_id, n_shingles, component_id of distinct rows."""
    found = {(d, t): sets_of(t, k) for d, t in rows}
    named = [x for x in found if x[0] is not None]
    links = [(a[0], b[0]) for i, a in enumerate(named) for b in named[:i]
             if found[a] and 100 * len(found[a] & found[b]) >= percent * len(found[a] | found[b])]
    comp = reachable({d for d, _ in named}, links)
    return sorted(((d, len(found[d, t]), comp[d] if d is not None else None) for d, t in rows), key=str)


def check_join(docs, k, percent):
    got = sorted((tuple(r) for r in jaccard.similar_documents(docs, k, percent).collect()), key=str)
    assert got == brute([(r.doc_id, r.text) for r in docs.collect()], k, percent)


def near_copies(n, seed):
    """A group in which many share their frequent shingles and some link."""
    rng = random.Random(seed)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(n):
        words = list(base)
        for _ in range(rng.choice([0, 0, 1, 1, 2])):
            words[rng.randrange(60)] = f"x{rng.randrange(40)}"
        rows.append((i, " ".join(words)))
    return rows


def test_join_on_tables_and_odd_rows(spark, documents):
    check_join(spark.read.parquet(f"{SF}/documents.parquet"), 4, 85)
    check_join(documents(ODD), 4, 85)
    check_join(documents([]), 5, 80)


def test_join_in_dense_groups(spark, documents, monkeypatch):
    check_join(documents(near_copies(120, 1)), 4, 85)
    monkeypatch.setattr(jaccard, "LONG_POSTING", 3)
    monkeypatch.setattr(jaccard, "BLOCK", 25)
    for percent in (60, 85, 95):
        check_join(documents(near_copies(150, 2) + [(1000 + i, t) for i, t in near_copies(40, 3)]), 3, percent)


def test_near_copies_go(spark, documents):
    docs = documents([(3, "a b c d e f g h"), (1, "A b c d e f g h"), (2, "other words are here"), (None, "a b c d e f g h"), (4, None), (5, "")])
    left = {r.doc_id for r in jaccard.without_near_copies(docs, 5, 80).collect()}
    assert left == {1, 2, None, 4, 5}


def test_components(spark):
    rng = random.Random(0)
    graphs = [[(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 60)], [(rng.randrange(80), rng.randrange(80)) for _ in range(60)],
              [(40 - i, 39 - i) for i in range(40)], [(5, 5), (None, 3)], []]
    for edges in graphs:
        got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
        real = [(a, b) for a, b in edges if a is not None]
        want = reachable({x for e in real for x in e}, real)
        assert got == {n: c for n, c in want.items() if n != c}


def brute_vectors(rows):
    valid = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    unit = [(i, v / np.linalg.norm(v)) for i, v in valid]
    pairs = [(a, b) for a in range(len(unit)) for b in range(a) if len(unit[a][1]) == len(unit[b][1]) and unit[a][1] @ unit[b][1] >= 0.9]
    return unit, pairs


def test_vectors(spark):
    rng = np.random.default_rng(0)
    base = rng.normal(size=(60, 16))
    rows = [(i, (base[i % 60] + rng.normal(size=16) * rng.choice([0.0, 0.05, 0.15])).tolist()) for i in range(400)]
    rows += [(500, None), (501, [0.0] * 16), (502, [float("nan")] + [1.0] * 15), (503, [None] + [1.0] * 15), (504, []), (None, base[0].tolist()),
             (3, rows[3][1]), (505, [1.0, 2.0]), (506, [2.0, 4.0])]
    got = pivots.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert len(got) == len(rows)
    unit, pairs = brute_vectors(rows)
    links = [0] * len(unit)
    for a, b in pairs:
        links[a] += 1
        links[b] += 1
    comp = reachable({i for i, _ in unit}, [(unit[a][0], unit[b][0]) for a, b in pairs])
    want = sorted((i, n, comp[i]) for (i, _), n in zip(unit, links))
    found = sorted((r.vec_id, r.n_links, r.component_id) for r in got if r.vec_id is not None and r.vec_id not in range(500, 505))
    missing = sum(w[1] for w in want) - sum(f[1] for f in found)
    assert 0 <= missing <= 0.02 * sum(w[1] for w in want)
    assert sum(w != f for w, f in zip(want, found)) <= 0.05 * len(want)
    for r in got:
        if r.vec_id is None or r.vec_id in range(500, 505):
            assert (r.n_links, r.component_id, r.kept) == (0, r.vec_id, True)
    assert pivots.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0


@pytest.mark.parametrize("cosine", [0.9, 0.95])
def test_pivots_find_pairs_at_the_threshold(spark, cosine):
    """Recall over planted pairs just above the threshold, lists cut into blocks."""
    rng = np.random.default_rng(1)
    a = pivots.unit(rng.normal(size=(600, 64)))
    r = rng.normal(size=a.shape)
    r = pivots.unit(r - (r * a).sum(1, keepdims=True) * a)
    near = cosine + 0.002
    b = near * a + np.sqrt(1 - near**2) * r
    rows = [(2 * i, x.tolist()) for i, x in enumerate(a)] + [(2 * i + 1, x.tolist()) for i, x in enumerate(b)]
    got = pivots.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), cosine=cosine).collect()
    assert sum(x.n_links > 0 for x in got) >= 0.95 * len(rows)
    assert all(x.component_id in (x.vec_id, x.vec_id - 1) for x in got)


def test_a_dense_group_is_found_whole(spark):
    rng = np.random.default_rng(2)
    dense = rng.normal(size=64) + 0.02 * rng.normal(size=(500, 64))
    rows = [(i, x.tolist()) for i, x in enumerate(np.concatenate([dense, rng.normal(size=(1500, 64))]))]
    got = pivots.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).where("vec_id < 500").collect()
    assert {(r.n_links, r.component_id) for r in got} == {(499, 0)}


@pytest.mark.parametrize("n,mutual", [(3000, 0.8), (12000, 0.8), (3000, 0.7), (12000, 0.7)])
def test_links_in_a_crowd_are_found(spark, n, mutual):
    """A third of all rows resemble each other without being near copies; pairs just above the threshold are planted among them."""
    rng = np.random.default_rng(n)
    mean = pivots.unit(rng.normal(size=(1, 64)))

    def across(x):
        return pivots.unit(x - (x @ mean.T) * mean)

    a = across(rng.normal(size=(n // 6, 64)))
    r = rng.normal(size=a.shape)
    r = across(r - (r * a).sum(1, keepdims=True) * a)
    inner = (0.905 - mutual) / (1 - mutual)
    b = inner * a + np.sqrt(1 - inner**2) * pivots.unit(r - (r * a).sum(1, keepdims=True) * a)
    crowd = np.sqrt(mutual) * mean + np.sqrt(1 - mutual) * np.concatenate([a, b])
    every = pivots.unit(np.concatenate([crowd, rng.normal(size=(n - len(crowd), 64))]))
    got = pivots.near_vectors(spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(every)], "vec_id long, embedding array<double>")).collect()
    near = np.concatenate([every[i : i + 1000] @ every.T >= 0.9 for i in range(0, n, 1000)])
    found = np.array([r.n_links for r in sorted(got)])
    assert near.sum() - n >= len(crowd)
    assert (found == near.sum(1) - 1).all()


def test_crowds_in_blocks_and_side_by_side(spark, monkeypatch):
    monkeypatch.setattr(pivots, "CROWD_BLOCK", 150)
    rng = np.random.default_rng(5)
    means = rng.normal(size=(3, 24))
    means[1] = means[0] + 0.5 * means[1]
    every = np.concatenate([np.repeat(means, 300, axis=0) + 0.45 * rng.normal(size=(900, 24)), rng.normal(size=(300, 24))])
    every = pivots.unit(np.concatenate([every, every[:200] + 0.3 * rng.normal(size=(200, 24)), every[:5]]))
    got = pivots.near_vectors(spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(every)], "vec_id long, embedding array<double>")).collect()
    unit, pairs = brute_vectors([(i, x.tolist()) for i, x in enumerate(every)])
    comp = reachable(set(range(len(every))), pairs)
    ends = np.bincount(np.array(pairs).ravel(), minlength=len(every))
    assert len(pairs) > 500 and sorted((r.vec_id, r.n_links, r.component_id) for r in got) == [(i, ends[i], comp[i]) for i in range(len(every))]


def brute_lines(rows, min_words):
    """Text left of each distinct (doc_id, text) by looking at every run of lines of every pair; equal rows are one document."""
    distinct = sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0, xxhash64(r[1])))
    texts = [(t or "").split("\n") for _, t in distinct]
    worded = [[(i, x.strip(" \t\n\r\x0b\x0c")) for i, x in enumerate(lines) if x.strip(" \t\n\r\x0b\x0c")] for lines in texts]
    out = {}
    for n, row in enumerate(distinct):
        own, gone = worded[n], set()
        for m in range(n):
            other = worded[m]
            for shift in range(-len(other) + 1, len(own)):
                run = []
                for i in range(max(0, shift), len(own) + 1):
                    if i < len(own) and i - shift < len(other) and own[i][1] == other[i - shift][1]:
                        run.append(i)
                        continue
                    if sum(len(own[j][1].encode().split()) for j in run) >= min_words:
                        gone.update(run)
                    run = []
        drop = {own[i][0] for i in gone} | {x for i in gone if i + 1 in gone for x in range(own[i][0], own[i + 1][0])}
        out[row] = "\n".join(x for i, x in enumerate(texts[n]) if i not in drop) if drop else row[1]
    return out


def xxhash64(text):
    """Spark's xxhash64 of a string."""
    return (xxhash.xxh64_intdigest((text or "").encode(), 42) + (1 << 63)) % (1 << 64) - (1 << 63) if text is not None else 42


def test_lines(spark, documents):
    rng = random.Random(0)
    lines = [" ".join(f"w{rng.randrange(50)}" for _ in range(rng.randint(1, 9))) for _ in range(60)]
    rows = [(i, "\n".join(rng.choice([*rng.sample(lines, 3), "", f"own {i}"]) for _ in range(rng.randint(0, 25)))) for i in range(80)]
    rows += [(200 + i, rows[i][1]) for i in range(10)] + [(300, rows[3][1] + "\nmore\n" + rows[4][1]), (None, rows[5][1]), rows[6]]
    rows += [(301, rows[4][1] + "\n \n" + rows[3][1]), (302, "\n".join([rows[7][1]] * 3)), (303, "\n".join(reversed(rows[8][1].split("\n")))), (303, rows[9][1]), (303, rows[8][1])]
    for given, least in ((rows, 8), (ODD, 2), ([(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()], 40), ([], 5)):
        want = brute_lines(given, least)
        docs = documents(given).withColumnRenamed("lang", "dropped").withColumnRenamed("source", "n_lines")
        out = line_dedup.deduplicated_lines(docs, least)
        assert out.columns[:5] == docs.columns and len(out.columns) == 8
        assert sorted(((r.doc_id, r.text) for r in out.collect()), key=str) == sorted(((d, want[d, t]) for d, t in given), key=str)
        left = line_dedup.deduplicated_documents(docs, least)
        assert left.columns == docs.columns
        # Rows equal in id and text are kept once.
        kept = [(d, want[d, t]) for d, t in set(given) if want[d, t] == t or want[d, t].encode().split()]
        assert sorted(((r.doc_id, r.text) for r in left.collect()), key=str) == sorted(kept, key=str)


def test_passages_and_copies_go(spark, documents):
    passage = "\n".join(" ".join(f"p{i}q{j}" for j in range(20)) for i in range(3))
    docs = documents([(1, f"first own\n{passage}\nend one"), (2, f"second own line\n{passage}"), (3, f"first own\n{passage}\nend one"), (4, "clean text")])
    out = {r.doc_id: r.text for r in line_dedup.deduplicated_documents(docs).collect()}
    assert out == {1: f"first own\n{passage}\nend one", 2: "second own line", 4: "clean text"}


def test_blocks_of_any_earlier_document_go(spark, documents):
    """The first document that has each of the lines is not the one that has the block."""
    lines = [" ".join(f"l{i}w{j}" for j in range(12)) for i in range(8)]
    inorder = "\n".join(lines)
    docs = documents([(1, "\n".join(reversed(lines))), (2, inorder), (3, inorder), (4, f"own\n{lines[2]}\n\n{lines[3]}\n{lines[4]}\n{lines[5]}\nend")])
    assert {r.doc_id: r.text for r in line_dedup.deduplicated_documents(docs).collect()} == {1: "\n".join(reversed(lines)), 2: inorder, 4: "own\nend"}


def test_lines_shared_with_many_make_no_block(spark, documents):
    lines = [" ".join(f"l{i}w{j}" for j in range(12)) for i in range(4)]
    rows = [(i, f"head {i}\n{x}\ntail {i}") for i, x in enumerate(lines)] + [(9, "\n".join(lines))]
    assert sorted((r.doc_id, r.text) for r in line_dedup.deduplicated_documents(documents(rows)).collect()) == rows


def test_a_line_and_a_passage_that_most_documents_have(spark, documents):
    common, passage = "this line is everywhere", "\n".join(" ".join(f"p{i}q{j}" for j in range(15)) for i in range(4))
    rows = [(i, f"{common}\nown {i} text\n{passage}\nmore {i}") for i in range(600)]
    got = {r.doc_id: r.text for r in line_dedup.deduplicated_documents(documents(rows)).collect()}
    assert got == {i: t if i == 0 else f"{common}\nown {i} text\nmore {i}" for i, t in rows}


def test_repeated_rows_stay_once(spark, documents):
    t = " ".join(f"w{i}" for i in range(60))
    got = [(r.doc_id, r.text) for r in line_dedup.deduplicated_documents(documents([(1, t), (1, t), (1, t), (2, t), (None, "x y"), (None, "x y"), (3, None), (3, None)])).collect()]
    assert sorted(got, key=str) == sorted([(1, t), (None, "x y"), (3, None)], key=str)


def test_windows_cover_every_block():
    rng = random.Random(4)
    for _ in range(300):
        lines = [(i, i, rng.choice([1, 3, 8, 25, 60])) for i in range(rng.randint(1, 12))]
        found = line_dedup.windows(lines, 40)
        for a in range(len(lines)):
            for b in range(a, len(lines)):
                if sum(n for _, _, n in lines[a : b + 1]) >= 40:
                    inside = [w for w in found if a <= w[0] and w[1] <= b]
                    assert all(any(w[0] <= i <= w[1] for w in inside) for i in range(a, b + 1))


def test_repeated_rows_and_several_texts_of_one_id(spark, documents):
    a, b, c = (" ".join(f"{x}{i}" for i in range(50)) for x in "abc")
    near = a.replace("a49", "changed")
    rows = [(1, a), (1, a), (1, a), (2, a), (3, b), (3, near), (4, c), (4, c.replace("c49", "other")), (None, b), (None, b), (5, None), (5, None), (6, "short"), (6, "short")]
    got = sorted(((r.doc_id, r.text) for r in jaccard.without_near_copies(documents(rows), 5, 80).collect()), key=str)
    kept = [x for x in got if x[0] == 4]
    assert len(kept) == 1 and [x for x in got if x[0] != 4] == sorted([(1, a), (3, b), (None, b), (5, None), (6, "short")], key=str)
