"""Backoff scores against a model in plain Python."""

import math
import random
import re
import zlib
from collections import Counter

import pytest
from cases import ODD
from pyspark.sql import functions as F

from txguard.llm import katz

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def tokens_of(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [*WORD.findall(lowered), "</s>"]


def held(d):
    return d is not None and zlib.crc32(str(d).encode()) % 7 == 2


class Model:
    """Katz backoff over dictionaries, evaluated recursively."""

    def __init__(self, texts, order):
        self.counts = [Counter() for _ in range(order + 1)]
        for text in texts:
            words = ["<s>", *tokens_of(text)]
            for k in range(1, order + 1):
                for i in range(1, len(words)):
                    if i - k + 1 >= 0:
                        self.counts[k][tuple(words[i - k + 1 : i + 1])] += 1
        self.order, self.n = order, sum(self.counts[1].values())
        self.d = [None]
        for k in range(1, order + 1):
            r = Counter(self.counts[k].values())
            found = katz.discounts([r[i] for i in range(1, 7)])
            self.d.append({i + 1: x for i, x in enumerate(found)})
        self.after = {}
        for k in range(2, order + 1):
            for gram, c in self.counts[k].items():
                self.after.setdefault(gram[:-1], []).append((gram[-1], c))
        self.known = {}

    def discounted(self, k, c):
        return c * self.d[k].get(c, 1.0)

    def whole(self, k, counts):
        """Denominator and share for what was not seen."""
        saved = sum(c - self.discounted(k, c) for c in counts)
        total = sum(counts) + (saved <= 0)
        return total, (saved if saved > 0 else 1) / total

    def p(self, word, context):
        key = (word, context)
        if key not in self.known:
            self.known[key] = self._p(word, context)
        return self.known[key]

    def _p(self, word, context):
        if not context:
            total, rest = self.whole(1, self.counts[1].values())
            c = self.counts[1][(word,)]
            return self.discounted(1, c) / total if c else rest
        if context not in self.after:
            return self.p(word, context[1:])
        seen = self.after[context]
        total, rest = self.whole(len(context) + 1, [c for _, c in seen])
        c = dict(seen).get(word, 0)
        if c:
            return self.discounted(len(context) + 1, c) / total
        return rest / (1 - sum(self.p(w, context[1:]) for w, _ in seen)) * self.p(word, context[1:])

    def score(self, text):
        words = ["<s>", *tokens_of(text)]
        return sum(math.log10(self.p(words[i], tuple(words[max(0, i - self.order + 1) : i]))) for i in range(1, len(words)))


def brute(rows, order):
    model = Model([t for d, t in rows if not held(d)], order)
    size = len(model.counts[1])
    out = []
    for d, t in rows:
        words = tokens_of(t)
        c = [model.counts[1][(w,)] for w in words]
        out.append((d, held(d), len(words), sum(x > 0 for x in c), model.n, sum(math.log10((x + 1) / (model.n + size + 1)) for x in c), model.score(t)))
    return model, sorted(out, key=repr)


def corpus(n, seed=0):
    rng = random.Random(seed)
    words = [f"W{i}" if i % 3 else f"w{i}" for i in range(1500)]
    weights = [1 / (i + 1) for i in range(1500)]
    rows = []
    for d in range(n):
        text = []
        for _ in range(rng.randint(0, 40)):
            text.append(rng.choices(words, weights)[0] if not text or rng.random() < 0.6 else f"after{text[-1].lower()}")
        rows.append((d, rng.choice([" ", "\n", "\t"]).join(text) + (f" only{d}" if d % 5 == 0 else "")))
    return rows


def check(documents, rows, order, **how):
    scored = katz.train_and_score(documents(rows).withColumnRenamed("lang", "path").withColumn("score", F.lit("x")).repartition(3), order, **how)
    assert scored.scores.columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    got = sorted((tuple(r) for r in scored.scores.collect()), key=repr)
    model, want = brute(rows, order)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    for g, w in zip(got, want):
        assert g[5] == pytest.approx(w[5], abs=1e-9, rel=1e-9) and g[6] == pytest.approx(w[6], abs=1e-7, rel=1e-7)
    return scored, model, got


@pytest.mark.parametrize("order", [2, 3])
def test_scores(documents, order):
    scored, model, got = check(documents, corpus(150), order)
    assert any(level.discounts for level in scored.levels)
    for k, table in enumerate(scored.tables, 1):
        counts = Counter(x for r in table.collect() for x in r["table_count"])
        assert counts == Counter(model.counts[k].values())
    # Better than word counts alone on texts it has not seen.
    unseen = [g for g in got if g[1]]
    assert sum(g[6] for g in unseen) > sum(g[5] for g in unseen)


def test_probabilities_add_up_to_one():
    model = Model([t for _, t in corpus(80)], 3)
    vocabulary = [w for (w,) in model.counts[1]] + ["never seen"]
    for context in [(), ("<s>",), ("w0",), ("w1", "w0"), ("<s>", "w0"), ("nothing",), *list(model.after)[:60]]:
        assert sum(model.p(w, context) for w in vocabulary) == pytest.approx(1, abs=1e-9)


@pytest.mark.parametrize("order", [2, 3])
def test_small_chunks_parts_and_dealt_contexts(documents, order):
    check(documents, corpus(120, 1), order, chunk_tokens=37, part_size=200, hot=10)


def test_odd_rows(documents):
    check(documents, ODD, 2, chunk_tokens=7000)
    check(documents, ODD[:6], 3, chunk_tokens=3)
    check(documents, [], 2)
    check(documents, [(d, "only held out") for d in range(100) if held(d)][:3], 2)
    check(documents, [(1, None)], 2)


def test_discounts():
    assert katz.discounts([0, 0, 0, 0, 0, 0]) == [] and katz.discounts([10, 0, 0, 0, 0, 0]) == []
    found = katz.discounts([1000, 400, 200, 120, 80, 50])
    assert len(found) == 5 and all(0 < d < 1 for d in found)
    # The reserved share of n-grams seen up to five times is the one of Good and Turing's unseen ones.
    n = [1000, 400, 200, 120, 80, 50]
    assert sum(n[r - 1] * r * (1 - found[r - 1]) for r in range(1, 6)) == pytest.approx(n[0])
