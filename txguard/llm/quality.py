"""Quality rules with risk-controlled cutoffs.

Signals of each text are compared with cutoffs. A cutoff is chosen per stratum from labelled documents so that, with confidence
``1 - delta`` over all rules and strata together, each rule wrongly rejects at most its share of ``risk`` of the good documents.
Candidates form a fixed grid and are tested from the most lenient to the strictest, each with an exact (Clopper-Pearson) upper bound of
the share of good documents beyond it; the first that fails ends the walk, so the grid needs no correction, and rules and strata get
Bonferroni's. Of the certified cutoffs the most lenient that rejects the most bad documents is used; a rule that rejects none is off.

So a stratum needs ``least_good`` good labelled documents before any rule can be on in it: 1,495 with five rules, four strata and the defaults. In
strata with fewer the verdict is the base rules alone; ``fit_cutoffs`` tells which these are.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from txguard.llm.common import fresh, stored

SIGNALS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_SPACES = " \t\n\x0b\f\r"
_SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50


@dataclass(frozen=True)
class Rule:
    """Reject where ``100 * top / bottom`` is beyond a cutoff of the grid (from lenient to strict); above it, or below it if ``low``."""

    name: str
    top: str
    bottom: str
    grid: tuple[float, ...]
    low: bool = False


RULES = (
    Rule("symbol_share", "n_symbols", "word_chars", tuple(float(x) for x in (50, 40, 30, 25, 20, 15, 12, 10, 8, 6, 5, 4, 3, 2, 1))),
    Rule("repeat_share", "n_repeat_words", "n_words", tuple(float(x) for x in range(50, 0, -2))),
    Rule("long_words", "word_chars", "n_words", tuple(float(x) for x in (4000, 3000, 2500, 2000, 1500, 1200, 1000, 900, 800))),
    Rule("short_words", "word_chars", "n_words", tuple(float(x) for x in (100, 150, 200, 250, 300, 350)), low=True),
    Rule("dup_lines", "n_dup_lines", "n_words", tuple(x / 4 for x in range(40, 0, -1))),
)


def text_signals(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of one text; null counts as empty."""
    if not text:
        return 0, 0, 0, 0, 0
    words = text.encode().split()
    chars = len(text) - sum(text.count(c) for c in _SPACES)
    symbols = sum(text.count(c) for c in _SYMBOLS)
    if "\n" in text:
        lines = Counter(line for line in text.split("\n") if line.strip(_SPACES))
        doubled = sum(lines.values()) - len(lines)
    else:
        doubled = 0
    n = len(words)
    repeated = 0
    if n > 3:
        numbers: dict[bytes, int] = {}
        w = np.fromiter((numbers.setdefault(x, len(numbers)) for x in words), np.int64, n)
        size = len(numbers)
        if size < 2_000_000:  # three word numbers fit into 63 bits
            triple = (w[:-2] * size + w[1:-1]) * size + w[2:]
        else:
            pairs = np.unique(w[:-1] * size + w[1:], return_inverse=True)[1]
            triple = pairs[:-1] * size + w[2:]
        order = np.argsort(triple, kind="stable")
        same = triple[order[1:]] == triple[order[:-1]]
        if same.any():
            hit = np.zeros(n, bool)
            twice = np.concatenate([order[1:][same], order[:-1][same]])
            hit[twice] = hit[twice + 1] = hit[twice + 2] = True
            repeated = int(hit.sum())
    return n, chars, symbols, doubled, repeated


def with_signals(docs: DataFrame) -> DataFrame:
    """``docs`` with the columns of ``SIGNALS`` (long) of its ``text``; columns of these names are replaced."""
    kept = docs.drop(*(c for c in docs.columns if c.lower() in SIGNALS))

    def signals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [text_signals(t) for t in batch.column("text").to_pylist()]
            found = [pa.array(c, pa.int64()) for c in zip(*rows)] if rows else [pa.array([], pa.int64())] * len(SIGNALS)
            yield pa.RecordBatch.from_arrays([*batch.columns, *found], [*batch.schema.names, *SIGNALS])

    return kept.mapInArrow(signals, StructType(kept.schema.fields + [StructField(c, LongType()) for c in SIGNALS]))


def base_failed() -> F.Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def upper_bound(wrong: int, n: int, delta: float) -> float:
    """Exact upper confidence bound of a binomial share after ``wrong`` of ``n``."""
    if wrong >= n:
        return 1.0
    k = np.arange(wrong + 1)
    ways = np.array([math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) for i in k])
    low, high = wrong / n, 1.0
    for _ in range(60):
        p = (low + high) / 2
        logs = ways + k * math.log(p) + (n - k) * math.log1p(-p)
        top = logs.max()
        tail = math.exp(top) * np.exp(logs - top).sum()
        low, high = (p, high) if tail > delta else (low, p)
    return high


def least_good(limit: float, delta: float) -> int:
    """The fewest good documents of which none beyond a cutoff certifies it."""
    return math.ceil(math.log(delta) / math.log1p(-limit))


def choose_cutoff(good: np.ndarray, bad: np.ndarray, n_good: int, limit: float, delta: float) -> int:
    """The grid place to use, -1 for none. ``good`` and ``bad``: documents beyond each place, from lenient to strict."""
    best, most = -1, 0
    for i in range(len(good)):
        if upper_bound(int(good[i]), n_good, delta) > limit:
            break
        if bad[i] > most:
            best, most = i, int(bad[i])
    return best


def _place(rule: Rule) -> F.Column:
    """How many cutoffs of the grid reject the row: the strictest ones."""
    top, bottom = 100 * F.col(rule.top), F.col(rule.bottom)
    beyond = [(top < F.lit(c) * bottom) if rule.low else (top > F.lit(c) * bottom) for c in rule.grid]
    return sum((b.cast("int") for b in beyond[1:]), beyond[0].cast("int"))


def fit_cutoffs(signals: DataFrame, labels: DataFrame, stratum: str = "lang", risk: float = 0.02, delta: float = 0.05,
                rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Cutoffs per stratum: stratum, one double column per rule (null: off), n_good, least_good (with fewer all rules are off), rules_on (names).

    ``labels``: doc_id, quality (1 good, 0 bad, null ignored). Documents that the base rules reject are left out, as the method's verdict
    does not touch them. All labelled documents count, each once: label rows that repeat are one label, documents whose labels contradict each other are left
    out, and of several rows with one doc_id the smallest by stratum and places counts. Near copies count as documents of their own, so labels should be drawn
    from a table without them. The grid is fixed beforehand, so all of them are holdout. Only counts by stratum,
    rule and grid place reach the Python step. Null is a stratum of its own. Without labels the table is empty.
    """
    # One label for each document, or the bound would count a document more than once.
    known = labels.where(F.col("quality").isNotNull()).groupBy(F.col("doc_id").alias("label_id")).agg(
        F.min("quality").alias("quality"), F.max("quality").alias("most")).where("(quality >= 1) = (most >= 1)").drop("most")
    row = F.struct(F.col(stratum).alias("stratum"), "quality", *(_place(r).alias(f"p{i}") for i, r in enumerate(rules)))
    marked = signals.where(~base_failed()).join(known, F.col("doc_id") == F.col("label_id")).groupBy("label_id").agg(F.min(row).alias("row")).select("row.*")
    places = F.explode(F.array(*(F.struct(F.lit(i).alias("rule"), F.col(f"p{i}").alias("place")) for i in range(len(rules))))).alias("at")
    counts = marked.select("stratum", "quality", places).groupBy("stratum", "at.rule", "at.place").agg(
        F.sum((F.col("quality") >= 1).cast("long")).alias("good"), F.sum((F.col("quality") < 1).cast("long")).alias("bad"))
    counts = stored(counts.withColumn("stratum", F.col("stratum").cast("string")), "quality-counts")
    tests = len(rules) * counts.select("stratum").distinct().count()

    def choose(rows: pd.DataFrame) -> pd.DataFrame:
        out: dict[str, object] = {"stratum": rows["stratum"].iloc[0]}
        for i, rule in enumerate(rules):
            own, size = rows[rows["rule"] == i], len(rule.grid)
            good, bad = np.zeros(size + 1, np.int64), np.zeros(size + 1, np.int64)
            np.add.at(good, own["place"], own["good"])
            np.add.at(bad, own["place"], own["bad"])
            # A document beyond p cutoffs is beyond the p strictest, the last ones of the grid.
            beyond = [x[::-1].cumsum()[:-1] for x in (good, bad)]
            n = int(good.sum())
            out["n_good"] = n
            at = choose_cutoff(*beyond, n, risk / len(rules), delta / tests) if n else -1
            out[rule.name] = rule.grid[at] if at >= 0 else None
        out["least_good"] = least_good(risk / len(rules), delta / tests)
        out["rules_on"] = [r.name for r in rules if out[r.name] is not None]
        return pd.DataFrame([out])

    schema = f"stratum string, n_good long, {', '.join(f'{r.name} double' for r in rules)}, least_good long, rules_on array<string>"
    return counts.groupBy("stratum").applyInPandas(choose, schema)


def judge(signals: DataFrame, cutoffs: DataFrame, stratum: str = "lang", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``signals`` with base_failed and kept. Strata without cutoffs, and rules that are off, reject nothing beyond the base rules."""
    names = {r.name: fresh(signals.columns, f"cut_{r.name}") for r in rules}
    key = fresh(signals.columns, "cut_stratum")
    cuts = cutoffs.select(F.col("stratum").alias(key), *(F.col(r.name).alias(names[r.name]) for r in rules))
    beyond = F.lit(False)
    for r in rules:
        value, cut = 100 * F.col(r.top), F.col(names[r.name]) * F.col(r.bottom)
        beyond = beyond | F.coalesce(value < cut if r.low else value > cut, F.lit(False))
    joined = signals.join(cuts, signals[stratum].cast("string").eqNullSafe(F.col(key)), "left")
    return joined.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & ~beyond).drop(key, *names.values())


def judged(docs: DataFrame, labels: DataFrame, stratum: str = "lang", **how: object) -> DataFrame:
    """doc_id, the stratum, signals, base_failed and kept of every row of ``docs``. Texts are read once; the signals are stored."""
    found = stored(with_signals(docs.select("doc_id", stratum, "text")).drop("text"), "quality-signals")
    return judge(found, stored(fit_cutoffs(found, labels, stratum, **how), "quality-cutoffs"), stratum)


def kept_documents(docs: DataFrame, labels: DataFrame, stratum: str = "lang", **how: object) -> DataFrame:
    """The rows of ``docs`` that are kept. Signals are computed twice, which costs less than moving every text to its verdict."""
    found = stored(with_signals(docs.select("doc_id", stratum, "text")).drop("text"), "quality-signals")
    cutoffs = stored(fit_cutoffs(found, labels, stratum, **how), "quality-cutoffs")
    # Columns of docs that are named like what is added here step aside.
    added = {*SIGNALS, "base_failed", "kept"}
    aside = {c: fresh([*docs.columns, *added], f"own_{c}") for c in docs.columns if c.lower() in added}
    judged_rows = judge(with_signals(docs.withColumnsRenamed(aside)), cutoffs, stratum).where("kept")
    return judged_rows.select(*(F.col(aside.get(c, c)).alias(c) for c in docs.columns))
