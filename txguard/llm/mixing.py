"""Mixing sources to target weights by fitting subset sums.

A source's target is first filled with whole passes over it. The rest of its budget goes to a subset of its documents, planned on the
counts of documents by exact length: an equal share of every length, rounded down, then a bounded-knapsack search over the documents left
for what is still missing. Each length's documents are then taken in the order of a seeded hash, so reruns agree and any length is sampled
evenly. Only the plan's counts pass through one task per source; documents are ranked within (source, length, hash bucket), so neither a
hot source nor a large group of copies meets in one task.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from txguard.llm.common import WORD, fresh, stored

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MAX_EPOCHS = 2
# The search covers remainders up to this many words; larger ones are first cut down by whole documents, longest first.
SEARCH_WORDS = 1 << 17
BUCKETS = 4096


def size_of(text: Column) -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def water_fill(sizes: list[int], weights: list[float], total: float, cap: float) -> list[float]:
    """Targets in proportion to the weights, none above ``cap`` times its size, the excess shared again by weight."""
    targets, open_, left = [0.0] * len(sizes), list(range(len(sizes))), total
    while open_:
        unit = left / sum(weights[i] for i in open_)
        full = [i for i in open_ if unit * weights[i] > cap * sizes[i]]
        if not full:
            for i in open_:
                targets[i] = unit * weights[i]
            break
        for i in full:
            targets[i] = cap * sizes[i]
            left -= targets[i]
        open_ = [i for i in open_ if i not in set(full)]
    return targets


def fit_lengths(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each length (1 or more) to take so that the sum comes as near to ``budget`` as the search finds.

    Starts from an equal share of every length; cuts a large remainder down, longest first, down to half of ``SEARCH_WORDS``; then finds the
    sum nearest to what is missing by bounded knapsack over the documents left. Reachable sums are the bits of one number; counts are
    split into powers of two. The documents considered last are the longest, so the walk back prefers short ones.
    """
    take = np.zeros(len(lengths), np.int64)
    total = int((lengths * counts).sum())
    if budget <= 0 or total == 0:
        return take
    if budget >= total:
        return counts.copy()
    take = np.array([int(c) * budget // total for c in counts], np.int64)
    missing = budget - int((lengths * take).sum())
    left = counts - take
    for i in np.argsort(-lengths):
        room = missing - SEARCH_WORDS // 2
        if room <= 0:
            break
        more = min(int(left[i]), room // int(lengths[i]))
        take[i] += more
        left[i] -= more
        missing -= more * int(lengths[i])
    # A sum above what is missing is better only if it is nearer than none at all.
    top = missing + min(missing, int(lengths[left > 0].max())) if (left > 0).any() else missing
    mask = (1 << (top + 1)) - 1
    reach, steps = 1, []
    for i in np.argsort(lengths):
        rest, part = min(int(left[i]), top // int(lengths[i])), 1
        while rest > 0 and not reach >> missing & 1:
            n = min(part, rest)
            grown = (reach | reach << (n * int(lengths[i]))) & mask
            if grown != reach:
                steps.append((i, n, reach))
                reach = grown
            rest -= n
            part *= 2
    below = (reach & ((1 << (missing + 1)) - 1)).bit_length() - 1
    above = reach >> (missing + 1)
    up = missing + 1 + ((above & -above).bit_length() - 1) if above else None
    at = up if up is not None and up - missing < missing - below else below
    for i, n, before in reversed(steps):
        if not before >> at & 1:
            take[i] += n
            at -= n * int(lengths[i])
    return take


def source_targets(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = MAX_EPOCHS) -> DataFrame:
    """source, source_size, target. Sources by code point, nulls last, take the weights in turn. One row per source meets in one task."""
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))

    def fill(rows: pd.DataFrame) -> pd.DataFrame:
        names = [None if pd.isna(s) else s for s in rows["source"]]
        order = sorted(range(len(names)), key=lambda i: (names[i] is None, (names[i] or "").encode()))
        sizes = [int(rows["source_size"].iloc[i]) for i in order]
        found = water_fill(sizes, [weights[k % len(weights)] for k in range(len(order))], share * sum(sizes), cap)
        return pd.DataFrame({"source": [names[i] for i in order], "source_size": sizes, "target": found})

    return sums.withColumn("every", F.lit(0)).groupBy("every").applyInPandas(fill, "source string, source_size long, target double")


def mix(docs: DataFrame, seed: int = 0, **how: object) -> DataFrame:
    """How often each document is taken: doc_id, text_hash, source, size, source_size, target, taken (words), copies. One row per row.

    Null text has size 0, and documents of size 0 are never taken. Null is a source of its own. Repeated rows count as documents of their own; which of several identical rows is taken is open, but not
    how many. Other columns are ignored. An empty table gives no rows.
    """
    # A key without nulls, so that joins and windows share one partitioning.
    key = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")).alias("key")
    sized = stored(docs.select("doc_id", key, F.col("source").cast("string").alias("source"), size_of(F.col("text")).alias("size"),
                               _hash(docs, seed).alias("text_hash")), "mixing-sizes")
    targets = stored(source_targets(sized, **how), "mixing-targets")
    goal = targets.select(F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")).alias("key"), "source_size", "target")
    bucketed = sized.where("size > 0").withColumn("bucket", F.pmod(F.shiftrightunsigned("text_hash", 40), F.lit(BUCKETS)))
    counts = bucketed.groupBy("key", "size", "bucket").agg(F.count(F.lit(1)).alias("n"))

    def plan(rows: pd.DataFrame) -> pd.DataFrame:
        whole, target = int(rows["source_size"].iloc[0]), float(rows["target"].iloc[0])
        passes = int(target // whole)
        lengths = rows["size"].to_numpy(np.int64)
        take = fit_lengths(lengths, rows["n"].to_numpy(np.int64), round(target) - passes * whole)
        return pd.DataFrame({"key": rows["key"], "size": lengths, "passes": passes, "take": take})

    lengths = counts.groupBy("key", "size").agg(F.sum("n").alias("n"))
    planned = lengths.join(goal, "key").groupBy("key").applyInPandas(plan, "key string, size long, passes long, take long")
    before = Window.partitionBy("key", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    quota = F.col("take") - F.coalesce(F.sum("n").over(before), F.lit(0))
    quotas = counts.join(planned, ["key", "size"]).select("key", "size", "bucket", "passes", quota.alias("quota"))
    # Rows of a hot source or length spread over the buckets, here and in the window.
    place = F.row_number().over(Window.partitionBy("key", "size", "bucket").orderBy("text_hash", "doc_id"))
    chosen = bucketed.withColumn("place", place).join(quotas, ["key", "size", "bucket"])
    columns = ["doc_id", "text_hash", "key", "source", "size"]
    copies = F.col("passes") + (F.col("place") <= F.col("quota")).cast("long")
    taken = chosen.select(*columns, copies.alias("copies")).unionByName(
        sized.where("size = 0").select(*columns, F.lit(0).cast("long").alias("copies")))
    return taken.join(goal, "key").select(
        "doc_id", "text_hash", "source", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


def _hash(docs: DataFrame, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), docs["doc_id"], docs["text"])


def mixed_documents(docs: DataFrame, seed: int = 0, **how: object) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it. Of identical rows, as many as chosen are taken once more than the rest."""
    key, least, more, number = (fresh(docs.columns, n) for n in ("mix_hash", "mix_least", "mix_more", "mix_number"))
    # Copies of identical rows differ by one at most.
    chosen = mix(docs, seed, **how).groupBy(F.col("text_hash").alias(key)).agg(
        F.min("copies").alias(least), (F.sum("copies") - F.count(F.lit(1)) * F.min("copies")).alias(more))
    joined = docs.withColumn(key, _hash(docs, seed)).join(chosen, key)
    numbered = joined.withColumn(number, F.row_number().over(Window.partitionBy(key).orderBy(key)))
    times = (F.col(least) + (F.col(number) <= F.col(more)).cast("long")).cast("int")
    return numbered.withColumn(number, F.explode(F.array_repeat(F.lit(1), times))).select(*docs.columns)
