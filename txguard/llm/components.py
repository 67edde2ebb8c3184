"""Connected components of a graph of links, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txguard.llm.common import stored


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b") % (1 << 31)).alias("s")).first()
    return row["n"], row["s"]


def components(edges: DataFrame) -> DataFrame:
    """node, component for every node of ``edges`` (a, b: longs) that is not its component's smallest, which is the component.

    Each round joins all neighbours of a node to the smallest of them, first those above the node, then those below; rounds grow with the
    logarithm of the graph, and each is written to the shared folder. A node with very many neighbours stands alone on the other side of
    its joins, where skewed partitions are split; minima are pre-aggregated. Null ends and loops are ignored.
    """
    current = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    state = _state(current)
    while state[0]:
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
        large = both.where("b > a").join(low, "a").where("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(least, "a").where("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
        # Downward edges have a > b; the rest of a node's lower neighbours hang below its smallest.
        joined = small.unionByName(least.select("a", F.col("low").alias("b"))).where("a <> b").select(
            F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        current = stored(joined, "edges")
        new = _state(current)
        if new == state:
            break
        state = new
    return current.select(F.col("a").alias("node"), F.col("b").alias("component"))
