"""Connected components by alternating stars: every step is a grouped minimum and a join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaywise.sources.scratch import discard, materialise


def totals(e: DataFrame):
    """Number of edges (u, v) and a sum of their hashes, of any size: 64 bits would pass their end at some 17 million edges."""
    return e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").bitwiseAND(F.lit((1 << 40) - 1)).cast("decimal(20,0)"))).first()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``node``, ``component`` (the least node reachable) for every node of ``edges`` (a, b).

    Alternating large-star and small-star steps; every second round is written to shared storage and the one before deleted, and the
    driver sees counts only. Nodes with many neighbours are met by grouped minima, which combine before they shuffle.
    """
    edges = materialise(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")

    def star(e: DataFrame) -> DataFrame:
        """One large star and one small star."""
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # large star: neighbours above a node go to the least of its neighbourhood
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: a node and its neighbours below go to the least of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        return small.union(low.select("u", F.col("m").alias("v"))).distinct()

    state = totals(edges)
    for _ in range(rounds):
        if not state[0]:
            break
        last, edges = edges, materialise(star(star(edges)), "edges")  # two rounds between writes
        discard(last)
        now = totals(edges)
        if now == state:
            break
        state = now
    else:
        raise RuntimeError("components didn't settle")
    own = edges.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
    return own.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
