"""Connected components of an edge table by alternating large-star and small-star steps.

Labels stay in distributed tables: each step is one aggregate and one join, cut by a reliable
checkpoint, and the driver only compares a count and a hash. Hubs are pre-aggregated before the
exchange, and the least neighbours are tables of their own, so that adaptive execution can split
the joins at a hub.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollmill.llm.cluster import checkpointed


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = checkpointed(both.groupBy("a").agg(F.min("b").alias("m"))).select("a", F.least("a", "m").alias("m"))
    return both.join(least, "a").where("b > a and b <> m").select(F.col("m").alias("a"), "b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    # here each edge has a < b; b's neighbours below it are tied to the least of them
    least = checkpointed(edges.groupBy("b").agg(F.min("a").alias("m")))
    tied = edges.join(least, "b").where("a <> m").select("a", "m").unionAll(least.select(F.col("b").alias("a"), "m"))
    return tied.select(F.least("a", "m").alias("a"), F.greatest("a", "m").alias("b")).where("a <> b").distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node, component (its least node) of every node of edges (a, b) of longs."""
    edges = checkpointed(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct())
    state = None
    for _ in range(rounds):
        edges = checkpointed(_small_star(_large_star(edges)))
        now = tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())
        if now == state:
            break
        state = now
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("b").alias("node"), F.col("a").alias("component")).unionAll(edges.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
