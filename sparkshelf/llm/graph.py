"""Connected components by alternating stars, each round written to the shared checkpoint folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkshelf.checkpoints import cut


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of all nodes of the edges (a, b), with component the smallest node reachable.

    Large-star and small-star steps alternate until the edges no longer change; that takes
    about log(longest path) rounds. Loops and repeated edges change nothing; no edges: no rows.
    """
    e = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    seen = None
    while True:
        # edges are distinct: two sets of one count and equal 128 bits are the same set
        state = e.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64(F.lit(1), "b", "a"))).first()
        if state == seen or not state[0]:
            return e.select(F.col("a").alias("node"), F.col("b").alias("component")).union(e.select(F.col("b").alias("node"), F.col("b").alias("component"))).groupBy("node").agg(F.min("component").alias("component"))
        seen = state
        both = e.union(e.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").union(low.select("a", F.col("m").alias("b")))
        e = cut(small.distinct())
