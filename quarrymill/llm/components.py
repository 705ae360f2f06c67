"""Connected components by alternating large-star and small-star steps; nothing but counts reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrymill.scratch import forget, materialize


def _state(edges: DataFrame) -> tuple:
    """What tells two rounds' edges apart: how many, and their hashes combined without a sum that could overflow."""
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Edges (a, b) to (node, root): every node of a component but its smallest, with the smallest.

    Each round points nodes to smaller neighbours' minima; the number of rounds grows with the logarithm of a
    component's size, and each round's edges are written to the shared folder. A hub's rows are reduced to a minimum
    before they are shuffled, and joined by key, where Spark splits skewed partitions.
    """
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now = materialize(now, "edges")
    state = _state(now)
    for _ in range(most_rounds):
        if not state[0]:
            break
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = materialize(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        new = _state(after)
        forget(now)
        now, done, state = after, new == state, new
        if done:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    if state[0]:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
