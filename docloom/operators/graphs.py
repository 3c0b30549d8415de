"""Connected components over DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import saved


def components(links: DataFrame, rounds: int = 50) -> DataFrame:
    """(node, root) of all nodes of ``links`` (a, b, of any one type): root is the least node in reach.

    Every node points to the least node it knows. A round tells each pointed-to node the least pointer among the neighbours of all that point to it, and then every node points to where its pointer points, so paths halve
    and rounds grow with the logarithm of the longest. Minima are combined before they are shuffled, and joined by shuffles, never through the driver; every round writes the pointers, one row a node.
    """
    both = saved(links.filter("a <> b").select("a", "b").union(links.filter("a <> b").select("b", "a")).distinct())
    now = saved(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root")))
    before = None
    for _ in range(rounds):
        mark = now.agg(F.count("*"), F.bit_xor(F.xxhash64("node", "root"))).first()
        if mark == before:
            return now
        before = mark
        seen = both.join(now.select(F.col("node").alias("b"), F.col("root").alias("seen")).hint("shuffle_merge"), "b").groupBy("a").agg(F.min("seen").alias("seen"))
        told = now.join(seen.withColumnRenamed("a", "node").hint("shuffle_merge"), "node")
        hooks = told.groupBy("root").agg(F.min("seen").alias("hook")).select(F.col("root").alias("node"), "hook")
        nearer = saved(told.join(hooks.hint("shuffle_merge"), "node", "left").select("node", F.least("root", "seen", F.coalesce("hook", "root")).alias("root")))
        up = nearer.select(F.col("node").alias("root"), F.col("root").alias("above"))
        now = saved(nearer.join(up.hint("shuffle_merge"), "root").select("node", F.least("root", "above").alias("root")))
    raise RuntimeError(f"pointers still change after {rounds} rounds")
