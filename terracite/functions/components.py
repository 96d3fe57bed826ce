"""Connected components of an edge table, in DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terracite.session import cut


def connected(edges: DataFrame, most_rounds: int = 50) -> DataFrame:
    """The smallest node that each node of an edge table reaches, for nodes that are not the smallest themselves.

    edges: a, b (comparable ids; direction, repeats and self-edges do not matter; rows with a null end are ignored).
    Alternates two steps until nothing changes: every node links its larger neighbours to the smallest node it knows,
    then its smaller neighbours. That ends in one star for each component after a number of rounds that grows with the
    logarithm of its size. Minima are combined before the shuffle, so a node with very many edges is no single task's
    work, and every round is a reliable checkpoint.

    Returns node, root.
    """
    ends = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    stars, seen = cut(ends), None
    for _ in range(most_rounds):
        state = stars.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if state == seen or state["n"] == 0:
            break
        seen = state
        both = stars.unionByName(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        known = large.join(least, "a")
        small = known.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        stars = cut(small.distinct())
    return stars.select(F.col("a").alias("node"), F.col("b").alias("root"))
