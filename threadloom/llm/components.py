"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm.common import materialise


def components(edges: DataFrame, name: str = "components", max_rounds: int = 60) -> DataFrame:
    """node, root (the smallest node it is linked to) of every node of ``edges`` (a, b).

    Alternating large-star and small-star steps: each node's smallest neighbour is an aggregate with a
    map-side part, and each step is a join on the node, whose larger side Spark can split where a hub's links
    gather. Rounds are logarithmic in practice; each step's edges are written to the shared folder, and the
    rounds end when their number and checksum stay the same.
    """
    seen = lambda df: df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
    links = materialise(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    was = seen(links)
    for _ in range(max_rounds if was[0] else 0):
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))  # larger neighbours to the smallest
        large = materialise(large.distinct(), name)
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").unionByName(least.select("a", F.col("m").alias("b")))
        links = materialise(small.distinct(), name)
        if (now := seen(links)) == was:
            break
        was = now
    else:
        if was[0]:
            raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
