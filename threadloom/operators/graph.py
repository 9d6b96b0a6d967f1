"""Reply graphs: parents, roots, exact depths, cycles."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from threadloom.operators.ranks import quantiles
from threadloom.session import settle

MAX_DEPTH = 1000


def resolve_parents(msgs: DataFrame) -> DataFrame:
    """id, parent (its own id for a root), orphan. Of repeated ids the first row (by time) counts; a parent that is not there makes a root."""
    first = W.partitionBy("tweet_id").orderBy(F.col("created_s").asc_nulls_last(), F.col("parent_id").asc_nulls_last())
    one = msgs.select("tweet_id", "parent_id", "created_s").withColumn("k", F.row_number().over(first)).filter("k = 1").drop("k", "created_s")
    known = one.select(F.col("tweet_id").alias("parent_id"), F.lit(True).alias("there"))
    joined = one.join(known, "parent_id", "left")
    return joined.select(F.col("tweet_id").alias("id"), F.when(F.col("there"), F.col("parent_id")).otherwise(F.col("tweet_id")).alias("parent"), (F.col("parent_id").isNotNull() & F.col("there").isNull()).alias("orphan"))


def thread_depths(parents: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    """id, root_id, depth. Pointers are doubled and carry their distance, so depths are exact after log2 rounds.

    Only messages whose pointer is not yet a root take part in a round. What is left after enough rounds
    for ``max_depth`` edges is on or behind a cycle, or deeper: depth -1, root the smallest id reached.
    """
    nodes = settle(parents.select("id", "parent"), "parents")
    done = nodes.filter("id = parent").select("id", F.col("id").alias("root_id"), F.lit(0).cast("long").alias("depth"))
    active = nodes.filter("id <> parent").select("id", F.col("parent").alias("at"), F.lit(1).cast("long").alias("steps"))
    reached = done
    for _ in range(math.ceil(math.log2(max_depth)) + 1):
        # A pointer that has come to a message whose root is known is finished. Only what the last round finished
        # (roots at first) can be new to it: had an older one been its target, it would have ended before.
        moved = settle(active.join(reached.select(F.col("id").alias("at"), "root_id", "depth"), "at", "left"), "moved")
        reached = moved.filter("root_id is not null").select("id", "root_id", (F.col("steps") + F.col("depth")).alias("depth"))
        left = moved.filter("root_id is null").select("id", "at", "steps")
        jump = left.select(F.col("id").alias("at"), F.col("at").alias("next"), F.col("steps").alias("more"))
        # A pointer whose own target was finished in this round waits for the next one.
        ahead = left.join(jump, "at", "left").select("id", F.coalesce("next", "at").alias("at"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"))
        active = settle(ahead, "active")
        done = done.unionByName(reached)
        if active.isEmpty():
            break
    lost = active.groupBy("id").agg(F.min("at").alias("root_id"), F.lit(-1).cast("long").alias("depth"))
    deep = F.when(F.col("depth") >= max_depth, -1).otherwise(F.col("depth")).cast("long")
    return done.withColumn("depth", deep).unionByName(lost)


def thread_stats(parents: DataFrame, depths: DataFrame) -> DataFrame:
    """One row: replies, resolvable, orphans, conversations, cycles, depth and size figures."""
    replies = parents.agg(F.count(F.lit(1)).alias("n_messages"), F.count_if("orphan").alias("n_orphans"), F.count_if(F.col("id") != F.col("parent")).alias("n_resolved"))
    depth = depths.agg(F.count_if(F.expr("depth < 0")).alias("n_cycle"), F.max("depth").alias("max_depth"), F.round(F.avg(F.when(F.col("depth") >= 0, F.col("depth"))), 6).alias("mean_depth"))
    sizes = settle(depths.filter("depth >= 0").groupBy("root_id").agg(F.count(F.lit(1)).alias("n")), "sizes")
    (median,) = quantiles(sizes, "n", [0.5])
    size = sizes.agg(F.count(F.lit(1)).alias("n_conversations"), F.round(F.avg("n"), 6).alias("mean_size"), F.lit(median).cast("double").alias("median_size"), F.max("n").alias("max_size"))
    out = replies.crossJoin(depth).crossJoin(size)  # one row each
    return out.withColumn("orphan_rate", F.round(F.col("n_orphans") / F.greatest(F.col("n_orphans") + F.col("n_resolved"), F.lit(1)), 6))
