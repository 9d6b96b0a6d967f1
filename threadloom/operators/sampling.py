"""Seeded samples: by hash, so that any engine draws the same rows in any partitioning."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from threadloom.functions.text import bucket
from threadloom.session import settle


def sample(rows: DataFrame, key: str, n: int, seed: str) -> DataFrame:
    """n rows without replacement: those with the smallest hashes."""
    return rows.withColumn("__h", bucket(F.col(key).cast("string"), seed)).orderBy("__h", key).limit(n).drop("__h")


def allocate(rows: DataFrame, group: str, total: int) -> DataFrame:
    """group, size, quota (size's share of ``total``, halves to even), rare (size at most the median size)."""
    sizes = rows.groupBy(group).agg(F.count(F.lit(1)).alias("size"))
    all_ = sizes.agg(F.sum("size").alias("__n"), F.percentile("size", F.lit(0.5)).alias("__m"))
    return sizes.crossJoin(F.broadcast(all_)).select(group, "size", F.bround(F.col("size") / F.col("__n") * total).cast("int").alias("quota"), (F.col("size") <= F.col("__m")).alias("rare"))


def stratified(rows: DataFrame, key: str, group: str, strata: list[tuple[str, int, Column]], core: int, total: int, seed: str) -> DataFrame:
    """key, stratum, weight (1 / rows of the stratum): a core in proportion to the groups, then each stratum's quota, then a top-up.

    A row is drawn once: each step takes from what the earlier ones left.
    """
    quotas = allocate(rows, group, core)
    pool = settle(rows.join(quotas, group).withColumn("__h", bucket(F.col(key).cast("string"), seed)), "pool")
    order = W.partitionBy(group).orderBy("__h", key)
    taken = [settle(pool.withColumn("__k", F.row_number().over(order)).filter((F.col("__k") <= core) & (F.col("__k") <= F.col("quota"))).select(key, F.lit("core").alias("stratum")), "drawn")]
    for name, n, wanted in strata:
        left = pool.join(reduce(DataFrame.unionByName, taken).select(key), key, "left_anti").filter(wanted)
        taken.append(settle(left.orderBy("__h", key).limit(n).select(key, F.lit(name).alias("stratum")), "drawn"))
    drawn = reduce(DataFrame.unionByName, taken)
    left = pool.join(drawn.select(key), key, "left_anti").orderBy("__h", key).limit(max(0, total - drawn.count())).select(key, F.lit("topup").alias("stratum"))
    return drawn.unionByName(left).withColumn("weight", F.round(1.0 / F.count(F.lit(1)).over(W.partitionBy("stratum")), 6))
