"""Mixing sources to target weights by Poisson replication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.llm.common import unit_hash

SEED = "mix-1"
#: A mean above this is a sum of equal smaller means, each inverted on its own hash.
PART_MEAN = 16.0

#: The table of sources is broadcast up to these sizes, which are counted first; a larger one meets the documents by an exchange.
BROADCAST_ROWS, BROADCAST_BYTES = 50_000, 4_000_000
#: Parts that the documents of a source are dealt in for that exchange.
SALTS = 32


def poisson(mean: Column, key: Column, seed: str = SEED) -> Column:
    """Poisson counts by inverting the distribution at uniforms hashed from ``key``.

    An inversion runs 12 deviations and 24 terms past the mean, where less is left than a double can show.
    """
    parts = F.greatest(F.lit(1), F.ceil(mean / PART_MEAN)).cast("int")
    each = mean / parts

    terms = F.ceil(each + 12 * F.sqrt(each) + 24).cast("int")

    def invert(total: Column, i: Column) -> Column:
        start = F.struct(F.exp(-each).alias("p"), F.exp(-each).alias("cdf"), F.lit(0).alias("n"), unit_hash(key, i.cast("string"), seed).alias("u"))

        def step(s: Column, k: Column) -> Column:
            p = s["p"] * each / k
            more = s["u"] >= s["cdf"]
            return F.struct(p.alias("p"), F.when(more, s["cdf"] + p).otherwise(s["cdf"]).alias("cdf"), F.when(more, s["n"] + 1).otherwise(s["n"]).alias("n"), s["u"].alias("u"))

        return total + F.aggregate(F.sequence(F.lit(1), terms), start, step, lambda s: s["n"])

    return F.when(mean > 0, F.aggregate(F.sequence(F.lit(1), parts), F.lit(0), invert)).otherwise(F.lit(0))


def repetition_rates(docs: DataFrame, weights: dict[str | None, float] | None = None, temperature: float = 0.5, size: float = 1.0) -> DataFrame:
    """source, mean copies of its documents: target share x size x all documents / its documents.

    ``weights`` are target shares by source (a source without one gets none); by default they follow the
    sources' own sizes to the power ``temperature``. One row a source.
    """
    n = docs.groupBy(F.col("source").alias("__source")).agg(F.count(F.lit(1)).cast("double").alias("__n"))
    if weights is None:
        n = n.withColumn("__w", F.pow("__n", F.lit(temperature)))
    else:
        w = F.lit(0.0)
        for source, value in weights.items():
            w = F.when(F.col("__source").eqNullSafe(F.lit(source)), F.lit(float(value))).otherwise(w)
        n = n.withColumn("__w", w)
    total = n.agg(F.sum("__n").alias("__docs"), F.sum("__w").alias("__sum"))
    return n.crossJoin(F.broadcast(total)).select("__source", F.when(F.col("__sum") > 0, F.col("__w") / F.col("__sum") * F.col("__docs") * size / F.col("__n")).otherwise(0.0).alias("__mean"))


def mix_sources(docs: DataFrame, weights: dict[str | None, float] | None = None, temperature: float = 0.5, size: float = 1.0, seed: str = SEED, shuffle: bool = True) -> DataFrame:
    """The rows of ``docs``, each as often as its Poisson count says, with ``copy_no`` (from 0) and ``mix_key``.

    The count comes from doc_id alone, so repeated rows get equal counts and a retry gives the same rows.
    With ``shuffle`` the copies are dealt over all partitions by their hash and sorted by it within each, a
    global shuffle in one exchange. A null source is a source of its own; a null doc_id counts as the text
    'null'; empty tables give empty results, very long texts are moved whole. Columns of the input with the names copy_no, mix_key are
    replaced, all others are carried along, whatever their names.
    """
    docs = docs.drop("copy_no", "mix_key")
    rates = repetition_rates(docs, weights, temperature, size)
    n, size_bytes = rates.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("__source") + 16), F.lit(0))).first()
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    # A row is one column from here on, so that its names clash with none.
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), key.alias("key"), F.col("source").alias("of"), F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).alias("salt"))
    same = F.col("of").eqNullSafe(F.col("__source"))
    if n <= BROADCAST_ROWS and size_bytes <= BROADCAST_BYTES:
        rated = rows.join(F.broadcast(rates), same, "left")
    else:
        salted = rates.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rated = rows.join(salted, same & (F.col("salt") == F.col("__salt")), "left")
    counted = rated.select("row", "key", poisson(F.col("__mean"), F.col("key"), seed).alias("copies")).filter("copies > 0")
    out = counted.select("row", "key", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy_no"))
    out = out.select("row.*", "copy_no", F.md5(F.concat_ws(":", "key", F.col("copy_no").cast("string"), F.lit(seed), F.lit("order"))).alias("mix_key"))
    return out.repartition(F.col("mix_key")).sortWithinPartitions("mix_key") if shuffle else out
