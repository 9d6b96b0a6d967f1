"""What the operators of this subpackage share: the shared scratch folder and bounded Arrow batches."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A Bloom filter's bits for each hash, about, and how many each sets; its least and most bits (64 MB). A filter at its bound takes
#: more for members: what is checked exactly after it grows, no result changes.
BITS_EACH, BITS_SET, FILTER_LEAST, FILTER_MOST = 16, 4, 1 << 20, 1 << 29
#: Rows in one Arrow batch handed to Python; long texts then stay within a worker's memory.
BATCH_ROWS = 1000


def scratch(spark: SparkSession) -> str:
    """The folder all executors share: the one the cluster names in spark.checkpoint.dir, else (tests) a new one."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="threadloom-"))
    return sc.getCheckpointDir()


def new_path(spark: SparkSession, name: str) -> str:
    return f"{scratch(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it again, so that its lineage ends in files."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bound_batches(spark: SparkSession) -> None:
    """Lowers the session's Arrow batch size to BATCH_ROWS where it is larger."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def bounded_sample(rows: DataFrame, n: int, total: int, seed: str) -> DataFrame:
    """At most ``n`` of the distinct (doc_id, text) of ``rows``, about ``total`` in all: those with the smallest hashes.

    A threshold leaves some 3 n of them, copies meet in an aggregate, and the n smallest are then taken, so
    the bound holds however often an id or a text repeats. One partition.
    """
    h = F.xxhash64("doc_id", "text", F.lit(seed))
    near = rows.withColumn("__h", h).filter(F.pmod("__h", F.lit(1 << 30)) < int(min(1.0, 3 * n / max(1, total)) * (1 << 30)))
    one = near.groupBy("__h").agg(F.min(F.struct(*rows.columns)).alias("__row"))
    return one.orderBy(F.pmod("__h", F.lit(1 << 30)), "__h").limit(n).select("__row.*")


def unit_hash(*parts: Column | str) -> Column:
    """A uniform double in [0, 1) from the md5 of the parts joined by ':'; any SQL engine can compute it."""
    text = F.concat_ws(":", *[p if isinstance(p, Column) else F.lit(p) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def filter_places(hashes: np.ndarray, size: int) -> np.ndarray:
    """Bits of a filter of that many (a power of two), a row for each 64-bit hash."""
    h = hashes.astype(np.uint64)
    first, step = h & np.uint64(0xFFFFFFFF), (h >> np.uint64(32)) | np.uint64(1)
    return ((first[:, None] + np.arange(BITS_SET, dtype=np.uint64) * step[:, None]) & np.uint64(size - 1)).astype(np.int64)


def in_filter(words: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = filter_places(hashes, 64 * len(words))
    return ((words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)).all(axis=1)


def membership(hashes: DataFrame) -> np.ndarray:
    """The filter of ``hashes`` (h long, few repeats; it is read twice), as 64-bit words. The driver holds FILTER_MOST bits at most."""
    size, n = FILTER_LEAST, BITS_EACH * hashes.count()
    while size < min(FILTER_MOST, n):
        size *= 2

    def bits(batches):
        for b in batches:
            at = filter_places(b["h"].to_numpy(dtype=np.int64).view(np.uint64), size).ravel()
            yield pd.DataFrame({"word": at >> 6, "bits": (np.uint64(1) << (at & 63).astype(np.uint64)).view(np.int64)})

    got = hashes.mapInPandas(bits, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toPandas()
    words = np.zeros(size // 64, dtype=np.uint64)
    words[got["word"].to_numpy(dtype=np.int64)] = got["bits"].to_numpy(dtype=np.int64).view(np.uint64)
    return words


def discard(spark: SparkSession, path: str) -> None:
    """Deletes a table of this subpackage's own that nothing reads any more."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
