"""Sources: raw message files, and the views the queries read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadloom.functions.text import flag, whole_number

#: The columns of a raw message file.
RAW_COLUMNS = ("tweet_id", "author_id", "inbound", "created_at", "text", "response_tweet_id", "in_response_to_tweet_id")
RAW_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in RAW_COLUMNS])
EPOCH = 1704067200


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_raw_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text; only an empty field is null; a row that doesn't parse goes to _corrupt_record."""
    schema = T.StructType([*RAW_SCHEMA, T.StructField("_corrupt_record", T.StringType())])
    return spark.read.csv(path, schema=schema, header=True, multiLine=True, escape='"', nullValue="", emptyValue="", mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt_record")


def typed(raw: DataFrame) -> DataFrame:
    """Numbers, flags and times from a raw message file: ids without a number are -1, times that don't parse null."""
    stamp = F.regexp_replace("created_at", "^[A-Za-z]{3} ", "")
    when = F.coalesce(F.try_to_timestamp("created_at"), F.try_to_timestamp(stamp, F.lit("MMM dd HH:mm:ss Z yyyy")))
    return raw.select(
        F.coalesce(whole_number(F.col("tweet_id")), F.lit(-1)).alias("tweet_id"), F.coalesce(whole_number(F.col("in_response_to_tweet_id")), F.lit(-1)).alias("parent_id"),
        F.coalesce("author_id", F.lit("")).alias("author"), flag(F.col("inbound")).alias("inbound"), F.unix_seconds(when).alias("created_s"), F.coalesce("text", F.lit("")).alias("text"),
    )


def schema_check(found: T.StructType, expected: T.StructType = RAW_SCHEMA) -> list[tuple[str, str]]:
    """(column, ok | missing | extra | type), in the expected order, extra ones last by name."""
    have = {f.name: f.dataType for f in found}
    want = {f.name: f.dataType for f in expected}
    out = [(c, "missing" if c not in have else "ok" if have[c] == t else "type") for c, t in want.items()]
    return out + [(c, "extra") for c in sorted(set(have) - set(want))]


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as messages: each turn answers the one before; assistants and systems are two brands."""
    c = table(spark, sf_dir, "conversations")
    tid = F.col("conv_id") * 100 + F.col("turn")
    return c.select(
        tid.alias("tweet_id"), F.lag(tid).over(W.partitionBy("conv_id").orderBy("turn")).alias("parent_id"), (F.col("role") == "user").alias("inbound"),
        F.when(F.col("role") == "user", F.concat(F.lit("u"), F.col("conv_id"))).otherwise(F.col("role")).alias("author"),
        (F.lit(EPOCH) + F.col("conv_id") * 3600 + F.col("turn") * 60).alias("created_s"), "text",
    )


def sessions(spark: SparkSession, sf_dir: str, gap_s: int = 12 * 3600) -> DataFrame:
    """Events with their session: a new one for each user after a gap."""
    by_user = W.partitionBy("user_id").orderBy("s", "event_id")
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", F.unix_seconds(F.col("ts").cast("timestamp")).alias("s"))
    new = F.when(F.col("s") - F.lag("s").over(by_user) > gap_s, 1).otherwise(0)
    return e.withColumn("new", new).withColumn("k", F.sum("new").over(by_user)).withColumn("session_id", F.col("user_id") * 100000 + F.col("k")).drop("new", "k")


def gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents with a gold class of four, and a predicted one by a fixed rule, with its confidence."""
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    pred = F.when(F.col("n_chars") % 7 == 0, (F.col("quality") * 2 + F.col("toxic") + 1) % 4).when(F.col("lang") == "es", F.lit(2)).otherwise(F.col("quality") * 2 + F.col("toxic"))
    conf = F.round((F.col("n_chars") % 101) / 100.0, 2)
    return d.select("doc_id", "lang", (F.col("quality") * 2 + F.col("toxic")).alias("gold"), pred.alias("pred"), conf.alias("conf"), (F.col("toxic") == 1).alias("gold_escalate"), (F.col("n_chars") % 5 == 0).alias("pred_escalate"), "n_chars")


def first_rows(rows: DataFrame, n: int, *by: str) -> DataFrame:
    """The first ``n`` rows in that order, so that a limited scan gives the same rows each time."""
    return rows.orderBy(*by).limit(n)
