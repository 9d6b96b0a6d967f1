"""Question and answer exchanges, their signals, and splits by time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from threadloom.functions import text as X
from threadloom.operators.ranks import quantiles
from threadloom.session import settle


def exchanges(msgs: DataFrame) -> DataFrame:
    """Each inbound message with its outbound replies, in order of time: texts joined by blanks, ids by commas."""
    order = F.array_sort(F.collect_list(F.struct("created_s", "tweet_id", "text")))
    replies = msgs.filter("not inbound").groupBy(F.col("parent_id").alias("tweet_id")).agg(order.alias("r"))
    replies = replies.select(
        "tweet_id", F.array_join(F.transform("r", lambda x: x["text"]), " ").alias("reply_text"), F.array_join(F.transform("r", lambda x: x["tweet_id"].cast("string")), ",").alias("reply_ids"),
        F.col("r")[0]["created_s"].alias("first_reply_s"), F.size("r").cast("long").alias("n_replies"),
    )
    asked = msgs.filter("inbound").filter(F.length(X.normalise(F.col("text"))) > 0)
    return asked.join(replies, "tweet_id").select("tweet_id", "root_id", "depth", "created_s", F.col("text").alias("customer_text"), "reply_text", "reply_ids", "first_reply_s", "n_replies")


def signals(ex: DataFrame, msgs: DataFrame, deflect: str = X.DEFLECT, thanks: str = X.THANKS) -> DataFrame:
    """Words of the reply, deflections, the conversation's depth, whether the customer thanked later, whether it opens the thread.

    "Later" compares the conversation's last thanks with the message: one aggregate a conversation, no pairs.
    """
    per = msgs.groupBy("root_id").agg(F.max("depth").alias("conv_max_depth"), F.max(F.when(F.col("inbound") & X.has(F.col("text"), thanks), F.col("created_s"))).alias("last_thanks"))
    words, deflects = X.word_count(F.col("reply_text")).cast("long"), X.has(F.col("reply_text"), deflect)
    out = ex.join(per, "root_id", "left")
    return out.select(
        "tweet_id", "root_id", words.alias("reply_words"), deflects.alias("is_deflection"), (deflects & (words <= 25)).alias("deflection_only"), "conv_max_depth",
        F.coalesce(F.col("last_thanks") > F.col("created_s"), F.lit(False)).alias("thanked_after"), (F.col("depth") == 0).alias("opens_thread"), "created_s",
    )


def rates(sig: DataFrame) -> DataFrame:
    pct = lambda c: F.round(100.0 * F.avg(F.col(c).cast("double")), 6)
    return sig.agg(F.count(F.lit(1)).alias("n"), pct("is_deflection").alias("deflection_pct"), pct("deflection_only").alias("deflection_only_pct"), pct("thanked_after").alias("thanked_after_pct"), F.round(F.avg("reply_words"), 6).alias("mean_reply_words"))


def spans(events: DataFrame, key: str, at: str) -> DataFrame:
    return events.groupBy(key).agg(F.min(at).alias("lo"), F.max(at).alias("hi"), F.count(F.lit(1)).alias("n_rows"))


def split_by_time(spanned: DataFrame, first: float = 0.7, second: float = 0.9) -> DataFrame:
    """history, dev, gold_pool, or straddler, by quantiles of the starts; one that reaches over a cut is a straddler."""
    spanned = settle(spanned, "spans")
    t1, t2 = quantiles(spanned, "lo", [first, second])
    where = F.when(F.col("hi") < t1, "history").when((F.col("lo") >= t1) & (F.col("hi") < t2), "dev").when(F.col("lo") >= t2, "gold_pool").otherwise("straddler")
    return spanned.withColumns({"t1": F.lit(t1).cast("double"), "t2": F.lit(t2).cast("double"), "split": where})


def keep_first(docs: DataFrame, key: str, *order: str) -> DataFrame:
    return docs.withColumn("__k", F.row_number().over(W.partitionBy(key).orderBy(*order))).filter("__k = 1").drop("__k")


def keep_last(docs: DataFrame, key: str, *order: str) -> DataFrame:
    return docs.withColumn("__k", F.row_number().over(W.partitionBy(key).orderBy(*[F.desc(c) for c in order]))).filter("__k = 1").drop("__k")


def dedupe_and_twins(docs: DataFrame, text: str, key: str) -> DataFrame:
    """key, split, has_twin: the smallest key of each text in its split, and whether the history has the same text. ``text`` may be a digest."""
    one = docs.groupBy("split", text).agg(F.min(key).alias(key))
    older = one.filter("split = 'history'").select(text, F.lit(True).alias("__twin"))
    return one.join(older, text, "left").select(key, "split", ((F.col("split") != "history") & F.coalesce("__twin", F.lit(False))).alias("has_twin"))
