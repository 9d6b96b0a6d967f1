"""Quality, author and brand profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.functions import text as X


def text_quality(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row of counters over a text column."""
    t = F.coalesce(F.col(text), F.lit(""))
    bare = X.squeeze(t)
    n = lambda c, name: F.count_if(c).alias(name)
    return docs.agg(
        F.count(F.lit(1)).alias("n_rows"), n(F.col(text).isNull(), "n_null"), n(bare == "", "n_empty"), n(F.length(bare) < 5, "n_short"), n(t.rlike(r"[^\x00-\x7F]"), "n_non_ascii"),
        n(F.lower(t).rlike(X.URL), "n_url"), n(F.lower(t).rlike(X.MENTION), "n_mention"), n(F.lower(t).rlike(X.MASK), "n_masked"), n(X.normalise(F.col(text)) == "", "n_url_or_mention_only"),
        F.min(F.length(t)).cast("long").alias("min_chars"), F.max(F.length(t)).cast("long").alias("max_chars"),
    )


def duplicates(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """One row: repeated ids, normalised texts seen more than once, rows they hold."""
    ids = docs.agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct(key).alias("n_ids"))
    norm = docs.groupBy(F.md5(X.normalise(F.col(text))).alias("norm")).agg(F.count(F.lit(1)).alias("n")).agg(F.count(F.lit(1)).alias("n_texts"), F.count_if(F.expr("n > 1")).alias("n_repeated_texts"), F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("n_rows_repeated"))
    return ids.crossJoin(norm).withColumn("n_repeated_ids", F.col("n_rows") - F.col("n_ids"))


def authors(msgs: DataFrame) -> DataFrame:
    """Per outbound author: messages, deflections (loose: any; strict: at most 25 words), sizes, first and last seen."""
    words = X.word_count(F.col("text"))
    deflects = X.has(F.col("text"), X.DEFLECT)
    return msgs.filter("not inbound").groupBy("author").agg(
        F.count(F.lit(1)).alias("n_outbound"), F.count_if(deflects).alias("n_deflect"), F.count_if(deflects & (words <= 25)).alias("n_deflect_strict"), F.sum(F.length("text")).cast("long").alias("n_chars"),
        F.sum(words).cast("long").alias("n_words"), F.min("created_s").alias("first_s"), F.max("created_s").alias("last_s"),
    )


def role_summary(msgs: DataFrame) -> DataFrame:
    deflects = X.has(F.col("text"), X.DEFLECT) & (X.word_count(F.col("text")) <= 25)
    out = ~F.col("inbound")
    return msgs.agg(
        F.count_if("inbound").alias("n_inbound"), F.count_if(out).alias("n_outbound"), F.round(F.avg(F.col("inbound").cast("double")), 6).alias("inbound_share"),
        F.count_distinct(F.when(out, F.col("author"))).alias("n_brands"), F.count_distinct(F.when(out & ~F.col("author").rlike("^[0-9]+$"), F.col("author"))).alias("n_named_brands"),
        F.round(F.coalesce(F.avg(F.when(out, deflects.cast("double"))), F.lit(0.0)), 6).alias("strict_deflect_rate"),
    )


def attribution(msgs: DataFrame) -> DataFrame:
    """Per conversation: its brands, and the brand where there is exactly one."""
    brands = msgs.filter("not inbound").groupBy("root_id").agg(F.count_distinct("author").alias("n_brands"), F.min("author").alias("one"))
    return brands.select("root_id", "n_brands", F.when(F.col("n_brands") == 1, F.col("one")).alias("brand"))


def conversations(msgs: DataFrame) -> DataFrame:
    """Per conversation: messages, inbound ones, distinct authors, greatest depth, span."""
    return msgs.groupBy("root_id").agg(F.count(F.lit(1)).alias("n_messages"), F.count_if("inbound").alias("n_inbound"), F.count_distinct("author").alias("n_authors"), F.max("depth").alias("max_depth"), F.min("created_s").alias("start_s"), F.max("created_s").alias("end_s"))


def brands(msgs: DataFrame) -> DataFrame:
    """Per brand: outbound messages, conversations that are its own, their inbound messages, multi-turn share, conversations shared with others."""
    conv, own = conversations(msgs), attribution(msgs)
    single = own.filter("brand is not null").join(conv, "root_id").groupBy(F.col("brand").alias("author")).agg(
        F.count(F.lit(1)).alias("n_own"), F.sum("n_inbound").alias("n_inbound"), F.count_if(F.expr("n_messages > 2")).alias("n_multi_turn"), F.round(F.avg("n_messages"), 6).alias("mean_size"), F.min("start_s").alias("first_s"), F.max("end_s").alias("last_s"))
    shared = msgs.filter("not inbound").select("root_id", "author").distinct().join(own.filter("n_brands > 1").select("root_id"), "root_id", "left_semi").groupBy("author").agg(F.count(F.lit(1)).alias("n_shared"))
    a = authors(msgs).select("author", "n_outbound", "n_deflect", "n_words")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return a.join(single, "author", "left").join(shared, "author", "left").select(
        "author", "n_outbound", zero("n_own"), zero("n_inbound"), zero("n_shared"), F.round(100.0 * F.col("n_deflect") / F.col("n_outbound"), 6).alias("deflect_pct"),
        F.round(F.col("n_words") / F.col("n_outbound"), 6).alias("mean_words"), F.round(100.0 * F.coalesce(F.col("n_multi_turn") / F.col("n_own"), F.lit(0.0)), 6).alias("multi_turn_pct"), F.coalesce("mean_size", F.lit(0.0)).alias("mean_size"),
        F.round(F.coalesce((F.col("last_s") - F.col("first_s")) / 86400.0, F.lit(0.0)), 6).alias("span_days"),
    )


def rank_brands(table: DataFrame, least_inbound: int, least_own: int, least_multi_pct: float, least_days: float) -> DataFrame:
    """The brands that pass all gates, ranked by the share of replies that do not deflect: one task sorts a row a brand, nothing else."""
    passed = table.filter((F.col("n_inbound") >= least_inbound) & (F.col("n_own") >= least_own) & (F.col("multi_turn_pct") >= least_multi_pct) & (F.col("span_days") >= least_days))
    from pyspark.sql import Window as W

    return passed.select("author", F.round(100.0 - F.col("deflect_pct"), 6).alias("score"), F.rank().over(W.orderBy(F.desc(F.round(100.0 - F.col("deflect_pct"), 6)))).alias("rank"))


def brand_profile(msgs: DataFrame) -> DataFrame:
    """Per outbound author: rates of both kinds of deflection, words a reply, its own conversations (one brand) and their inbound messages,
    multi-turn ones (depth 2 or more) and sizes, conversations shared with other brands and their inbound messages, first and last seen.

    Rates of conversations are null for a brand that has none of its own. Rows whose author is null are no brand.
    """
    conv, own = conversations(msgs), attribution(msgs)
    single = own.filter("brand is not null").join(conv, "root_id").groupBy(F.col("brand").alias("author")).agg(
        F.count(F.lit(1)).alias("n_own"), F.sum("n_inbound").alias("n_inbound_own"), F.count_if(F.col("max_depth") >= 2).alias("n_multi_turn"), F.round(F.avg("n_messages"), 2).alias("mean_size"))
    several = own.filter("n_brands > 1").join(conv, "root_id").select("root_id", "n_inbound")
    shared = msgs.filter("not inbound").select("root_id", "author").distinct().join(several, "root_id").groupBy("author").agg(F.count(F.lit(1)).alias("n_shared"), F.sum("n_inbound").alias("n_inbound_shared"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    share = lambda a, b, name: F.round(100.0 * F.col(a) / F.col(b), 2).alias(name)
    return authors(msgs.filter("author is not null")).join(single, "author", "left").join(shared, "author", "left").select(
        "author", "n_outbound", share("n_deflect", "n_outbound", "deflect_pct"), share("n_deflect_strict", "n_outbound", "deflect_strict_pct"), F.round(F.col("n_words") / F.col("n_outbound"), 1).alias("mean_words"),
        zero("n_own"), zero("n_inbound_own"), zero("n_multi_turn"), share("n_multi_turn", "n_own", "multi_turn_pct"), "mean_size", zero("n_shared"), zero("n_inbound_shared"), "first_s", "last_s",
    )


def raw_columns(rows: DataFrame) -> DataFrame:
    """column, n_null of every column of a raw table, from one pass."""
    one = rows.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in rows.columns])
    return one.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, rows.columns)), F.array(*[F.col(f"`{c}`") for c in rows.columns]))).alias("column", "n_null"))


def raw_messages(rows: DataFrame) -> DataFrame:
    """One row of raw messages (all strings: tweet_id, in_response_to_tweet_id, created_at): ids and times that cannot be read, parents that are missing, the range of times."""
    number = lambda c: F.col(c).try_cast("double")
    parent, at = F.col("in_response_to_tweet_id"), F.try_to_timestamp(F.col("created_at"))
    return rows.agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(number("tweet_id").isNull()).alias("id_non_numeric"), F.count_if(parent.isNull()).alias("parent_missing"), F.count_if(parent.isNotNull() & number("in_response_to_tweet_id").isNull()).alias("parent_non_numeric"),
        F.count_if(at.isNull()).alias("time_unread"), F.unix_seconds(F.min(at)).alias("first_s"), F.unix_seconds(F.max(at)).alias("last_s"),
    )
