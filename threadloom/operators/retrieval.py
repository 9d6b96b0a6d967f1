"""BM25 over an inverted index, with strict "older than the query" and exclusion filters."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from threadloom.functions import text as X
from threadloom.operators.ranks import numbered
from threadloom.session import settle, spread

K1, B = 1.5, 0.75
#: Fixed value: what stands for evidence where there is none.
NO_EVIDENCE = "(no historical precedent found)"
#: Orders that random evidence is drawn in, and places in a span of time.
ORDERS, SPAN = 8, 512
#: Older documents of a query that are ranked, about; the others' hashes lie above a bound.
ENOUGH = 64


def tokenised(docs: DataFrame) -> DataFrame:
    """doc_id, at, w, dl (words of w) of documents (doc_id, at, text)."""
    return spread(docs.select("doc_id", "at", "text"), "doc_id").select("doc_id", "at", X.tokens(F.col("text")).alias("w")).withColumn("dl", F.size("w"))


def counted(words: DataFrame) -> DataFrame:
    """doc_id, at, dl, term, tf of (doc_id, at, dl, term)."""
    return words.groupBy("doc_id", "at", "dl", "term").agg(F.count(F.lit(1)).alias("tf"))


def term_stats(docs: DataFrame) -> DataFrame:
    """term, df, idf of documents: a term counts once in a document, so nothing but terms is exchanged."""
    w = spread(docs.select("doc_id", "text"), "doc_id").select(F.explode(F.array_distinct(X.tokens(F.col("text")))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    n = docs.agg(F.count(F.lit(1)).alias("n"))
    return w.crossJoin(F.broadcast(n)).select("term", "df", F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))


def scores(docs: DataFrame, queries: DataFrame, excluded: DataFrame | None = None) -> DataFrame:
    """item_id, doc_id, score of every document older than the query that shares a term with it.

    Scores are rounded to four digits here, before the floor and the ranks, so that equal documents tie
    whatever the order of the sum; ties then go to the smaller doc_id.

    queries: item_id, at (null: no limit of time), text; a document without a time is never older. Query
    terms count once. The postings are cut down to the queries' terms before anything is summed.
    """
    terms = queries.select("item_id", F.col("at").alias("q_at"), F.explode(F.array_distinct(X.tokens(F.col("text")))).alias("term"))
    words = settle(tokenised(docs), "tokens")
    size = words.agg(F.count(F.lit(1)).alias("n_docs"), F.avg("dl").alias("avgdl"))
    wanted = counted(words.select("doc_id", "at", "dl", F.explode("w").alias("term")).join(terms.select("term").distinct(), "term", "left_semi"))
    idf = wanted.groupBy("term").agg(F.count(F.lit(1)).alias("df")).crossJoin(F.broadcast(size)).withColumn("idf", F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    weighted = wanted.join(idf, "term")
    part = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    pairs = weighted.join(terms, "term").filter(F.col("q_at").isNull() | (F.col("at") < F.col("q_at")))
    out = pairs.groupBy("item_id", "doc_id").agg(F.round(F.sum(part), 4).alias("score"))
    return out if excluded is None else out.join(excluded, ["item_id", "doc_id"], "left_anti")


def best(scored: DataFrame, k: int, floor: float = 0.0) -> DataFrame:
    """The k best above the floor for each query, with their rank; ties to the smaller doc_id."""
    order = W.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")
    return scored.filter(F.col("score") > floor).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def sampled_evidence(docs: DataFrame, queries: DataFrame, k: int, seed: str) -> DataFrame:
    """item_id, doc_id, rank: k documents older than each query, by hash: a placebo for evidence. Without a time nothing is older.

    A query takes one of ORDERS orders of the documents, so queries share them (own_evidence gives each its own), and a query's documents are the first k of its order before its time.
    Documents and queries are numbered together by time and lie in spans of SPAN places. For every order the first k of each span are
    kept, and of each two, four, ... spans; a query looks at the few such nodes that make up all spans before
    its own, and at the documents of its own span. No pair of a query and an older document is made but these.
    """
    both = docs.select(F.col("at").cast("double").alias("at"), F.lit(1).alias("doc"), F.col("doc_id").alias("id")).unionByName(queries.select(F.col("at").cast("double").alias("at"), F.lit(0).alias("doc"), F.col("item_id").alias("id")))
    placed = settle(numbered(both.filter("at is not null"), "at", "doc", "id", name="place").withColumn("span", F.floor(F.col("place") / SPAN)), "placed")
    order = F.explode(F.sequence(F.lit(0), F.lit(ORDERS - 1)))
    asked = placed.filter("doc = 0").select(F.col("id").alias("item_id"), F.col("at").alias("q_at"), F.col("span").alias("q_span"), F.pmod(X.bucket(F.col("id").cast("string"), seed), F.lit(ORDERS)).cast("int").alias("o"))
    known = placed.filter("doc = 1").select(F.col("id").alias("doc_id"), "at", "span", order.alias("o")).withColumn("h", X.bucket(F.col("o").cast("string"), F.col("doc_id").cast("string"), F.lit(seed)))
    spans = (placed.agg(F.max("span")).first()[0] or 0) + 1
    levels = max(1, math.ceil(math.log2(spans)) + 1)
    first = W.partitionBy("o", "level", "node").orderBy("h", "doc_id")  # a limit by group, taken before the exchange too
    kept = [known.select("o", F.lit(0).alias("level"), F.col("span").alias("node"), "h", "doc_id")]
    for level in range(levels):
        rows = kept[-1].withColumn("k", F.row_number().over(first)).filter(F.col("k") <= k).drop("k")
        kept[-1] = settle(rows, "nodes")
        kept.append(kept[-1].select("o", F.lit(level + 1).alias("level"), F.floor(F.col("node") / 2).alias("node"), "h", "doc_id"))
    nodes = reduce(DataFrame.unionByName, kept[:-1])
    # The spans before number s: for each bit of s a node of that level, the one before where the bits above it end.
    bits = F.filter(F.sequence(F.lit(0), F.lit(levels - 1)), lambda b: F.expr("1L").bitwiseAND(F.call_function("shiftright", F.col("q_span"), b)) == 1)
    parts = asked.withColumn("level", F.explode(bits)).withColumn("node", F.call_function("shiftright", F.col("q_span"), F.col("level")) - 1)
    older = parts.join(nodes, ["o", "level", "node"]).select("item_id", "h", "doc_id")
    beside = asked.join(known, (asked["q_span"] == known["span"]) & (asked["o"] == known["o"])).filter(F.col("at") < F.col("q_at")).select("item_id", "h", "doc_id")
    best = W.partitionBy("item_id").orderBy("h", "doc_id")
    return older.unionByName(beside).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("item_id", "doc_id", "rank")


def own_evidence(docs: DataFrame, queries: DataFrame, k: int, seed: str) -> DataFrame:
    """item_id, doc_id, rank: k documents older than each query, by a hash of both, so that each query has an order of its own. Without a time nothing is older.

    Every pair of a query and an older document is hashed, where the document lies. A query's older documents are counted first; of the pairs only those
    below the hash that about ENOUGH of them stay under are exchanged. A query that finds fewer than k there is asked again without that bound.
    """
    known = spread(docs.select("doc_id", "at"), "doc_id")
    asked = settle(queries.select("item_id", F.col("at").alias("q_at")), "asked")
    n = known.join(asked, F.col("at") < F.col("q_at")).groupBy("item_id").agg(F.count(F.lit(1)).alias("n"))
    bound = F.lower(F.lpad(F.hex(F.least(F.lit(2**32 - 1), F.floor(F.lit(float(ENOUGH)) / F.col("n") * 2.0**32))), 8, "0"))
    bounded = settle(asked.join(n, "item_id").select("item_id", "q_at", "n", bound.alias("bound")), "bounds")
    h = F.substring(F.md5(F.concat_ws(":", F.col("item_id").cast("string"), F.col("doc_id").cast("string"), F.lit(seed))), 1, 8)  # in the order of the numbers they spell
    pairs = lambda q: known.join(q, (F.col("at") < F.col("q_at")) & (h <= F.col("bound"))).select("item_id", "doc_id", h.alias("h"))
    few = settle(pairs(bounded), "few")
    have = few.groupBy("item_id").agg(F.count(F.lit(1)).alias("have"))
    short = settle(bounded.join(have, "item_id", "left").filter(F.coalesce("have", F.lit(0)) < F.least("n", F.lit(k))).select("item_id", "q_at", F.lit("f" * 8).alias("bound")), "short")
    order = W.partitionBy("item_id").orderBy("h", "doc_id")
    every = few.join(short, "item_id", "left_anti").unionByName(pairs(short))
    return every.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("item_id", "doc_id", "rank")


def rendered(hits: Column) -> Column:
    """Evidence as text: rank, score and both sides of each hit (rank, score, asked, answered); a line of its own says that there is none."""
    one = lambda x: F.concat(F.lit("[E"), x["rank"].cast("string"), F.lit("] (similarity "), F.format_string("%.4f", x["score"]), F.lit(")\n  Customer: "), F.coalesce(x["asked"], F.lit("")), F.lit("\n  Brand replied: "), F.coalesce(x["answered"], F.lit("")))
    return F.when(F.size(hits) > 0, F.array_join(F.transform(hits, one), "\n")).otherwise(NO_EVIDENCE)


def central_text(docs: DataFrame, key: str, low: int = 8, high: int = 30, first: int = 200, cut: int = 280) -> DataFrame:
    """The one text of the first ones of fitting length whose words are most common among them."""
    words = X.word_count(F.col("text"))
    marked = docs.select(key, "text", words.between(low, high).alias("fits"))
    some = marked.agg(F.bool_or("fits").alias("some"))
    cohort = marked.crossJoin(F.broadcast(some)).filter(F.col("fits") | ~F.col("some")).orderBy(key).limit(first).select(key, "text", F.array_distinct(X.tokens(F.col("text"))).alias("w"))
    each = cohort.select(key, "text", F.explode("w").alias("term"))
    df = each.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    scored = each.join(df, "term").groupBy(key, "text").agg(F.round(F.avg("df"), 6).alias("score"))
    return scored.orderBy(F.desc("score"), key).limit(1).select(key, F.substring("text", 1, cut).alias("text"), "score")
