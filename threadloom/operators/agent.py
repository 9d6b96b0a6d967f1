"""The whole chain of a reply: evidence, one answer for intent and draft, a second opinion, the policy, what the customer gets."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.functions import text as X
from threadloom.operators import model_calls, policy
from threadloom.operators.retrieval import rendered

#: Characters of both sides of an exchange that evidence shows.
ASKED_CUT, ANSWERED_CUT = 280, 400
HITS = "array<struct<rank:int,score:double,asked:string,answered:string>>"


def evidence_lists(hits: DataFrame) -> DataFrame:
    """item_id, e: the hits (item_id, rank, score, asked, answered) of each item in order, both sides cut."""
    hit = F.struct(F.col("rank").cast("int").alias("rank"), F.col("score").cast("double").alias("score"), F.substring("asked", 1, ASKED_CUT).alias("asked"), F.substring("answered", 1, ANSWERED_CUT).alias("answered"))
    return hits.groupBy("item_id").agg(F.array_sort(F.collect_list(hit)).alias("e"))  # k hits


def run(messages: DataFrame, hits: DataFrame, brand: str, taxonomy: str, intents: list[str], answer: Callable[[Column, list[str]], Column], tau: float, theta: float, least_strong: int, allowed: list[str], sensitive: str | None = X.SENSITIVE, account: str | None = X.ACCOUNT_ACTION) -> DataFrame:
    """One row a message (item_id, text, silver_intent) with its intent, decision, reason and reply.

    hits: see evidence_lists; messages without any are answered without evidence. ``answer`` gives the model's answer for a prompt
    column. silver_intent is the second opinion, null where there is none, which counts as agreement. Whoever escalates holds the customer with
    what the first reason asks; else the draft is the reply. sensitive, account: see policy.decide.
    """
    rows = messages.join(evidence_lists(hits), "item_id", "left").withColumn("e", F.coalesce("e", F.array().cast(HITS)))
    prompt = model_calls.filled("analyze", {"brand": F.lit(brand), "taxonomy": F.lit(taxonomy), "message": F.substring("text", 1, model_calls.MESSAGE_CUT), "evidence": rendered(F.col("e"))})
    rows = rows.withColumn("a", model_calls.parse_analysis(answer(prompt, intents), intents)).select("*", F.col("a.intent").alias("intent"), F.col("a.confidence").alias("conf"), F.col("a.sufficient").alias("sufficient"), F.col("a.unsupported").alias("unsupported"), F.col("a.multi_intent").alias("multi"))
    rows = rows.withColumns({"agrees": F.col("silver_intent").isNull() | (F.col("silver_intent") == F.col("intent")), "scores": F.transform("e", lambda x: x["score"]), "conflict": policy.evidence_conflict(F.transform("e", lambda x: x["answered"]))})
    out = policy.decide(rows, tau, theta, least_strong, allowed, sensitive, account)
    held = F.col("decision") == "escalate"
    return out.select(
        "item_id", "intent", F.round("conf", 3).alias("confidence"), F.col("a.runner_up").alias("runner_up"), "silver_intent", F.col("agrees").alias("agreement"), "decision", "reason_codes", "reason",
        F.when(held, policy.holding_reply(F.col("primary"))).otherwise(F.col("a.reply")).alias("reply"), F.when(held, "holding_ack").otherwise("draft_resolution").alias("reply_type"), F.col("a.reply").alias("draft_reply"),
        F.size("e").alias("n_evidence"), F.col("a.n_claims").alias("n_claims"), "unsupported", "sufficient", F.col("a.parse_failed").alias("parse_failed"),
    )
