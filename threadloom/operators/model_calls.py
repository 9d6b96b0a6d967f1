"""Model calls: prompts, a response cache by content, a deterministic stand-in, parsing of replies, limits."""

from __future__ import annotations

import contextlib
import random
import re
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from threadloom.functions import text as X
from threadloom.operators.replies import unsupported_claims
from threadloom.session import settle

PROMPT = "Message: %s\nReturn ONLY JSON with intent and confidence."
#: Prompts by name; what stands in braces is filled in. A change of wording makes new cache keys.
TEMPLATES = {
    "discover": "Groups of messages to {brand}, with their distinctive terms and samples:\n\n{clusters}\n\nName {low} to {high} intents that cover them, each with a definition and what it includes and excludes. Answer with JSON: intents (name, definition, includes, excludes, account_specific, example_messages).",
    "classify": "Intents of messages to {brand}:\n{taxonomy}\n- other: none of these\n\nMessage:\n{message}\n\nWhich one is it? Answer with JSON: intent, confidence, runner_up, multi_intent.",
    "classify_batch": "Intents of messages to {brand}:\n{taxonomy}\n- other: none of these\n\nMessages:\n{messages}\n\nWhich one is each? Answer with JSON: results (id, intent, confidence, runner_up, multi_intent).",
    "draft": "Draft a reply of {brand} to this message, whose intent is {intent}:\n{message}\n\nOnly these earlier answers count as facts:\n{evidence}\n\nPromise nothing. Answer with JSON: reply, sufficient_evidence, evidence_used, claims (claim, supported_by).",
    "analyze": "Classify this message to {brand}, and draft a reply:\n{message}\n\nIntents:\n{taxonomy}\n- other: none of these\n\nOnly these earlier answers count as facts:\n{evidence}\n\nPromise nothing. Answer with JSON: intent, confidence, runner_up, multi_intent, reply, sufficient_evidence, evidence_used, claims (claim, supported_by).",
    "judge": "Message:\n{message}\n\nEvidence:\n{evidence}\n\nDraft:\n{reply}\n\nIntent {intent}, decision {decision}. Score relevance, groundedness, helpfulness, tone_fit and completeness from 1 to 5, and flag unsupported_claims and escalation_appropriate. Answer with JSON: each with why, and score or flag.",
}
#: Characters of a message that a prompt holds.
MESSAGE_CUT = 1500


def filled(template: str, values: dict[str, Column]) -> Column:
    """A template of TEMPLATES with its slots filled in; every slot needs a value, a null one is empty."""
    parts = re.split(r"\{(\w+)\}", TEMPLATES[template])
    return F.concat(*[F.coalesce(values[p].cast("string"), F.lit("")) if i % 2 else F.lit(p) for i, p in enumerate(parts)])


def cache_key(model: str, prompt: Column) -> Column:
    return F.sha2(F.concat(F.lit(model + "\n"), prompt), 256)


def mock_reply(prompt: Column, intents: list[str]) -> Column:
    """A valid reply made from the prompt's hash."""
    h = F.conv(F.substring(F.sha2(prompt, 256), 1, 8), 16, 10).cast("long")
    intent = F.array(*map(F.lit, intents))[(h % len(intents)).cast("int")]
    return F.format_string('{"intent": "%s", "confidence": %s, "sufficient_evidence": %s}', intent, F.format_string("0.%02d", (F.lit(40) + h % 60).cast("int")), F.when(h % 4 != 0, "true").otherwise("false"))


def mock_analysis(prompt: Column, intents: list[str]) -> Column:
    """What a model could answer to "analyze", made from the prompt's hash."""
    h = F.conv(F.substring(F.sha2(prompt, 256), 1, 8), 16, 10).cast("long")
    name = lambda i: F.get(F.array(*map(F.lit, intents)), (i % len(intents)).cast("int"))
    claim = lambda i: F.struct(F.concat(F.lit("claim "), i.cast("string")).alias("claim"), F.when((h / F.pow(F.lit(2), i)).cast("long") % 2 == 0, F.array(F.lit(1))).otherwise(F.array().cast("array<int>")).alias("supported_by"))
    claims = F.transform(F.filter(F.sequence(F.lit(0), F.lit(2)), lambda i: i < h % 4), claim)
    said = F.struct(name(h).alias("intent"), ((F.lit(40) + h % 60) / 100).alias("confidence"), name(h + 1).alias("runner_up"), (h % 9 == 0).alias("multi_intent"), F.when(h % 11 == 0, " ").otherwise(F.concat(F.lit(" Draft "), (h % 1000).cast("string"), F.lit(" "))).alias("reply"), (h % 5 != 0).alias("sufficient_evidence"), claims.alias("claims"))
    return F.when(h % 13 == 0, "no JSON").otherwise(F.to_json(said))


def parse_analysis(reply: Column, intents: list[str], other: str = "other") -> Column:
    """struct<intent, confidence, runner_up, multi_intent, reply, sufficient, n_claims, unsupported, parse_failed> of an answer to "analyze".

    An intent that is none of these is ``other``. What is no JSON object fails with confidence 0, an empty reply and no claims; so
    does, as to ``parse_failed`` alone, an empty reply.
    """
    v = X.parse_json(reply)
    got = lambda path, kind: F.try_variant_get(v, path, kind)
    ok = F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))
    intent, text = got("$.intent", "string"), F.trim(F.coalesce(got("$.reply", "string"), F.lit("")))
    yes = lambda path: ok & F.coalesce(got(path, "boolean"), F.lit(False))
    claims = F.coalesce(F.when(ok, F.size(got("$.claims", "array<variant>"))), F.lit(0))
    return F.struct(
        F.when(ok & intent.isin(intents), intent).otherwise(other).alias("intent"), F.when(ok, X.clamp01(got("$.confidence", "string"))).otherwise(0.0).alias("confidence"), F.when(ok, got("$.runner_up", "string")).alias("runner_up"), yes("$.multi_intent").alias("multi_intent"),
        F.when(ok, text).otherwise("").alias("reply"), yes("$.sufficient_evidence").alias("sufficient"), F.greatest(claims, F.lit(0)).alias("n_claims"), F.when(ok, unsupported_claims(reply)).otherwise(0).alias("unsupported"), (~ok | (text == "")).alias("parse_failed"),
    )


def with_cache(prompts: DataFrame, cache: DataFrame) -> DataFrame:
    """prompts (key, ...) with the cached response, null where there is none."""
    return prompts.join(cache.groupBy("key").agg(F.max("response").alias("response")), "key", "left")


class Share:
    """A task's share of a limit: so many calls in any ``period`` seconds, the next one waits until the oldest is that long ago."""

    def __init__(self, calls: int, period: float):
        self.calls, self.period, self.times = calls, period, []

    def wait(self) -> float:
        """Waits until a call may be made, notes it, and gives the seconds waited."""
        now = time.monotonic()
        self.times = [t for t in self.times if now - t < self.period]
        pause = self.period - (now - self.times[-self.calls]) if len(self.times) >= self.calls else 0.0
        if pause > 0:
            time.sleep(pause)
        self.times.append(time.monotonic())
        return max(0.0, pause)


def call_model(prompts: DataFrame, client: Callable[[str], str], attempts: int = 4, wait_s: float = 0.0, limit: int = 0, tasks: int = 4, period: float = 60.0) -> DataFrame:
    """key, response, tries, waited_s, throttled_s of prompts (key, prompt); a call that keeps failing gives null. The client is called in the partitions.

    Before another try a task waits ``wait_s`` seconds, twice as long each time, and up to as much again by chance.

    With a ``limit`` of calls (tries too) in any ``period`` seconds, prompts are dealt to ``tasks`` tasks (no more than the limit), each with
    its share of it, so that all together stay below it without a word between them. A task that is run again begins with an
    empty share: for one period its calls come on top of those of the lost one.
    """
    tasks = max(1, min(tasks, limit)) if limit else tasks

    def calls(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        place = TaskContext.get().partitionId()
        share = Share(limit // tasks + (place < limit % tasks), period) if limit else None
        for b in batches:
            out = []
            for p in b["prompt"]:
                reply, waited, tried, throttled = None, 0.0, 0, 0.0
                while reply is None and tried < attempts:
                    if tried and wait_s:
                        pause = wait_s * 2 ** (tried - 1) * (1 + random.random())
                        time.sleep(pause)
                        waited += pause
                    tried += 1
                    throttled += share.wait() if share else 0.0
                    with contextlib.suppress(OSError, TimeoutError):
                        reply = client(p)
                out.append((reply, tried, waited, throttled))
            yield pd.DataFrame({"key": b["key"], **{c: [o[i] for o in out] for i, c in enumerate(("response", "tries", "waited_s", "throttled_s"))}})

    rows = prompts.select("key", "prompt")
    rows = rows.repartition(tasks) if limit else rows
    return rows.mapInPandas(calls, "key string, response string, tries int, waited_s double, throttled_s double")


def answered(prompts: DataFrame, path: str, client: Callable[[str], str], attempts: int = 4, wait_s: float = 0.0, **throttle) -> DataFrame:
    """key, response, tries (0: from the cache, which no limit counts), waited_s, throttled_s of each distinct key of prompts (key, prompt).

    The cache is a Parquet table (key, response) at ``path``; what it lacks is asked once a key, written to the
    shared folder, and what came back is appended. A response that is null is not cached: it is asked again next time.
    """
    spark = prompts.sparkSession
    cache = spark.read.schema("key string, response string").parquet(path).groupBy("key").agg(F.max("response").alias("response"))
    wanted = prompts.groupBy("key").agg(F.min("prompt").alias("prompt"))
    hits = settle(wanted.join(cache, "key").select("key", "response", F.lit(0).alias("tries"), F.lit(0.0).alias("waited_s"), F.lit(0.0).alias("throttled_s")), "hits")
    fresh = settle(call_model(wanted.join(hits, "key", "left_anti"), client, attempts, wait_s, **throttle), "answers")
    fresh.filter("response is not null").select("key", "response").write.mode("append").parquet(path)
    return hits.unionByName(fresh)


def usage(calls: DataFrame) -> DataFrame:
    """One row of answered calls: how many were made, came from the cache, failed, were tried again, the seconds waited before other tries, and for the limit."""
    made = F.col("tries") > 0
    again = F.coalesce(F.sum(F.when(made, F.col("tries") - 1)), F.lit(0)).alias("retries")
    return calls.agg(F.count_if(made).alias("calls"), F.count_if(F.col("tries") == 0).alias("cache_hits"), F.count_if(made & F.col("response").isNull()).alias("errors"), again, *[F.coalesce(F.round(F.sum(c), 3), F.lit(0.0)).alias(c) for c in ("waited_s", "throttled_s")])


def parse_reply(reply: Column) -> Column:
    """struct<intent, confidence, sufficient, failed> of a reply; a bad one is other, 0, not sufficient, failed."""
    v = X.parse_json(reply)
    intent = F.try_variant_get(v, "$.intent", "string")
    return F.struct(F.coalesce(intent, F.lit("other")).alias("intent"), X.clamp01(F.try_variant_get(v, "$.confidence", "string")).alias("confidence"), F.coalesce(F.try_variant_get(v, "$.sufficient_evidence", "boolean"), F.lit(False)).alias("sufficient"), intent.isNull().alias("failed"))


def budget(items: DataFrame, retries: float = 0.15) -> DataFrame:
    """item, calls of ``items``, with a line for retries (a share of all, rounded down) and the total."""
    t = items.agg(F.sum("calls").alias("s")).withColumn("r", F.floor(F.col("s") * retries))
    line = lambda name, n: t.select(F.lit(name).alias("item"), n.cast("long").alias("calls"))
    return items.unionByName(line("retries", F.col("r"))).unionByName(line("total", F.col("s") + F.col("r")))


def rate_window(calls: DataFrame, at: str, limit: int, seconds: int = 60) -> DataFrame:
    """calls with those of the last ``seconds`` (itself included) and whether they are over the limit, by blocks of time so that one task never gets all.

    Calls are counted by time first. In a block (an hour, or the window if that is longer) a time's calls enter at it and leave after its window, and the running
    sum is the calls in the window. Those still there when the next block begins enter it at its start.
    """
    length = max(3600, seconds)
    counts = calls.groupBy(F.col(at).alias("__t")).agg(F.count(F.lit(1)).alias("__n"))
    block, end = F.floor(F.col("__t") / length), F.col("__t") + seconds
    stays = end >= (block + 1) * length
    step = lambda b, t, kind, n: F.struct(b.cast("long").alias("b"), t.cast("double").alias("t"), F.lit(kind).alias("kind"), n.cast("long").alias("n"))
    out = step(F.when(stays, block + 1).otherwise(block), end, 1, -F.col("__n"))
    steps = F.array(step(block, F.col("__t"), 0, F.col("__n")), out, F.when(stays, step(block + 1, (block + 1) * length, -1, F.col("__n"))))
    w = W.partitionBy("__s.b").orderBy("__s.t", "__s.kind").rowsBetween(W.unboundedPreceding, 0)
    sums = counts.select("__t", F.explode(F.array_compact(steps)).alias("__s")).withColumn("in_window", F.sum("__s.n").over(w))
    known = sums.filter("__s.kind = 0").select("__t", "in_window")
    return calls.join(known, F.col(at).eqNullSafe(F.col("__t"))).drop("__t").withColumn("over", F.col("in_window") > limit)
