"""What models answer, as rows: ratings, batches, claims; baselines beside them; verdicts and usage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.functions import text as X

#: What the constant and the keyword baseline give as reasons.
TRIVIAL, RULE = "trivial_baseline", "rule_baseline"
#: A gap in groundedness below the first separates nothing; an accuracy within the second of chance is chance.
GAP, NEAR = 0.5, 0.05


def _node(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "variant")


def _kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def whole(v: Column) -> Column:
    """A variant as a whole number: numbers and booleans lose their fraction, strings must be digits; else null."""
    digits = F.when(F.try_variant_get(v, "$", "string").rlike(r"^\s*[+-]?\d+\s*$"), F.trim(F.try_variant_get(v, "$", "string")).try_cast("long"))
    return F.when(_kind(v) == "STRING", digits).otherwise(F.try_variant_get(v, "$", "double").try_cast("long"))


def parse_judgement(reply: Column, dims: list[str], flags: list[str]) -> Column:
    """struct<failed, dims..., flags..., composite> of a judge's reply.

    A dimension is an object with ``score`` or the score itself, rounded half to even, 1 to 5; if one fails, the whole row does and
    all else is null. A flag is 1 where it (or its ``flag``) is 1, else 0. The composite is the mean of the dimensions.
    """
    return X.let(X.parse_json(reply), lambda v: _judged(v, dims, flags))


def _judged(v: Column, dims: list[str], flags: list[str]) -> Column:
    got = [X.rating(F.coalesce(F.try_variant_get(v, f"$.{d}.score", "double"), F.try_variant_get(v, f"$.{d}", "double"))) for d in dims]
    on = [F.when(F.coalesce(whole(F.coalesce(_node(v, f"$.{f}.flag"), _node(v, f"$.{f}"))) == 1, F.lit(False)), 1).otherwise(0) for f in flags]

    def row(scores: Column) -> Column:
        ok = F.array_size(F.array_compact(scores)) == len(dims)
        mean = F.round(sum((scores[i] for i in range(1, len(dims))), scores[0]) / len(dims), 3)
        return F.struct((~ok).alias("failed"), *[F.when(ok, scores[i]).alias(d) for i, d in enumerate(dims)], *[F.when(ok, c).alias(f) for f, c in zip(flags, on, strict=True)], F.when(ok, mean).alias("composite"))

    return X.let(F.array(*got), row)


def align_batches(asked: DataFrame, replies: DataFrame, valid: list[str], other: str = "other") -> DataFrame:
    """asked (batch, id, ...) with intent, confidence, parse_failed out of replies (batch, reply), whose ``results`` carry ids.

    The last result of an id counts. One that is missing or names no valid intent gives ``other``, 0 and parse_failed;
    a confidence that is no number is 0. Rows of ``asked`` with a null batch or id get no result.
    """
    r = replies.select("batch", F.posexplode(F.try_variant_get(X.parse_json(F.col("reply")), "$.results", "array<variant>")).alias("pos", "r"))
    r = r.select("batch", whole(_node(F.col("r"), "$.id")).alias("id"), "pos", F.try_variant_get("r", "$.intent", "string").alias("i"), F.try_variant_get("r", "$.confidence", "double").alias("c")).filter("id is not null")
    last = r.groupBy("batch", "id").agg(F.max_by(F.struct("i", "c"), "pos").alias("r"))
    ok = F.coalesce(F.col("r.i").isin(valid), F.lit(False))
    value = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("r.c", F.lit(0.0))))
    return asked.join(last, ["batch", "id"], "left").withColumns({"intent": F.when(ok, F.col("r.i")).otherwise(other), "confidence": F.when(ok, value).otherwise(0.0), "parse_failed": ~ok}).drop("r")


def unsupported_claims(reply: Column) -> Column:
    """How many of a reply's ``claims`` are objects without anything in ``supported_by``; 0 where there is no list."""
    claims = F.try_variant_get(X.parse_json(reply), "$.claims", "array<variant>")
    empty = lambda c: F.coalesce(F.to_json(_node(c, "$.supported_by")).isin("null", "[]", "{}", '""', "0", "false"), F.lit(True))
    return F.coalesce(F.size(F.filter(claims, lambda c: _kind(c).startswith("OBJECT") & empty(c))), F.lit(0))


def taxonomy_text(intents: DataFrame) -> DataFrame:
    """One row, text: the intents (place, name, definition, includes, excludes) as lines in order of place; null or empty parts are left out."""
    part = lambda c: F.when(F.coalesce(F.col(c), F.lit("")) != "", F.concat(F.lit(f"    {c}: "), F.col(c)))
    line = F.concat_ws("\n", F.concat(F.lit("- "), F.col("name"), F.lit(": "), F.col("definition")), part("includes"), part("excludes"))
    rows = intents.agg(F.array_sort(F.collect_list(F.struct("place", line.alias("line")))).alias("l"))
    return rows.select(F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("text"))


def left_merge(left: DataFrame, right: DataFrame, on: str, suffix: str) -> DataFrame:
    """Every row of ``left`` with those of ``right`` of the same key; columns of ``right`` whose names clash get the suffix."""
    clash = {c: f"{c}{suffix}" for c in right.columns if c != on and c in left.columns}
    return left.join(right.withColumnsRenamed(clash), on, "left")


def baselines(rows: DataFrame, majority: str, sensitive: str = X.SENSITIVE, account: str = X.ACCOUNT_ACTION) -> DataFrame:
    """rows (text, n_hits, ...) with what both baselines decide: ``trivial_*`` always handles, ``rule_*`` escalates by keyword, or without evidence."""
    return _decided(_keyed(rows, sensitive, account), majority).drop("__sensitive", "__account")


def baselines_with_suggestion(rows: DataFrame, majority: str, sensitive: str = X.SENSITIVE, account: str = X.ACCOUNT_ACTION) -> DataFrame:
    """``baselines`` and ``suggested`` (see suggest_escalation) of rows (text, n_hits, intent, ...); each pattern is looked for once in a text."""
    out = _decided(_keyed(rows, sensitive, account), majority)
    return out.withColumn("suggested", F.col("__sensitive") | F.col("__account") | _says_nothing(F.col("intent"))).drop("__sensitive", "__account")


def _keyed(rows: DataFrame, sensitive: str, account: str) -> DataFrame:
    return rows.withColumns({"__sensitive": X.has(F.col("text"), sensitive), "__account": X.has(F.col("text"), account)})


def _decided(rows: DataFrame, majority: str) -> DataFrame:
    code = F.when(F.col("__sensitive"), "sensitive_topic").when(F.col("__account"), "account_action_required").when(F.coalesce("n_hits", F.lit(0)) == 0, "insufficient_evidence").otherwise(RULE)
    return rows.withColumns({"trivial_intent": F.lit(majority), "trivial_decision": F.lit("auto_handle"), "trivial_code": F.lit(TRIVIAL), "rule_code": code}).withColumn("rule_decision", F.when(F.col("rule_code") == RULE, "auto_handle").otherwise("escalate"))


def _says_nothing(intent: Column) -> Column:
    return F.coalesce(intent, F.lit("")).isin("", "other")


def suggest_escalation(text: Column, intent: Column, sensitive: str = X.SENSITIVE, account: str = X.ACCOUNT_ACTION) -> Column:
    """Whether a labeller is shown "escalate": a keyword, or no intent that says anything (null counts as none)."""
    return X.has(text, sensitive) | X.has(text, account) | _says_nothing(intent)


def placebo(judged: DataFrame, accuracy: Column, n_classes: int, agent: str = "agent", control: str = "placebo") -> DataFrame:
    """One row of judged (system, mean_groundedness): both means, their gap, whether the judge separates them (null if one is missing), and whether an accuracy is chance."""
    of = lambda s: F.max(F.when(F.col("system") == s, F.col("mean_groundedness")))
    r = judged.agg(of(agent).alias("agent"), of(control).alias("control")).withColumn("gap", F.round(F.col("agent") - F.col("control"), 6))
    return r.select("agent", "control", "gap", (F.abs("gap") >= GAP).alias("separates"), F.round(F.lit(1.0 / n_classes), 6).alias("chance"), (F.abs(accuracy - 1.0 / n_classes) < NEAR).alias("near_chance"))


def latency(calls: DataFrame) -> DataFrame:
    """One row of calls (seconds, error): attempted, succeeded, turned away by a quota, other errors, mean and greatest seconds, calls a minute. ``error`` is null where a call came back."""
    bad = F.col("error")
    limited = bad.contains("429") | F.upper(bad).contains("RESOURCE_EXHAUSTED") | F.lower(bad).contains("quota")
    s = F.when(bad.isNull(), F.col("seconds"))
    return calls.agg(F.count(F.lit(1)).alias("attempted"), F.count_if(bad.isNull()).alias("succeeded"), F.count_if(limited).alias("rate_limited"), F.count_if(bad.isNotNull() & ~limited).alias("other_errors"), F.round(F.avg(s), 2).alias("mean_s"), F.round(F.max(s), 2).alias("max_s"), F.round(F.lit(60.0) / F.avg(s), 1).alias("per_minute"))


def cheapness(name: Column) -> Column:
    """struct<tier, version, length> that sorts model names by price: lite, flash, others, pro; newer first; shorter first."""
    n = F.lower(name)
    tier = F.when(n.contains("lite"), 0).when(n.contains("flash"), 1).when(n.contains("pro"), 3).otherwise(2)
    newest = F.array_max(F.transform(F.regexp_extract_all(n, F.lit(r"(\d+\.\d+|\d+)"), F.lit(1)), lambda x: x.cast("double")))
    return F.struct(tier.alias("tier"), (F.lit(0.0) - F.coalesce(newest, F.lit(0.0))).alias("version"), F.length(name).alias("length"))
