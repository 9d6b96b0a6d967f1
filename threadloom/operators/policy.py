"""Ordered rule policies with machine-readable reasons."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.functions import text as X

#: Reason codes in order, and what to ask for each.
REASONS = ("sensitive_topic", "account_action_required", "unknown_intent", "low_quality_input", "low_confidence", "classifier_disagreement", "insufficient_evidence", "conflicting_precedents", "ungrounded_draft", "multi_intent", "intent_not_auto_allowed")
HANDLED = ("confident_intent", "strong_retrieval_support", "no_account_action_required")
ASKS = {
    "account_action_required": "They'll need to verify your account before making any changes.",
    "sensitive_topic": "Someone will follow up with you directly on this.",
    "unknown_intent": "Could you tell us a little more about what you need?",
    "low_quality_input": "Could you share a few more details so we can help?",
    "insufficient_evidence": "They'll be able to give you a definitive answer.",
    "conflicting_precedents": "They'll confirm the right answer for your situation.",
    "ungrounded_draft": "They'll be able to give you a definitive answer.",
    "low_confidence": "Could you tell us a little more about the issue?",
    "classifier_disagreement": "Could you tell us a little more about the issue?",
    "multi_intent": "It looks like there are a couple of things here \u2014 a colleague will pick both up.",
    "intent_not_auto_allowed": "They'll be able to help with this directly.",
}
DEFAULT_ASK = "They'll follow up with you shortly."
#: Fixed value: the reply to a message that is passed on.
HOLDING = "Thanks for reaching out \u2014 I'm passing this to a member of our team who can look into it properly. %s"
#: What a reason says, where no number belongs in it.
DETAILS = {
    "sensitive_topic": "message contains legal, financial-harm, safety or medical language",
    "account_action_required": "request needs a change to the customer's account, which this system must never perform",
    "unknown_intent": "message does not fall into any intent the taxonomy covers",
    "classifier_disagreement": "the LLM and the distilled TF-IDF classifier chose different intents",
    "conflicting_precedents": "retrieved historical replies disagree with each other",
    "ungrounded_draft": "the draft could not be fully supported by the retrieved evidence",
    "multi_intent": "message contains more than one distinct request",
}
#: What a reason says with numbers, and the sentences around it.
NUMBERED = {
    "low_quality_input": "message has fewer than {least} content words, too little to act on",
    "low_confidence": "intent confidence {conf} is below the {tau} threshold",
    "insufficient_evidence": "only {strong} of {n} retrieved precedents scored above {theta}; the brand has no consistent historical response",
    "intent_not_auto_allowed": "intent '{intent}' is not on the auto-handle allowlist",
}
HANDLED_REASON = "auto_handle \u2014 confident_intent: '{intent}' at {conf} (>= {tau}), {strong} historical precedents above similarity {theta}, and no account action or sensitive content detected."
ESCALATED_REASON = "escalate \u2014 {primary}: {detail}. Needs a human."
#: Words that a message needs at least.
LEAST_WORDS = 4
CONFLICT = 0.45 * 0.35


def jaccard(a: Column, b: Column) -> Column:
    n = F.size(F.array_union(a, b))
    return F.when(n > 0, F.size(F.array_intersect(a, b)) / n).otherwise(0.0)


def evidence_conflict(texts: Column, threshold: float = CONFLICT) -> Column:
    """Whether the first three texts share few words: the mean Jaccard index of their pairs is low. Fewer than two texts do not conflict."""
    sets = F.transform(F.filter(F.slice(texts, 1, 3), lambda t: F.length(t) > 0), lambda t: F.array_distinct(F.regexp_extract_all(F.lower(t), F.lit("[a-z']+"), F.lit(0))))
    pair = lambda i, j: jaccard(sets[i], sets[j])
    mean = F.when(F.size(sets) == 2, pair(0, 1)).when(F.size(sets) == 3, (pair(0, 1) + pair(0, 2) + pair(1, 2)) / 3)
    return F.coalesce(mean < threshold, F.lit(False))


def ask(code: Column) -> Column:
    """What to ask for a reason, or the default."""
    asks = F.create_map(*[F.lit(x) for kv in ASKS.items() for x in kv])
    return F.coalesce(F.try_element_at(asks, code), F.lit(DEFAULT_ASK))


def holding_reply(code: Column) -> Column:
    """What a customer is told while a person looks: the template with what to ask for a reason, or the default."""
    return F.format_string(HOLDING, ask(code))


def reason(primary: Column, strong: Column, n_evidence: Column, tau: float, theta: float) -> Column:
    """The decision in words, with its numbers; ``primary`` is null for what is handled. Reads intent and conf."""
    conf = F.format_string("%.2f", F.col("conf"))
    said = F.create_map(*[F.lit(x) for kv in DETAILS.items() for x in kv])
    values = {"least": F.lit(LEAST_WORDS), "conf": conf, "tau": F.lit(tau), "strong": strong, "n": n_evidence, "theta": F.lit(theta), "intent": F.col("intent")}

    def sentence(text: str, **more: Column) -> Column:
        parts = re.split(r"\{(\w+)\}", text)
        return F.concat(*[(values | more)[p].cast("string") if i % 2 else F.lit(p) for i, p in enumerate(parts)])

    detail = F.try_element_at(said, primary)
    for code, text in NUMBERED.items():
        detail = F.when(primary == code, sentence(text)).otherwise(detail)
    return F.when(primary.isNull(), sentence(HANDLED_REASON)).otherwise(sentence(ESCALATED_REASON, primary=primary, detail=detail))


def decide(rows: DataFrame, tau: float, theta: float, least_strong: int, allowed: list[str], sensitive: str | None = X.SENSITIVE, account: str | None = X.ACCOUNT_ACTION, unknown: str = "other") -> DataFrame:
    """decision, reason_codes, primary, ask and reason for rows (text, intent, conf, agrees, scores, conflict, sufficient, unsupported, multi). A pattern that is None is a rule that does not stand."""
    strong = F.size(F.filter("scores", lambda s: s >= theta))
    said = lambda pattern: F.lit(False) if pattern is None else X.has(F.col("text"), pattern)
    flags = {
        "sensitive_topic": said(sensitive), "account_action_required": said(account), "unknown_intent": F.col("intent") == unknown, "low_quality_input": X.low_quality(F.col("text"), LEAST_WORDS),
        "low_confidence": F.col("conf") < tau, "classifier_disagreement": ~F.col("agrees"), "insufficient_evidence": strong < least_strong, "conflicting_precedents": F.col("conflict"),
        "ungrounded_draft": ~F.col("sufficient") | (F.col("unsupported") > 0), "multi_intent": F.col("multi"), "intent_not_auto_allowed": ~F.col("intent").isin(allowed) & (F.col("intent") != unknown),
    }
    codes = F.array_compact(F.array(*[F.when(flags[r], r) for r in REASONS]))
    out = rows.withColumn("codes", codes)
    none = F.size("codes") == 0
    primary = F.when(~none, F.col("codes")[0])
    return out.withColumns({"decision": F.when(none, "auto_handle").otherwise("escalate"), "reason_codes": F.array_join(F.when(none, F.array(*map(F.lit, HANDLED))).otherwise(F.col("codes")), ","), "primary": primary, "ask": F.when(~none, ask(primary)), "reason": reason(primary, strong, F.size("scores"), tau, theta)}).drop("codes")
