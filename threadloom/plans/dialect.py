"""Pieces of SQL for the oracle: the text functions once more, and the views."""

from __future__ import annotations

from threadloom.functions import text as X


#: Fixed values once more, so that a wrong one in the functions does not pass.
URL, MENTION = r"https?://[^ \t\n\r\f]+|(^|[^\p{L}\p{N}_])www\.[^ \t\n\r\f]+", r"@[\p{L}\p{N}_]+"
DEFLECT = r"((^|[^a-z0-9_])dms?([^a-z0-9_]|$)|(^|[^a-z0-9_])d\.?m\.?([^a-z0-9_]|$)|direct message|private message|(^|[^a-z0-9_])pm us([^a-z0-9_]|$)|inbox us|message us privately)"
THANKS = r"(^|[^a-z0-9_])(thanks|thank you|cheers|appreciate it|sorted|fixed it|that worked|perfect|awesome|legend)([^a-z0-9_]|$)"
SENSITIVE = (
    r"(^|[^a-z0-9_])(lawsuit|sue|suing|legal action|attorney|lawyer|court|subpoena|fraud|fraudulent|unauthorou?ised|stolen|identity theft|hacked|discriminat[a-z0-9_]*|racist|harass[a-z0-9_]*|threat[a-z0-9_]*|"
    r"died|death|passed away|funeral|hospital|medical|disabilit[a-z0-9_]*|self.?harm|suicid[a-z0-9_]*|kill myself|data breach|gdpr|ombudsman|regulator|complaint to)([^a-z0-9_]|$)"
)
ACCOUNT = (
    r"(^|[^a-z0-9_])(refund|charge ?back|reimburse|credit my|cancel my (account|subscription|plan)|close my account|delete my account|reset my password|change my (email|address|card)|"
    r"update my (card|billing|payment)|bill(ed|ing) me|double.?charged|unsubscribe me|downgrade my|upgrade my)([^a-z0-9_]|$)"
)
LATIN = r"A-Za-z\x{C0}-\x{24F}\x{1E00}-\x{1EFF}\x{2C60}-\x{2C7F}\x{A720}-\x{A7FF}"


#: What to ask for a reason; quotes are doubled, as they stand in SQL.
ASKS = {
    "account_action_required": "They''ll need to verify your account before making any changes.", "sensitive_topic": "Someone will follow up with you directly on this.", "unknown_intent": "Could you tell us a little more about what you need?", "low_quality_input": "Could you share a few more details so we can help?",
    "insufficient_evidence": "They''ll be able to give you a definitive answer.", "conflicting_precedents": "They''ll confirm the right answer for your situation.", "ungrounded_draft": "They''ll be able to give you a definitive answer.", "low_confidence": "Could you tell us a little more about the issue?",
    "classifier_disagreement": "Could you tell us a little more about the issue?", "multi_intent": "It looks like there are a couple of things here — a colleague will pick both up.", "intent_not_auto_allowed": "They''ll be able to help with this directly.",
}

def said(strong: str, n: str, tau: str, theta: str) -> str:
    """Cases of what a reason says; reads conf and intent."""
    details = {
        "sensitive_topic": "message contains legal, financial-harm, safety or medical language", "account_action_required": "request needs a change to the customer''s account, which this system must never perform", "unknown_intent": "message does not fall into any intent the taxonomy covers",
        "low_quality_input": "message has fewer than 4 content words, too little to act on", "low_confidence": f"intent confidence ' || printf('%.2f', conf) || ' is below the {tau} threshold", "classifier_disagreement": "the LLM and the distilled TF-IDF classifier chose different intents",
        "insufficient_evidence": f"only ' || {strong} || ' of ' || {n} || ' retrieved precedents scored above {theta}; the brand has no consistent historical response", "conflicting_precedents": "retrieved historical replies disagree with each other", "ungrounded_draft": "the draft could not be fully supported by the retrieved evidence",
        "multi_intent": "message contains more than one distinct request", "intent_not_auto_allowed": "intent ''' || intent || ''' is not on the auto-handle allowlist",
    }
    return " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in details.items())


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def low(t: str) -> str:
    return f"lower(coalesce({t}, ''))"


def squeeze(x: str) -> str:
    return f"trim(regexp_replace({x}, {lit(r'[ \t\n\r\f\x0B]+')}, ' ', 'g'))"


def norm(t: str) -> str:
    return squeeze(f"regexp_replace(regexp_replace({low(t)}, {lit(URL)}, '\\1 ', 'g'), {lit(MENTION)}, ' ', 'g')")


_CLEAN = lit(r"https?://[^ \t\n\r\f]+|@[a-z0-9_]+")


def tokens(t: str) -> str:
    stop = ", ".join(lit(w) for w in sorted(set(X.STOP_WORDS)))
    return f"list_filter(regexp_extract_all(regexp_replace({low(t)}, {_CLEAN}, ' ', 'g'), '[a-z0-9'']+'), lambda w: len(w) > 1 AND w NOT IN ({stop}))"


def words(t: str) -> str:
    return f"len(regexp_extract_all(coalesce({t}, ''), '[A-Za-z0-9_]+'))"


def blanks(t: str) -> str:
    return f"len(list_filter(string_split({squeeze(f'coalesce({t}, {lit(str())})')}, ' '), lambda w: w <> ''))"


def has(t: str, pattern: str) -> str:
    return f"regexp_matches({low(t)}, {lit(X.between_words(pattern))})"


def low_quality(t: str, least: int = 4) -> str:
    gone = lit(r"https?://[^ \t\n\r\f]+|@[\p{L}\p{N}_]+")
    bare = f"regexp_replace(regexp_replace({low(t)}, {gone}, ' ', 'g'), {lit(r'[^\p{L}\p{N}_ \t\n\r\f\x0B]')}, ' ', 'g')"
    return f"({blanks(bare)} < {least})"


def bucket(*parts: str) -> str:
    return f"('0x' || substr(md5({' || chr(58) || '.join(f'{p}::VARCHAR' for p in parts)}), 1, 8))::BIGINT"


MSGS = """msgs AS (SELECT conv_id * 100 + turn AS tweet_id, lag(conv_id * 100 + turn) OVER (PARTITION BY conv_id ORDER BY turn) AS parent_id, role = 'user' AS inbound,
  CASE WHEN role = 'user' THEN 'u' || conv_id ELSE role END AS author, 1704067200 + conv_id * 3600 + turn * 60 AS created_s, text FROM conversations)"""
#: Recursion downward from the roots: messages without a parent that is there.
THREADS = MSGS + """, tree AS (SELECT tweet_id AS id, tweet_id AS root_id, 0::BIGINT AS depth FROM msgs WHERE parent_id IS NULL OR parent_id NOT IN (SELECT tweet_id FROM msgs)
  UNION ALL SELECT m.tweet_id, t.root_id, t.depth + 1 FROM tree t JOIN msgs m ON m.parent_id = t.id)
, thr AS (SELECT m.*, t.root_id, t.depth FROM msgs m JOIN tree t ON t.id = m.tweet_id)"""
SESSIONS = """ev AS (SELECT event_id, user_id, event_type, value, (epoch_us(ts) // 1000000)::BIGINT AS s FROM events),
cut AS (SELECT *, CASE WHEN s - lag(s) OVER (PARTITION BY user_id ORDER BY s, event_id) > 43200 THEN 1 ELSE 0 END AS fresh FROM ev),
ses AS (SELECT event_id, user_id, event_type, value, s, (user_id * 100000 + sum(fresh) OVER (PARTITION BY user_id ORDER BY s, event_id))::BIGINT AS session_id FROM cut),
spans AS (SELECT session_id, min(s) AS lo, max(s) AS hi, count(*) AS n_rows FROM ses GROUP BY session_id),
t AS (SELECT quantile_cont(lo, 0.7) AS t1, quantile_cont(lo, 0.9) AS t2 FROM spans),
split AS (SELECT spans.*, CASE WHEN hi < t1 THEN 'history' WHEN lo >= t1 AND hi < t2 THEN 'dev' WHEN lo >= t2 THEN 'gold_pool' ELSE 'straddler' END AS split FROM spans, t)"""
GOLD = """gold AS (SELECT doc_id, lang, quality * 2 + toxic AS gold, CASE WHEN n_chars % 7 = 0 THEN (quality * 2 + toxic + 1) % 4 WHEN lang = 'es' THEN 2 ELSE quality * 2 + toxic END AS pred,
  round((n_chars % 101) / 100.0::DOUBLE, 2) AS conf, toxic = 1 AS gold_escalate, n_chars % 5 = 0 AS pred_escalate, n_chars FROM documents JOIN labels USING (doc_id))"""
#: Documents a minute apart, and the benchmark's items, spread over the same time, as queries that may only look back.
BM25 = f"""docs AS (SELECT doc_id, doc_id * 60 AS tm, text, {tokens('text')} AS w FROM documents),
items AS (SELECT item_id, ((item_id + 1) * (SELECT (max(doc_id) + 1) * 60 FROM documents)) // (SELECT max(item_id) + 1 FROM benchmark) AS tm, text, list_distinct({tokens('text')}) AS w FROM benchmark),
posts AS (SELECT doc_id, tm, len(w) AS dl, term, count(*) AS tf FROM (SELECT doc_id, tm, w, unnest(w) AS term FROM docs) GROUP BY ALL),
size AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM docs),
idf AS (SELECT term, count(*) AS df, ln(1 + (n - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM posts, size GROUP BY term, n),
scored AS (SELECT item_id, doc_id, round(sum(idf * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))), 4) AS score
  FROM (SELECT item_id, tm AS q_at, unnest(w) AS term FROM items) q JOIN posts p USING (term) JOIN idf USING (term), size WHERE p.tm < q.q_at GROUP BY item_id, doc_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0)"""
