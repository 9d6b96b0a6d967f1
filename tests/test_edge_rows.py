"""Rows at the edges: odd threads, broken answers, odd names."""

import pytest
from pyspark.sql import functions as F

from threadloom.functions import text as X
from threadloom.operators import audit, evaluation, graph, model_calls, policy, replies
from threadloom.operators.retrieval import rendered


def test_threads(spark):
    edges = [(1, None), (2, 1), (3, 1), (4, 2), (10, 999), (20, 21), (21, 20), (22, 21), (30, 30), (40, None), (40, 1), (41, 40)]
    rows = spark.createDataFrame([(a, b, i) for i, (a, b) in enumerate(edges)], "tweet_id long, parent_id long, created_s long")
    got = {r["id"]: (r["root_id"], r["depth"]) for r in graph.thread_depths(graph.resolve_parents(rows)).collect()}
    assert {i: d for i, (_, d) in got.items()} == {1: 0, 2: 1, 3: 1, 4: 2, 10: 0, 20: -1, 21: -1, 22: -1, 30: 0, 40: 0, 41: 1}
    assert {i: r for i, (r, d) in got.items() if d >= 0} == {1: 1, 2: 1, 3: 1, 4: 1, 10: 10, 30: 30, 40: 40, 41: 40}


def test_replies(spark):
    rows = [(1, '{"intent": "billing", "confidence": 0.7}'), (2, 'Sure:\n```json\n{"intent": "refund", "confidence": 1.4}\n```'), (3, 'x {"intent": "app", "confidence": "bad"} y'), (4, "no json"), (5, '{"confidence": 0.2}'), (6, None)]
    got = spark.createDataFrame(rows, "id int, reply string").select("id", model_calls.parse_reply(F.col("reply")).alias("p")).select("id", "p.intent", "p.confidence", "p.failed").collect()
    assert sorted(map(tuple, got)) == [(1, "billing", 0.7, False), (2, "refund", 1.0, False), (3, "app", 0.0, False), (4, "other", 0.0, True), (5, "other", 0.2, True), (6, "other", 0.0, True)]


def test_judgements(spark):
    rows = [
        (1, '{"relevance": {"score": 4, "why": "x"}, "tone": 5, "unsupported": {"flag": 1}, "apt": 0}'), (2, '```json\n{"relevance": "3", "tone": {"score": 2.5}, "unsupported": 1, "apt": {"flag": "1"}}\n```'),
        (3, '{"relevance": 6, "tone": 3}'), (4, '{"relevance": {"why": "x"}, "tone": 3}'), (5, "no JSON at all"), (6, '{"relevance": 3.5, "tone": 1, "unsupported": "yes", "apt": "1.0"}'), (7, None), (8, '{"relevance": null, "tone": 2}'),
        (9, '{"relevance": "nan", "tone": 2}'), (10, '{"relevance": 1e300, "tone": 2}'), (11, '{"relevance": true, "tone": 2, "apt": 1.7}'), (12, "[1, 2]"),
    ]
    got = {r["id"]: tuple(r)[1:] for r in spark.createDataFrame(rows, "id int, reply string").select("id", replies.parse_judgement(F.col("reply"), ["relevance", "tone"], ["unsupported", "apt"]).alias("j")).select("id", "j.*").collect()}
    failed = (True, None, None, None, None, None)
    assert got == {**{i: failed for i in (3, 4, 5, 7, 8, 9, 10, 12)}, 1: (False, 4, 5, 1, 0, 4.5), 2: (False, 3, 2, 1, 1, 2.5), 6: (False, 4, 1, 0, 0, 2.5), 11: (False, 1, 2, 0, 1, 1.5)}


def test_batches(spark):
    said = [
        (1, '{"results": [{"id": 0, "intent": "good", "confidence": 0.7}, {"id": "1", "intent": "fine", "confidence": "1.5"}, {"id": 2, "intent": "strange", "confidence": 1}, {"id": "x", "intent": "good"}]}'),
        (2, '{"results": [{"id": 0, "intent": "bad"}, {"id": 0, "intent": "good", "confidence": null}, 7, {"intent": "good"}, {"id": 1.9, "intent": "fine", "confidence": -2}]}'), (3, "broken"),
    ]
    asked = spark.createDataFrame([(b, i) for b, n in ((1, 4), (2, 3), (3, 1), (4, 1)) for i in range(n)], "batch int, id long")
    got = replies.align_batches(asked, spark.createDataFrame(said, "batch int, reply string"), ["good", "fine", "bad"]).collect()
    bad = ("other", 0.0, True)
    assert {(r[0], r[1]): tuple(r)[2:] for r in got} == {(1, 0): ("good", 0.7, False), (1, 1): ("fine", 1.0, False), (1, 2): bad, (1, 3): bad, (2, 0): ("good", 0.0, False), (2, 1): ("fine", 0.0, False), (2, 2): bad, (3, 0): bad, (4, 0): bad}


def test_claims_names_and_taxonomy(spark):
    rows = [
        (1, '{"claims": [{"c": "a", "supported_by": []}, {"c": "b", "supported_by": ["E1"]}, {"c": "c"}, "loose", {"supported_by": null}, {"supported_by": "E2"}, {"supported_by": ""}]}'),
        (2, '{"claims": null}'), (3, '{"claims": "none"}'), (4, None), (5, '{"claims": []}'),
    ]
    got = spark.createDataFrame(rows, "id int, reply string").select("id", replies.unsupported_claims(F.col("reply"))).collect()
    assert dict(map(tuple, got)) == {1: 4, 2: 0, 3: 0, 4: 0, 5: 0}
    names = spark.createDataFrame([("m-1.5-lite",), ("M-2-flash",), ("pro-3.1-7",), ("plain",)], "name string").select("name", replies.cheapness(F.col("name")).alias("c")).select("name", "c.*")
    assert sorted(map(tuple, names.collect())) == [("M-2-flash", 1, -2.0, 9), ("m-1.5-lite", 0, -1.5, 10), ("plain", 2, 0.0, 5), ("pro-3.1-7", 3, -7.0, 9)]
    keys = spark.createDataFrame([(" Billing Issue ",), ("billing-issue",), ("Other",)], "raw string").select(X.name_key(F.col("raw")))
    assert [r[0] for r in keys.collect()] == ["billing_issue", "billing_issue", "other"]
    intents = spark.createDataFrame([(2, "bugs", "what breaks", "crashes", "wishes"), (1, "billing", "money matters", "invoices", ""), (3, "rest", "all else", None, None)], "place int, name string, definition string, includes string, excludes string")
    assert replies.taxonomy_text(intents).first()[0] == "- billing: money matters\n    includes: invoices\n- bugs: what breaks\n    includes: crashes\n    excludes: wishes\n- rest: all else"


def test_low_quality_and_addresses(spark):
    rows = ["\U0001f602 \U0001f44d ❤ ✨", "one two three four", "a b c ¿", "été là où ça", "awww.yes www.a.b http://x y", None, "x_1 2 ३ z"]
    t = F.col("t")
    got = spark.createDataFrame([(r,) for r in rows], "t string").select(X.low_quality(t), X.normalise(t)).collect()
    assert [r[0] for r in got] == [True, False, True, False, False, True, False] and got[4][1] == "awww.yes y" and got[0][1] == rows[0]


def test_answers_of_the_analysis(spark):
    whole = '{"intent": "good", "confidence": "0.8", "runner_up": "bad", "multi_intent": true, "reply": " Hi ", "sufficient_evidence": true, "claims": [{"claim": "a", "supported_by": []}, {"claim": "b", "supported_by": [1]}, 3]}'
    rows = spark.createDataFrame([(1, whole), (2, "nothing"), (3, '{"intent": "new", "reply": ""}'), (4, "[1]"), (5, None)], "id int, r string")
    got = {r["id"]: tuple(r["a"]) for r in rows.select("id", model_calls.parse_analysis(F.col("r"), ["good", "bad"]).alias("a")).collect()}
    broken = ("other", 0.0, None, False, "", False, 0, 0, True)
    assert got == {1: ("good", 0.8, "bad", True, "Hi", True, 3, 1, False), 2: broken, 3: broken, 4: broken, 5: broken}
    filled = spark.range(1).select(model_calls.filled("classify", {"brand": F.lit("acme"), "taxonomy": F.lit("- x"), "message": F.lit(None)}), rendered(F.array().cast("array<struct<rank:int,score:double,asked:string,answered:string>>"))).first()
    assert "to acme" in filled[0] and "{" not in filled[0] and filled[1] == "(no historical precedent found)"


def test_reasons_and_holding_replies(spark):
    codes = spark.createDataFrame([(c,) for c in [*policy.REASONS, "new"]], "c string").select("c", policy.holding_reply(F.col("c"))).collect()
    assert len({r[1] for r in codes}) == 1 + len(set(policy.ASKS.values())) and all(r[1].startswith("Thanks for reaching out") for r in codes)


def test_pairs_leave_out_failed_and_null_ratings(spark):
    human = spark.createDataFrame([(1, 4, None), (2, 3, 2), (3, 1, 1)], "id int, a int, b int")
    judge = spark.createDataFrame([(1, False, 5, 2), (2, True, 3, 2), (4, False, 1, 1), (3, None, None, 1)], "id int, failed boolean, a int, b int")
    assert sorted(map(tuple, evaluation.paired(human, judge, ["a", "b"]).collect())) == [("a", 4, 5), ("b", 1, 1)]


def test_files_of_a_tree(spark, tmp_path):
    (tmp_path / "a" / "b").mkdir(parents=True)
    (tmp_path / "a" / "b" / "x.md").write_text("one\ntoken = \"" + "0" * 40 + "\"\n")
    (tmp_path / "a" / "y.json").write_text("{}")
    (tmp_path / "z.bin").write_text("-----BEGIN PRIVATE KEY-----")
    root = str(tmp_path)
    assert sorted((r["path"], r["suffix"], r["length"]) for r in audit.files(spark, root).collect()) == [("a/b/x.md", ".md", 4 + 9 + 40 + 2), ("a/y.json", ".json", 2)]
    assert audit.leaked(audit.file_lines(spark, root)).collect()[0].asDict() == {"name": "no key material in files", "status": "CRITICAL", "detail": "a/b/x.md"}
    clean = audit.leaked(audit.file_lines(spark, root, (".json",))).collect()[0]
    assert clean["status"] == "OK"


@pytest.mark.parametrize(("key", "kind"), [("AIza" + "x" * 35, "API key"), ("AIza", "unknown"), ("ya29.x", "access token"), ("eyJa.b.c", "identity token"), ("https://x", "URL"), ("AIzaAIza" + "x" * 90, "several keys"), ("-----BEGIN X", "private key"), ("k" * 101, "too long"), ("", "unknown")])
def test_kinds_of_credentials(spark, key, kind):
    assert spark.range(1).select(audit.credential_kind(F.lit(key))).first()[0] == kind
