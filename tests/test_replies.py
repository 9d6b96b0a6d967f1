"""Rows of what models answer: empty tables, nulls, clashes, the cache and its counters."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadloom.operators import audit, model_calls, profile, replies


def test_answers_are_cached_once_and_counted(spark, tmp_path):
    path = str(tmp_path / "cache")
    spark.createDataFrame([("a", "old")], "key string, response string").write.parquet(path)
    prompts = spark.createDataFrame([("a", "x"), ("b", "y"), ("b", "y"), ("c", "bad")], "key string, prompt string")

    def client(prompt):
        if prompt == "bad":
            raise TimeoutError
        return prompt.upper()

    first = model_calls.answered(prompts, path, client, attempts=3, wait_s=0.001)
    assert {r["key"]: (r["response"], r["tries"]) for r in first.collect()} == {"a": ("old", 0), "b": ("Y", 1), "c": (None, 3)}
    u = model_calls.usage(first).first()
    assert (u["calls"], u["cache_hits"], u["errors"], u["retries"]) == (2, 1, 1, 2) and u["waited_s"] > 0
    again = model_calls.answered(prompts, path, client, attempts=1)
    assert {r["key"]: r["tries"] for r in again.collect()} == {"a": 0, "b": 0, "c": 1}
    assert spark.read.parquet(path).count() == 2
    none = model_calls.usage(first.limit(0)).first()
    assert (none["calls"], none["retries"], none["waited_s"]) == (0, 0, 0.0)


def test_empty_tables(spark):
    empty = lambda s: spark.createDataFrame([], s)
    assert replies.align_batches(empty("batch int, id long"), empty("batch int, reply string"), ["a"]).count() == 0
    assert replies.taxonomy_text(empty("place int, name string, definition string, includes string, excludes string")).first()["text"] == ""
    p = replies.placebo(empty("system string, mean_groundedness double"), F.lit(0.5), 4).first()
    assert p["gap"] is None and p["separates"] is None and not p["near_chance"]
    c = replies.latency(empty("seconds double, error string")).first()
    assert c["attempted"] == 0 and c["mean_s"] is None and c["per_minute"] is None
    assert {r["n_null"] for r in profile.raw_columns(empty("a string, `b.c` string")).collect()} == {0}


def test_nulls_in_baselines(spark):
    rows = spark.createDataFrame([(1, None, None, None), (2, "", 1, ""), (3, "they hacked my account", 0, "good")], "id int, text string, n_hits int, intent string")
    out = replies.baselines(rows, "good").withColumn("s", replies.suggest_escalation(F.col("text"), F.col("intent"))).orderBy("id").collect()
    assert [(r["rule_code"], r["rule_decision"], r["s"]) for r in out] == [("insufficient_evidence", "escalate", True), ("rule_baseline", "auto_handle", True), ("sensitive_topic", "escalate", True)]


def test_left_merge_keeps_both_names(spark):
    left = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "k int, v string")
    right = spark.createDataFrame([(1, "x", 1.0)], "k int, v string, w double")
    got = replies.left_merge(left, right, "k", "_r")
    assert got.columns == ["k", "v", "v_r", "w"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(1, "a", "x", 1.0), (2, "b", None, None), (None, "c", None, None)], key=str)


def test_text_tree_reads_whole_files_too(spark):
    rows = spark.createDataFrame([("a", "one\ntwo"), ("a", "three"), ("b", None), ("b", "four")], "f string, text string").coalesce(1)
    assert sorted(tuple(r) for r in audit.text_tree(rows, "f").collect()) == [("a", "one two"), ("a", "three"), ("b", "four")]
    assert audit.text_tree(rows, "f", whole=True).count() == 2
