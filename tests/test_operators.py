import math

from pyspark.sql import functions as F

from threadloom.functions import text as X
from threadloom.functions.stats import wilson
from threadloom.operators import graph, model_calls
from threadloom.sources import tables
from threadloom.streaming import profile


def messages(spark, edges):
    return spark.createDataFrame([(a, b, i) for i, (a, b) in enumerate(edges)], "tweet_id long, parent_id long, created_s long")


def depths(spark, edges, **k):
    return {r["id"]: r["depth"] for r in graph.thread_depths(graph.resolve_parents(messages(spark, edges)), **k).collect()}


def test_chain_branch_orphan_and_cycle(spark):
    assert depths(spark, [(1, None), (2, 1), (3, 2), (4, 3)]) == {1: 0, 2: 1, 3: 2, 4: 3}
    assert depths(spark, [(1, None), (2, 1), (3, 1), (4, 2)]) == {1: 0, 2: 1, 3: 1, 4: 2}
    assert depths(spark, [(1, None), (2, 999999)]) == {1: 0, 2: 0}
    assert depths(spark, [(1, 2), (2, 1), (3, 2)]) == {1: -1, 2: -1, 3: -1}
    assert depths(spark, [(1, 1)]) == {1: 0}


def test_chain_at_the_depth_limit(spark):
    d = depths(spark, [(i, i - 1 if i else None) for i in range(41)], max_depth=40)
    assert d[39] == 39 and d[40] == -1


def test_empty_messages(spark):
    assert depths(spark, []) == {}


def test_text_functions(spark):
    rows = spark.createDataFrame([("Hi @bob see HTTPS://x.y/z  NOW\n",), ("please DM us",), ("édm x",), ("dmx",), (None,), ("आपका धन्यवाद",), ("café ab",)], "t string")
    t = F.col("t")
    got = rows.select(X.normalise(t), X.has(t, X.DEFLECT), X.non_latin(t), X.low_quality(t), X.tokens(t)).collect()
    assert got[0][0] == "hi see now" and got[4][0] == ""
    assert [r[1] for r in got] == [False, True, True, False, False, False, False]
    assert [r[2] for r in got] == [False, False, False, False, False, True, False]
    assert got[1][3] and got[4][3]
    assert got[0][4] == ["hi", "see", "now"]


def test_wilson_bounds(spark):
    rows = spark.createDataFrame([(0, 0), (0, 10), (10, 10), (2, 74)], "k long, n long")
    low, high = wilson(F.col("k"), F.col("n"))
    got = rows.select(low, high).collect()
    assert tuple(got[0]) == (0.0, 0.0) and got[1][0] == 0.0 and got[2][1] == 1.0
    assert math.isclose(got[3][0], 0.0074, abs_tol=5e-4) and math.isclose(got[3][1], 0.0933, abs_tol=5e-4)


def test_raw_csv_and_typed(spark, tmp_path):
    (tmp_path / "m.csv").write_text('tweet_id,author_id,inbound,created_at,text,response_tweet_id,in_response_to_tweet_id\n1,u,True,Mon Oct 02 10:00:00 +0000 2017,"a, ""b""\nc",,\nx,NA,False,bad,,,1.0\n')
    rows = tables.typed(tables.read_raw_csv(spark, str(tmp_path / "m.csv"))).collect()
    assert rows[0].asDict() == {"tweet_id": 1, "parent_id": -1, "author": "u", "inbound": True, "created_s": 1506938400, "text": 'a, "b"\nc'}
    assert rows[1].asDict() == {"tweet_id": -1, "parent_id": 1, "author": "NA", "inbound": False, "created_s": None, "text": ""}


def test_model_calls_retry(spark):
    def client(prompt):
        if prompt == "bad":
            raise TimeoutError
        return prompt.upper()

    rows = spark.createDataFrame([("a", "hi"), ("b", "bad")], "key string, prompt string")
    assert {r["key"]: r["response"] for r in model_calls.call_model(rows, client).collect()} == {"a": "HI", "b": None}


def test_rate_window_over_the_hour(spark):
    rows = spark.createDataFrame([(1, 3590), (2, 3610), (3, 3660)], "id long, s long")
    assert {r["id"]: r["in_window"] for r in model_calls.rate_window(rows, "s", 1).collect()} == {1: 1, 2: 2, 3: 2}
    far = spark.createDataFrame([(1, 10), (2, 5000), (3, 7205), (4, 14000)], "id long, s long")
    assert {r["id"]: r["in_window"] for r in model_calls.rate_window(far, "s", 1, 7200).collect()} == {1: 1, 2: 2, 3: 3, 4: 2}


def test_stream_counts_equal_batch(spark, small, tmp_path):
    e = spark.read.parquet(f"{small}/events.parquet")
    e.write.parquet(str(tmp_path / "in"))
    stream = profile.windowed_counts(spark.readStream.schema(e.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("counts").start()
    q.processAllAvailable()
    q.stop()
    got = spark.table("counts").agg(F.sum("n")).first()[0]
    assert got == e.count()
