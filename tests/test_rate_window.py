"""Calls in a window of time, where many fall on the same second."""

import time

from pyspark.sql import functions as F

from threadloom.operators import model_calls


def test_windows_equal_counting(spark):
    for seconds in (7, 60, 4000):
        at = [(i, t) for i, t in enumerate([0, 0, 3, 7, 8, 59, 60, 61, 3599, 3600, 3600, 3601, 7199, 7200, 7206, 7207, 11000, 14400, -1, -3600])] + [(99, None)]
        got = {r["i"]: (r["in_window"], r["over"]) for r in model_calls.rate_window(spark.createDataFrame(at, "i int, t long"), "t", 3, seconds).collect()}
        for i, t in at:
            n = sum(t is not None and x is not None and t - seconds <= x <= t for _, x in at) if t is not None else 1
            assert got[i] == (n, n > 3)


def test_a_crowded_hour_is_linear(spark):
    calls = spark.range(400_000).select((F.col("id") % 3600).alias("t"))
    start = time.monotonic()
    out = model_calls.rate_window(calls, "t", 15, 3600).agg(F.max("in_window").alias("m"), F.count(F.lit(1)).alias("n")).first()
    assert (out["m"], out["n"]) == (400_000, 400_000)
    assert time.monotonic() - start < 60  # each row looked at every other of its window: 400,000 squared
