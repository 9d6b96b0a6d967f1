"""Quantiles, draws, evidence by spans, versions of tables, shares of a limit, records with their places."""

import hashlib
import math
import time

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadloom.functions import stats
from threadloom.operators import evaluation, model_calls, ranks, retrieval, snapshots
from threadloom.sources import records


@pytest.mark.parametrize("values", [[], [3.0], [1.0, 2.0], [5.0] * 300, [*range(700), *[350] * 900], [1e308, -1e308, 0.0, 1e-300] * 50, [float(x) for x in np.random.default_rng(1).normal(size=900).round(2)]])
def test_quantiles_equal_sorting(spark, monkeypatch, values):
    monkeypatch.setattr(ranks, "LAST", 8)
    monkeypatch.setattr(ranks, "CELLS", 7)
    rows = spark.createDataFrame([(float(v),) for v in values] + [(None,), (float("nan"),)], "x double").repartition(3)
    got = ranks.quantiles(rows, "x", [0.0, 0.25, 0.5, 0.9, 1.0])
    s = sorted(map(float, values))
    for q, g in zip((0.0, 0.25, 0.5, 0.9, 1.0), got, strict=True):
        if not s:
            assert g is None
        else:
            p = q * (len(s) - 1)
            lo, hi = s[math.floor(p)], s[math.ceil(p)]
            assert g == lo + (hi - lo) * (p - math.floor(p))


def test_numbers_follow_the_order(spark):
    rows = spark.range(500).select((F.col("id") * 7919 % 500).alias("o"))
    got = ranks.numbered(rows, "o").collect()
    assert sorted(r["o"] for r in got) == list(range(500)) and all(r["o"] == r["id"] for r in got)


def test_binomials_and_tails(spark):
    for n, p in ((1, 0.5), (10, 0.3), (300, 0.02)):
        cdf = np.cumsum([math.comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(n + 1)])
        u = (np.arange(200) + 0.5) / 200
        assert evaluation.binomial(u, np.full(200, n), p).tolist() == [int(np.argmax(cdf >= x)) for x in u]
    far = evaluation.binomial(np.array([0.025, 0.5, 0.975]), np.full(3, 10**9), 0.3)
    assert np.allclose((far - 3e8) / math.sqrt(1e9 * 0.21), [-1.96, 0, 1.96], atol=1e-3)
    rows = spark.createDataFrame([(0.5, 10), (0.0, 20), (1.0, 8), (-0.9, 12), (0.1, 2), (0.05, 5000)], "r double, n long")
    got = [r[0] for r in rows.select(stats.correlation_p(F.col("r"), F.col("n"))).collect()]
    assert [g if g is None else round(g, 6) for g in got] == [round(plain_p(0.5, 10), 6), 1.0, 0.0, round(plain_p(0.9, 12), 6), None, round(plain_p(0.05, 5000), 6)]
    z = spark.createDataFrame([(x,) for x in (0.5, 1.0, 7.3, 1e6)], "z double").select("z", stats.log_gamma(F.col("z")).alias("g")).collect()
    assert all(math.isclose(r["g"], math.lgamma(r["z"]), rel_tol=1e-10, abs_tol=1e-10) for r in z)


def plain_p(r, n):
    x = np.linspace(-abs(r), abs(r), 200_001)
    y = (1 - x * x) ** ((n - 4) / 2)
    inside = float(((y[1:] + y[:-1]) / 2 * np.diff(x)).sum())
    return 1 - inside / math.exp(math.lgamma(0.5) + math.lgamma((n - 2) / 2) - math.lgamma((n - 1) / 2))


def test_bootstrap_on_few_rows_and_its_spread(spark):
    for rows in ([(1, 1)], [(0, 1), (1, 1), (1, 0)]):
        got = evaluation.bootstrap(spark.createDataFrame(rows, "gold int, pred int"), [0, 1], 50).first()
        assert got["n_boot"] == 50 and 0 <= got["accuracy_low"] <= got["accuracy_high"] <= 1
    none = evaluation.bootstrap(spark.createDataFrame([(None, 1)], "gold int, pred int"), [0, 1], 50).first()
    assert none["accuracy"] is None and none["n_boot"] == 0
    cells = [("a", 300), ("b", 100)]
    n = evaluation.resampled(cells, np.arange(3000), "s")
    assert (n.sum(axis=1) == 400).all() and abs(n[:, 0].mean() - 300) < 1 and abs(n[:, 0].var() / 75 - 1) < 0.1


def test_evidence_by_spans_equals_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "SPAN", 4)
    docs = [(i, i // 3 if i % 11 else None) for i in range(150)]
    asked = [(i, i) for i in range(0, 60, 3)] + [(100, None), (101, 10_000), (102, 0)]
    d, q = spark.createDataFrame(docs, "doc_id long, at long"), spark.createDataFrame(asked, "item_id long, at long")
    got = sorted(map(tuple, retrieval.sampled_evidence(d, q, 5, "s").collect()))
    h = lambda *x: int(hashlib.md5(":".join(map(str, x)).encode()).hexdigest()[:8], 16)
    want = []
    for i, at in asked:
        o = h(i, "s") % retrieval.ORDERS
        older = sorted((h(o, x, "s"), x) for x, t in docs if t is not None and at is not None and t < at)[:5]
        want += [(i, x, k) for k, (_, x) in enumerate(older, 1)]
    assert got == sorted(want)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_versions_of_a_table(spark, tmp_path):
    path = str(tmp_path / "t")
    new = lambda *rows: spark.createDataFrame(rows, "k int, v string, seq int")
    assert snapshots.read(spark, path) is None and snapshots.version(spark, path) == 0
    assert snapshots.upsert(new((1, "a", 1), (1, "b", 2), (2, "c", 1), (None, "n", 1)), path, "k", "seq") == 1
    before = snapshots.read(spark, path)
    assert snapshots.upsert(new((2, "d", 1), (3, "e", 1), (None, "m", 1)), path, "k", "seq") == 2
    assert rows_of(before.select("k", "v").filter("k is not null")) == [(1, "b"), (2, "c")]  # a reader keeps its version
    assert rows_of(snapshots.read(spark, path).select("k", "v").filter("k is not null")) == [(1, "b"), (2, "d"), (3, "e")]
    assert [r["v"] for r in snapshots.read(spark, path).filter("k is null").collect()] == ["m"] and rows_of(snapshots.read(spark, path, 1)) == rows_of(before)


def test_a_writer_that_dies_leaves_nothing_that_counts(spark, tmp_path):
    path = str(tmp_path / "t")
    one = spark.createDataFrame([(1, "a", 1)], "k int, v string, seq int")
    snapshots.upsert(one, path, "k", "seq")

    def dies():
        raise KeyboardInterrupt

    with pytest.raises(KeyboardInterrupt):
        snapshots.upsert(one.withColumn("v", F.lit("lost")), path, "k", "seq", before_commit=dies)
    (tmp_path / "t" / "commits" / ".half").write_text("x")  # died between writing and renaming
    assert snapshots.version(spark, path) == 1 and rows_of(snapshots.read(spark, path)) == [(1, "a", 1)]
    assert snapshots.upsert(one.withColumn("v", F.lit("b")), path, "k", "seq") == 2


def test_the_second_of_two_writers_starts_again(spark, tmp_path):
    path = str(tmp_path / "t")
    row = lambda k: spark.createDataFrame([(k, str(k), 1)], "k int, v string, seq int")
    snapshots.upsert(row(0), path, "k", "seq")
    done = []

    def other():
        if not done:
            done.append(snapshots.upsert(row(1), path, "k", "seq"))

    assert snapshots.upsert(row(2), path, "k", "seq", before_commit=other) == 3
    assert [r[0] for r in rows_of(snapshots.read(spark, path))] == [0, 1, 2]
    with pytest.raises(snapshots.Conflict):
        snapshots.commit(spark, path, "x", 3)
    assert snapshots.version(spark, path) == 3


def test_calls_stay_below_the_limit(spark, tmp_path):
    log = str(tmp_path)

    def client(prompt):
        with open(f"{log}/{prompt}", "w") as f:
            f.write(repr(time.time()))
        return "ok"

    prompts = spark.createDataFrame([(str(i), f"p{i}") for i in range(18)], "key string, prompt string").repartition(4)
    calls = model_calls.call_model(prompts, client, limit=6, tasks=4, period=3.0).collect()
    times = sorted(float((tmp_path / f"p{i}").read_text()) for i in range(18))
    assert all(r["response"] == "ok" for r in calls) and sum(r["throttled_s"] > 0 for r in calls) >= 6
    assert all(times[i + 6] - times[i] > 2.9 for i in range(12))  # never seven within the period
    free = model_calls.call_model(prompts, client).collect()
    assert sum(r["throttled_s"] for r in free) == 0


def test_a_share_waits_only_when_it_is_used_up():
    share, began = model_calls.Share(2, 0.3), time.monotonic()
    waits = [share.wait() for _ in range(4)]
    assert waits[:2] == [0.0, 0.0] and waits[2] > 0.2 and 0.3 <= time.monotonic() - began < 1.5


SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in "abc"])


def test_records_and_their_places(spark, tmp_path, monkeypatch):
    first = 'a,b,c\n1,"x, ""y""\nz",3\n\n2,b\n3,too,many,here\n4,"é\n\n\n",\r\n'
    second = "a,b,c\n5,,\n6,\"open,7\nrest,of\nfile\n"
    (tmp_path / "1.csv").write_bytes(first.encode())
    (tmp_path / "2.csv").write_bytes(second.encode())
    for split in ("128m", "9b", "20b"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        good, broken = records.read(spark, str(tmp_path), SCHEMA)
        assert sorted(map(tuple, good.collect()), key=str) == [("1", 'x, "y"\nz', "3"), ("2", "b", None), ("4", "é\n\n\n", None), ("5", None, None)]
        bad = sorted((r["file"].rsplit("/", 1)[1], r["line"], r["byte"], r["fields"], r["record"]) for r in broken.collect())
        assert bad == [("1.csv", 5, first.encode().index(b"3,too"), 4, "3,too,many,here"), ("2.csv", 2, second.index("6,"), bad[1][3], '6,"open,7\nrest,of\nfile')]
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def test_an_open_quote_comes_in_pieces(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(records, "LONGEST", 10)
    (tmp_path / "x.csv").write_text('a,b,c\n1,2,3\n4,"open\n' + "line\n" * 45)
    good, broken = records.read(spark, str(tmp_path), SCHEMA)
    assert [tuple(r) for r in good.collect()] == [("1", "2", "3")]
    assert sorted(r["line"] for r in broken.collect()) == [2, 12, 22, 32, 42] and broken.agg(F.max(F.length("record"))).first()[0] <= 60
