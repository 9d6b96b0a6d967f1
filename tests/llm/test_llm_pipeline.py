import hashlib

from pyspark.sql import functions as F

import corpus_pipeline
from threadloom.llm import simhash


def test_stages_keep_columns_and_decide(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    n = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = stage(spark, docs, small)
        assert docs.columns == corpus_pipeline.COLUMNS, name
        path = simhash.materialise(docs, "test")
        if name != "mixture":
            assert path.join(before.select("doc_id", "text"), ["doc_id", "text"], "left_anti").count() == 0
        docs = path
        n.append(docs.count())
    assert n[1] <= n[0] and n[2] < n[1] and n[3] < n[2]


def test_run_equals_stages_one_by_one(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    by_id = {r["doc_id"]: r["text"] for r in docs.collect()}
    for _, stage in corpus_pipeline.STAGES:
        docs = simhash.materialise(stage(spark, docs, small), "t")
    got = corpus_pipeline.run(spark, small).collect()
    assert len(got) > 0 and sorted(map(tuple, got)) == sorted(map(tuple, docs.collect()))
    assert all(r["decoded_sha256"] == hashlib.sha256(by_id[r["doc_id"]].encode()).hexdigest() for r in got)


def test_stages_on_odd_rows_and_none(spark, small):
    long = "the quick brown fox jumps over it " * 3000
    rows = [(1, None, "en", "a", None), (2, "", "en", None, 0), (3, long, "en", "a", 1), (3, long, "en", "a", 1), (None, "the shore of the other is and", None, None, None), (5, "12 !!", "de", "b", 5)]
    own = spark.read.parquet(f"{small}/documents.parquet").select(corpus_pipeline.COLUMNS)
    odd = own.unionByName(spark.createDataFrame(rows, own.schema)).withColumns({c: F.lit(c) for c in ("row", "key", "copies", "__quality")})
    for docs in (odd, odd.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            docs = simhash.materialise(stage(spark, docs, small), "t")
            assert name == "encoding" or docs.columns == corpus_pipeline.COLUMNS
    assert docs.count() == 0
