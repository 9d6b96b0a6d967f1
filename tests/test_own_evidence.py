"""Random evidence in an order of each query's own."""

import hashlib

import pytest

from threadloom.operators import retrieval
from threadloom.plans import catalog


@pytest.mark.parametrize("enough", [1, 64])
def test_each_query_has_its_own_order(spark, monkeypatch, enough):
    monkeypatch.setattr(retrieval, "ENOUGH", enough)  # 1: most queries find too few at first
    docs = [(i, i // 3 if i % 11 else None) for i in range(150)]
    asked = [(i, i) for i in range(0, 60, 3)] + [(100, None), (101, 10_000), (102, 0)]
    d, q = spark.createDataFrame(docs, "doc_id long, at long"), spark.createDataFrame(asked, "item_id long, at long")
    got = sorted(map(tuple, retrieval.own_evidence(d, q, 5, "s").collect()))
    h = lambda *x: int(hashlib.md5(":".join(map(str, x)).encode()).hexdigest()[:8], 16)
    want = []
    for i, at in asked:
        older = sorted((h(i, x, "s"), x) for x, t in docs if t is not None and at is not None and t < at)[:5]
        want += [(i, x, k) for k, (_, x) in enumerate(older, 1)]
    assert got == sorted(want)


def test_items_do_not_share_orders(spark, small):
    rows = catalog.QUERIES["random_evidence"](spark, small).filter("rank = 1").collect()
    assert len({r["doc_id"] for r in rows}) > 8  # eight orders gave few firsts
