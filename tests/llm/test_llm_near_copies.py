"""The pipeline's near-duplicates stage against all pairs compared by brute force."""

import numpy as np
import pytest

import corpus_pipeline
from threadloom.llm import near_copies

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def brute_force(rows):
    """doc_ids that stay, and the pairs of different sets that are similar enough."""
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({b" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    group, pairs = list(range(len(rows))), 0
    for a in range(len(rows)):
        for b in range(a):
            x, y = sets[a], sets[b]
            if x == y or (5 * min(len(x), len(y)) >= 4 * max(len(x), len(y)) and 5 * len(x & y) >= 4 * len(x | y)):
                pairs += x != y
                if group[a] != group[b]:
                    old, new = group[a], group[b]
                    group = [new if g == old else g for g in group]
    least = {}
    for (i, _), g in zip(rows, group, strict=True):
        least[g] = min([x for x in (least.get(g), i) if x is not None], default=None)
    return sorted(map(str, least.values())), pairs


def kept(df):
    return sorted(str(r["doc_id"]) for r in df.collect())


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_stage_equals_brute_force(spark, sf):
    docs = spark.read.parquet(f"/root/testdata/sf{sf}/documents.parquet")
    want, _ = brute_force([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert kept(corpus_pipeline.near_duplicates(spark, docs, "")) == want


def test_group_of_many_near_copies(spark):
    words = [f"w{k}" for k in range(120)]
    rows = [(i, " ".join([*words[: i % 100], f"new{i}", *words[i % 100 + 1 :]])) for i in range(300)]
    rows += [(1000 + i, " ".join([*words[:60], *(f"x{i}y{k}" for k in range(60))])) for i in range(100)]
    rows += [(None, "no id"), (2000, None), (2001, " \n"), (2002, "one two"), (2003, "ONE  two")]
    want, pairs = brute_force(rows)
    assert pairs > 10_000
    df = spark.createDataFrame([(i, t, "en", "a", 1) for i, t in rows], SCHEMA)
    assert kept(corpus_pipeline.near_duplicates(spark, df, "")) == want


def test_lists_dealt_in_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "LIST_BLOCK", 7)
    rng = np.random.default_rng(3)
    base = [f"w{k}" for k in range(60)]
    rows = [(i, " ".join(f"n{i}x{k}" if k in gone else w for k, w in enumerate(base))) for i in range(120) if (gone := set(rng.choice(60, int(rng.integers(0, 4)), replace=False).tolist())) is not None]
    want, pairs = brute_force(rows)
    assert pairs > 100 and 1 < len(want) < 120
    df = spark.createDataFrame([(i, t, "en", "a", 1) for i, t in rows], SCHEMA)
    assert kept(corpus_pipeline.near_duplicates(spark, df, "")) == want


def test_block_pairs_are_all_that_may_be_similar():
    rng = np.random.default_rng(9)
    common = rng.integers(0, 2**64, 40, dtype=np.uint64)
    sets = [np.unique(np.r_[common[rng.random(40) < rng.choice([0.5, 0.95])], rng.integers(0, 2**64, int(rng.integers(0, 12)), dtype=np.uint64)]) for _ in range(1300)]
    n, root, block = np.array([len(x) for x in sets]), rng.integers(0, 300, 1300), rng.integers(0, 2, 1300)
    short = np.frombuffer(b"".join(near_copies.folded(x) for x in sets), np.uint8).reshape(-1, near_copies.FOLDED)
    found = set(zip(*(x.tolist() for x in near_copies.block_pairs(n, np.zeros(1300, dtype=np.int64), root, block, short)), strict=True))
    assert all(root[p] < root[q] and block[p] != block[q] for p, q in found)
    for p in range(0, 1300, 13):
        for q in range(1300):
            if root[p] < root[q] and block[p] != block[q] and near_copies.similar(sets[p], sets[q]):
                assert (p, q) in found


def test_no_documents(spark):
    assert near_copies.drop_near_copies(spark.createDataFrame([], SCHEMA)).count() == 0


def test_repeated_id_with_different_texts(spark):
    rows = [(1, "first text of these"), (7, "first text of these"), (7, "another one"), (8, "another one"), (9, "alone a"), (9, "alone b")]
    df = spark.createDataFrame([(i, t, "en", "a", 1) for i, t in rows], SCHEMA)
    got = sorted((r["doc_id"], r["text"]) for r in corpus_pipeline.near_duplicates(spark, df, "").collect())
    assert got == [(1, "first text of these"), (7, "another one"), (9, "alone a"), (9, "alone b")]


def test_sketches_never_rule_out_a_similar_pair():
    rng = np.random.default_rng(5)
    ruled_out = 0
    for _ in range(400):
        n = int(rng.integers(1, 400))
        a = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
        b = np.unique(np.r_[a[rng.random(len(a)) < rng.choice([0.3, 0.85, 0.95, 1.0])], rng.integers(0, 2**64, int(rng.integers(0, 1 + n // 4)), dtype=np.uint64)])
        if len(b):
            may = near_copies.may_be_similar(len(a), near_copies.sketch(a), len(b), near_copies.sketch(b))
            assert may or not near_copies.similar(a, b)
            ruled_out += not may
    assert ruled_out > 50
    heavy = np.arange(300, dtype=np.uint64) << np.uint64(32)
    assert near_copies.may_be_similar(300, near_copies.sketch(heavy), 300, near_copies.sketch(heavy))
