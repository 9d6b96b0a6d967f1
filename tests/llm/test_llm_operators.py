"""Each operator against a brute-force version, and on rows that are null, empty, very long, tied, repeated."""

import base64
import hashlib
import math
import re
import time
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from threadloom.llm import bpe, chunking, common, components, langid, license_scan, media, mixing, quality, simhash, token_count, token_store, topk

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_tokens int, score string"
LONG = "the quick brown fox " * 8000
ODD = [
    (0, None, "en", "a", None), (1, "", "en", None, 0), (2, "   \n\t ", None, "a", 6), (3, LONG, "en", "a", len(LONG)), (4, LONG, "en", "b", len(LONG)), (5, "Licensed under CC BY-NC 4.0. CC by", "en", "b", 30),
    (6, "!!! ??? 123", "en", "b", 11), (7, "same words here again today", "en", "c", 27), (7, "same words here again today", "en", "c", 27), (8, "été <|endoftext|> 日本  🙂\n\n x", "fr", "c", 20), (9, "GNU General  Public\nLicense, version 3", "en", "c", 30),
    (None, "no id", "en", "c", 5), (10, "Same words HERE again today", "en", "c", 27), (20, "x", "de", "d", 1),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, 1, "clash") for r in ODD], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet")


def text_of(t):
    return t or ""


TOKENIZER = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
TIKTOKEN = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_multi_50k.tiktoken"), "rb"))}, special_tokens={})
PIECES = st.lists(st.sampled_from([*"ab é日.1\n\t\x1f\xa0 ", "  ", "'s", "the", "ing", "<|endoftext|>", "aaaa"]), max_size=30).map("".join)


@settings(max_examples=200, deadline=None)
@given(st.one_of(PIECES, st.text(max_size=40).filter(lambda s: s.isprintable())))
def test_token_counts_and_ids_equal_the_libraries(text):
    ids = TOKENIZER.encode(text, add_special_tokens=False).ids
    assert token_count.count_texts([text], P.path(token_count.VOCABULARY)) == [len(ids)]
    assert token_store.encode_texts([text], P.path(token_store.VOCABULARY))[0].tolist() == ids
    coded = bpe.encode_texts([text], P.path(bpe.VOCABULARY))[0]
    assert np.frombuffer(coded, "<u4").tolist() == TIKTOKEN.encode_ordinary(text)
    assert bpe.decode_ids(coded, P.path(bpe.VOCABULARY)) == text.encode()


def brute_license(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text_of(text)))
    at = {t.label: [i for i in range(len(w)) if w[i : i + len(t.key.split())] == t.key.split()] for t in license_scan.TEMPLATES}
    base = [i for t in license_scan.TEMPLATES if t.base for i in at[t.label]]
    return len(w), len(base), min(base, default=None), max(base, default=None), ",".join(sorted(t.label for t in license_scan.TEMPLATES if t.base and at[t.label])), ",".join(sorted(k for k, v in at.items() if v))


def test_license_scan(odd, docs, none):
    for d in (odd, docs):
        want = sorted((r["doc_id"] or -1, *brute_license(r["text"])) for r in d.collect())
        got = sorted((r["doc_id"] or -1, r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"], r["labels"]) for r in license_scan.scan_licenses(d).collect())
        assert list(map(str, got)) == list(map(str, want))
    assert license_scan.scan_licenses(none).count() == 0


def test_token_store(spark, odd, docs, none):
    for d in (odd, docs):
        path = token_store.write_store(d)
        got = token_store.read_checked(spark, path).collect()
        want = {}
        rows = sorted(((-1 if r["doc_id"] is None else r["doc_id"]), text_of(r["text"])) for r in d.collect())
        start = 0
        for i, t in rows:
            ids = np.array([*TOKENIZER.encode(t, add_special_tokens=False).ids, 0], dtype="<u4")
            want.setdefault(i, []).append((start, len(ids), zlib.crc32(ids.tobytes())))
            start += len(ids)
        have = {}
        for r in got:
            have.setdefault(-1 if r["doc_id"] is None else r["doc_id"], []).append((r["start"], r["n_tokens"], r["ids_crc32"]))
        assert {k: sorted(v) for k, v in have.items()} == want
        back = {(r["doc_id"], r["start"]): np.asarray(r["ids"], "<u4") for r in token_store.read_ids(spark, path).collect()}
        assert all(zlib.crc32(back[r["doc_id"], r["start"]].tobytes()) == r["ids_crc32"] for r in got)
    assert token_store.read_checked(spark, token_store.write_store(none)).count() == 0


def test_token_store_notices_damage(spark, docs):
    path = token_store.write_store(docs.limit(20))
    wrong = F.lit(bytearray(token_store.pack(np.array([1], "<u4"))))
    rows = simhash.materialise(token_store.read_kind(spark, path, "chunk").drop("kind").withColumn("body", wrong), "wrong")
    rows.write.mode("overwrite").parquet(f"{path}/chunks/kind=chunk")
    with pytest.raises(Exception, match="damaged"):
        token_store.read_checked(spark, path).collect()


def rewritten(df, path):
    simhash.materialise(df, "rewritten").write.mode("overwrite").parquet(path)


@pytest.mark.parametrize("damage", ["swapped", "dropped", "renamed", "manifest"])
def test_token_store_notices_altered_documents(spark, docs, damage):
    path = token_store.write_store(docs.limit(20))
    at = f"{path}/documents"
    d = spark.read.parquet(at)
    part = d.first()["part"]
    two = [r["doc_id"] for r in d.orderBy("doc_id").limit(2).collect()]
    if damage == "swapped":
        roots = {r["doc_id"]: r["root"] for r in d.collect()}
        swap = F.when(F.col("doc_id") == two[0], F.lit(roots[two[1]])).when(F.col("doc_id") == two[1], F.lit(roots[two[0]])).otherwise(F.col("root"))
        rewritten(d.withColumn("root", swap), at)
    elif damage == "dropped":
        rewritten(d.filter(F.col("doc_id") != two[1]), at)
    elif damage == "renamed":
        rewritten(d.withColumn("doc_id", F.when(F.col("doc_id") == two[1], 10**12).otherwise(F.col("doc_id"))), at)
    else:
        m = spark.read.parquet(f"{path}/manifest").filter(F.col("part") != part)
        rewritten(m, f"{path}/manifest")
        rewritten(d.filter(F.col("part") != part), at)
    with pytest.raises(ValueError, match="manifest"):
        token_store.read_checked(spark, path)


def test_ids_above_doubles_beside_a_null(spark):
    big = 2**53 + 1
    d = spark.createDataFrame([(None, "a b"), (big, "c d"), (big + 1, "c d")], "doc_id long, text string").coalesce(1)
    path = token_store.write_store(d)
    for got in (token_store.read_checked(spark, path), token_store.read_ids(spark, path), media.media_column(d), bpe.round_trip(d), token_count.count_tokens(d), simhash.near_duplicates(d)):
        assert sorted(str(r["doc_id"]) for r in got.collect()) == sorted(["None", str(big), str(big + 1)])


@given(st.lists(st.binary(max_size=50), min_size=1, max_size=6))
@settings(deadline=None)
def test_crc_of_parts(parts):
    after = np.array([sum(map(len, parts[i + 1 :])) for i in range(len(parts))])
    whole = np.bitwise_xor.reduce(chunking.crc_shift(np.array([zlib.crc32(p) for p in parts]), after))
    assert int(whole) == zlib.crc32(b"".join(parts))


@given(st.binary(max_size=6000))
@settings(max_examples=30, deadline=None)
def test_cuts_cover_and_keep_bounds(data):
    parts = media.chunks_of(data) if data else []
    assert b"".join(parts) == data and all(len(p) <= media.MOST for p in parts)


def test_quality(spark, small, docs, odd, none):
    labels = spark.read.parquet(f"{small}/labels.parquet")
    r = quality.score_quality(docs, labels).join(labels, "doc_id").toPandas()
    assert (r["keep"] == (r["quality"] == 1)).mean() > 0.85 and r[r["quality"] == 1]["keep"].mean() > 0.95
    no_labels = labels.limit(0)
    assert {(x["score"], x["keep"]) for x in quality.score_quality(odd, no_labels).collect()} == {(0.5, True)}
    assert quality.score_quality(odd, labels).count() == len(ODD) and quality.score_quality(none, labels).count() == 0
    assert quality.keep_good(odd, labels).columns == odd.columns


def test_classifiers_learn_from_bounded_samples(spark):
    rows = spark.range(50_000).select(F.lit(8).cast("long").alias("doc_id"), F.concat(F.lit("some words "), F.col("id").cast("string")).alias("text"))
    assert common.bounded_sample(rows, 100, 50_000, "s").count() == 100
    same = spark.range(50_000).select(F.lit(8).cast("long").alias("doc_id"), F.lit("the same").alias("text"))
    assert common.bounded_sample(same, 100, 50_000, "s").count() <= 1
    docs = rows.withColumn("lang", F.when(F.pmod(F.xxhash64("text"), F.lit(3)) == 0, "de").otherwise("en"))
    assert sorted(langid.fit(docs, sample=50).languages) == ["de", "en"]


def plain_cosines(spark, train, texts):
    """Dense TF-IDF vectors of trigrams, hashed as the operator says; the nearest of the given centroids' cosines, by plain loops."""

    def vector(t):
        data = b"".join(bytes([c]) if c >= 0x80 or 0x61 <= c <= 0x7A else b" " for c in (" " + t.lower() + " ").encode())
        x = [0.0] * langid.BUCKETS
        for i in range(len(data) - 2):
            if data[i : i + 3] != b"   ":
                x[(int.from_bytes(data[i : i + 3], "big") * 2654435761 & 0xFFFFFFFF) >> 19] += 1
        return x

    ids = [i for i in range(1000) if zlib.crc32(str(i).encode()) % 4 != 2][: len(train)]
    model = langid.fit(spark.createDataFrame(train.assign(doc_id=ids), "lang string, text string, doc_id long"))
    vectors = [vector(t) for t in train["text"]]
    idf = [math.log((1 + len(vectors)) / (1 + sum(v[j] > 0 for v in vectors))) + 1 for j in range(langid.BUCKETS)]
    centroids = [[w / i for w, i in zip(c, idf, strict=True)] for c in model.weighted.tolist()]
    out = []
    for t in texts:
        x = [a * b for a, b in zip(vector(t), idf, strict=True)]
        norm = math.sqrt(sum(a * a for a in x))
        cosine = [sum(a * b for a, b in zip(c, x, strict=True)) / (norm * math.sqrt(sum(a * a for a in c)) or 1) for c in centroids]
        best = max(range(len(cosine)), key=cosine.__getitem__)
        out.append((model.languages[model.owner[best]], min(1.0, max(0.0, cosine[best]))))
    return model, out


def test_langid_equals_dense_cosines_and_rejects_junk(spark, docs):
    known = docs.filter("lang is not null and text is not null").orderBy("doc_id").select("lang", "text").toPandas()
    train, rest = known.iloc[:100].reset_index(drop=True), known["text"].iloc[100:130].tolist()
    model, want = plain_cosines(spark, train, rest)
    got = [model.predict(t) for t in rest]
    assert [g[0] for g in got] == [w[0] for w in want] and np.allclose([g[1] for g in got], [w[1] for w in want], atol=1e-4)
    whole = langid.fit(docs)
    rng = np.random.default_rng(3)
    long = [t for t in known["text"] if len(t) > 600]
    shuffled = ["".join(rng.permutation(list(t))) for t in long]
    assert np.mean([whole.predict(t)[2] for t in shuffled]) > 0.9 and all(whole.predict(t)[2] for t in ("日本語の文章です " * 40, "Κείμενο στα ελληνικά " * 40, "1234 !!", ""))
    assert np.mean([whole.predict(t)[2] for t in known["text"]]) < 0.03


def plain_cotraining(text, meta, y):
    """The rounds once more, a document at a time, with weights found by long plain gradient descent."""

    def learn(x, rows, labels):
        n = [max(1, labels.count(0)), max(1, labels.count(1))]
        w, weight = np.zeros(x.shape[1] + 1), np.array([0.5 / n[int(v)] for v in labels])
        weight /= weight.sum()
        a = np.array([[*x[i], 1.0] for i in rows])
        step = 1 / (0.25 * float(sum(k * r @ r for k, r in zip(weight, a, strict=True))) + 1e-3)
        for _ in range(20_000):
            w = w - step * (sum(k * (1 / (1 + math.exp(-float(r @ w))) - v) * r for k, r, v in zip(weight, a, labels, strict=True)) if len(a) < 12 else a.T @ (weight * (1 / (1 + np.exp(-(a @ w))) - np.array(labels))) + 1e-3 * w)
        return w

    known = [i for i in range(len(y)) if y[i] >= 0]
    back, own = [i for k, i in enumerate(known) if k % 4 == 3], [i for k, i in enumerate(known) if k % 4 != 3]
    pool, good = [i for i in range(len(y)) if y[i] < 0], sum(y[i] for i in own) / len(own)
    taught = ({}, {})
    of = lambda v: learn((text, meta)[v], own + sorted(taught[v]), [int(y[i]) for i in own] + [taught[v][i] for i in sorted(taught[v])])
    w = [of(0), of(1)]
    for _ in range(quality.ROUNDS):
        for v in (0, 1):
            p = {i: 1 / (1 + math.exp(-float(np.append((text, meta)[v][i], 1.0) @ w[v]))) for i in pool}
            sure = max(1, int(quality.SHARE * len(pool)))
            taught[1 - v].update({i: 1 for i in sorted(pool, key=lambda i: (-p[i], i))[: max(1, int(sure * good))] if p[i] >= quality.SURE})
            taught[1 - v].update({i: 0 for i in sorted(pool, key=lambda i: (p[i], i))[: max(1, int(sure * (1 - good)))] if p[i] <= 1 - quality.SURE})
        w = [of(0), of(1)]
    return w, back


def test_cotraining_equals_a_plain_version():
    rng = np.random.default_rng(4)
    y = np.array([*([1, 0] * 14), *[-1] * 30])
    true = np.where(y >= 0, y, rng.integers(0, 2, len(y)))
    text = (rng.normal(size=(len(y), 3)) * 0.4 + np.outer(true * 2 - 1, [2.0, -1.5, 0.5])).astype(np.float32)
    meta = (rng.normal(size=(len(y), 2)) * 0.4 + np.outer(true * 2 - 1, [1.5, 1.0])).astype(np.float32)
    model = quality.cotrain(text, meta, y)
    w, _ = plain_cotraining(text.astype(float), meta.astype(float), y)
    for mine, plain, x in ((model.content, w[0], text), (model.metadata, w[1], meta)):
        assert np.allclose(quality.sigmoid(quality.margin(mine, x)), quality.sigmoid(quality.margin(plain, x)), atol=0.02)
    score = model.score(text, meta)[0]
    assert ((score > 0.5) == (true == 1)).all()


def brute_components(rows):
    prints = []
    for i, t in rows:
        w = text_of(t).encode().lower().split()
        s = [b" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))] if w else []
        h = [xxhash.xxh64_intdigest(x, 42) for x in s]
        prints.append((i, sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0))
    group = list(range(len(prints)))
    for a in range(len(prints)):
        for b in range(a):
            if (prints[a][1] ^ prints[b][1]).bit_count() <= 3 and group[a] != group[b]:
                old, new = group[a], group[b]
                group = [new if g == old else g for g in group]
    least = {}
    for (i, _), g in zip(prints, group, strict=True):
        least[g] = min([x for x in (least.get(g), i) if x is not None], default=None)
    return sorted((str(i), f"{p:016x}", str(least[g])) for (i, p), g in zip(prints, group, strict=True))


def test_simhash(odd, docs, none):
    for d in (odd, docs):
        got = sorted((str(r["doc_id"]), r["fingerprint"], str(r["component_id"])) for r in simhash.near_duplicates(d).collect())
        assert got == brute_components([(r["doc_id"], r["text"]) for r in d.collect()])
    assert simhash.near_duplicates(none).count() == 0
    left = simhash.drop_near_duplicates(odd)
    assert left.columns == odd.columns
    ids = sorted(str(r["doc_id"]) for r in left.collect())
    assert ids == sorted({c for _, _, c in brute_components([(r[0], r[1]) for r in ODD])})


def test_link_shard_splits_find_all_pairs():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 2**64, 3000, dtype=np.uint64)
    near = x[:800] ^ (np.uint64(1) << rng.integers(0, 64, 800).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 800).astype(np.uint64))
    x = np.unique(np.r_[x, near])
    pairs = {(int(a), int(b)) for i in range(len(x)) for a, b in [(i, j) for j in np.flatnonzero(np.bitwise_count(x ^ x[i]) <= 3)] if a < b}
    sets = simhash.Sets(len(x))
    for half in ((x & np.uint64(0xFFFFFFFF)).astype(np.uint32), (x >> np.uint64(32)).astype(np.uint32)):
        own = simhash.link_shard(x, half, 1)
        for i in range(len(x)):
            sets.join(i, own.find(i))
    assert len(pairs) >= 700 and all(sets.find(a) == sets.find(b) for a, b in pairs)


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (102, 101)], "a long, b long")
    got = {r["node"]: r["root"] for r in components.components(edges).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100, 102: 100}


def plain_media(payload):
    """The stored form and the features by plain loops: a gear hash carried from byte to byte."""
    gear, z = [], 0
    for i in range(1, 257):
        z = i * 0x9E3779B97F4A7C15 % 2**64
        z = (z ^ z >> 30) * 0xBF58476D1CE4E5B9 % 2**64
        z = (z ^ z >> 27) * 0x94D049BB133111EB % 2**64
        gear.append((z ^ z >> 31) % 2**16)
    ends, last, h, n = [], 0, 0, len(payload)
    for i, c in enumerate(payload, 1):
        h = (2 * h + gear[c]) % 2**16  # what left the window of 16 is shifted out
        if i - last == 16384 and i < n:
            ends.append(i)
            last = i
        if h >> 5 == 0 and 256 <= i - last and i < n:
            ends.append(i)
            last = i
    form = b"TLMD" + (len(ends) + 1).to_bytes(4, "little") + n.to_bytes(8, "little")
    for s, e in zip([0, *ends], [*ends, n], strict=True):
        form += (e - s).to_bytes(4, "little") + hashlib.blake2b(payload[s:e], digest_size=16).digest() + payload[s:e]
    mean = sum(payload) / n
    deviation = max(0.0, sum(c * c for c in payload) / n - mean * mean) ** 0.5
    bands = ",".join(str(sum(c // 32 == k for c in payload)) for k in range(8))
    return hashlib.sha256(form).hexdigest(), len(form), f"chunks={len(ends) + 1};mean={mean:.4f};deviation={deviation:.4f};bands={bands}"


def test_media(odd, docs, none):
    for d in (odd, docs):
        got = {}
        for r in media.media_column(d).collect():
            got.setdefault(r["doc_id"], []).append(r)
        for r in d.collect():
            data = text_of(r["text"]).encode()
            payload = data + b"\xff" * (max(1, -(-len(data) // 576)) * 576 - len(data))
            g = got[r["doc_id"]][0]
            assert (g["n_bytes"], g["payload_bytes"], g["payload_sha256"], g["tail_crc32"]) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
            assert (g["media_sha256"], g["media_bytes"], g["feature"]) == plain_media(payload)
        assert sum(map(len, got.values())) == d.count()
    assert media.media_column(none).count() == 0


def test_token_count_and_bpe(odd, docs, none):
    for d in (odd, docs):
        texts = sorted((str(r["doc_id"]), text_of(r["text"])) for r in d.collect())
        got = sorted((str(r["doc_id"]), r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in token_count.count_tokens(d).collect())
        n = [len(TOKENIZER.encode(t, add_special_tokens=False).ids) for _, t in texts]
        assert got == sorted((i, len(t.encode()), k, k > 512) for (i, t), k in zip(texts, n, strict=True))
        want = sorted((i, len(ids := TIKTOKEN.encode_ordinary(t)), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()) for i, t in texts)
        assert sorted((str(r["doc_id"]), r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe.round_trip(d).collect()) == want
    assert token_count.count_tokens(none).count() == bpe.round_trip(none).count() == 0


def test_topk(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.integers(-6, 6, 8) / 16]) for i in range(400)] + [(400 + i, [0.5] * 8) for i in range(60)]
    rows += [(500, None), (520, [1.0, None]), (540, [float("nan")] * 8), (None, [1.0] * 8), (560, [0.25]), (580, [])]
    e = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    good = [(i, np.floor(64 * np.array([*v, *[0.0] * (8 - len(v))])).astype(int)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    want = []
    for q, v in good:
        if q % 20 == 0:
            best = sorted((-int(v @ c), i) for i, c in good if i != q)[:20]
            want += [(q, k, i, -s) for k, (s, i) in enumerate(best, 1)]
    for shard, tasks in ((topk.SHARD, topk.TASKS), (64, 1), (64, 30)):
        assert sorted(map(tuple, topk.top_k(e.withColumns({c: F.lit(1) for c in ("v", "shard", "score")}), shard=shard, tasks=tasks).collect())) == want
    with pytest.raises(ValueError, match="64 bits"):
        topk.top_k(spark.createDataFrame([(20, [1e30]), (21, [2.0])], "vec_id long, embedding array<float>"))
    assert topk.top_k(e.limit(0)).count() == 0
    assert topk.top_k(spark.createDataFrame([(20, [1.0]), (21, [2.0])], "vec_id long, embedding array<float>")).collect()[0].asDict() == {"query_id": 20, "rank": 1, "vec_id": 21, "score": 8192}


@pytest.mark.parametrize("top", [40, 2**20, 2**28])
def test_topk_answers_a_batch_level_by_level(top):
    """Whole numbers in floats of 4 and 8 bytes and in integers; a query may be larger than every candidate of a shard."""
    rng = np.random.default_rng(top)
    ids = rng.permutation(3000)
    v = rng.integers(-top // 2, top // 2, (3000, 16))
    v[:600] = v[0]  # copies
    v[600:1200] //= 1000
    q = np.vstack([v[:3], v[1200:1330], rng.integers(-top, top, (5, 16))])
    own = np.r_[ids[:3], ids[1200:1330], np.full(5, -1)]
    index = topk.Index(ids, v, float(top))
    got = {(o, s.tobytes()): i.tolist() for o, i, s in index.search(own, q, 20)}
    assert len(got) == len(q)
    for o, x in zip(own.tolist(), q, strict=True):
        score = v @ x
        order = [i for i in np.lexsort((ids, -score)) if ids[i] != o][:20]
        assert got[o, score[order].tobytes()] == ids[order].tolist()


def test_topk_takes_little_time_a_query():
    rng = np.random.default_rng(5)
    v = np.floor(8 * rng.standard_normal((50_000, 64))).astype(np.int64)
    index, began = topk.Index(np.arange(50_000), v, 60.0), time.thread_time()
    assert len(list(index.search(np.arange(256), v[:256], 20))) == 256
    assert time.thread_time() - began < 256 * 0.007  # 0.0147 while each posting was added by itself


def test_langid(docs, odd, none):
    r = langid.identify_languages(docs).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    assert (r["lang_pred"] == r["lang"]).mean() > 0.97 and (r[r["held_out"]]["lang_pred"] == r[r["held_out"]]["lang"]).mean() > 0.95
    assert all(h == (zlib.crc32(str(i).encode()) % 4 == 2) for i, h in zip(r["doc_id"], r["held_out"], strict=True))
    got = {x["doc_id"]: x for x in langid.identify_languages(odd).collect()}
    assert {got[i]["lang_pred"] for i in (0, 1, 2, 6)} == {"und"} and all(0 <= x["score"] <= 1 for x in got.values())
    assert langid.identify_languages(none).count() == 0 and langid.keep_identified(odd).columns == odd.columns


def test_mixing(odd, docs, none):
    weights = {"src0": 3.0, "src1": 1.0}
    rows = mixing.mix_sources(docs, weights, size=4.0).toPandas()
    n, total = docs.groupBy("source").count().toPandas().set_index("source")["count"], docs.count()
    assert set(rows["source"]) == set(weights)
    for s, w in weights.items():
        want = w / 4 * 4.0 * total
        assert abs((rows["source"] == s).sum() - want) < 5 * want**0.5 + 1, (s, n[s])
    out = mixing.mix_sources(odd)
    assert {c for c in odd.columns} <= set(out.columns) and out.groupBy("doc_id", "text").count().filter("doc_id = 7 and count % 2 = 1").count() == 0
    assert mixing.mix_sources(none).count() == 0


def test_poisson_follows_its_distribution(spark):
    for mean in (0.3, 2.0, 40.0):
        k = spark.range(4000).select(mixing.poisson(F.lit(mean), F.col("id").cast("string")).alias("k")).agg(F.avg("k"), F.variance("k"), F.avg((F.col("k") == 0).cast("int"))).first()
        assert abs(k[0] - mean) < 5 * (mean / 4000) ** 0.5 and abs(k[1] / mean - 1) < 0.15 and abs(k[2] - np.exp(-mean)) < 0.04
