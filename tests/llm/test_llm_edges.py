"""Names that clash, many languages, long lists of fingerprints, letters that only look like ASCII."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from threadloom.llm import langid, license_scan, mixing, near_copies, quality, simhash

OWN = ["__language", "__quality", "__go", "__of", "__many", "__mean", "__source", "__copies", "__row", "__fp", "row", "id", "key", "of", "salt", "copies", "go", "fp", "__id", "a.b"]


@pytest.fixture(scope="module")
def named(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").limit(60)
    docs = docs.unionByName(docs.limit(5)).unionByName(docs.limit(3).withColumn("text", F.lit("another text of five words or more")))  # repeated ids too
    return docs.withColumns({c: F.concat(F.lit(f"{c}-"), F.col("doc_id").cast("string")) for c in OWN})


def test_every_column_of_the_users_is_carried_along(spark, small, named):
    labels = spark.read.parquet(f"{small}/labels.parquet")
    for out in (langid.keep_identified(named), quality.keep_good(named, labels), near_copies.drop_near_copies(named), simhash.drop_near_duplicates(named), mixing.mix_sources(named).drop("copy_no", "mix_key")):
        assert out.columns == named.columns
        rows = out.collect()
        assert rows and all(r[c] == f"{c}-{r['doc_id']}" for r in rows for c in OWN)


def test_more_sources_than_a_broadcast_takes(named, monkeypatch):
    want = sorted(map(repr, mixing.mix_sources(named).collect()))
    monkeypatch.setattr(mixing, "BROADCAST_ROWS", 0)
    assert sorted(map(repr, mixing.mix_sources(named).collect())) == want


def test_every_language_is_learned(spark, monkeypatch):
    letters = "abcdefghijklmnopqrstuvwxyz"
    rng = np.random.default_rng(5)
    words = {k: ["".join(rng.choice(list(letters), 6)) for _ in range(4)] for k in range(130)}
    rows = [(8 * i, " ".join(rng.choice(words[i % 130], 30)), f"l{i % 130:03d}") for i in range(1300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = langid.identify_languages(docs).join(docs, "doc_id").collect()
    assert len({r["lang_pred"] for r in got}) == 130 and np.mean([r["lang"] == r["lang_pred"] for r in got]) > 0.97
    monkeypatch.setattr(langid, "BROADCAST", 100)
    again = langid.identify_languages(docs).collect()
    assert sorted((r["doc_id"], r["lang_pred"], r["score"]) for r in again) == sorted((r["doc_id"], r["lang_pred"], r["score"]) for r in got)


def test_only_ascii_letters_are_lowered(spark):
    docs = spark.createDataFrame([(1, "This wor\u212a is licensed under the GNU General Public License"), (2, "THIS WORK IS LICENSED UNDER THE GNU GENERAL PUBLIC LICENSE")], "doc_id long, text string")
    a, b = license_scan.scan_licenses(docs).orderBy("doc_id").collect()
    assert a["base_labels"] == b["base_labels"] == "gpl" and a["score"] < b["score"] == 1.0


def test_many_fingerprints_that_share_a_half():
    rng = np.random.default_rng(2)
    high = np.unique(rng.integers(0, 2**32, 50_000, dtype=np.uint64))
    x = np.unique(np.r_[high << np.uint64(32), (high[:500] ^ np.uint64(0b111)) << np.uint64(32)]) | np.uint64(12345)
    sets = simhash.link_shard(x, (x & np.uint64(0xFFFFFFFF)).astype(np.uint32), 1)
    places = {int(v): i for i, v in enumerate(x)}
    for v in (high[:500]).tolist():
        assert sets.find(places[v << 32 | 12345]) == sets.find(places[(v ^ 7) << 32 | 12345])
    for i in range(0, len(x), 97):
        near = np.flatnonzero(np.bitwise_count(x ^ x[i]) <= 3)
        assert len({sets.find(int(j)) for j in near}) == 1


def test_whole_notices_score_by_what_agrees(spark):
    of = {t.label: t for t in license_scan.TEMPLATES}
    mit, bsd = of["mit-text"].notice.split(), of["bsd"].notice
    half = " ".join(mit[: len(mit) // 2] + ["other"] * 40)
    docs = spark.createDataFrame([(1, "x " + " ".join(mit) + " y"), (2, half), (3, bsd.upper()), (4, "license " * 5000), (5, of["mit-text"].key.replace("granted", "given"))], "doc_id long, text string")
    got = {r["doc_id"]: r for r in license_scan.scan_licenses(docs).collect()}
    assert got[1]["labels"] == got[2]["labels"] == "mit-text" and got[1]["score"] == 1.0 and 0.2 < got[2]["score"] < 0.8
    assert got[3]["labels"] == "bsd" and got[3]["score"] == 1.0 and got[3]["n_base"] == 0 and got[3]["first_word"] is None
    assert got[4]["labels"] == got[5]["labels"] == "" and got[4]["n_words"] == 5000
