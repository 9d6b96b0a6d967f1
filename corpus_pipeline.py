"""A training corpus from raw documents: language, quality, near-duplicates, source mixture, token ids.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame; it is written as Parquet and read again as
the next stage's docs. All but the last give the columns of documents.

Null texts, and texts without a letter, go in the first stage; null sources, languages and sizes are values of their own
everywhere. A null doc_id, repeated ids and repeated rows are told apart by their texts. Texts are read whole, however long. An empty table
gives an empty one in every stage. Columns beyond those of documents, whatever their names, are let go after each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from threadloom.llm import bpe, langid, mixing, near_copies, quality
from threadloom.llm.common import new_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that language identification rejects go."""
    return langid.keep_identified(docs).select(COLUMNS)


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).select(COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: those linked by five-word shingles of Jaccard similarity 0.8 or more."""
    return near_copies.drop_near_copies(docs).select(COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents come as often as their source's target share asks, in random order; equal ids get equal counts."""
    return mixing.mix_sources(docs).select(COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each document's ids and what they decode to."""
    return bpe.round_trip(docs)


STAGES = [("language", language), ("quality", good_quality), ("near-duplicates", near_duplicates), ("mixture", mixture), ("encoding", encode)]

#: SQL cannot express the classifiers and the byte-pair merges.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = new_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
