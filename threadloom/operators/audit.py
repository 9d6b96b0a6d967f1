"""Audits as tables of checks, and sinks."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.functions import text as X
from threadloom.session import shared_path


def check(rows: DataFrame, name: str, fails: Column, severity: str = "CRITICAL") -> DataFrame:
    """One row: status, name, n_failed."""
    return rows.agg(F.count_if(fails).alias("n_failed")).select(F.when(F.col("n_failed") == 0, "OK").otherwise(severity).alias("status"), F.lit(name).alias("name"), "n_failed")


def audit(checks: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, checks)


def secrets(docs: DataFrame, key: str) -> DataFrame:
    """key, kinds of the documents that hold what looks like a credential."""
    kinds = F.array_compact(F.array(*[F.when(F.col("text").rlike(p), name) for name, p in sorted(X.SECRETS.items())]))
    return docs.select(key, F.array_join(kinds, ",").alias("kinds")).filter(F.col("kinds") != "")


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """All rows of ``new``, and those of ``old`` whose key ``new`` does not have."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def write_and_read(rows: DataFrame, kind: str, split: str | None = None) -> DataFrame:
    """``rows`` through a sink of that kind (csv, json, parquet), a folder a split, and back."""
    path = shared_path(rows.sparkSession, f"sink-{kind}")
    writer = rows.write.option("header", "true") if kind == "csv" else rows.write
    (writer.partitionBy(split) if split else writer).format(kind).save(path)
    reader = rows.sparkSession.read.schema(rows.schema)
    return (reader.option("header", "true") if kind == "csv" else reader).format(kind).load(path)


def text_tree(rows: DataFrame, folder: str, text: str = "text", whole: bool = False) -> DataFrame:
    """folder, text: ``rows`` as a tree of text files, a folder for each value, read again by line (or by file, ``whole``).

    Line breaks within a text would make more lines of it, so they become blanks; null texts are left out.
    """
    path = shared_path(rows.sparkSession, "tree")
    lines = rows.filter(F.col(text).isNotNull()).select(folder, F.regexp_replace(text, r"[\r\n]+", " ").alias("value"))
    lines.write.partitionBy(folder).text(path)
    read = rows.sparkSession.read.option("pathGlobFilter", "*.txt").schema(f"value string, {folder} string")
    return read.text(path, wholetext=whole).select(folder, F.col("value").alias(text))


def document(row: DataFrame) -> DataFrame:
    """``row`` (one row) as a JSON document in the shared folder, read again."""
    path = shared_path(row.sparkSession, "document")
    row.coalesce(1).write.json(path)
    return row.sparkSession.read.schema(row.schema).option("multiLine", True).json(path)


SUFFIXES = (".py", ".md", ".yaml", ".yml", ".json", ".csv", ".txt")


def _tree(spark: SparkSession, kind: str, root: str, suffixes: tuple[str, ...]) -> DataFrame:
    found = spark.read.format(kind).option("recursiveFileLookup", True).option("pathGlobFilter", "*{" + ",".join(suffixes) + "}").load(root)
    below = re.escape(re.sub(r"^[a-z]+:/*", "/", root).rstrip("/")) + "/(.*)$"
    return found.select("*", F.regexp_extract("_metadata.file_path", below, 1).alias("__path"))


def files(spark: SparkSession, root: str, suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """path (below ``root``), suffix, length of every file of these suffixes in the tree, folders within folders too. No content is read."""
    return _tree(spark, "binaryFile", root, suffixes).select(F.col("__path").alias("path"), F.regexp_extract("__path", r"(\.[A-Za-z]+)$", 1).alias("suffix"), "length")


def file_lines(spark: SparkSession, root: str, suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """path, text of every line of these files; files are split as any text is."""
    return _tree(spark, "text", root, suffixes).select(F.col("__path").alias("path"), F.col("value").alias("text"))


def row(condition: Column, name: str, bad: str, detail: Column) -> Column:
    """A check (name, status, detail) as a struct: OK, or ``bad``; null counts as bad."""
    return F.struct(F.lit(name).alias("name"), F.when(condition, "OK").otherwise(bad).alias("status"), detail.cast("string").alias("detail"))


def leaked(lines: DataFrame, shown: int = 5) -> DataFrame:
    """One check of lines (path, text): no credential in any, else the first paths that hold one."""
    hit = F.exists(F.array(*[F.col("text").rlike(p) for p in X.SECRETS.values()]), lambda x: x)
    few = lines.filter(hit).select("path").distinct().orderBy("path").limit(shown).agg(F.array_join(F.array_sort(F.collect_list("path")), ", ").alias("paths"))
    return few.select(row(F.col("paths") == "", "no key material in files", "CRITICAL", F.when(F.col("paths") == "", "scanned all text files").otherwise(F.col("paths"))).alias("c")).select("c.*")


def splits(rows: DataFrame) -> DataFrame:
    """Two checks of rows (split, id, at): no id in two splits; history before dev before gold_pool."""
    twice = rows.groupBy("id").agg(F.count_distinct("split").alias("n")).agg(F.count_if(F.col("n") > 1).alias("n"))
    at = lambda f, s: f(F.when(F.col("split") == s, F.col("at")))
    ends = rows.agg(at(F.max, "history").alias("h"), at(F.min, "dev").alias("d0"), at(F.max, "dev").alias("d1"), at(F.min, "gold_pool").alias("g"))
    one = row(F.col("n") == 0, "no conversation overlap between splits", "CRITICAL", F.when(F.col("n") == 0, "disjoint").otherwise(F.col("n").cast("string")))
    fine = (F.col("h") <= F.col("d0")) & (F.col("d1") <= F.col("g"))
    two = row(fine, "splits are time-ordered", "CRITICAL", F.when(fine, "history < dev < gold_pool").otherwise("time ranges overlap"))
    return twice.crossJoin(ends).select(F.explode(F.array(one, two)).alias("c")).select("c.*")  # one row each


def labelling(rows: DataFrame, low: int = 150, high: int = 250) -> DataFrame:
    """Three checks of rows (human, suggested): some are labelled, not all as suggested, and their number is within bounds."""
    n = rows.agg(F.count_if(F.length("human") > 0).alias("n"), F.bool_and(F.col("human").eqNullSafe(F.col("suggested"))).alias("copied"))
    copied = F.coalesce("copied", F.lit(True)) & (F.col("n") > 0)
    return n.select(F.explode(F.array(
        row(F.col("n") > 0, "gold labels are human-typed", "CRITICAL", F.concat(F.col("n").cast("string"), F.lit(" rows"))), row(~copied, "human labels are no copy of suggestions", "WARN", F.when(copied, "all equal").otherwise("they differ")),
        row(F.col("n").between(low, high), "golden set size", "WARN", F.concat(F.lit("n="), F.col("n").cast("string"))),
    )).alias("c")).select("c.*")


def honesty(metrics: DataFrame) -> DataFrame:
    """Five checks of a metrics document (text, one row): no mock mode, agreement with a valid status and, where measured, real pairs, intent metrics and precision not pending."""
    v = F.try_parse_json("text")
    got = lambda path, kind: F.try_variant_get(v, path, kind)
    status, pairs = got("$.agreement.status", "string"), F.coalesce(got("$.agreement.n_pairs", "long"), F.lit(0))
    mock, waits, p5 = F.coalesce(got("$.mock_mode", "boolean"), F.lit(False)), F.coalesce(got("$.intent.status", "string"), F.lit("")) == "PENDING", F.coalesce(got("$.retrieval.precision_at_5", "string"), F.lit(""))
    return metrics.select(F.explode(F.array(
        row(~mock, "results not from mock mode", "CRITICAL", F.when(mock, "every number is synthetic").otherwise("real answers")), row(status.isin("MEASURED", "PENDING", "INSUFFICIENT"), "agreement not claimed without ratings", "CRITICAL", F.concat(F.lit("status="), F.coalesce(status, F.lit("none")))),
        row((status != "MEASURED") | (pairs > 0), "agreement measured on real pairs", "CRITICAL", F.concat(F.lit("n_pairs="), pairs.cast("string"))), row(~waits, "intent metrics", "WARN", F.when(waits, "PENDING").otherwise("measured")), row(p5 != "PENDING", "retrieval P@5", "WARN", p5),
    )).alias("c")).select("c.*")


def deliverables(found: DataFrame, wanted: dict[str, str]) -> DataFrame:
    """A check for each wanted path (a file, or a folder with files) and its severity."""
    have = found.select(F.explode(F.array(F.col("path"), F.regexp_extract("path", r"^([^/]+)/", 1))).alias("path"), "length").groupBy("path").agg(F.sum("length").alias("bytes"))
    asked = found.sparkSession.createDataFrame(list(wanted.items()), "path string, severity string")
    there = asked.join(have, "path", "left")
    detail = F.coalesce(F.concat(F.col("bytes").cast("string"), F.lit(" bytes")), F.lit("missing"))
    return there.select(F.concat("path", F.lit(" exists")).alias("name"), F.when(F.col("bytes").isNotNull(), "OK").otherwise(F.col("severity")).alias("status"), detail.alias("detail"))


def at_least(n: DataFrame, name: str, least: int, what: str) -> DataFrame:
    """One check of a count (one row, column n)."""
    return n.select(row(F.col("n") >= least, name, "WARN", F.concat(F.col("n").cast("string"), F.lit(f" {what}"))).alias("c")).select("c.*")


def credential_kind(key: Column) -> Column:
    """What a pasted key looks like, by the first rule that fits."""
    n = F.length(key)
    return (
        F.when(key.startswith("AIza") & n.between(35, 45), "API key").when(key.startswith("ya29."), "access token").when((F.regexp_count(key, F.lit(r"\.")) == 2) & key.startswith("eyJ"), "identity token")
        .when(key.startswith("http://") | key.startswith("https://"), "URL").when(F.regexp_count(key, F.lit("AIza")) > 1, "several keys").when(key.contains("-----BEGIN"), "private key").when(n > 100, "too long").otherwise("unknown")
    )
