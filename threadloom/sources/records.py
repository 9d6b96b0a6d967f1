"""Delimited text, record by record, with the place of each: good records as columns, broken ones as a table of their own.

Files are split as any text is. Whether a line begins a record depends on the quotes before it, so these are counted within
each split and added up over a file's splits; a quoted field may hold line ends and still no file is read by one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadloom.session import settle

#: Lines of a record; what goes on longer, after a quote that is never closed, comes in pieces of so many, all broken.
LONGEST = 1000


def running(rows: DataFrame, value: Column, name: str) -> DataFrame:
    """rows (file, block, at, ...) with the sum of ``value`` over all lines of the file before each."""
    rows = rows.withColumn("__v", value)
    blocks = rows.groupBy(F.col("file").alias("__file"), F.col("block").alias("__block")).agg(F.sum("__v").alias("__s"))
    starts = blocks.withColumn("__start", F.sum("__s").over(W.partitionBy("__file").orderBy("__block")) - F.col("__s")).drop("__s")  # a row a split
    within = F.sum("__v").over(W.partitionBy("file", "block").orderBy("at")) - F.col("__v")
    joined = rows.join(starts, (F.col("file") == F.col("__file")) & (F.col("block") == F.col("__block")))
    return joined.withColumn(name, F.col("__start") + within).drop("__v", "__file", "__block", "__start")


def lines(spark: SparkSession, path: str) -> DataFrame:
    """file, block (where its split begins), at (order within the split), value of every line."""
    text = spark.read.option("lineSep", "\n").text(path)
    return settle(text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value"), "lines")


def records(spark: SparkSession, path: str) -> DataFrame:
    """file, line (from 0), byte (where it begins), record, pieces (more than 0: of a record that is too long)."""
    marked = running(lines(spark, path), (F.octet_length("value") + 1).cast("long"), "byte")
    marked = running(marked, F.lit(1).cast("long"), "line")
    marked = running(marked, F.regexp_count("value", F.lit('"')).cast("long"), "quotes")
    marked = settle(marked.withColumn("first", (F.col("quotes") % 2 == 0).cast("long")), "marked")
    # Before a record's first line stand as many records as before its others, less one.
    numbered = running(marked, F.col("first"), "before").withColumn("record", F.col("before") + F.col("first"))
    begun = F.when(F.col("first") == 1, F.col("line"))
    blocks = numbered.groupBy(F.col("file").alias("__file"), F.col("block").alias("__block")).agg(F.max(begun).alias("__l"))
    carried = blocks.withColumn("carried", F.max("__l").over(W.partitionBy("__file").orderBy("__block").rowsBetween(W.unboundedPreceding, -1))).drop("__l")  # a row a split
    start = numbered.withColumn("own", F.max(begun).over(W.partitionBy("file", "block").orderBy("at")))
    start = start.join(carried, (F.col("file") == F.col("__file")) & (F.col("block") == F.col("__block")))
    piece = F.floor((F.col("line") - F.coalesce("own", "carried")) / LONGEST)
    one = start.groupBy("file", "record", piece.alias("piece")).agg(F.array_sort(F.collect_list(F.struct("line", "byte", "value"))).alias("l"))
    text = F.array_join(F.transform("l", lambda x: x["value"]), "\n")
    return one.select("file", F.col("l")[0]["line"].alias("line"), F.col("l")[0]["byte"].alias("byte"), text.alias("record"), F.col("piece").alias("pieces"))


def n_fields(record: Column) -> Column:
    outside = F.regexp_replace(record, r'"(?:[^"]|"")*+"', "")
    return F.length(outside) - F.length(F.replace(outside, F.lit(","))) + 1


def read(spark: SparkSession, path: str, schema: T.StructType, header: bool = True) -> tuple[DataFrame, DataFrame]:
    """(rows, broken): the records as columns of ``schema`` (strings), and file, line, byte, fields, record of those that are none.

    A record with too many fields or an open quote is broken; one with too few is filled up with nulls; an empty line is none. An empty
    field is null. With ``header`` each file's first record is left out.
    """
    r = records(spark, path).withColumn("record", F.regexp_replace("record", "\r$", "")).filter("trim(record) <> ''")
    if header:
        r = r.filter("line > 0")
    fields, quotes = n_fields(F.col("record")), F.regexp_count("record", F.lit('"'))
    r = settle(r.withColumns({"fields": fields, "bad": (fields > len(schema)) | (quotes % 2 == 1) | (F.col("pieces") > 0)}), "records")
    filled = F.concat("record", F.repeat(F.lit(","), F.lit(len(schema)) - F.col("fields")))
    options = {"escape": '"', "nullValue": "", "emptyValue": "", "mode": "PERMISSIVE"}
    good = r.filter("not bad").select(F.from_csv(filled, schema.simpleString()[7:-1].replace(":", " "), options).alias("c")).select("c.*")
    return good, r.filter("bad").select("file", "line", "byte", "fields", "record")
