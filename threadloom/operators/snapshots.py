"""Tables that change by whole versions: rows in a folder of their own, and a commit file that is there or not.

A version is ``commits/<number>``, a file that names the folder with its rows. It is written under another name and
renamed, which fails if the number is taken: so a reader sees a whole version or the one before it, a writer that dies
leaves nothing that counts, and of two writers the second starts again from what the first has committed.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.operators.exchanges import keep_last


class Conflict(RuntimeError):
    """The version is committed already."""


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def version(spark: SparkSession, path: str) -> int:
    """The last committed version, 0 without any. Files under other names don't count."""
    p, fs = _fs(spark, f"{path}/commits")
    names = [f.getPath().getName() for f in fs.listStatus(p)] if fs.exists(p) else []
    return max((int(n) for n in names if n.isdecimal()), default=0)


def _folder(spark: SparkSession, path: str, number: int) -> str:
    p, fs = _fs(spark, f"{path}/commits/{number:020d}")
    stream = fs.open(p)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def read(spark: SparkSession, path: str, number: int | None = None) -> DataFrame | None:
    """The rows of a version (the last one), None where there is none. Rows stay those of that version, whatever is committed meanwhile."""
    number = version(spark, path) if number is None else number
    return spark.read.parquet(f"{path}/rows/{_folder(spark, path, number)}") if number else None


def commit(spark: SparkSession, path: str, folder: str, number: int) -> None:
    """Makes the rows written to ``folder`` that version. Raises Conflict if it is there already."""
    own, fs = _fs(spark, f"{path}/commits/.{folder}")
    stream = fs.create(own, False)
    stream.write(bytearray(folder.encode()))
    stream.close()
    jvm = spark._jvm.org.apache.hadoop.fs
    to = jvm.Path(f"{path}/commits/{number:020d}")
    try:
        qualified = fs.makeQualified(own)
        jvm.FileContext.getFileContext(qualified.toUri(), spark._jsc.hadoopConfiguration()).rename(qualified, fs.makeQualified(to), spark.sparkContext._gateway.new_array(jvm.Options.Rename, 0))
    except Exception as e:
        fs.delete(own, False)
        if "FileAlreadyExists" in str(e):
            raise Conflict(f"version {number} of {path}") from None
        raise


def upsert(rows: DataFrame, path: str, key: str, *order: str, attempts: int = 5, before_commit: Callable[[], None] = lambda: None) -> int:
    """Commits the table at ``path`` with ``rows`` in place of what it has of their keys, and gives the version.

    Of several rows of a key in ``rows`` the last by ``order`` counts. Null keys are a key. Rows of the table and new ones have the same
    columns. ``before_commit`` is called once the rows are written. After a conflict the merge is done again on the new version.
    """
    spark = rows.sparkSession
    fresh = keep_last(rows, key, *order)
    for _ in range(attempts):
        base = version(spark, path)
        old = read(spark, path, base)
        merged = fresh if old is None else old.join(fresh.select(F.col(key).alias("__key")), F.col(key).eqNullSafe(F.col("__key")), "left_anti").unionByName(fresh)
        folder = uuid.uuid4().hex
        merged.write.parquet(f"{path}/rows/{folder}")
        before_commit()
        try:
            commit(spark, path, folder, base + 1)
            return base + 1
        except Conflict:
            continue
    raise Conflict(f"{attempts} others came first at {path}")
