"""Media payloads in content-defined chunks, each stored once.

A payload is cut by a rolling gear hash. A first pass counts chunk digests; those that occur more than once
go into a Bloom filter sized by their number, up to a bound. A second pass writes each document with the chunks that no other has
in its own row, with no exchange, and sends only chunks that may be shared to a store of their own, one row
a digest. A chunk that the filter takes for shared without need is stored there too, once: nothing is lost
when the filter is full, only more is exchanged. A document is read back by its ordered chunk list: its own
chunks from its row, shared ones by a join on the digest; each is verified.

The media form of a document: b"TLMD", chunks (32 bits), payload bytes (64 bits), then for each chunk its
length (32 bits), digest (16 bytes) and 8-bit samples. All little-endian.
"""

from __future__ import annotations

import hashlib
import zlib
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.llm.chunking import cuts, digest, gear_table
from threadloom.llm.common import bound_batches, in_filter, materialise, membership, new_path

#: Fixed values of the contract: payloads are filled up with FILL to a multiple of FRAME.
FRAME, FILL = 576, 255
#: A chunk ends at one byte in 2**BITS, is LEAST to MOST bytes long.
BITS, LEAST, MOST = 11, 256, 16384
OWN = "n_bytes long, sha string, names binary, sizes binary, common binary, shares boolean, body binary"
FEATURES = "payload_sha256 string, payload_bytes long, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


@lru_cache(maxsize=1)
def gears() -> np.ndarray:
    return gear_table(256)


def payload_of(text: str | None) -> tuple[bytes, int]:
    """The payload and the text's own bytes."""
    data = b"" if text is None else text.encode("utf-8", "surrogatepass")
    whole = max(1, -(-len(data) // FRAME)) * FRAME
    return data + bytes([FILL]) * (whole - len(data)), len(data)


def chunks_of(payload: bytes) -> list[bytes]:
    ends = cuts(gears()[np.frombuffer(payload, dtype=np.uint8)], BITS, LEAST, MOST)
    return [payload[s:e] for s, e in zip([0, *ends[:-1]], ends, strict=True)]


def hashes(digests: list[bytes]) -> np.ndarray:
    """64 bits of each digest, for the filter."""
    return np.array([int.from_bytes(d[:8], "little") for d in digests], dtype=np.uint64)


def describe(chunks: list[bytes], names: list[bytes], sha: str | None = None) -> tuple:
    """The values of FEATURES of a payload read back; each chunk must have its name, the payload its sha256."""
    whole, media = hashlib.sha256(), hashlib.sha256()
    n = sum(map(len, chunks))
    media.update(b"TLMD" + len(chunks).to_bytes(4, "little") + n.to_bytes(8, "little"))
    total = squares = 0
    histogram = np.zeros(256, dtype=np.int64)
    for body, name in zip(chunks, names, strict=True):
        if digest(body) != name:
            raise ValueError(f"chunk {name.hex()} is damaged")
        whole.update(body)
        media.update(len(body).to_bytes(4, "little") + name + body)
        histogram += np.bincount(np.frombuffer(body, dtype=np.uint8), minlength=256)
    level = np.arange(256)
    total, squares = int((histogram * level).sum()), int((histogram * level * level).sum())
    if sha is not None and whole.hexdigest() != sha:
        raise ValueError(f"payload {sha} is damaged")
    tail = b"".join(chunks)[-32:] if len(chunks[-1]) < 32 else chunks[-1][-32:]
    mean = total / n
    bands = ",".join(map(str, histogram.reshape(8, 32).sum(1).tolist()))
    return whole.hexdigest(), n, zlib.crc32(tail), 16 + n + 20 * len(chunks), media.hexdigest(), f"chunks={len(chunks)};mean={mean:.4f};deviation={max(0.0, squares / n - mean * mean) ** 0.5:.4f};bands={bands}"


def shared_filter(docs: DataFrame) -> np.ndarray:
    """The filter of all digests that occur more than once, as 64-bit words."""

    def names(batches):
        for b in batches:
            yield pd.DataFrame({"digest": [digest(c) for t in b["text"] for c in chunks_of(payload_of(t)[0])]})

    def short(batches):
        for b in batches:
            yield pd.DataFrame({"h": hashes([bytes(d) for d in b["digest"]]).view(np.int64)})

    repeated = docs.select("text").mapInPandas(names, "digest binary").groupBy("digest").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("digest")
    return membership(materialise(repeated.mapInPandas(short, "h long"), "repeated-digests"))


def beside(b: pa.RecordBatch, kept: list[str], rows: list[tuple], schema: str) -> pa.RecordBatch:
    """Columns of a batch, untouched, and beside them those of ``rows``."""
    types = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_()}
    new = [c.split() for c in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) or [()] * len(new)
    return pa.RecordBatch.from_arrays([*map(b.column, kept), *[pa.array(x, types[t]) for x, (_, t) in zip(columns, new, strict=True)]], [*kept, *[name for name, _ in new]])


def write_media(docs: DataFrame, path: str | None = None) -> str:
    """Writes own/ (a row for each row of ``docs``) and shared/ (a row for each digest), gives the folder."""
    spark = docs.sparkSession
    bound_batches(spark)
    path = path or new_path(spark, "media")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    words = spark.sparkContext.broadcast(shared_filter(docs))

    def own(batches):
        for b in batches:
            out = []
            for t in b.column("text").to_pylist():
                payload, n = payload_of(t)
                parts = chunks_of(payload)
                names = [digest(c) for c in parts]
                common = in_filter(words.value, hashes(names))
                out.append((n, hashlib.sha256(payload).hexdigest(), b"".join(names), np.array([len(c) for c in parts], dtype="<u4").tobytes(), np.packbits(common).tobytes(), bool(common.any()), b"".join(c for c, s in zip(parts, common, strict=True) if not s)))
            yield beside(b, ["doc_id"], out, OWN)

    def shared(batches):
        sent: set[bytes] = set()
        for b in batches:
            out = []
            for t in b["text"]:
                parts = chunks_of(payload_of(t)[0])
                names = [digest(c) for c in parts]
                for c, name, s in zip(parts, names, in_filter(words.value, hashes(names)), strict=True):
                    if s and name not in sent:
                        sent.add(name)
                        out.append((name, c))
            if len(sent) > 500_000:
                sent.clear()
            yield pd.DataFrame(out, columns=["digest", "body"])

    docs.mapInArrow(own, f"doc_id long, {OWN}").write.option("compression", "zstd").parquet(f"{path}/own")
    docs.mapInPandas(shared, "digest binary, body binary").repartition("digest").dropDuplicates(["digest"]).write.option("compression", "zstd").parquet(f"{path}/shared")
    return path


def split_row(names: bytes, sizes: bytes, common: bytes, body: bytes) -> list[tuple[int, bytes, bytes | None]]:
    """Place, name and own bytes (None: shared) of each chunk of a row of own/."""
    out, at = [], 0
    size = np.frombuffer(sizes, dtype="<u4").tolist()
    flags = np.unpackbits(np.frombuffer(common, dtype=np.uint8), count=len(size))
    for i, n in enumerate(size):
        own = None if flags[i] else bytes(body[at : at + n])
        at += 0 if flags[i] else n
        out.append((i, bytes(names[16 * i : 16 * i + 16]), own))
    return out


def read_media(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, n_bytes and FEATURES of every document, from the stored bytes."""
    own = spark.read.parquet(f"{path}/own")

    def alone(batches):
        for b in batches:
            out = []
            for row in zip(*[b.column(c).to_pylist() for c in ("names", "sizes", "common", "body", "sha")], strict=True):
                parts = split_row(*row[:4])
                out.append(describe([p[2] for p in parts], [p[1] for p in parts], row[4]))
            yield beside(b, ["doc_id", "n_bytes"], out, FEATURES)

    single = own.filter("not shares").mapInArrow(alone, f"doc_id long, n_bytes long, {FEATURES}")
    sharing = own.filter("shares")
    chunks = shared_chunks(spark, path, sharing)

    @F.pandas_udf(FEATURES)
    def put_together(chunks: pd.Series, sha: pd.Series) -> pd.DataFrame:
        out = []
        for c, s in zip(chunks, sha, strict=True):
            parts = sorted(c, key=lambda x: x["at"])
            out.append(describe([bytes(x["body"]) for x in parts], [bytes(x["digest"]) for x in parts], s))
        return pd.DataFrame(out, columns=[c.split()[0] for c in FEATURES.split(", ")])

    read = chunks.groupBy("sha").agg(F.collect_list(F.struct("at", "digest", "body")).alias("chunks"))
    read = materialise(read.select(put_together("chunks", "sha").alias("f")).select("f.*"), "media-features")
    both = sharing.select("doc_id", "n_bytes", "sha").join(read, F.col("sha") == F.col("payload_sha256"), "left")
    names = [c.split()[0] for c in FEATURES.split(", ")]
    whole = F.when(F.col("payload_sha256").isNull(), F.raise_error(F.lit("a document's chunks are missing"))).otherwise(F.col("payload_sha256")).alias("payload_sha256")
    return single.unionByName(both.select("doc_id", "n_bytes", whole, *names[1:]))


def shared_chunks(spark: SparkSession, path: str, rows: DataFrame) -> DataFrame:
    """sha, at, digest, body: the chunks of each distinct payload among ``rows`` of own/, own and shared."""
    distinct = rows.dropDuplicates(["sha"])

    def parts(batches):
        for b in batches:
            for sha, *r in zip(b["sha"], b["names"], b["sizes"], b["common"], b["body"], strict=True):
                yield pd.DataFrame([(sha, *p) for p in split_row(*r)], columns=["sha", "at", "digest", "body"])

    listed = distinct.select("sha", "names", "sizes", "common", "body").mapInPandas(parts, "sha string, at int, digest binary, body binary")
    shared = spark.read.parquet(f"{path}/shared").withColumnRenamed("body", "stored")
    return listed.join(shared, "digest", "left").select("sha", "at", "digest", F.coalesce("body", "stored").alias("body"))


def media_column(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and FEATURES of every row of ``docs``, stored and read back.

    A null text is an empty one (one frame of filling). Equal texts have equal values; repeated rows give
    repeated rows. Only doc_id and text are read.
    """
    return read_media(docs.sparkSession, write_media(docs))
