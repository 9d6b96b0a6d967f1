"""A content-addressed store of token ids.

Rolling hashes cut each document's ids into chunks; a chunk is named by its digest and stored once. A
document is a recipe, the ordered digests of its chunks, named by their Merkle root, so that documents with
the same ids share a recipe. The store is a folder of Parquet files on shared storage:

    chunks/kind=chunk    key (digest), body (ids, 16 bits each where they fit, compressed), n
    chunks/kind=recipe   key (Merkle root), digests, sizes, n
    documents            doc_id, root, n, part, row, place: in ascending doc_id order, a file for each part
    manifest             part, n_documents, n_tokens, root (Merkle root of the part's documents, by blocks)
    store                n_parts, root (Merkle root of the parts)

Reading checks all of it from the leaves up: ids against a chunk's digest, chunks against a recipe's root,
documents against their part's root in the manifest, the manifest against the store's root.
"""

from __future__ import annotations

import hashlib
import zlib
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.llm.chunking import crc_shift, cuts, digest, gear_table, merkle_root
from threadloom.llm.common import bound_batches, materialise, new_path
from threadloom.llm.pretokens import PieceCache, spans, texts_of
from threadloom.llm.token_count import byte_letters

VOCABULARY = "byte_bpe_50k.json"
END = 0
#: A chunk ends at one place in 2**BITS, is LEAST to MOST ids long.
BITS, LEAST, MOST = 10, 128, 8192
#: Documents in a block: a block's root is over its documents, a part's over its blocks, the store's over its parts.
BLOCK = 4096


@lru_cache(maxsize=2)
def tokenizer(path: str):
    """Special tokens' strings and ids, and the cache over the library's model."""
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(path)
    letters = np.array([ord(c) for c in byte_letters()], dtype="<u4")
    letters[0xFF] = ord(" ")  # no byte of UTF-8, and no letter of a byte: it stands between words
    tokenize, special = whole.model.tokenize, {t.content: i for i, t in whole.get_added_tokens_decoder().items()}

    def encode(words: list[str]) -> list[bytes]:
        if not words:
            return []
        written = letters[np.frombuffer(b"\xff".join([w.encode() for w in words]), dtype=np.uint8)].tobytes().decode("utf-32-le").split(" ")
        ids = [[t.id for t in tokenize(w)] for w in written]
        data = np.fromiter(chain.from_iterable(ids), dtype="<u4").tobytes()
        ends = np.cumsum([4 * len(x) for x in ids]).tolist()
        return [data[s:e] for s, e in zip([0, *ends[:-1]], ends, strict=True)]

    return special, PieceCache(encode, limit=800_000)


def encode_texts(texts: list[str | None], path: str) -> list[np.ndarray]:
    """The ids the library gives for each text, without added special tokens; a special token's string in a text is that token."""
    special, cache = tokenizer(path)
    texts = ["" if t is None else t for t in texts]
    pieces: list[list[str | int]] = []
    for t in texts:
        own: list[str | int] = [t]
        for s, i in special.items():
            if s in t:
                own = [y for x in own for y in ([x] if isinstance(x, int) else [z for p in x.split(s) for z in (i, p)][1:])]
        pieces.append(own)
    coded = iter(cache.texts([x for own in pieces for x in own if isinstance(x, str)]))
    return [np.frombuffer(b"".join(next(coded) if isinstance(x, str) else np.array([x], dtype="<u4").tobytes() for x in own), dtype="<u4") for own in pieces]


@lru_cache(maxsize=1)
def gears() -> np.ndarray:
    return gear_table(1 << 16)


@lru_cache(maxsize=1)
def coders() -> tuple[zstandard.ZstdCompressor, zstandard.ZstdDecompressor]:
    return zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def pack(ids: np.ndarray) -> bytes:
    narrow = not len(ids) or int(ids.max()) < 1 << 16
    return (b"\x02" if narrow else b"\x04") + coders()[0].compress((ids.astype("<u2") if narrow else ids.astype("<u4")).tobytes())


def unpack(body: bytes) -> np.ndarray:
    return np.frombuffer(coders()[1].decompress(body[1:]), dtype="<u2" if body[:1] == b"\x02" else "<u4").astype("<u4")


def chunks_of(ids: np.ndarray) -> list[np.ndarray]:
    ends = cuts(gears()[ids & 0xFFFF], BITS, LEAST, MOST)
    return [ids[s:e] for s, e in zip([0, *ends[:-1]], ends, strict=True)]


def write_store(docs: DataFrame, path: str | None = None, vocabulary: str | None = None) -> str:
    """Encodes every document (a null text as an empty one) and its end, writes the store, gives its path.

    The ids are those of the library's ``encode_batch_fast``: its model encodes each distinct match of its
    byte-level pattern once. One exchange carries chunks, recipes and documents, each by its own key; map
    tasks send a chunk once. Documents with a null doc_id come first; repeated rows are documents each. Only
    doc_id and text are read.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    path, vocabulary = path or new_path(spark, "token-store"), vocabulary or public_tokenizers.path(VOCABULARY)
    names = ["kind", "key", "n", "body", "sizes", "doc_id", "serial"]
    types = [pa.string(), pa.binary(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64()]

    def rows(batches):
        from pyspark import TaskContext

        sent: set[bytes] = set()
        serial = TaskContext.get().partitionId() << 40
        for b in spans(batches):
            out: list[tuple] = []
            for doc_id, ids in zip(b["doc_id"].to_pylist(), encode_texts(texts_of(b["text"]), vocabulary), strict=True):
                parts = chunks_of(np.append(ids, np.uint32(END)).astype("<u4"))
                digests = [digest(p.tobytes()) for p in parts]
                root = merkle_root(digests)
                for name, p in zip(digests, parts, strict=True):
                    if name not in sent:
                        sent.add(name)
                        out.append(("chunk", name, len(p), pack(p), None, None, None))
                if root not in sent:
                    sent.add(root)
                    out.append(("recipe", root, len(ids) + 1, b"".join(digests), np.array([len(p) for p in parts], dtype="<u4").tobytes(), None, None))
                serial += 1
                out.append(("document", root + serial.to_bytes(8, "big"), len(ids) + 1, None, None, doc_id, serial))
            if len(sent) > 500_000:
                sent.clear()
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), types, strict=True)], names)

    schema = "kind string, key binary, n long, body binary, sizes binary, doc_id long, serial long"
    coded = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(rows, schema)
    coded.repartition("kind", "key").dropDuplicates(["kind", "key"]).write.partitionBy("kind").option("compression", "zstd").parquet(f"{path}/chunks")
    order_documents(spark, path)
    return path


def order_documents(spark: SparkSession, path: str) -> None:
    """Writes documents/ in ascending doc_id order, manifest/ and store/."""
    found = read_kind(spark, path, "document").select("doc_id", "serial", F.substring("key", 1, 16).alias("root"), "n")
    ordered = found.repartitionByRange("doc_id", "serial").sortWithinPartitions("doc_id", "serial")

    def placed(batches):
        from pyspark import TaskContext

        part, row, place = TaskContext.get().partitionId(), 0, 0
        for b in batches:
            n = b.column("n").to_numpy()
            after = place + np.cumsum(n)
            columns = [b.column("doc_id"), b.column("root"), b.column("n"), pa.array(np.full(len(n), part, np.int32)), pa.array(row + np.arange(len(n))), pa.array(after - n)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "root", "n", "part", "row", "place"])
            row, place = row + len(n), int(after[-1]) if len(n) else place

    ordered.select("doc_id", "root", "n").mapInArrow(placed, "doc_id long, root binary, n long, part int, row long, place long").write.parquet(f"{path}/documents")
    parts_of(spark.read.parquet(f"{path}/documents")).write.parquet(f"{path}/manifest")
    m = spark.read.parquet(f"{path}/manifest")
    m.agg(F.count(F.lit(1)).alias("n_parts"), joined_root("part", "root").alias("root")).write.parquet(f"{path}/store")


def joined_root(place: str, root: str) -> Column:
    """The root over ``root`` in the order of ``place``."""
    return F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(place, root))), lambda x: x[root]), ","), 256)


def parts_of(documents: DataFrame) -> DataFrame:
    """part, n_documents, n_tokens, root: a Merkle tree over blocks of BLOCK documents, a row a part. No group is larger than a block or the blocks of a part."""
    leaf = F.sha2(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.hex("root"), "n", "place"), 256)
    blocks = documents.select("part", F.floor(F.col("row") / BLOCK).alias("block"), "row", "n", leaf.alias("leaf"))
    blocks = blocks.groupBy("part", "block").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"), joined_root("row", "leaf").alias("leaf"))
    return blocks.groupBy("part").agg(F.sum("k").alias("n_documents"), F.sum("n").alias("n_tokens"), joined_root("block", "leaf").alias("root"))


def read_kind(spark: SparkSession, path: str, kind: str) -> DataFrame:
    schema = "key binary, n long, body binary, sizes binary, doc_id long, serial long, kind string"
    return spark.read.schema(schema).parquet(f"{path}/chunks").filter(F.col("kind") == kind)


def starts(spark: SparkSession, path: str) -> DataFrame:
    """part, the ids of all parts before it, after the check of documents/ against manifest/ and store/.

    The driver holds one row a part: at most the partitions of one exchange.
    """
    order = lambda df: df.orderBy("part").collect()
    written, store = order(spark.read.parquet(f"{path}/manifest")), spark.read.parquet(f"{path}/store").first()
    if order(parts_of(spark.read.parquet(f"{path}/documents"))) != written:
        raise ValueError("the documents are not those of the manifest")
    if store is None or store["n_parts"] != len(written) or store["root"] != hashlib.sha256(",".join(r["root"] for r in written).encode()).hexdigest():
        raise ValueError("the manifest is damaged")
    before, rows = 0, []
    for r in written:
        rows.append((r["part"], before))
        before += r["n_tokens"]
    return spark.createDataFrame(rows, "part int, before long")


def read_checked(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the store's files.

    Each chunk is read once: its ids are unpacked, their digest must be its name, and their CRC-32 is taken.
    A recipe's Merkle root must be its name, its chunks must all be there, and its CRC-32 is put together
    from theirs, so no ids are sent anywhere. The documents must be those of the manifest. A failed check stops the query.
    """

    def verified(batches):
        for b in batches:
            crc = []
            for key, n, body in zip(b["key"], b["n"], b["body"], strict=True):
                data = unpack(bytes(body)).tobytes()
                if digest(data) != bytes(key) or len(data) != 4 * n:
                    raise ValueError(f"chunk {bytes(key).hex()} is damaged")
                crc.append(zlib.crc32(data))
            yield pd.DataFrame({"digest": b["key"], "crc": np.array(crc, dtype=np.int64)})

    def uses(batches):
        for b in batches:
            roots, digests, after, count, whole = [], [], [np.zeros(0, np.int64)], [], []
            for root, n, names, sizes in zip(b["key"], b["n"], b["body"], b["sizes"], strict=True):
                parts = [bytes(names[i : i + 16]) for i in range(0, len(names), 16)]
                size = np.frombuffer(sizes, dtype="<u4").astype(np.int64)
                if merkle_root(parts) != bytes(root) or size.sum() != n:
                    raise ValueError(f"recipe {bytes(root).hex()} is damaged")
                roots += [root] * len(parts)
                digests += parts
                after.append(4 * (n - np.cumsum(size)))
                count += [len(parts)] * len(parts)
                whole += [n] * len(parts)
            yield pd.DataFrame({"root": roots, "digest": digests, "after": np.concatenate(after), "parts": count, "n": whole})

    def shifted(batches):
        for b in batches:
            yield pd.DataFrame({"root": b["root"], "crc": crc_shift(b["crc"].to_numpy(), b["after"].to_numpy()).astype(np.int64), "parts": b["parts"], "n": b["n"]})

    chunks = read_kind(spark, path, "chunk").select("key", "n", "body").mapInPandas(verified, "digest binary, crc long")
    used = read_kind(spark, path, "recipe").select("key", "n", "body", "sizes").mapInPandas(uses, "root binary, digest binary, after long, parts long, n long")
    whole = used.join(chunks, "digest").select("root", "crc", "after", "parts", "n").mapInPandas(shifted, "root binary, crc long, parts long, n long")
    whole = whole.groupBy("root").agg(F.bit_xor("crc").alias("ids_crc32"), F.count(F.lit(1)).alias("found"), F.max("parts").alias("parts"), F.max("n").alias("whole"))
    whole = materialise(whole, "recipes")
    documents = spark.read.parquet(f"{path}/documents").join(F.broadcast(starts(spark, path)), "part")
    out = documents.join(whole, "root", "left")
    sound = F.coalesce((F.col("found") == F.col("parts")) & (F.col("whole") == F.col("n")), F.lit(False))
    return out.select("doc_id", (F.col("before") + F.col("place")).alias("start"), F.when(sound, F.col("n")).otherwise(F.raise_error(F.lit("a document's chunks are missing")).cast("long")).alias("n_tokens"), "ids_crc32")


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, ids (array<int>): the documents themselves, a row a row written; the manifest is checked."""

    def uses(batches):
        for b in batches:
            for root, names in zip(b["key"], b["body"], strict=True):
                parts = [bytes(names[i : i + 16]) for i in range(0, len(names), 16)]
                yield pd.DataFrame({"root": root, "digest": parts, "at": np.arange(len(parts))})

    @F.pandas_udf("array<int>")
    def joined(bodies: pd.Series) -> pd.Series:
        return pd.Series([np.concatenate([unpack(bytes(x["body"])) for x in sorted(b, key=lambda x: x["at"])]).astype(np.int32) for b in bodies])

    used = read_kind(spark, path, "recipe").select("key", "body").mapInPandas(uses, "root binary, digest binary, at long")
    chunks = read_kind(spark, path, "chunk").select(F.col("key").alias("digest"), "body")
    recipes = used.join(chunks, "digest").groupBy("root").agg(F.collect_list(F.struct("at", "body")).alias("bodies")).select("root", joined("bodies").alias("ids"))
    documents = spark.read.parquet(f"{path}/documents").join(F.broadcast(starts(spark, path)), "part")
    return documents.join(recipes, "root").select("doc_id", (F.col("before") + F.col("place")).alias("start"), "ids")
