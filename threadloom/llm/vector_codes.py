"""Vector codes: every vector as one codebook entry for each of its parts, by Lloyd's algorithm with heaps.

Vectors lie in blocks, each a row of a table in the shared folder. For every part position and entry a block
keeps a heap of the parts assigned to it, keyed by slack: the lower bound of the distance to any other entry minus
the upper bound of that to their own. When entries move, the slack of all parts of an entry falls by the same
amount: its own drift and the largest of the others. So a part's key is its slack when it was last scanned plus
the drift that its entry had seen by then, and only parts whose key the cumulative drift has passed are popped;
these are scanned exactly, in integers, and pushed to the heap of their nearest entry. A heap is a list of sorted
runs: what one round pushes is a run, and popping takes the beginnings of all. The driver holds the
codebooks, and the sums and counts of their entries, which the popped parts that moved change.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm.common import bound_batches, discard, materialise, new_path

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
#: Vectors of a block.
BLOCK = 8192
#: What bounds may be wrong by, as a share of the largest distance: doubles are far better.
SLACK = 1e-9
_STATE = "ids array<long>, labels array<string>, v binary, places binary, keys binary, runs array<int>, change array<long>"


def quantise(values: np.ndarray, scale: int) -> np.ndarray:
    return np.floor(scale * values.astype(np.float64)).astype(np.int32)


def padded(column: pa.Array, width: int, scale: int) -> np.ndarray:
    """A row for each vector; a shorter one is filled up with zeros."""
    sizes, flat = column.value_lengths().to_numpy(zero_copy_only=False), quantise(column.flatten().to_numpy(zero_copy_only=False), scale)
    if (sizes == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(sizes), width), dtype=np.int32)
    out[np.repeat(np.arange(len(sizes)), sizes), np.concatenate([np.arange(n) for n in sizes])] = flat
    return out


@dataclass
class Books:
    """entries (position, entry, component); drift (position, entry): by how much the slack of an entry's parts has fallen; tolerance of the bounds."""

    entries: np.ndarray
    drift: np.ndarray
    tolerance: float

    def moved(self, entries: np.ndarray) -> Books:
        """With new entries, and the drift that these bring."""
        step = np.sqrt(np.square(entries - self.entries).sum(-1).astype(np.float64))
        drift = self.drift.copy()
        for e in range(step.shape[1]):
            drift[:, e] += step[:, e] + np.delete(step, e, axis=1).max(axis=1, initial=0.0)
        return Books(entries, drift, self.tolerance)


class Block:
    """The vectors of a block and their heaps: heaps[position][entry] is a list of runs (keys ascending, places)."""

    def __init__(self, v: np.ndarray, shape: tuple[int, int], heaps: list | None = None):
        self.v, self.shape = v, shape
        self.heaps = heaps

    def part(self, position: int) -> np.ndarray:
        d = self.v.shape[1] // self.shape[0]
        return self.v[:, position * d : (position + 1) * d]

    def popped(self, position: int, books: Books) -> tuple[np.ndarray, np.ndarray]:
        """Places whose bounds the drift has violated, and the entry whose heap they were in (-1: none yet)."""
        if self.heaps is None:
            return np.arange(len(self.v)), np.full(len(self.v), -1)
        places, was = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for e, runs in enumerate(self.heaps[position]):
            left = []
            for keys, at in runs:
                cut = int(np.searchsorted(keys, books.drift[position, e] + books.tolerance, side="right"))
                places.append(at[:cut])
                was.append(np.full(cut, e))
                if cut < len(keys):
                    left.append((keys[cut:], at[cut:]))
            self.heaps[position][e] = left
        return np.concatenate(places), np.concatenate(was)

    def advance(self, books: Books) -> np.ndarray:
        """Brings the heaps up to the codebooks; gives what that changes in each entry's sums, and its count last."""
        positions, entries = self.shape
        change = np.zeros((positions, entries, self.v.shape[1] // positions + 1), dtype=np.int64)
        fresh = [[[] for _ in range(entries)] for _ in range(positions)]
        for s in range(positions):
            places, was = self.popped(s, books)
            x = self.part(s)[places].astype(np.int64)
            d = np.square(x[:, None, :] - books.entries[s][None]).sum(-1)
            own = d.argmin(axis=1)  # the lower index of equal ones
            two = np.sqrt(np.partition(d, 1, axis=1)[:, :2].astype(np.float64)) if entries > 1 else None
            key = books.drift[s, own] + (two[:, 1] - two[:, 0] if entries > 1 else np.inf)
            go = np.flatnonzero(own != was)
            row = np.c_[x[go], np.ones(len(go), dtype=np.int64)]
            np.add.at(change[s], own[go], row)
            left = was[go] >= 0
            np.subtract.at(change[s], was[go][left], row[left])
            for e in range(entries):
                mine = np.flatnonzero(own == e)
                order = mine[np.argsort(key[mine], kind="stable")]
                fresh[s][e] = [(key[order], places[order])] if len(order) else []
        old = self.heaps or [[[] for _ in range(entries)] for _ in range(positions)]
        self.heaps = [[old[s][e] + fresh[s][e] for e in range(entries)] for s in range(positions)]
        return change

    def codes(self) -> np.ndarray:
        out = np.zeros((len(self.v), self.shape[0]), dtype=np.int64)
        for s, heaps in enumerate(self.heaps):
            for e, runs in enumerate(heaps):
                for _, at in runs:
                    out[at, s] = e
        return out

    def stored(self) -> tuple[bytes, bytes, list[int]]:
        """places, keys, and (position, entry, length) of every run."""
        runs = [(s, e, keys, at) for s, heaps in enumerate(self.heaps) for e, own in enumerate(heaps) for keys, at in own]
        return b"".join(at.astype("<i4").tobytes() for *_, at in runs), b"".join(keys.tobytes() for *_, keys, _ in runs), [x for s, e, keys, _ in runs for x in (s, e, len(keys))]


def restored(row: dict, shape: tuple[int, int], width: int) -> Block:
    v = np.frombuffer(row["v"], dtype="<i4").reshape(-1, width)
    if row["runs"] is None:
        return Block(v, shape)
    places, keys = np.frombuffer(row["places"], dtype="<i4").astype(np.int64), np.frombuffer(row["keys"], dtype=np.float64)
    heaps, start = [[[] for _ in range(shape[1])] for _ in range(shape[0])], 0
    for s, e, n in np.array(row["runs"], dtype=np.int64).reshape(-1, 3).tolist():
        heaps[s][e].append((keys[start : start + n], places[start : start + n]))
        start += n
    return Block(v, shape, heaps)


_ARROW = pa.schema([("ids", pa.list_(pa.int64())), ("labels", pa.list_(pa.string())), ("v", pa.binary()), ("places", pa.binary()), ("keys", pa.binary()), ("runs", pa.list_(pa.int32())), ("change", pa.list_(pa.int64()))])


def _record(**row) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([{name: row.get(name) for name in _ARROW.names}], schema=_ARROW)


def blocks(kept: DataFrame, width: int, scale: int) -> DataFrame:
    """Rows of _STATE without heaps from (vec_id, label, embedding)."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            b = pa.Table.from_batches([b])
            held = b if held is None else pa.concat_tables([held, b])
            while len(held) >= BLOCK:
                yield one(held.slice(0, BLOCK))
                held = held.slice(BLOCK)
        if held is not None and len(held):
            yield one(held)

    def one(t: pa.Table) -> pa.RecordBatch:
        t = t.combine_chunks()
        return _record(ids=t["vec_id"].to_pylist(), labels=t["label"].to_pylist(), v=padded(t["embedding"].combine_chunks(), width, scale).astype("<i4").tobytes())

    return kept.mapInArrow(packed, _STATE)


def advanced(state: DataFrame, books: Books, width: int) -> DataFrame:
    """The blocks of ``state`` brought up to the codebooks, and for each task a row with the change of sums and counts."""
    shape = books.entries.shape[:2]

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            for i in range(len(b)):
                row = b.slice(i, 1).to_pylist()[0]
                block = restored(row, shape, width)
                change = block.advance(books)
                total = change if total is None else total + change
                places, keys, runs = block.stored()
                yield _record(ids=row["ids"], labels=row["labels"], v=row["v"], places=places, keys=keys, runs=runs)
        if total is not None:
            yield _record(change=total.ravel().tolist())

    return state.mapInArrow(step, _STATE)


def coded(state: DataFrame, books: Books, width: int) -> DataFrame:
    """vec_id, label, code, error by the last codebooks."""
    shape = books.entries.shape[:2]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(len(b)):
                row = b.slice(i, 1).to_pylist()[0]
                block = restored(row, shape, width)
                block.advance(books)
                codes, error = block.codes(), 0
                for s in range(shape[0]):
                    error = error + np.square(block.part(s).astype(np.int64) - books.entries[s][codes[:, s]]).sum(-1)
                yield pa.RecordBatch.from_arrays([pa.array(row["ids"], pa.int64()), pa.array(row["labels"], pa.string()), pa.array(["".join(map("{:02x}".format, c)) for c in codes.tolist()], pa.string()), pa.array(error, pa.int64())], ["vec_id", "label", "code", "error"])

    return state.mapInArrow(rows, "vec_id long, label string, code string, error long")


@dataclass
class Codes:
    """rows: vec_id, label, code, error. entries: the codebooks (position, entry, component), None without rows."""

    rows: DataFrame
    entries: np.ndarray | None

    @property
    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> Codes:
    """Codes of ``vectors`` (vec_id, embedding, label): components become floor(scale * x), each part its nearest entry's index.

    Rows whose vector is null, or holds null or non-finite components, are dropped. The codebooks begin with the
    parts of the vectors with the smallest vec_ids (null ids last, equal ids by their components), fewer if there are
    fewer. A shorter vector counts as filled up with zeros, to a width that ``parts`` divides; so does an empty one.
    Repeated rows count each. Components whose squared distances could leave 64 bits are an error, never a
    wrong number. Other columns are not read.
    """
    spark = vectors.sparkSession
    bound_batches(spark)
    kept = vectors.select("vec_id", F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    kept = kept.filter(F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))))
    longest, largest = kept.agg(F.max(F.size("embedding")), F.max(F.array_max(F.transform("embedding", F.abs)))).first()
    if longest is None:
        return Codes(kept.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error")), None)
    d = max(1, -(-longest // parts))
    width, reach = d * parts, scale * (largest or 0.0) + 1
    if reach >= 2**31 or d * (2 * reach) ** 2 >= 2**62:
        raise ValueError(f"components as large as {largest} can't be told apart in 64 bits at a scale of {scale}")
    first = kept.orderBy(F.col("vec_id").isNull(), "vec_id", "embedding").limit(entries).select("embedding").toArrow()["embedding"].combine_chunks()
    start = padded(first, width, scale).astype(np.int64).reshape(-1, parts, d).transpose(1, 0, 2)
    books = Books(start, np.zeros(start.shape[:2]), SLACK * float(np.sqrt(d) * 2 * reach))
    path = new_path(spark, "blocks")
    blocks(kept, width, scale).write.parquet(path)
    total = np.zeros((*start.shape[:2], d + 1), dtype=object)  # exact however many there are
    read = lambda p: spark.read.schema(_STATE).parquet(p)
    for _ in range(rounds):
        advanced(read(path).filter("change is null"), books, width).write.parquet(after := new_path(spark, "blocks"))
        discard(spark, path)
        path = after
        changes = read(path).filter("change is not null").select(F.posexplode("change").alias("at", "x")).groupBy("at").agg(F.sum(F.col("x").cast("decimal(28,0)")).alias("x"))
        for r in changes.collect():  # one number for each component of the codebooks
            total.reshape(-1)[r["at"]] += int(r["x"])
        new = [[[x // int(t[-1]) for x in t[:-1]] if t[-1] else c.tolist() for t, c in zip(t_s, c_s, strict=True)] for t_s, c_s in zip(total, books.entries, strict=True)]
        books = books.moved(np.array(new, dtype=np.int64))
    out = materialise(coded(read(path).filter("change is null"), books, width), "codes")
    discard(spark, path)
    return Codes(out, books.entries)


def codes_and_errors(vectors: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256: one row a kept row of ``vectors``; nulls, ties, repeats and empty tables as in ``compress``.

    label_error sums the errors of equal labels, nulls together.
    """
    c = compress(vectors)
    sums = c.rows.groupBy(F.col("label").alias("__label")).agg(F.sum("error").alias("label_error"))
    out = c.rows.join(sums, F.col("label").eqNullSafe(F.col("__label")))
    return out.select("vec_id", "code", "error", "label_error", F.lit(c.sha256 if c.entries is not None else None).cast("string").alias("codebooks_sha256"))
