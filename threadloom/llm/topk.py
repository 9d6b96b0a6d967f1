"""Exact top-k search by inner product with an impact-ordered, score-at-a-time index.

Vectors are quantised to integers. A shard of the candidates is indexed by the impact of its postings (a component of
a candidate): levels hold the postings of a band of absolute values each, the largest first. A level is added up for
a batch of queries at once, as a product of matrices. What is left of a candidate adds at most its length times the query's,
so candidates that stay below the k-th exact score known so far are proven out. When few are left, these
possible members are scored exactly; only queries with many go on to the next level.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from threadloom.llm.common import bound_batches, materialise

SCALE = 64
#: No component that is scored is larger.
LARGEST = 2.0**52
#: Candidates in a shard of the index.
SHARD = 65_536
#: Tasks aimed at: with fewer shards, each is searched in so many parts of the queries that there are about as many.
TASKS = 16
#: Queries that meet a level together. Candidates of which the best one leads its run. Share that rounding of bounds may take.
QUERIES, RUN, SLACK = 64, 64, 1e-9
#: Processing stops when at most this share of a shard's candidates is possible.
RESCORE = 0.05


def pack(vectors: pd.Series) -> pd.DataFrame:
    """v: floor(SCALE * x) as packed 64-bit integers, None for a vector with a null or non-finite component; top: the largest absolute value of SCALE * x, and 1."""
    out, top = [], []
    for v in vectors:
        x = None if v is None else SCALE * np.array([np.nan if c is None else c for c in v], dtype=np.float64)
        good = x is not None and np.isfinite(x / SCALE).all()
        top.append(1 + float(np.abs(x).max(initial=0.0)) if good else 0.0)
        out.append(np.floor(np.clip(x, -LARGEST, LARGEST)).astype("<i8").tobytes() if good else None)
    return pd.DataFrame({"v": pd.Series(out, dtype=object), "top": pd.Series(top, dtype=float)})


def unpack(packed: list[bytes], width: int) -> np.ndarray:
    """Rows of ``width`` components; a shorter vector's missing ones are 0."""
    if all(len(p) == 8 * width for p in packed):
        return np.frombuffer(b"".join(packed), dtype="<i8").reshape(len(packed), width)
    out = np.zeros((len(packed), width), dtype=np.int64)
    for i, p in enumerate(packed):
        out[i, : len(p) // 8] = np.frombuffer(p, dtype="<i8")
    return out


class Index:
    """Candidates by id, and their postings (dimension, value) in levels of falling impact: the thirds with the largest, middle and least absolute values."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, top: float):
        """top: no component is larger, of a candidate or a query."""
        order = np.argsort(ids, kind="stable")
        most = vectors.shape[1] * top * top  # no sum is larger, and whole numbers below these are exact
        self.ids, self.vectors = ids[order], vectors[order].astype("<f4" if most < 2**24 else "<f8" if most < 2**53 else "<i8")
        size = np.abs(self.vectors)
        cuts = np.unique(np.quantile(size, [1 / 3, 2 / 3], method="lower"))[::-1] if size.size else []
        bands = [size > cuts[0], *[(size <= a) & (size > b) for a, b in zip(cuts, cuts[1:], strict=False)], size <= cuts[-1]] if len(cuts) else [size >= 0]
        self.levels = [np.where(x, self.vectors, 0).astype(self.vectors.dtype) for x in bands]
        squares = [np.square(x.astype(float)).sum(axis=1) for x in self.levels]
        self.rest = [np.sqrt(sum(squares[i + 1 :], np.zeros(len(ids)))) for i in range(len(bands))]  # lengths of what the levels below hold

    def search(self, own: np.ndarray, queries: np.ndarray, k: int):
        """For each query, in no order: its id, and the ids and scores of the k best but itself, by score, then id."""
        n, few = len(self.ids), max(4 * k, int(RESCORE * len(self.ids)))
        q, lengths = queries.astype(self.vectors.dtype), np.sqrt(np.square(queries.astype(float)).sum(axis=1))
        sums, open_ = np.zeros((len(q), n), self.vectors.dtype), np.arange(len(q))
        for level, rest in zip(self.levels, self.rest, strict=True):
            sums += q[open_] @ level.T
            longest, last, later = rest.max(initial=0.0), level is self.levels[-1], []
            for at, i in enumerate(open_.tolist()):
                known, row = self.known(sums[at], own[i], q[i], k), sums[at]
                least = known - SLACK * abs(known) - 1
                reach = lengths[i] * (1 + SLACK)
                near = np.flatnonzero(row >= least - reach * longest)
                near = near[row[near] >= least - reach * rest[near]]
                if len(near) > few and not last:
                    later.append(at)
                    continue
                near = near[self.ids[near] != own[i]]
                score = (self.vectors[near] @ q[i]).astype(np.int64)
                best = np.lexsort((self.ids[near], -score))[:k]
                yield own[i], self.ids[near[best]], score[best]
            if not later:
                return
            sums, open_ = sums[later], open_[later]

    def known(self, sums: np.ndarray, own: int, q: np.ndarray, k: int) -> float:
        """An exact score that k candidates reach: the k-th best of those that lead so far. All are possible with fewer than k."""
        blocks = len(sums) // RUN
        lead = np.arange(len(sums))
        if blocks > k:  # the best of each run of candidates: k + 1 of these are k + 1 leaders
            best = sums[: blocks * RUN].reshape(blocks, RUN).max(axis=1)
            lead = np.flatnonzero(sums >= np.partition(best, blocks - k - 1)[blocks - k - 1])[: 16 * k]
        lead = lead[self.ids[lead] != own]
        if len(lead) < k:
            return -np.inf
        return float(np.partition(self.vectors[lead] @ q, len(lead) - k)[len(lead) - k])


def search(width: int, top: float, k: int):
    """Answers queries from rows (shard, part, kind, vec_id, v) sorted by these: a shard's candidates (kind 0) come first, queries follow batch by batch."""

    def found(batches):
        key, ids, vectors, index = None, [], [], None
        for b in batches:
            if not len(b):
                continue
            names = b[["shard", "part", "kind"]].to_numpy(dtype=np.int64)
            starts = np.flatnonzero(np.r_[True, (names[1:] != names[:-1]).any(axis=1)])
            for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(b)], strict=True):
                own = names[s, :2].tolist()
                if own != key:
                    key, ids, vectors, index = own, [], [], None
                part, v = b["vec_id"].to_numpy(dtype=np.int64)[s:e], unpack(b["v"].iloc[s:e].tolist(), width)
                if names[s, 2] == 0:
                    ids.append(part)
                    vectors.append(v)
                elif ids:
                    index = index or Index(np.concatenate(ids), np.concatenate(vectors), top)
                    for at in range(0, len(part), QUERIES):
                        for one, near, score in index.search(part[at : at + QUERIES], v[at : at + QUERIES], k):
                            yield pd.DataFrame({"query_id": one, "vec_id": near, "score": score})

    return found


def top_k(vectors: DataFrame, k: int = 20, every: int = 20, shard: int = SHARD, tasks: int = TASKS) -> DataFrame:
    """query_id, rank, vec_id, score: the k best other rows of each row whose vec_id is divisible by ``every``.

    Ties go to the smaller vec_id. Rows with a null vec_id or a vector that is null or holds null or
    non-finite components take no part; a shorter vector counts as filled up with zeros, an empty one scores 0. Rows that repeat an
    id are candidates each, never for a query of that id, which is answered once. Components whose products could leave
    64 bits are an error, never a wrong score. An empty table gives an empty result; other columns, whatever their names, are not read.

    A shard of candidates is indexed once in a task, to which all queries are sent; only while there are fewer shards than
    ``tasks`` are shards copied, for a part of the queries each. Each gives k rows a query at most, and these meet by query.
    """
    bound_batches(vectors.sparkSession)
    pack_column = F.pandas_udf(pack, "v binary, top double").asNondeterministic()
    packed = vectors.filter("vec_id is not null").select("vec_id", pack_column("embedding").alias("p")).select("vec_id", "p.v", "p.top").filter("v is not null")
    packed = materialise(packed, "vectors")
    n, width, top = packed.agg(F.count(F.lit(1)), F.max(F.octet_length("v")), F.max("top")).first()
    width = (width or 0) // 8
    if n and (top >= LARGEST or width * top * top >= 2.0**62):
        raise ValueError(f"components as large as {top / SCALE} have products beyond 64 bits")
    shards = max(1, -(-n // shard))
    parts = max(1, -(-tasks // shards))
    place = lambda name, parts: F.pmod(F.xxhash64("vec_id", F.lit(name)), F.lit(parts)).cast("int")
    all_ = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    candidates = packed.select(place("shard", shards).alias("shard"), all_(parts).alias("part"), F.lit(0).alias("kind"), "vec_id", "v")
    queries = packed.filter(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v"))
    queries = queries.select(all_(shards).alias("shard"), place("part", parts).alias("part"), F.lit(1).alias("kind"), "vec_id", "v")
    dealt = candidates.unionByName(queries).repartitionById(shards * parts, F.col("shard") * parts + F.col("part")).sortWithinPartitions("shard", "part", "kind")
    found = dealt.mapInPandas(search(width, top or 0.0, k), "query_id long, vec_id long, score long")
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
