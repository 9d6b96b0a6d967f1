"""Near-duplicates by SimHash fingerprints, linked through vantage-point trees.

Two fingerprints of 64 bits that differ in at most 3 have a half (32 bits) in which they differ in at most
1. So each half gets a vantage-point tree, searched with a radius of 1: a node splits its fingerprints by
their Hamming distance to a vantage point at a bound; by the triangle inequality two within the radius
differ by no more in that distance, so only a fingerprint whose distance is within the radius of the bound
has to stand on both sides. The tree's shape comes from a bounded sample; every fingerprint is routed
through it, to the shards in which all exact pairs are then found (on all 64 bits). A shard that is still
large is split further by a tree of its own.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.llm.common import bound_batches, materialise, unit_hash
from threadloom.llm.components import components

#: Fixed value of the contract: the hash's seed.
SEED = 42
WORDS, BITS = 3, 3
#: Fingerprints that the trees are shaped by, about, at most; those in a shard aimed at, and compared directly.
SAMPLE, SHARD, DIRECT = 60_000, 1500, 400
_BLOCK = 1 << 16


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """Of the whole text's shingles, repeats included. The words are lower-cased (A-Z) and cut at ASCII white space."""
    w = [] if text is None else text.encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return 0
    total, ones = max(1, len(w) - words + 1), np.zeros(64, dtype=np.int64)
    for s in range(0, total, _BLOCK):
        part = w[s : min(s + _BLOCK, total) + words - 1]
        if len(part) < words:
            shingles = [b" ".join(part)]
        else:
            shingles = list(map(b" ".join, zip(*[part[i:] for i in range(words)], strict=False)))
        h = np.array([xxhash.xxh64_intdigest(x, SEED) for x in shingles], dtype="<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > total, bitorder="little").view("<u8")[0])


def fingerprint_column(text: Column, words: int = WORDS) -> Column:
    """The fingerprint as a (signed) long."""

    @F.pandas_udf("long")
    def fp(text: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, words) for t in text], dtype=np.uint64).view(np.int64))

    return fp.asNondeterministic()(text)


@dataclass
class Tree:
    """Nodes in arrays. A node without children (-1) is a shard; vantage and bound are of the others."""

    vantage: np.ndarray
    bound: np.ndarray
    near: np.ndarray
    far: np.ndarray
    radius: int


def distance(x: np.ndarray, v) -> np.ndarray:
    return np.bitwise_count(x ^ v).astype(np.int16)


def split(x: np.ndarray, radius: int, tries: int = 4) -> tuple[int, int] | None:
    """The vantage point and bound (near: distance <= bound) that leave the least to compare; None if no split helps."""
    best, least = None, 0.85 * float(len(x)) ** 2
    for k in range(tries):
        v = x[(k * 2654435761) % len(x)]
        n = np.bincount(distance(x, v), minlength=66).astype(float)
        below = np.cumsum(n)
        for bound in range(64):
            near = below[bound]
            far = len(x) - below[bound] + n[max(0, bound - radius + 1) : bound + 1].sum()
            if near and below[bound] < len(x) and near * near + far * far < least:
                best, least = (int(v), bound), near * near + far * far
    return best


def build(sample: np.ndarray, leaf: float, radius: int) -> Tree:
    vantage, bound, near, far = [], [], [], []

    def add() -> int:
        for a in (vantage, bound, near, far):
            a.append(-1)
        return len(near) - 1

    todo = [(add(), np.unique(sample))]
    while todo:
        node, x = todo.pop()
        found = split(x, radius) if len(x) > leaf else None
        if found is None:
            continue
        vantage[node], bound[node], near[node], far[node] = *found, add(), add()
        d = distance(x, np.uint32(found[0]))
        todo += [(near[node], x[d <= found[1]]), (far[node], x[d > found[1] - radius])]
    return Tree(np.array([max(0, v) for v in vantage], dtype=np.uint32), np.array(bound, dtype=np.int16), np.array(near), np.array(far), radius)


def route(tree: Tree, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in x, and the shard of each; one on a boundary comes once for each side."""
    row, node = np.arange(len(x)), np.zeros(len(x), dtype=np.int64)
    rows, shards = [], []
    while len(row):
        leaf = tree.near[node] < 0
        rows.append(row[leaf])
        shards.append(node[leaf])
        row, node = row[~leaf], node[~leaf]
        d, bound = distance(x[row], tree.vantage[node]), tree.bound[node]
        near, far = d <= bound, d > bound - tree.radius
        row, node = np.r_[row[near], row[far]], np.r_[tree.near[node[near]], tree.far[node[far]]]
    return np.concatenate(rows) if rows else row, np.concatenate(shards) if shards else node


class Sets:
    """Union-find over places."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def join(self, i: int, j: int) -> None:
        a, b = self.find(i), self.find(j)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def link_shard(x: np.ndarray, half: np.ndarray, radius: int, bits: int = BITS) -> Sets:
    """Links every two of the distinct fingerprints x whose halves are within the radius and which differ in at most ``bits`` (3 at most).

    Many that share their half, or nearly, can't be told apart by it. These are dealt by each of the four bytes of their other half: of
    two that differ in at most 3 bits, one byte there is equal.
    """
    sets = Sets(len(x))
    todo = [(np.arange(len(x)), False)]
    other = (x ^ half.astype(np.uint64)) if ((x & np.uint64(0xFFFFFFFF)) == half).all() else (x << np.uint64(32))
    while todo:
        at, dealt = todo.pop()
        if len(at) > DIRECT and not dealt:
            found = split(half[at], radius)
            if found is not None:
                d = distance(half[at], np.uint32(found[0]))
                todo += [(at[d <= found[1]], False), (at[d > found[1] - radius], False)]
                continue
            for k in range(4):
                byte = (other[at] >> np.uint64(32 + 8 * k)) & np.uint64(0xFF)
                order = np.argsort(byte, kind="stable")
                todo += [(own, True) for own in np.split(at[order], np.flatnonzero(np.diff(byte[order])) + 1)]
            continue
        own = x[at]
        for s in range(0, len(at), 256):
            i, j = np.nonzero(np.bitwise_count(own[s : s + 256, None] ^ own[None, s:]) <= bits)
            for p, q in zip(at[s + i[i < j]].tolist(), at[s + j[i < j]].tolist(), strict=True):
                sets.join(p, q)
    return sets


def link(distinct: DataFrame, n: int, bits: int = BITS) -> DataFrame:
    """a, b: links whose components are those of all pairs of ``distinct`` (fp, one row each) that differ in at most ``bits`` <= 3.

    Within a shard a component's links lead to one of its members, so no group's pairs are written out.
    """
    if not 0 <= bits <= 3:
        raise ValueError("halves with a radius of 1 hold for at most 3 bits")
    sample = distinct.filter(unit_hash(F.col("fp").cast("string"), "tree") < min(1.0, SAMPLE / max(1, n))).toPandas()["fp"].to_numpy(dtype=np.int64).view(np.uint64)
    halves = lambda x: ((x & np.uint64(0xFFFFFFFF)).astype(np.uint32), (x >> np.uint64(32)).astype(np.uint32))
    sample = np.sort(sample)
    trees = [build(h, max(8.0, SHARD * len(sample) / max(1, n)), 1) for h in halves(sample)] if len(sample) else []

    def routed(batches):
        for b in batches:
            x = b["fp"].to_numpy(dtype=np.int64).view(np.uint64)
            for k, h in enumerate(halves(x)):
                row, shard = route(trees[k], h)
                yield pd.DataFrame({"shard": shard * 2 + k, "fp": x[row].view(np.int64)})

    def linked(key: tuple, b: pd.DataFrame) -> pd.DataFrame:
        x = np.unique(b["fp"].to_numpy(dtype=np.int64).view(np.uint64))
        sets = link_shard(x, halves(x)[key[0] % 2], 1, bits)
        root = np.array([sets.find(i) for i in range(len(x))], dtype=np.int64)
        own = np.flatnonzero(root != np.arange(len(x)))
        return pd.DataFrame({"a": x[own].view(np.int64), "b": x[root[own]].view(np.int64)})

    if not trees:
        return distinct.sparkSession.createDataFrame([], "a long, b long")
    return distinct.mapInPandas(routed, "shard long, fp long").groupBy("shard").applyInPandas(linked, "a long, b long")


def near_duplicates(docs: DataFrame, words: int = WORDS, bits: int = BITS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id reachable): one row a row of ``docs``.

    A null text, like one without a word, has fingerprint zero and is linked like any other. A null doc_id
    takes part in a component but is never its id, unless the component has no other. Repeated rows give
    repeated rows; extra columns are not read.
    """
    bound_batches(docs.sparkSession)
    marked = materialise(docs.select("doc_id", fingerprint_column(F.col("text"), words).alias("fp")), "fingerprints")
    smallest = materialise(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    links = materialise(link(smallest.select("fp"), smallest.count(), bits), "links")
    of = materialise(components(links, "fingerprint-links"), "members")
    member = of.join(smallest, of["node"] == smallest["fp"]).select("fp", "root", "least")
    group = member.groupBy("root").agg(F.min("least").alias("component_id"))
    linked = materialise(member.join(group, "root").select("fp", "component_id"), "groups")
    alone = smallest.join(linked.select("fp"), "fp", "left_anti").select("fp", F.col("least").alias("component_id"))
    known = materialise(linked.unionByName(alone), "classes")
    return marked.join(known, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, words: int = WORDS, bits: int = BITS) -> DataFrame:
    """The rows of ``docs``, all columns, that are the first of their group: the smallest doc_id, and one row of it.

    Rows with a null doc_id stay only where their group has no other; one of them then stays.
    """
    classes = near_duplicates(docs.select("doc_id", "text"), words, bits)
    stays = materialise(classes.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("doc_id").agg(F.count(F.lit(1)).alias("__rows")), "stays")
    # The same exchange at every size: each text is sent once. A row is one column, so that its names clash with none.
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").alias("id"))
    once = rows.join(stays.filter("__rows = 1 and doc_id is not null").select(F.col("doc_id").alias("id")).hint("merge"), "id", "left_semi").select("row.*")
    repeated = stays.filter("__rows > 1 or doc_id is null").select(F.col("doc_id").alias("__id"))
    if repeated.isEmpty():
        return once
    # Repeated ids: one row of each, chosen by its content.
    again = rows.join(repeated, F.col("id").eqNullSafe(F.col("__id")), "left_semi").withColumn("fp", fingerprint_column(F.col("row.text"), words))
    picked = again.groupBy("id", F.when(F.col("id").isNull(), F.col("fp")).alias("of")).agg(F.min_by("row", F.struct(F.xxhash64("row"), F.col("row.text"))).alias("row"))
    return once.unionByName(picked.select("row.*"))
