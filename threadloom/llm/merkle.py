"""A Merkle manifest of a dataset: a tree over each source's rows, and one over the sources.

Leaves get their index by row_number within ranges of (source, doc_id), to which the ranges before add their
counts, so that no source meets in one task. Each level divides the indices by the fanout; grouped,
sorted child arrays are hashed into their parents, and written as one table a level. Proofs come down the same
tables: a join of each level appends the siblings of its nodes to what their parents have, so the rows that
all joins move are half as many again as the leaves.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from threadloom.llm.common import materialise

#: Nodes that a parent has at most.
FANOUT = 3
#: The columns that a leaf covers, in order.
COVERED = ("doc_id", "source", "lang", "n_chars", "text")


def encoded(columns: list[Column]) -> Column:
    """Every value as its length in bytes, a colon and itself, '-' for a null, one after the other."""
    one = lambda c: F.when(c.isNull(), "-").otherwise(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c))
    return F.concat(*[one(c.cast("string")) for c in columns])


def digest(text: Column) -> Column:
    """SHA-256 in 32 bytes."""
    return F.unhex(F.sha2(text, 256))


def hexed(digests: Column) -> Column:
    return F.lower(F.hex(digests))


def tampered(doc_id: Column) -> Column:
    """Whether a document's text is altered in the trial: an even CRC-32 of its decimal id; no id, no trial."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 2 == 0, F.lit(False))


def ranked(rows: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """rows with idx (from 0, in order within their group, nulls first) and size (the group's rows).

    Rows are dealt by ranges of group and order, equal ones by their place of arrival, so a group may lie in many
    ranges; row_number counts within each, and the counts of the ranges before are added.
    """
    placed = rows.withColumn("__tie", F.monotonically_increasing_id())
    placed = placed.repartitionByRange(*group, *order, "__tie").withColumn("range", F.spark_partition_id()).drop("__tie")
    placed = materialise(placed, "ranges")
    counts = placed.groupBy(*group, "range").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy(*group).orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # a row for each range of a group
    starts = counts.select(*[F.col(g).alias(f"__{g}") for g in group], F.col("range").alias("__range"), before.alias("__start"), F.sum("n").over(W.partitionBy(*group)).alias("size"))
    same = F.col("range") == F.col("__range")
    for g in group:
        same &= F.col(g).eqNullSafe(F.col(f"__{g}"))
    within = F.row_number().over(W.partitionBy(*group, "range").orderBy(*order))
    return placed.join(starts, same).withColumn("idx", F.col("__start") + within - 1).drop("range", "__range", "__start", *[f"__{g}" for g in group])


@dataclass
class Tree:
    """Trees of the same depth or less, by name: their inner levels and tops.

    levels[k]: tree, parent, size (of level k), kids array<struct<idx, digest, ...>>; tops[k]: tree, digest of those whose
    level k is a single node.
    """

    levels: list[DataFrame]
    tops: list[DataFrame]


def climb(nodes: DataFrame, largest: int, fanout: int, carried: list[str], name: str) -> Tree:
    """From nodes (tree, idx, size, digest, ...) to the tops; ``largest`` is the greatest size. The first level's children carry columns along."""
    levels, tops, columns = [], [nodes.filter("size = 1")], ["idx", "digest", *carried]
    while largest > 1:
        kids = F.sort_array(F.collect_list(F.struct(*columns))).alias("kids")  # never more than the fanout
        parents = nodes.filter("size > 1").groupBy("tree", F.floor(F.col("idx") / fanout).alias("parent")).agg(F.max("size").alias("size"), kids)
        levels.append(materialise(parents, f"{name}-{len(levels)}"))
        above = F.array_join(F.transform("kids", lambda k: hexed(k["digest"])), "")
        nodes = levels[-1].select("tree", F.col("parent").alias("idx"), F.ceil(F.col("size") / fanout).alias("size"), digest(above).alias("digest"))
        columns, largest = ["idx", "digest"], -(-largest // fanout)
        tops.append(nodes.filter("size = 1").select("tree", "idx", "digest"))
    return Tree(levels, tops)


PATH = "array<struct<before:binary,after:binary>>"


def descend(tree: Tree, above: DataFrame, carried: list[str]) -> DataFrame:
    """tree, idx, digest, path and what ``above`` (tree, path, ...) says of each leaf's tree, with the carried columns.

    path: the siblings to the left and right on every level, from the leaf up, then the path of ``above``.
    """
    more = [c for c in above.columns if c not in ("tree", "path")]
    a = above.select(F.col("tree").alias("__tree"), "path", *more)
    top = lambda k: tree.tops[k].join(a, F.col("tree").eqNullSafe(F.col("__tree"))).drop("__tree")
    join = lambda xs: F.aggregate(xs, F.lit(b""), lambda s, x: F.concat(s, x["digest"]))
    nodes = top(len(tree.levels))
    for k in reversed(range(len(tree.levels))):
        up = nodes.select(F.col("tree").alias("__tree"), F.col("idx").alias("__idx"), "path", *more)
        down = tree.levels[k].join(up, F.col("tree").eqNullSafe(F.col("__tree")) & (F.col("parent") == F.col("__idx"))).select("tree", "kids", "path", *more, F.posexplode("kids").alias("at", "kid"))
        beside = F.struct(join(F.slice("kids", F.lit(1), F.col("at"))).alias("before"), join(F.slice("kids", F.col("at") + 2, F.size("kids"))).alias("after"))
        own = carried if k == 0 else []
        down = down.select("tree", "kid.idx", "kid.digest", *[F.col(f"kid.{c}").alias(c) for c in own], F.concat(F.array(beside), "path").alias("path"), *more)
        nodes = down.unionByName(top(k).select(*down.columns))
    return nodes


@dataclass
class Manifest:
    """A tree for each source, the tree over their subroots (its nodes carry the source's name), and the root (None without rows)."""

    sources: Tree
    top: Tree
    root: str | None


def build(docs: DataFrame, covered: tuple[str, ...] = COVERED, fanout: int = FANOUT) -> Manifest:
    """The manifest of ``docs`` (doc_id, source, and what the leaves cover). Only these columns are read.

    Rows of a source are ordered by doc_id (nulls first), equal ids by their leaves; a null source is one of its
    own. Beside each leaf stands what it would be with its text's line ends deleted, where ``tampered`` says so.
    """
    own = {c: F.col(c) for c in covered}
    changed = encoded(list((own | {"text": F.translate("text", "\n", "")}).values()))
    leaves = docs.select(F.col("source").cast("string").alias("tree"), "doc_id", digest(encoded(list(own.values()))).alias("digest"), F.when(tampered(F.col("doc_id")) & F.contains("text", F.lit("\n")), digest(changed)).alias("changed"))
    leaves = materialise(ranked(leaves, ["tree"], ["doc_id", "digest"]), "leaves")
    largest = leaves.agg(F.max("size")).first()[0] or 0
    sources = climb(leaves, largest, fanout, ["doc_id", "changed"], "level")
    subroots = sources.tops[0].select("tree", "digest")
    for t in sources.tops[1:]:
        subroots = subroots.unionByName(t.select("tree", "digest"))
    nodes = materialise(ranked(subroots.withColumnRenamed("tree", "source"), [], ["source"]).withColumn("tree", F.lit("")), "subroots")
    top = climb(nodes, nodes.agg(F.max("size")).first()[0] or 0, fanout, ["source"], "top")
    root = top.tops[-1].select(hexed(F.col("digest"))).first()
    return Manifest(sources, top, root and root[0])


def proofs(m: Manifest) -> DataFrame:
    """doc_id, leaf, changed, subroot (digests), path: one row a row of the dataset."""
    start = m.top.tops[0].sparkSession.range(1).select(F.lit("").alias("tree"), F.array().cast(PATH).alias("path"))
    above = descend(m.top, start, ["source"]).select(F.col("source").alias("tree"), "path", F.col("digest").alias("subroot"))
    above = materialise(above, "subroot-paths")  # a row a source; every level asks it
    return descend(m.sources, above, ["doc_id", "changed"]).select("doc_id", F.col("digest").alias("leaf"), "changed", "subroot", "path")


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf (hexadecimal) and the siblings of its path lead to."""
    return F.aggregate(path, leaf, lambda h, x: F.sha2(F.concat(hexed(x["before"]), h, hexed(x["after"])), 256))


def verify(docs: DataFrame, covered: tuple[str, ...] = COVERED, fanout: int = FANOUT) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified: one row a row of ``docs``.

    folded_root comes from the altered leaf where the trial alters the text. Null columns are a '-' of their leaf, empty and
    very long texts are leaves like any other, repeated rows are leaves each, columns of other names are not read. An
    empty table gives an empty result.
    """
    m = build(docs, covered, fanout)
    p = proofs(m)
    leaf, used = hexed(F.col("leaf")), hexed(F.coalesce("changed", "leaf"))
    siblings = F.array_join(F.transform("path", lambda x: hexed(F.concat(x["before"], x["after"]))), "")
    out = p.select("doc_id", leaf.alias("leaf"), hexed(F.col("subroot")).alias("subroot"), F.lit(m.root).cast("string").alias("root"), F.sha2(siblings, 256).alias("proof_sha256"), fold(used, F.col("path")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
