"""Near copies: documents whose sets of five-word shingles have a Jaccard similarity of 0.8 or more, all of them.

Two steps make links, each verified by the sets of its texts. The first takes the links that vantage-point
trees find among SimHash fingerprints of the sets (simhash.link), and a few pairs from each posting list; then
more pairs from the lists that still hold several groups. The second is exact: two sets that similar share at least 0.8 n of their shingles, n the size of the larger, so
under any one order of all shingles they share COMMON among the first n - ceil(0.8 n) + COMMON of each (or
all they must share, if that is fewer); all such pairs that the first step has not put into one group are looked at, so a large group is never written out
pair by pair. The order puts shingles that a share of the texts, the same at every size, shows to be frequent
last, so that common passages make few candidates. Before texts are sent, a sketch (counts of a set's hashes by bucket) bounds
what two sets can share from above, and leaves out most pairs that are not similar. Shingles are compared by
their 64-bit hashes.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from threadloom.llm.common import bound_batches, in_filter, materialise, membership
from threadloom.llm.components import components
from threadloom.llm.simhash import SEED, link

WORDS = 5
#: The least similarity, as a fraction, so that the comparison is exact.
OVER, UNDER = 4, 5
#: Shingles that two prefixes must share.
COMMON = 3
#: One distinct text in so many counts for the order; in how many of them a shingle is frequent; frequent shingles told apart, at most.
ONE_IN, OFTEN, FREQUENT = 8, 3, 400_000
#: Pairs of a document in the first step; rounds of more pairs once the groups so far are known, a document's pairs in each, and neighbours looked at in a posting list.
LINKS, AGAIN, MORE, TRIES = 2, 1, 16, 4
#: Rows of a block of a posting list; buckets of the folded sketch that stands beside each row there; pairs whose sketches are compared at once.
LIST_BLOCK, FOLDED, AT_ONCE = 512, 128, 8192
#: Rows up to which a table of ids or fingerprints is broadcast.
SMALL = 1_000_000
_BLOCK = 1 << 16


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Distinct hashes of the text's shingles, ascending; a text of fewer words is one shingle. Words as in simhash."""
    w = [] if text is None else text.encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return np.zeros(0, dtype="<u8")
    total, found = max(1, len(w) - words + 1), []
    for s in range(0, total, _BLOCK):
        part = w[s : min(s + _BLOCK, total) + words - 1]
        own = [b" ".join(part)] if len(part) < words else map(b" ".join, zip(*[part[i:] for i in range(words)], strict=False))
        found.append(np.unique(np.array([xxhash.xxh64_intdigest(x, SEED) for x in own], dtype="<u8")))
    return found[0] if len(found) == 1 else np.unique(np.concatenate(found))


def name_of(own: np.ndarray) -> int:
    """The fingerprint of a set of shingles; zero if it is empty."""
    return xxhash.xxh64_intdigest(own.tobytes(), SEED) if len(own) else 0


def simhash_of(own: np.ndarray) -> int:
    """The SimHash of a set of shingles."""
    if not len(own):
        return 0
    ones = np.unpackbits(own.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(own), bitorder="little").view("<u8")[0])


def sketch(own: np.ndarray) -> bytes:
    """How many of a set's shingles fall into each of as many buckets (a power of two) as it has shingles; 255 is 255 or more."""
    buckets = 1 << max(0, len(own) - 1).bit_length()
    return np.minimum(np.bincount((own & np.uint64(buckets - 1)).astype(np.int64), minlength=buckets), 255).astype(np.uint8).tobytes()


def folded(own: np.ndarray) -> bytes:
    """A sketch of FOLDED buckets, whatever the set's size; 255 is 255 or more."""
    return np.minimum(np.bincount((own & np.uint64(FOLDED - 1)).astype(np.int64), minlength=FOLDED), 255).astype(np.uint8).tobytes()


def may_be_similar(n: int, x: bytes, m: int, y: bytes) -> bool:
    """Whether sketches allow a similarity of 0.8: never false for two sets that have it."""
    a, b = np.frombuffer(x, np.uint8).astype(np.int64), np.frombuffer(y, np.uint8).astype(np.int64)
    if a.max() == 255 or b.max() == 255:
        return True
    if len(a) < len(b):
        a, b = b, a
    shared = int(np.minimum(a.reshape(-1, len(b)).sum(0), b).sum())
    return UNDER * shared >= OVER * (n + m - shared)


def fingerprint_column(text: Column) -> Column:
    """The set's fingerprint as a (signed) long."""

    @F.pandas_udf("long")
    def fp(text: pd.Series) -> pd.Series:
        return pd.Series(np.array([name_of(shingles(t)) for t in text], dtype=np.uint64).view(np.int64))

    return fp.asNondeterministic()(text)


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(a) + len(b)
    shared = both - len(np.unique(np.concatenate([a, b])))
    return UNDER * shared >= OVER * (both - shared)


def frequent(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Frequent shingles, ascending, and their counts in a share of the distinct texts."""
    h = F.xxhash64("text")
    part = docs.select("text").filter(F.pmod(h, F.lit(ONE_IN)) == 0).groupBy(h.alias("h")).agg(F.first("text").alias("text")).select("text")

    def exploded(batches):
        for b in batches:
            yield pd.DataFrame({"sh": np.concatenate([shingles(t) for t in b["text"]] or [np.zeros(0, "<u8")]).view(np.int64)})

    often = part.mapInPandas(exploded, "sh long").groupBy("sh").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= OFTEN)
    top = often.orderBy(F.desc("n"), "sh").limit(FREQUENT).toPandas()
    order = np.argsort(top["sh"].to_numpy(dtype=np.int64).view(np.uint64))
    return top["sh"].to_numpy(dtype=np.int64).view(np.uint64)[order], top["n"].to_numpy(dtype=np.int64)[order]


def prefixes(docs: DataFrame) -> DataFrame:
    """doc_id, fp, n (distinct shingles), sim, sketch, folded, prefix: one row a row of ``docs``."""
    table = docs.sparkSession.sparkContext.broadcast(frequent(docs))

    def rows(batches):
        known, counts = table.value
        for b in batches:
            out = []
            for t in b.column("text").to_pylist():
                own = shingles(t)
                n, often = len(own), np.zeros(len(own), dtype=np.int64)
                if len(known) and n:
                    at = np.minimum(np.searchsorted(known, own), len(known) - 1)
                    often = np.where(known[at] == own, counts[at], 0)
                keep = min(n, n - (OVER * n + UNDER - 1) // UNDER + COMMON)
                out.append((name_of(own), n, simhash_of(own), sketch(own), folded(own), own[np.lexsort((own, often))[:keep]].view(np.int64)))
            fp, n, sim, sketches, short, first = zip(*out, strict=True) if out else [()] * 6
            signed = lambda x: pa.array(np.array(x, dtype=np.uint64).view(np.int64))
            columns = [b.column("doc_id"), signed(fp), pa.array(n, pa.int32()), signed(sim), pa.array(sketches, pa.binary()), pa.array(short, pa.binary()), pa.array(first, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "fp", "n", "sim", "sketch", "folded", "prefix"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(rows, "doc_id long, fp long, n int, sim long, sketch binary, folded binary, prefix array<long>")


def possible(n: Column, at: Column, m: Column, place: Column) -> Column:
    """Whether two sets of n and m shingles can be similar enough if one of their first COMMON common ones stands at these places."""
    most = F.least(n - at, m - place) + (COMMON - 1)
    return (UNDER * F.least(n, m) >= OVER * F.greatest(n, m)) & ((OVER + UNDER) * most >= OVER * (n + m))


def block_pairs(n: np.ndarray, at: np.ndarray, root: np.ndarray, block: np.ndarray, short: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places p, q of a list's rows with root[p] < root[q] that may be similar by sizes, places and folded sketches.

    Where the rows are of two blocks, each pair has one of each.
    """
    found, full, two = [], (short == 255).any(axis=1), block[0] != block[-1] or len(np.unique(block)) > 1
    for s in range(0, len(n), LIST_BLOCK):
        x = slice(s, s + LIST_BLOCK)
        good = root[x, None] < root[None, :]
        if two:
            good &= block[x, None] != block[None, :]
        good &= UNDER * np.minimum(n[x, None], n) >= OVER * np.maximum(n[x, None], n)
        good &= (OVER + UNDER) * (np.minimum((n - at)[x, None], n - at) + (COMMON - 1)) >= OVER * (n[x, None] + n)
        p, q = np.nonzero(good)
        p += s
        for k in range(0, len(p), AT_ONCE):
            i, j = p[k : k + AT_ONCE], q[k : k + AT_ONCE]
            shared = np.minimum(short[i], short[j]).sum(axis=1, dtype=np.int64)
            may = full[i] | full[j] | (UNDER * shared >= OVER * (n[i] + n[j] - shared))
            found.append((i[may], j[may]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, dtype=np.int64),) * 2


def list_pairs(lists: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b: the pairs of posting lists (sh, fp, n, at, root, many: the list's rows) of different roots that may be similar.

    They share COMMON shingles of their prefixes (or all they must share), and the folded sketches of ``sets``
    (fp, folded) allow it. A list is dealt in blocks of about LIST_BLOCK rows: a task compares two blocks,
    and gives only the pairs that pass, so neither a row for each pair nor a long list meets in one place.
    """
    blocks = F.ceil(F.col("many") / LIST_BLOCK).cast("int")
    dealt = lists.join(sets, "fp").withColumn("block", F.pmod(F.xxhash64("fp", "sh"), blocks).cast("int")).withColumn("k", F.explode(F.sequence(F.lit(0), blocks - 1)))
    dealt = dealt.select("sh", F.least("block", "k").alias("i"), F.greatest("block", "k").alias("j"), "block", "fp", "n", "at", "root", "folded")

    def compared(rows: pd.DataFrame) -> pd.DataFrame:
        whole = rows[["sh", "i", "j"]].to_numpy(dtype=np.int64)
        ends = np.r_[np.flatnonzero((whole[1:] != whole[:-1]).any(axis=1)) + 1, len(rows)]
        fp, n, at, root, block = (rows[c].to_numpy(dtype=np.int64) for c in ("fp", "n", "at", "root", "block"))
        short = np.frombuffer(b"".join(rows["folded"]), np.uint8).reshape(-1, FOLDED)
        out, start = [], 0
        for end in ends.tolist():
            own = slice(start, end)
            if end - start > 1 and (root[own] != root[start]).any():
                p, q = block_pairs(n[own], at[own], root[own], block[own], short[own])
                out.append((p + start, q + start))
            start = end
        p, q = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, dtype=np.int64),) * 2
        must = (OVER * np.maximum(n[p], n[q]) + UNDER - 1) // UNDER
        return pd.DataFrame({"a": fp[p], "b": fp[q], "least": np.minimum(COMMON, must)})

    def rows(batches):
        held = None
        for b in batches:
            held = b if held is None else pd.concat([held, b], ignore_index=True)
            key = held[["sh", "i", "j"]].to_numpy(dtype=np.int64)
            last = int(np.flatnonzero((key != key[-1]).any(axis=1)).max(initial=-1)) + 1 if len(held) else 0
            if last:
                yield compared(held.iloc[:last])
                held = held.iloc[last:]
        if held is not None and len(held):
            yield compared(held)

    each = dealt.repartition("sh", "i", "j").sortWithinPartitions("sh", "i", "j").mapInPandas(rows, "a long, b long, least long")
    return each.groupBy("a", "b").agg(F.count(F.lit(1)).alias("k"), F.max("least").alias("least")).filter("k >= least").select("a", "b")


def few(df: DataFrame) -> DataFrame:
    """``df`` marked for a broadcast if its counted size is small, for an exchange beyond that."""
    return F.broadcast(df) if df.count() <= SMALL else df.hint("merge")


def texts_of(docs: DataFrame, marked: DataFrame, wanted: DataFrame) -> DataFrame:
    """fp, text: at least one row for each of the wanted fingerprints. Texts are smaller than their sets."""
    ids = materialise(marked.join(wanted, "fp", "left_semi").groupBy("fp").agg(F.min("doc_id").alias("__id")).select("__id").distinct(), "ids")
    some = docs.select("doc_id", "text").join(few(ids), F.col("doc_id").eqNullSafe(F.col("__id")), "left_semi")
    return materialise(some.select(fingerprint_column(F.col("text")).alias("fp"), "text"), "texts")


def sketched(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) that the sketches of ``sets`` (fp, n, sketch) allow."""

    def rows(batches):
        for b in batches:
            good = [may_be_similar(*r) for r in zip(b["n"], b["x"], b["m"], b["y"], strict=True)]
            yield b.loc[np.array(good, dtype=bool), ["a", "b"]]

    pairs = materialise(pairs, "candidates")
    own = sets.join(few(pairs.select(F.explode(F.array("a", "b")).alias("fp")).distinct()), "fp", "left_semi")
    both = pairs.join(own.select(F.col("fp").alias("a"), "n", F.col("sketch").alias("x")), "a").join(own.select(F.col("fp").alias("b"), F.col("n").alias("m"), F.col("sketch").alias("y")), "b")
    return both.select("a", "b", "n", "x", "m", "y").mapInPandas(rows, "a long, b long")


def verified(pairs: DataFrame, docs: DataFrame, marked: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) that are similar enough, by their texts."""

    def rows(batches):
        for b in batches:
            good = [similar(shingles(x), shingles(y)) for x, y in zip(b["x"], b["y"], strict=True)]
            yield b.loc[np.array(good, dtype=bool), ["a", "b"]]

    pairs = materialise(sketched(pairs, sets), "pairs")
    texts = texts_of(docs, marked, materialise(pairs.select(F.explode(F.array("a", "b")).alias("fp")).distinct(), "paired")).dropDuplicates(["fp"])
    both = pairs.join(texts.select(F.col("fp").alias("a"), F.col("text").alias("x")), "a").join(texts.select(F.col("fp").alias("b"), F.col("text").alias("y")), "b")
    return materialise(both.select("a", "b", "x", "y").mapInPandas(rows, "a long, b long"), "links")


def tree_pairs(sets: DataFrame) -> DataFrame:
    """(a, b): pairs of sets whose SimHash fingerprints the vantage-point trees link, a star for each fingerprint and each link."""
    named = materialise(sets.groupBy("sim").agg(F.min("fp").alias("b")), "named")
    links = materialise(link(named.select(F.col("sim").alias("fp")), named.count()), "tree-links")
    same = sets.join(named, "sim").filter(F.col("fp") != F.col("b")).select(F.col("fp").alias("a"), "b")
    ends = links.join(named.select(F.col("sim").alias("a"), F.col("b").alias("x")), "a").join(named.select(F.col("sim").alias("b"), F.col("b").alias("y")), "b")
    return same.unionByName(ends.select(F.col("x").alias("a"), F.col("y").alias("b")))


def groups(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, fp) of every row, and (fp, root) of the fingerprints linked to others: root names their group."""
    bound_batches(docs.sparkSession)
    marked = materialise(prefixes(docs), "prefixes")
    copied = few(materialise(marked.groupBy("fp").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1").select("fp"), "copied"))

    def sets(*columns: str) -> DataFrame:
        """One row for each distinct set."""
        again = marked.join(copied, "fp", "left_semi").groupBy("fp").agg(*[F.first(c).alias(c) for c in columns])
        return again.unionByName(marked.join(copied, "fp", "left_anti").select("fp", *columns))

    postings = sets("n", "prefix").select("fp", "n", F.posexplode("prefix").alias("at", "sh")).repartition("sh")
    order = W.partitionBy("sh").orderBy(F.xxhash64("fp", "sh"), "fp")
    seen = postings.withColumn("other", F.lag(F.struct("fp", "n", "at")).over(order)).withColumn("next", F.lead("fp").over(order))
    shared = materialise(seen.filter("other is not null or next is not null").drop("next"), "shared")
    some = shared.filter("other is not null").filter(possible(F.col("n"), F.col("at"), F.col("other.n"), F.col("other.at")))
    some = some.groupBy("fp", F.col("other.fp").alias("b")).agg(F.count(F.lit(1)).alias("k"))
    some = some.withColumn("r", F.row_number().over(W.partitionBy("fp").orderBy(F.desc("k"), "b"))).filter(F.col("r") <= LINKS)
    some = some.select(F.col("fp").alias("a"), "b").unionByName(tree_pairs(sets("sim")))
    sketches = sets("n", "sketch")
    ids = marked.select("doc_id", "fp")
    checked = lambda pairs: verified(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), docs, ids, sketches)

    def unlinked(links: DataFrame, name: str) -> DataFrame:
        """The posting lists that hold several groups, with the group of each set."""
        member = components(links, name).select(F.col("node").alias("fp"), "root")
        rooted = shared.select("sh", "fp", "n", "at").join(member, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
        within = W.partitionBy("sh")
        return materialise(rooted.withColumn("lo", F.min("root").over(within)).withColumn("hi", F.max("root").over(within)).withColumn("many", F.count(F.lit(1)).over(within)).filter("lo < hi").drop("lo", "hi"), "unlinked")

    first = checked(some)
    for again in range(AGAIN):
        mixed = W.partitionBy("sh").orderBy(F.xxhash64("fp", "sh", F.lit(again)), "fp")
        beside = F.array(*[F.lag(F.struct("fp", "n", "at", "root"), k).over(mixed) for k in range(1, TRIES + 1)])
        near = unlinked(first, "first-links").withColumn("beside", beside).withColumn("o", F.explode("beside")).filter("o is not null").filter((F.col("root") != F.col("o.root")) & possible(F.col("n"), F.col("at"), F.col("o.n"), F.col("o.at")))
        both = F.array(F.struct("fp", F.col("o.fp").alias("b")), F.struct(F.col("o.fp").alias("fp"), F.col("fp").alias("b")))
        near = near.select(F.explode(both).alias("p")).select("p.fp", "p.b").groupBy("fp", "b").agg(F.count(F.lit(1)).alias("k"))
        near = near.withColumn("r", F.row_number().over(W.partitionBy("fp").orderBy(F.desc("k"), "b"))).filter(F.col("r") <= MORE)
        first = first.unionByName(checked(near.select(F.col("fp").alias("a"), "b")))
    # What these links have not put into one group: every such pair of a posting list.
    rest = checked(list_pairs(unlinked(first, "more-links"), sets("folded")))
    links = components(first.unionByName(rest), "all-links").select(F.col("node").alias("fp"), "root")
    return ids, materialise(links, "members")


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, that are the first of their group: the smallest doc_id, and one row of it.

    Groups are the components of the pairs of similarity 0.8 or more; texts without a word, null ones too, are
    one group. Rows with a null doc_id stay only where their group has no other; one of them then stays. A
    doc_id with several texts is told apart by its fingerprints. Very long texts are read whole, in blocks. An
    empty table gives an empty one; other columns, whatever their names, are carried along.

    A Bloom filter of the ids that go says at once which rows stay; only the others, and the few that the filter
    takes for them, are exchanged to meet the ids that stay.
    """
    marked, linked = groups(docs)
    rows = marked.join(linked, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    kept = rows.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "fp")).alias("k"))
    kept = materialise(kept.select(F.col("k.doc_id").alias("__id"), F.col("k.fp").alias("__fp")), "kept")
    many = materialise(marked.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1 or doc_id is null").select(F.col("doc_id").alias("__many")), "repeated-ids")
    alone = kept.join(many, F.col("__id").eqNullSafe(F.col("__many")), "left_anti")
    gone = marked.filter("doc_id is not null").select("doc_id").distinct().join(alone, F.col("doc_id") == F.col("__id"), "left_anti")
    words = docs.sparkSession.sparkContext.broadcast(membership(materialise(gone.select(F.xxhash64("doc_id").alias("h")), "gone")))

    @F.pandas_udf("boolean")
    def may_go(h: pd.Series) -> pd.Series:
        return pd.Series(in_filter(words.value, h.to_numpy(dtype=np.int64).view(np.uint64)), dtype=bool)

    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")  # a row is one column, so that its names clash with none
    asked = docs.select(whole, "doc_id", (F.col("doc_id").isNull() | may_go.asNondeterministic()(F.xxhash64(F.col("doc_id").cast("long")))).alias("go"))
    unsure = asked.filter("go").join(alone.select(F.col("__id").alias("doc_id")).hint("merge"), "doc_id", "left_semi")
    once = asked.filter(~F.col("go")).select("row.*").unionByName(unsure.select("row.*"))
    if many.isEmpty():
        return once
    # Repeated ids: one row of each fingerprint that stays, chosen by its content.
    again = docs.select(whole, "doc_id", "text").join(many, F.col("doc_id").eqNullSafe(F.col("__many")), "left_semi").withColumn("of", fingerprint_column(F.col("text")))
    again = again.join(kept, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("of") == F.col("__fp")), "left_semi")
    picked = again.groupBy("doc_id", "of").agg(F.min_by("row", F.struct(F.xxhash64("row"), F.col("text"))).alias("row"))
    return once.unionByName(picked.select("row.*"))
