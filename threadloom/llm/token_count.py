"""Token counts by rank-synchronous merging of ragged arrays.

The distinct pre-tokens of a batch stand one after another in one numpy array of symbols. In each round
every sequence finds its lowest-rank pair, and all places of these pairs merge at once; sequences without
a pair are done. The symbols that survive are counted, and a text's count is the sum over its pre-tokens.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm.common import bound_batches
from threadloom.llm.pretokens import PieceCache

VOCABULARY = "byte_bpe_50k.json"


def byte_letters() -> list[str]:
    """The letter by which a byte-level vocabulary writes each byte: itself where it prints, else one from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class Merges:
    """Pairs with ranks, as sorted arrays."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.start = np.array([vocab[c] for c in byte_letters()], dtype=np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], dtype=np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        order = np.argsort(keys)
        self.keys, self.rank, self.made = keys[order], order.astype(np.int64), made[order]

    def look_up(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Where each pair stands in ``keys``, or -1."""
        want = left << 32 | right
        at = np.searchsorted(self.keys, want)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == want, at, -1)


NONE = np.iinfo(np.int64).max


def merge_all(merges: Merges, words: list[bytes]) -> list[np.ndarray]:
    """The ids of each word."""
    sizes = np.array([len(w) for w in words], dtype=np.int64)
    out: list[np.ndarray] = [np.empty(0, np.int64)] * len(words)
    symbols = merges.start[np.frombuffer(b"".join(words), dtype=np.uint8)]
    owner = np.repeat(np.arange(len(words)), sizes)
    while len(symbols):
        inner = owner[:-1] == owner[1:]
        at = np.full(len(symbols), -1, dtype=np.int64)
        at[:-1][inner] = merges.look_up(symbols[:-1][inner], symbols[1:][inner])
        rank = np.where(at >= 0, merges.rank[at], NONE)
        heads = np.flatnonzero(np.r_[True, ~inner])
        lowest = np.minimum.reduceat(rank, heads)
        lengths = np.diff(np.r_[heads, len(symbols)])
        done = np.repeat(lowest == NONE, lengths)
        if done.any():
            for h, n in zip(heads[lowest == NONE], lengths[lowest == NONE], strict=True):
                out[owner[h]] = symbols[h : h + n].copy()
            keep = ~done
            symbols, owner, at, rank = symbols[keep], owner[keep], at[keep], rank[keep]
            lowest, lengths = lowest[lowest != NONE], lengths[lowest != NONE]
            if not len(symbols):
                break
        hit = rank == np.repeat(lowest, lengths)
        if (hit[:-1] & hit[1:]).any():  # of places that overlap (a run of one symbol) every other one counts, from the left
            places = np.flatnonzero(hit)
            first = np.r_[True, np.diff(places) > 1]
            since = np.arange(len(places)) - np.flatnonzero(first)[np.cumsum(first) - 1]
            hit[places[since % 2 == 1]] = False
        symbols = np.where(hit, merges.made[at], symbols)
        keep = np.r_[True, ~hit[:-1]]
        symbols, owner = symbols[keep], owner[keep]
    return out


@lru_cache(maxsize=4)
def counter(path: str) -> tuple[Merges, PieceCache]:
    merges = Merges(path)

    def encode(words: list[str]) -> list[bytes]:
        return [len(x).to_bytes(4, "little") for x in merge_all(merges, [w.encode() for w in words])]

    return merges, PieceCache(encode)


def count_texts(texts: list[str | None], path: str) -> list[int]:
    """Tokens of each text; a special token's string inside it is one token."""
    merges, cache = counter(path)
    texts = ["" if t is None else t for t in texts]
    special = np.zeros(len(texts), np.int64)
    parts, owner = [], []
    for i, t in enumerate(texts):
        own = [t]
        for s in merges.special:
            cut = [p.split(s) for p in own]
            special[i] += sum(len(c) - 1 for c in cut)
            own = [p for c in cut for p in c]
        parts += own
        owner += [i] * len(own)
    for i, b in zip(owner, cache.texts(parts), strict=True):
        special[i] += np.frombuffer(b, dtype="<u4").sum(dtype=np.int64)
    return special.tolist()


def count_tokens(docs: DataFrame, limit: int = 512, path: str | None = None) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit: one row a row of ``docs``; a null text counts as an empty one.

    Only doc_id and text are read; repeated rows give repeated rows.
    """
    path = path or public_tokenizers.path(VOCABULARY)
    bound_batches(docs.sparkSession)

    @F.pandas_udf("long")
    def tokens(text: pd.Series) -> pd.Series:
        return pd.Series(count_texts(text.tolist(), path), dtype="int64")

    text = F.coalesce(F.col("text"), F.lit(""))
    n = docs.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), tokens.asNondeterministic()(text).alias("n_tokens"))
    return n.withColumn("over_limit", F.col("n_tokens") > limit)
