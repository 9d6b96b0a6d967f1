"""Byte-level BPE encoding and decoding by replaying the merges over all distinct pre-tokens of a span of texts.

A span is what a task reads, in pieces of ``pretokens.SPAN`` bytes: the pre-tokens of the whole corpus would
have to be exchanged, and their ids sent back to every text, for one replay of all. The pre-tokens stand in
one linked list of symbols. An inverted index leads from each pair of tokens that has a rank to its places.
Ranks are taken in ascending order; a merge touches its two symbols and their neighbours only, whose new
pairs enter the index. Where a new pair has a lower rank than the one being applied, the
order within that pre-token would no longer be the sequential one, so it is encoded on its own, exactly.
The same holds for a new pair of the rank being applied.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from functools import lru_cache

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.llm.common import bound_batches
from threadloom.llm.pretokens import PieceCache, spans, texts_of

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


class Ranks:
    """Tokens by rank, and the rank that two neighbouring ids merge to."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.by_bytes = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.tokens: list[bytes] = [b""] * (max(self.by_bytes.values()) + 1)
        for t, i in self.by_bytes.items():
            self.tokens[i] = t
        self.single = [self.by_bytes[bytes([b])] for b in range(256)]
        self.pairs: dict[int, int] = {}

    def pair(self, a: int, b: int) -> int:
        """The merged id, -1 without one."""
        key = a << 32 | b
        found = self.pairs.get(key)
        if found is None:
            if len(self.pairs) > 500_000:
                self.pairs.clear()
            found = self.pairs[key] = self.by_bytes.get(self.tokens[a] + self.tokens[b], -1)
        return found


def encode_one(ranks: Ranks, word: bytes) -> list[int]:
    """Sequential merging: again and again the leftmost pair of the lowest rank, by a heap over a linked list."""
    ids: list[int] = [ranks.single[b] for b in word]
    n = len(ids)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := ranks.pair(ids[i], ids[i + 1])) >= 0]
    heapq.heapify(heap)
    while heap:
        r, i, a, b = heapq.heappop(heap)
        j = after[i] if ids[i] == a else n
        if j >= n or ids[j] != b:
            continue
        ids[i], ids[j] = r, -1
        k = after[i] = after[j]
        if k < n:
            before[k] = i
            if (q := ranks.pair(r, ids[k])) >= 0:
                heapq.heappush(heap, (q, i, r, ids[k]))
        if (h := before[i]) >= 0 and (q := ranks.pair(ids[h], r)) >= 0:
            heapq.heappush(heap, (q, h, ids[h], r))
    return [x for x in ids if x >= 0]


#: In the list of symbols: the gap between words, and a symbol merged away.
GAP, GONE = -2, -1


def replay(ranks: Ranks, words: list[bytes]) -> list[list[int]]:
    """The ids of each word, all merged together."""
    whole = [ranks.by_bytes.get(w) for w in words]
    todo = [k for k, r in enumerate(whole) if r is None and len(words[k])]
    single, pair, pairs = ranks.single, ranks.pair, ranks.pairs
    ids: list[int] = []
    starts: list[int] = []
    for k in todo:
        starts.append(len(ids))
        ids += [single[b] for b in words[k]]
        ids.append(GAP)
    n = len(ids)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    index: dict[int, list[int]] = {}  # the places of each pair, by its left symbol
    of_rank: dict[int, list[int]] = {}  # the pairs of each rank: more than one can make the same token
    left: list[int] = []

    def enter(key: int, r: int, place: int) -> None:
        index[key] = [place]
        if r in of_rank:
            of_rank[r].append(key)
        else:
            of_rank[r] = [key]
            heapq.heappush(left, r)

    for i, (a, b) in enumerate(zip(ids, ids[1:])):
        if a != GAP != b:
            key = a << 32 | b
            if key in index:
                index[key].append(i)
            elif (r := pair(a, b)) >= 0:
                enter(key, r, i)
    astray: list[int] = []
    while left:
        r = heapq.heappop(left)
        keys = of_rank.pop(r)
        if len(keys) == 1:
            places, a, b = index.pop(keys[0]), keys[0] >> 32, keys[0] & 0xFFFFFFFF
            places.sort()
            todo_here = ((i, a, b) for i in places)
        else:
            todo_here = iter(sorted((i, key >> 32, key & 0xFFFFFFFF) for key in keys for i in index.pop(key)))
        for i, a, b in todo_here:
            if ids[i] != a or ids[j := after[i]] != b:
                continue
            ids[i], ids[j] = r, GONE
            k = after[i] = after[j]
            before[k] = i
            c = ids[k]
            if c >= 0:
                key = r << 32 | c
                q = pairs.get(key)
                if q is None:
                    q = pair(r, c)
                if q >= 0:
                    if q <= r:
                        astray.append(i)
                    elif key in index:
                        index[key].append(i)
                    else:
                        enter(key, q, i)
            h = before[i]
            if h >= 0 and (c := ids[h]) >= 0:
                key = c << 32 | r
                q = pairs.get(key)
                if q is None:
                    q = pair(c, r)
                if q >= 0:
                    if q <= r:
                        astray.append(i)
                    elif key in index:
                        index[key].append(h)
                    else:
                        enter(key, q, h)
    out: list[list[int]] = [[] if r is None else [r] for r in whole]
    for k, s, e in zip(todo, starts, [*starts, n][1:], strict=True):
        out[k] = [x for x in ids[s:e] if x >= 0]
    if astray:
        for at in set(np.searchsorted(np.array(starts), np.array(astray), side="right").tolist()):
            out[todo[at - 1]] = encode_one(ranks, words[todo[at - 1]])
    return out


@lru_cache(maxsize=4)
def encoder(path: str) -> tuple[Ranks, PieceCache]:
    ranks = Ranks(path)

    def encode(words: list[str]) -> list[bytes]:
        return [np.array(x, dtype="<u4").tobytes() for x in replay(ranks, [w.encode() for w in words])]

    return ranks, PieceCache(encode)


def encode_texts(texts: list[str | None], path: str) -> list[bytes]:
    """Ids as little-endian 32-bit integers."""
    return encoder(path)[1].texts(["" if t is None else t for t in texts])


def decode_ids(ids: bytes, path: str) -> bytes:
    tokens = encoder(path)[0].tokens
    return b"".join(map(tokens.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


def encode_column(text: Column, path: str | None = None) -> Column:
    """A text's ids, array<int>; a null text has those of an empty one, none."""
    path = path or public_tokenizers.path(VOCABULARY)

    @F.pandas_udf("array<int>")
    def ids(text: pd.Series) -> pd.Series:
        return pd.Series([np.frombuffer(b, dtype="<u4").astype(np.int32) for b in encode_texts(text.tolist(), path)])

    return ids(text)


def decode_column(ids: Column, path: str | None = None) -> Column:
    """The bytes of ids, binary; null for null."""
    path = path or public_tokenizers.path(VOCABULARY)

    @F.pandas_udf("binary")
    def text(ids: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else decode_ids(np.asarray(x, dtype="<u4").tobytes(), path) for x in ids])

    return text(ids)


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: every text encoded, its ids decoded again.

    A null text counts as an empty one. Only doc_id and text are read; repeated rows give repeated rows.
    """
    path = path or public_tokenizers.path(VOCABULARY)
    bound_batches(docs.sparkSession)

    def digests(batches):
        for b in spans(batches):
            ids = encode_texts(texts_of(b["text"]), path)
            columns = [[len(x) // 4 for x in ids], [hashlib.sha256(x).hexdigest() for x in ids], [hashlib.sha256(decode_ids(x, path)).hexdigest() for x in ids]]
            yield pa.RecordBatch.from_arrays([b["doc_id"].combine_chunks(), *map(pa.array, columns)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(digests, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")
