"""Splitting text by the byte-level pattern, with the work per distinct piece done once.

A text is cut at single spaces. Such a cut never falls inside a match of the pattern, unless the space
stands between white space (or at the end after white space); texts with that are matched as a whole.
Between cuts the same pieces come again and again, so the bytes of their ids are kept, in a bounded cache. A
batch is cut and its distinct pieces are found by Arrow, and the texts' bytes are gathered by numpy.
"""

from __future__ import annotations

import gc
import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex

PATTERN = regex.compile(public_tokenizers.PATTERN)
#: A space with white space on both sides, or after white space at the end. The class holds what either library calls white space.
_UNSAFE = re.compile(r" (?<=[\s\x85᠎​] )(?=[\s\x85᠎​]|\Z)")
_PLAIN_END = frozenset(".,;:!?")
#: Longer pieces are not kept.
LONGEST_KEPT = 64
#: Bytes of Arrow batches that are put together before their distinct pieces are encoded, about.
SPAN = 4 << 20


def spans(batches: Iterable[pa.RecordBatch], size: int = SPAN) -> Iterator[pa.Table]:
    """The batches put together into tables of at least ``size`` bytes, but for the last."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        held.append(b)
        if sum(x.nbytes for x in held) >= size:
            yield pa.Table.from_batches(held)
            held = []
    if held:
        yield pa.Table.from_batches(held)


def texts_of(column: pa.ChunkedArray) -> list[str]:
    """A column of texts as strings, null as an empty one."""
    return pc.fill_null(column.cast(pa.large_string()), "").to_numpy().tolist()


def matches(text: str) -> list[str]:
    return PATTERN.findall(text)


class PieceCache:
    """Bytes of the ids of whole texts, from a function that gives the bytes (4 or a multiple for each match) of many matches at once."""

    def __init__(self, encode: Callable[[list[str]], list[bytes]], limit: int = 400_000):
        self.encode, self.limit = encode, limit
        self.words: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def _words(self, words: Iterable[str]) -> dict[str, bytes]:
        """Bytes of matches."""
        wanted = set(words)
        out = {w: self.words[w] for w in wanted if w in self.words}
        new = [w for w in wanted if w not in out]
        for w, b in zip(new, self.encode(new), strict=True):
            out[w] = b
            if len(w) <= LONGEST_KEPT:
                self.words[w] = b
        return out

    def _pieces(self, pieces: list[str]) -> list[bytes]:
        """Bytes of distinct pieces, each with the space before it."""
        kept = self.pieces
        found = list(map(kept.get, pieces))
        stems, ended, other = set(), [], []
        for p, b in zip(pieces, found):
            if b is not None:
                continue
            if p.isalpha():
                stems.add(p)
            elif p[-1:] in _PLAIN_END and (stem := p[:-1]).isalpha():
                ended.append(p)
                if stem not in kept:
                    stems.add(stem)
            else:
                other.append(p)
        new = list(stems)
        fresh = dict(zip(new, self.encode([" " + p for p in new]), strict=True))
        split = {p: matches(" " + p) for p in other}
        word = self._words([*_PLAIN_END, *(w for ws in split.values() for w in ws)])
        for p in ended:
            stem = p[:-1]
            fresh[p] = (fresh[stem] if stem in fresh else kept[stem]) + word[p[-1]]
        for p, ws in split.items():
            fresh[p] = b"".join([word[w] for w in ws])
        out = [fresh[p] if b is None else b for p, b in zip(pieces, found)]
        kept.update((p, b) for p, b in fresh.items() if len(p) <= LONGEST_KEPT)
        return out

    def texts(self, texts: list[str]) -> list[bytes]:
        """The bytes of the ids of each text."""
        collects = gc.isenabled()
        gc.disable()  # millions of small objects without cycles
        try:
            return self._texts(texts)
        finally:
            if collects:
                gc.enable()

    def _texts(self, texts: list[str]) -> list[bytes]:
        if len(self.words) > self.limit:
            self.words.clear()
        if len(self.pieces) > self.limit:
            self.pieces.clear()
        safe = [i for i, t in enumerate(texts) if not _UNSAFE.search(t)]
        parts = pc.split_pattern(pa.array([texts[i] for i in safe], type=pa.large_string()), " ")
        flat, offsets = parts.flatten(), np.asarray(parts.offsets, dtype=np.int64)
        first = np.zeros(len(flat), dtype=bool)
        first[offsets[:-1]] = True
        heads = texts.copy()
        for i, t in zip(safe, flat.filter(pa.array(first)).to_numpy(zero_copy_only=False).tolist(), strict=True):
            heads[i] = t
        split = [matches(t) for t in heads]
        word = self._words(w for ws in split for w in ws)
        out = [b"".join([word[w] for w in ws]) for ws in split]
        pieces = flat.filter(pa.array(~first)).dictionary_encode()
        if len(pieces):
            table = self._pieces(pieces.dictionary.to_numpy(zero_copy_only=False).tolist())
            sizes = np.array([len(b) // 4 for b in table], dtype=np.int64)
            starts = np.cumsum(sizes) - sizes
            code = np.asarray(pieces.indices)
            ends = np.cumsum(sizes[code])
            ids = np.frombuffer(b"".join(table), dtype="<u4")
            kind = np.int32 if max(ends[-1], len(ids)) < 1 << 31 else np.int64
            place = np.repeat((starts[code] - ends + sizes[code]).astype(kind), sizes[code])
            place += np.arange(ends[-1], dtype=kind)
            ids = ids[place]
            places = np.r_[0, ends][offsets - np.arange(len(offsets))]
            for i, s, e in zip(safe, places[:-1].tolist(), places[1:].tolist(), strict=True):
                out[i] += ids[s:e].tobytes()
        return out
