"""Content-defined cuts, checksums of parts put together, and Merkle roots."""

from __future__ import annotations

import hashlib

import numpy as np

#: Bytes of a digest.
DIGEST = 16


def digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=DIGEST).digest()


def gear_table(n: int, seed: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """n pseudo-random 64-bit words: the splitmix64 sequence."""
    z = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(seed)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def gear_hashes(words: np.ndarray) -> np.ndarray:
    """The gear hash h = 2 h + word over a window of 16, at every place: windows of 1, 2, 4, 8 are doubled."""
    h = words
    for width in (1, 2, 4, 8):
        new = h.copy()
        new[width:] += h[:-width] << np.uint64(width)
        h = new
    return h


def cuts(words: np.ndarray, bits: int, least: int, most: int) -> list[int]:
    """Ends of chunks: after a place whose hash has its ``bits`` bits below bit 16 all 0, at least ``least`` and at most ``most`` apart."""
    n = len(words)
    if n <= least:
        return [n] if n else []
    mask = np.uint64(((1 << bits) - 1) << (16 - bits))
    out, last = [], 0
    for e in (np.flatnonzero((gear_hashes(words) & mask) == 0) + 1).tolist():
        while e - last > most:
            last += most
            out.append(last)
        if e - last >= least and e < n:
            out.append(e)
            last = e
    while n - last > most:
        last += most
        out.append(last)
    return [*out, n]


def merkle_root(leaves: list[bytes]) -> bytes:
    """Pairs hashed level by level (prefixes tell leaves, inner nodes and the count apart); an odd one moves up."""
    level = [digest(b"\x00" + x) for x in leaves]
    while len(level) > 1:
        level = [digest(b"\x01" + level[i] + level[i + 1]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return digest(b"\x02" + len(leaves).to_bytes(8, "little") + b"".join(level))


def _zero_bytes() -> list[np.ndarray]:
    """For each k the table, by byte and its place, of what 2**k zero bytes make of a CRC-32's register."""
    poly = 0xEDB88320
    one_bit = [poly if i == 0 else 1 << (i - 1) for i in range(32)]
    apply = lambda m, x: int(np.bitwise_xor.reduce([m[i] for i in range(32) if x >> i & 1] or [0]))
    matrix = one_bit
    for _ in range(3):
        matrix = [apply(matrix, c) for c in matrix]
    out = []
    for _ in range(48):
        table = np.zeros((4, 256), dtype=np.uint32)
        for place in range(4):
            for b in range(256):
                table[place, b] = int(np.bitwise_xor.reduce([matrix[8 * place + i] for i in range(8) if b >> i & 1] or [0]))
        out.append(table)
        matrix = [apply(matrix, c) for c in matrix]
    return out


_TABLES: list[np.ndarray] = []


def crc_shift(crc: np.ndarray, after: np.ndarray) -> np.ndarray:
    """What CRC-32s of parts add to the whole's, ``after`` bytes of which follow: the whole's is their exclusive or."""
    if not _TABLES:
        _TABLES.extend(_zero_bytes())
    crc, after = crc.astype(np.uint32), after.astype(np.int64)
    for k in range(48):
        rows = np.flatnonzero(after >> k & 1)
        if len(rows):
            c, t = crc[rows], _TABLES[k]
            crc[rows] = t[0][c & 255] ^ t[1][c >> 8 & 255] ^ t[2][c >> 16 & 255] ^ t[3][c >> 24]
        elif not (after >> k).any():
            break
    return crc
