"""Words, word shingles and b-bit MinHash signatures of one text, in numpy.

A word is a run of bytes outside ``[\\x20\\x09-\\x0D]`` after lower-casing A-Z. A
text with fewer words than a shingle has its whole word sequence as the one
shingle; a text without words has none.
"""

from __future__ import annotations

import numpy as np
from xxhash import xxh3_64_intdigest

BLOCK = 1024  # shingles hashed at a time; the block of 32-bit minima stays in cache


def words(text: str | None) -> list[bytes]:
    """Lower-cased words. ``bytes.lower`` and ``bytes.split`` know ASCII only, as wanted."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles."""
    found = words(text)
    if not found:
        return np.zeros(0, np.uint64)
    hashes = np.fromiter(map(xxh3_64_intdigest, found), np.uint64, len(found))
    width = min(size, len(found))
    n = len(found) - width + 1
    mixed = np.full(n, width, np.uint64)
    for i in range(width):
        mixed = (mixed ^ hashes[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    return np.unique(mixed)


class MinHash:
    """``length`` independent minima of a shingle set, the low 16 bits of each kept."""

    def __init__(self, length: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.length = length
        self.shift, self.first, self.second = (
            rng.integers(0, 2**32, length, np.uint32) | np.uint32(1) for _ in range(3)
        )

    def signature(self, shingles: np.ndarray) -> np.ndarray:
        """uint16 symbols; two sets agree in each with their Jaccard similarity as probability."""
        low = (shingles >> np.uint64(32)).astype(np.uint32) ^ shingles.astype(np.uint32)
        least = np.full(self.length, 0xFFFFFFFF, np.uint32)
        for at in range(0, len(low), BLOCK):
            h = (low[at : at + BLOCK, None] ^ self.shift) * self.first
            h ^= h >> np.uint32(15)
            h *= self.second
            np.minimum(least, h.min(axis=0), out=least)
        least ^= least >> np.uint32(16)
        return least.astype(np.uint16)
