"""Words and their hashes, as numpy arrays.  Words are split at ASCII white space (bytes.split() splits at exactly 0x09-0x0D and 0x20)."""

from __future__ import annotations

import numpy as np
from xxhash import xxh64_intdigest

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Keeps 0-9, a-z and bytes of 0x80 and more, lowers A-Z, makes all others spaces.
LETTERS = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))

MIX = np.uint64(0x9E3779B97F4A7C15)
MIX2 = np.uint64(0xBF58476D1CE4E5B9)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose output bits all depend on all input bits."""
    h = (h ^ (h >> np.uint64(32))) * MIX
    h = (h ^ (h >> np.uint64(29))) * MIX2
    return h ^ (h >> np.uint64(32))


def hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxh64_intdigest, words), np.uint64, len(words))


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n words; none if there are fewer."""
    m = len(h) - n + 1
    if m <= 0:
        return h[:0]
    out = h[:m].copy()
    for i in range(1, n):
        out = mix(out) + h[i : m + i]
    return mix(out)


def shingles(text: str | None, n: int) -> np.ndarray:
    """The sorted distinct hashes of a text's runs of n lower-cased words (A-Z); with fewer words, of the whole sequence."""
    h = hashes((text or "").encode().translate(LOWER).split())
    if not len(h):
        return h
    if len(h) < n:
        return grams(h, len(h)) ^ np.uint64(len(h))
    return np.unique(grams(h, n))
