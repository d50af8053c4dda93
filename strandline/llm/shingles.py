"""Word shingles as sorted arrays of 64-bit hashes.

Words are ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lower-cased; a document's set holds its
distinct shingles of ``width`` words, or its whole word sequence when it has fewer words.
"""

from __future__ import annotations

import numpy as np
import xxhash

from .common import U64, mix64, tidy


class Words(dict):
    """64-bit hashes of words, remembered up to a bound."""

    most = 150_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


_known = Words()


def forget() -> None:
    """Drops the words at the end of a task."""
    _known.clear()
    tidy()


def shingle_set(text: bytes, width: int) -> np.ndarray:
    """Sorted distinct shingle hashes of a UTF-8 text; empty without words."""
    # bytes.split and bytes.lower know ASCII only: just the words and letters wanted here
    words = text.lower().split()
    if not words:
        return np.zeros(0, dtype=U64)
    h = np.fromiter(map(_known.__getitem__, words), dtype=U64, count=len(words))
    n = min(width, len(h))
    with np.errstate(over="ignore"):
        out = np.full(len(h) - n + 1, n, dtype=U64)
        for k in range(n):
            out = mix64(out * U64(0x9E3779B97F4A7C15) + h[k : len(h) - n + 1 + k])
    return np.unique(out)


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    return int((b[np.minimum(at, len(b) - 1)] == a).sum())
