"""Word shingles as 64-bit hashes, for the near-duplicate operators. Words are runs without ASCII white space; A-Z are lower-cased."""

from __future__ import annotations

import numpy as np
import xxhash

from loomspec.llm.common import bounded_memo

MEMO_ENTRIES = 400_000
_A, _B, _C = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that scatters them."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * _A
        x = (x ^ (x >> np.uint64(27))) * _B
    return x ^ (x >> np.uint64(31))


class WordHashes:
    """Hashes of a text's words, through a bounded table."""

    def __init__(self):
        self.memo = bounded_memo(MEMO_ENTRIES)
        self.memo.make = xxhash.xxh3_64_intdigest

    def __call__(self, text: bytes) -> np.ndarray:
        words = text.lower().split()  # of bytes: ASCII letters and ASCII white space alone
        return np.fromiter(map(self.memo.__getitem__, words), np.uint64, len(words))


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """The hash of each run of `size` words, in order; of the whole sequence where there are fewer; nothing without words."""
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    size = min(size, n)
    with np.errstate(over="ignore"):
        out = mix(words[: n - size + 1] + np.uint64(size) * _C)
        for k in range(1, size):
            out = mix(out + words[k : n - size + 1 + k] * _C)
    return out
