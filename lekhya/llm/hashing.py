"""Vectorised word hashing and n-gram hashing over whole batches of texts."""

from __future__ import annotations

from itertools import chain

import numpy as np
import pandas as pd

_KEY = "lekhya-hash-0001"


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply): spreads every input bit over the word."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def flat_hashes(words: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of a batch in one array, and the offsets at which each text starts (one more at the end)."""
    offsets = np.zeros(len(words) + 1, dtype=np.int64)
    np.cumsum([len(w) for w in words], out=offsets[1:])
    flat = np.empty(offsets[-1], dtype=object)
    flat[:] = list(chain.from_iterable(words))
    return pd.util.hash_array(flat, hash_key=_KEY, categorize=True), offsets


def gram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words starting at each position; the last n-1 positions of a text run into the next text."""
    if len(h) < n:
        return np.empty(0, dtype=np.uint64)
    m = len(h) - n + 1
    out = np.zeros(m, dtype=np.uint64)
    for k in range(n):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + h[k : k + m])
    return out
