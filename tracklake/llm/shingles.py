"""Word shingles and MinHash signatures in numpy."""

from __future__ import annotations

import re

import numpy as np
import xxhash

from .common import claim

WORDS = re.compile(rb"[^\x20\x09-\x0D]+")
#: Entries of a worker's word table; it is emptied when full.
CACHE_WORDS = 400_000
LOW = np.uint64(0xFFFFFFFF)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_HASHES = _Hashes()


def hold_words() -> None:
    claim("shingles", _HASHES.clear)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads all bits."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def shingle_set(text: str | None, size: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word shingles; ASCII lower case; with fewer words, one of all of them."""
    words = WORDS.findall((text or "").encode("utf-8", "surrogatepass").lower())
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))
    n = len(h) - size + 1
    if n < 1:
        h = np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))], np.uint64)
    else:
        out = h[:n].copy()
        for i in range(1, size):
            out = mix(out) + h[i : i + n]
        h = mix(out)
    return np.unique(h)


def permutations(count: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Odd multipliers and addends of the hash functions, from a fixed seed."""
    rng = np.random.default_rng(seed)
    return rng.integers(1, 1 << 63, count, dtype=np.uint64) | np.uint64(1), rng.integers(0, 1 << 63, count, dtype=np.uint64)


def minima(values: np.ndarray, a: np.ndarray, b: np.ndarray, chunk: int = 2048) -> np.ndarray:
    """Upper 32 bits of the least value of each hash function; memory is bounded by the chunk."""
    best = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(values), chunk):
        h = values[i : i + chunk, None] * a
        h += b
        np.minimum(best, h.min(axis=0), out=best)
    return mix(best) >> np.uint64(32)
