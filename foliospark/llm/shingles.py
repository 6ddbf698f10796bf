"""Word shingles as 64-bit hashes."""

from __future__ import annotations

import numpy as np
import xxhash

#: Words whose hashes a task keeps.
CACHE = 150_000
_MUL = np.uint64(0x9E3779B97F4A7C15)
_SHIFT = np.uint64(29)


class WordHashes(dict):
    """Hashes of words (bytes), the frequent ones kept; memory is bounded by CACHE words."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) < CACHE:
            self[word] = h
        return h


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words(text: str | None) -> list[bytes]:
    """Words `[^\\x20\\x09-\\x0D]+` with A-Z lowered: what bytes.lower and bytes.split do."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def shingles(text: str | None, width: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of the `width`-word shingles; with fewer words, of the whole sequence; without words, none."""
    w = words(text)
    if not w:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, w), np.uint64, len(w))
    size = min(width, len(w))
    n = len(w) - size + 1
    acc = np.full(n, size, np.uint64)
    for j in range(size):
        acc = (acc ^ h[j : j + n]) * _MUL
        acc ^= acc >> _SHIFT
    acc = mix(acc)
    acc.sort()
    keep = np.empty(n, bool)
    keep[0] = True
    np.not_equal(acc[1:], acc[:-1], out=keep[1:])
    return acc[keep]
