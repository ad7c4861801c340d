"""Words of texts, their hashes, and rolling hashes over runs of words."""

from __future__ import annotations

import re

import numpy as np
import xxhash

from .shared import TABLES

#: The words of a text: what white space of ASCII leaves.
words_of = re.compile(r"[^\x20\x09-\x0D]+").findall
_BASE, _SECOND = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
_MASK = (1 << 64) - 1
#: Texts bring new words without end; a table of frequent ones takes some 20 MB in each worker.
_KNOWN = 100_000
_known: dict[str, int] = {}
TABLES.append(_known.clear)


def hashes(words: list[str]) -> np.ndarray:
    """A 64-bit hash of each word; those of distinct words are kept in a bounded table."""
    if len(_known) > _KNOWN:
        _known.clear()
    for w in set(words).difference(_known):
        _known[w] = xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass"))
    return np.fromiter(map(_known.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def rolling(h: np.ndarray, n: int, second: bool = False) -> np.ndarray:
    """Hash of every ``n`` consecutive words, by doubling."""
    base = _SECOND if second else _BASE
    part, size, out, done = h, 1, None, 0
    while n:
        if n & 1:
            if out is None:
                out, done = part, size
            else:
                k = len(h) - done - size + 1
                out = part[:k] * np.uint64(pow(base, done, 1 << 64)) + out[size : size + k]
                done += size
        n >>= 1
        if n:
            k = len(part) - size
            part = part[:k] * np.uint64(pow(base, size, 1 << 64)) + part[size : size + k]
            size *= 2
    return mix(out)


def sliding_min(x: np.ndarray, n: int) -> np.ndarray:
    size = 1
    while 2 * size <= n:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[: len(x) - (n - size)], x[n - size :]) if n > size else x
