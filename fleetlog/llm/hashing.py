"""Hashes of byte strings and of word runs, for whole batches at once."""

from __future__ import annotations

import hashlib
from functools import cache

import numpy as np

# Bytes of text that word hashes are computed for at a time.
PIECE = 1 << 20
# ASCII white space.
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
# Odd weight of the words in a run.
_WEIGHT = 0x9E3779B97F4A7C15


@cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd weight and of its inverse modulo 2^64."""
    weight = 0x9E3779B97F4A7C15
    inverse = pow(weight, -1, 1 << 64)
    up = np.full(n, weight, np.uint64)
    down = np.full(n, inverse, np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


@cache
def _byte_values(seed: int) -> np.ndarray:
    return np.frombuffer(b"".join(hashlib.blake2b(bytes([seed, b]), digest_size=8).digest() for b in range(256)), "<u8")


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xE9846AF9B1A615D)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xE9846AF9B1A615D)
    return x ^ (x >> np.uint64(28))


class Strings:
    """Hashes of substrings of a byte array in constant time each."""

    def __init__(self, data: np.ndarray, seed: int = 0):
        size = 1 << max(21, int(len(data) + 1).bit_length())
        up, self.down = _powers(size)
        self.sums = np.concatenate([[np.uint64(0)], np.cumsum(_byte_values(seed)[data] * up[: len(data)], dtype=np.uint64)])

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64))


def _piece_words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of a piece and where they begin."""
    space = _SPACE[data]
    begins = np.flatnonzero(~space & np.concatenate([[True], space[:-1]]))
    ends = np.flatnonzero(~space & np.concatenate([space[1:], [True]])) + 1
    return Strings(data).hash(begins, ends), begins


def word_hashes(texts: list[bytes]) -> list[np.ndarray]:
    """64-bit hashes of the words (runs of anything but ASCII white space) of each text, in order."""
    joined = b" ".join(texts)
    bounds = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    data = np.frombuffer(joined, np.uint8)
    hashes, places, start = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], 0
    while start < len(data):
        end = min(len(data), start + PIECE)
        while end < len(data) and not _SPACE[data[end]]:  # a piece ends with a word
            end += 1
        found, begins = _piece_words(data[start:end])
        hashes.append(found)
        places.append(begins + start)
        start = end
    every, at = np.concatenate(hashes), np.searchsorted(np.concatenate(places), bounds)
    return [every[a:b] for a, b in zip(at, at[1:])]


def runs(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of `width` words."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, weight = np.zeros(n, np.uint64), 1
    for k in range(width):
        out += words[k : k + n] * np.uint64(weight)
        weight = weight * _WEIGHT % (1 << 64)
    return mix(out)
