"""Hashes of words and of runs of words, in NumPy."""

from __future__ import annotations

import numpy as np
import xxhash

#: Words whose hashes a worker remembers.
_REMEMBERED = 200_000

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed(x: np.ndarray) -> np.ndarray:
    """SplitMix64's finisher: every bit of the result depends on every bit of x."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= _REMEMBERED:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_hashes = WordHashes()
#: For a worker that is done with a task.
forget = _hashes.clear


def words_of(text: str | None, lower: bool = False) -> list[bytes]:
    """The words of a text; `lower` turns A-Z, and no other letters, into a-z."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return (raw.lower() if lower else raw).split()  # at x20 and x09 to x0D, as bytes are


def hashes_of(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))


def runs(hashes: np.ndarray, length: int, salt: int = 0) -> np.ndarray:
    """A 64-bit hash of each run of `length` neighbours. None if there are fewer."""
    n = len(hashes) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    factor = np.uint64((0x9E3779B97F4A7C15 + 2 * salt * 0x5851F42D4C957F2D) % (1 << 64))
    out = hashes[:n].copy()
    for k in range(1, length):
        out *= factor
        out += hashes[k:k + n]
    return mixed(out + np.uint64(length))


_random = np.random.default_rng(7)
_VALUES = _random.integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + _random.integers(0, 2, 256, np.uint64)
_BASE = np.uint64(0x9FB21C651E98DF25)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A 64-bit hash of each word, its length in bytes, and how many words each text has.

    All texts at once: a word's hash is a polynomial of random values of its
    bytes, whose powers are as many as the longest word has bytes.
    """
    raw = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    inside = ~_SPACE[raw]
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    edges = np.append(0, edges) if inside[0] else edges
    start, end = edges[::2], edges[1::2]
    size = end - start
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
    upto = np.searchsorted(start, ends)
    count = np.diff(np.append(0, upto))
    if not len(start):
        return np.zeros(0, np.uint64), size, count
    powers = np.full(int(size.max()), _BASE)
    powers[0] = 1
    powers = np.multiply.accumulate(powers)
    value = _VALUES[raw[inside]]
    first = np.cumsum(size) - size
    value *= powers[np.arange(len(value)) - np.repeat(first, size)]
    return mixed(np.add.reduceat(value, first) + size.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), size, count
