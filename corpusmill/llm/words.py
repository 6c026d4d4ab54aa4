"""Words, runs of words and their hashes, a batch of texts at a time."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Longest runs of letters and digits.
WORD = re.compile(r"[^\W_]+")
#: Words that a word list may have; a longer one is an error, as all tasks hold it.
MOST_LISTED = 1_000_000
GOLD = np.uint64(0x9E3779B97F4A7C15)


def words(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective mixing of 64-bit integers (finaliser of the SplitMix generator)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def times(i: int) -> np.uint64:
    """``i`` times the golden constant, modulo 2^64."""
    return np.uint64(i * int(GOLD) & 0xFFFFFFFFFFFFFFFF)


class WordHashes:
    """Hashes of all words of some texts at once, over their characters as numbers.

    A word's hash is a polynomial of its characters modulo 2^64, mixed; it depends on nothing but the word.
    """

    def __init__(self):
        plane = np.arange(1 << 16, dtype=np.uint32).astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
        self.letters = np.fromiter((c.isalnum() for c in plane), bool, 1 << 16)
        self.powers = np.ones(1, np.uint64)

    def _inside(self, codes: np.ndarray) -> np.ndarray:
        """Which characters belong to words."""
        high = codes >= 1 << 16
        if not high.any():
            return self.letters[codes]
        out = np.zeros(len(codes), bool)
        out[~high] = self.letters[codes[~high]]
        found, at = np.unique(codes[high], return_inverse=True)
        out[high] = np.fromiter((chr(c).isalnum() for c in found), bool, len(found))[at]
        return out

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All words' hashes, one text after the other, and the number of words of each text."""
        joined = "\n".join([t.lower() if t else "" for t in texts]) + "\n"
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        inside = self._inside(codes)
        edge = np.diff(np.r_[False, inside].view(np.int8))
        start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        length = end - start
        if len(length) and length.max() > len(self.powers):
            grown = np.full(int(length.max()) * 2, GOLD | np.uint64(1), np.uint64)
            grown[0] = 1
            self.powers = np.multiply.accumulate(grown)
        spots = np.flatnonzero(inside)
        word = np.repeat(np.arange(len(length)), length)
        place = spots - start[word]
        value = (codes[spots].astype(np.uint64) + np.uint64(0x9E37)) * self.powers[place]
        total = np.add.reduceat(value, np.cumsum(length) - length) if len(length) else np.zeros(0, np.uint64)
        sizes = np.fromiter((len(t.lower()) + 1 if t else 1 for t in texts), np.int64, len(texts))
        count = np.diff(np.r_[0, np.searchsorted(start, np.cumsum(sizes))])
        return mix(total + length.astype(np.uint64) * GOLD), count


def hashed(texts: list[str | None], hashes: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """All words' hashes, one text after the other, and the number of words of each text."""
    return hashes(texts)


def runs(h: np.ndarray, n: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(text number, hash) of each run of ``width`` successive words, in their order."""
    if len(h) < width:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    doc = np.repeat(np.arange(len(n)), n)
    k = len(h) - width + 1
    out = np.zeros(k, np.uint64)
    for i in range(width):
        out = mix(out * GOLD + h[i : i + k] + np.uint64(i + 1))
    whole = doc[:k] == doc[width - 1 :]
    return doc[:k][whole], out[whole]


def counted(doc: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text number, hash), sorted, with their counts; of up to 256 texts, by the upper 56 bits of the hashes."""
    if not len(h):
        return doc, h, np.zeros(0, np.int64)
    key = np.sort((doc.astype(np.uint64) << np.uint64(56)) | (h >> np.uint64(8)))
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    count = np.diff(np.r_[first, len(key)])
    key = key[first]
    return (key >> np.uint64(56)).astype(np.int64), key << np.uint64(8), count


def digests(doc: np.ndarray, h: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each text's set of hashes, 0 for an empty set."""
    a, b = np.zeros(count, np.uint64), np.zeros(count, np.uint64)
    np.add.at(a, doc, mix(h ^ GOLD))
    np.add.at(b, doc, mix(h * GOLD + np.uint64(7)))
    return a.view(np.int64), b.view(np.int64)


def word_list(common: DataFrame, *, most: int = MOST_LISTED) -> frozenset[str]:
    """The distinct words of ``common(word)`` in small letters, all of them."""
    found = common.select(F.lower("word").alias("word")).dropna().distinct().limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"a list of common words has at most {most} words")
    return frozenset(r[0] for r in found)
