"""An FM-index over word numbers: suffix array, wavelet matrix, backward search, sampled positions."""

from __future__ import annotations

import numpy as np


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Sorted suffixes of whole numbers of which 0 separates; separators differ, in the order of their places.

    Prefix doubling; a suffix is told apart by its separator at the latest, so the rounds are logarithmic in the
    longest piece.
    """
    n = len(text)
    rank = text.astype(np.int64)
    gaps = np.flatnonzero(text == 0)
    rank[rank > 0] += len(gaps)
    rank[gaps] = np.arange(len(gaps))
    step = 1
    while True:
        key = rank * (n + len(gaps) + 2 + int(rank.max()))
        key[: n - step] += rank[step:] + 1
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        fresh = np.r_[0, np.cumsum(ordered[1:] != ordered[:-1])]
        rank = np.empty(n, np.int64)
        rank[order] = fresh
        step *= 2
        if fresh[-1] == n - 1 or step >= n:
            return order


class Wavelet:
    """Ranks of symbols below ``2^levels`` in a sequence, in one step a bit, for many queries at once."""

    def __init__(self, seq: np.ndarray, top: int):
        self.n, self.levels = len(seq), max(1, int(top).bit_length())
        self.ones, self.zeros = [], []
        for level in range(self.levels - 1, -1, -1):
            bit = (seq >> level) & 1
            self.ones.append(np.r_[0, np.cumsum(bit)].astype(np.int32))
            self.zeros.append(self.n - int(self.ones[-1][-1]))
            seq = np.concatenate([seq[bit == 0], seq[bit == 1]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol comes before its place ``at``."""
        low, high = np.zeros(len(at), np.int64), at.astype(np.int64)
        for i, (ones, zeros) in enumerate(zip(self.ones, self.zeros)):
            up = (symbol >> (self.levels - 1 - i)) & 1 == 1
            a, b = ones[low].astype(np.int64), ones[high].astype(np.int64)
            low, high = np.where(up, zeros + a, low - a), np.where(up, zeros + b, high - b)
        return high - low

    def symbol(self, at: np.ndarray) -> np.ndarray:
        """The symbols at some places."""
        out, at = np.zeros(len(at), np.int64), at.astype(np.int64)
        for ones, zeros in zip(self.ones, self.zeros):
            before = ones[at].astype(np.int64)
            up = ones[at + 1] > before
            at = np.where(up, zeros + before, at - before)
            out = out * 2 + up
        return out


class FMIndex:
    """Search of phrases in a text of positive word numbers with 0 between pieces."""

    def __init__(self, text: np.ndarray, top: int, every: int = 16):
        order = suffix_array(text)
        last = text[order - 1]  # of the first suffix, the text's last symbol
        self.wavelet = Wavelet(last.astype(np.int64), top)
        self.first = np.r_[0, np.cumsum(np.bincount(text, minlength=top + 1))]
        kept = (order % every == 0) | (last == 0)  # a walk back never leaves its piece
        self.kept = np.r_[0, np.cumsum(kept)].astype(np.int32)
        self.places = order[kept]

    def find(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each row of ``phrases`` the half-open range of suffixes that start with it, by backward search."""
        low = np.zeros(len(phrases), np.int64)
        high = np.full(len(phrases), self.wavelet.n, np.int64)
        live = np.arange(len(phrases))
        for j in range(phrases.shape[1] - 1, -1, -1):
            c = phrases[live, j]
            low[live] = self.first[c] + self.wavelet.rank(c, low[live])
            high[live] = self.first[c] + self.wavelet.rank(c, high[live])
            live = live[low[live] < high[live]]
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text places of suffixes, by walks back to a sampled one."""
        out, steps = np.zeros(len(rows), np.int64), 0
        at, here = rows.astype(np.int64), np.arange(len(rows))
        while len(at):
            known = self.kept[at + 1] > self.kept[at]
            out[here[known]] = self.places[self.kept[at[known]]] + steps
            at, here = at[~known], here[~known]
            c = self.wavelet.symbol(at)
            at = self.first[c] + self.wavelet.rank(c, at)
            steps += 1
        return out
