"""BagMinHash signatures: unbiased signatures for the weighted Jaccard likeness of bags."""

from __future__ import annotations

import numpy as np

from .words import GOLD, mix, times

#: Length of the stretches of time in which an element's points are drawn at once, and points expected in one.
STRETCH, EXPECTED = 1.0 / 64, 2.0
_PMF = np.exp(-EXPECTED) * EXPECTED ** np.arange(20.0) / np.cumprod(np.r_[1.0, np.arange(1.0, 20.0)])
#: The number of points of a stretch (Poisson) for each value of 16 random bits.
POINTS = np.searchsorted(np.cumsum(_PMF), (np.arange(1 << 16) + 0.5) / (1 << 16)).astype(np.int64)


def _blocks(doc: np.ndarray, h: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, ...]:
    """The processes of each element, one a block of the discretised weight axis: [0,1), [1,2), [2,4), [4,8), ...

    Returns text number, seed, lower end and width of the block and the element's weight.
    """
    parts, low, width = [], 0, 1
    here = np.arange(len(h))
    while len(here):
        parts.append((doc[here], mix(h[here] + times(low)), np.full(len(here), low), np.full(len(here), width), weight[here]))
        low, width = low + width, max(1, low + width)
        here = here[weight[here] > low]
    return tuple(np.concatenate(x) for x in zip(*parts)) if parts else (doc, h, weight, weight, weight)


def _fan(count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each place as often as its count says, and a running number within it."""
    place = np.repeat(np.arange(len(count)), count)
    return place, np.arange(len(place)) - np.repeat(np.cumsum(count) - count, count)


def _draw(sig: np.ndarray, key: np.ndarray, turn: np.ndarray, doc: np.ndarray, size: int, unit: float, stretch: np.ndarray) -> None:
    """Enter the points of some streams into the signatures."""
    stream = mix(key + turn.astype(np.uint64) * GOLD)
    of, number = _fan(POINTS[stream >> np.uint64(48)])
    r = mix(stream[of] + (number.astype(np.uint64) + np.uint64(1)) * GOLD)
    time = (stretch[of] + (r >> np.uint64(16)).astype(np.float64) * 2.0**-48) * unit
    np.minimum.at(sig, doc[of] * size + ((r & np.uint64(0xFFFF)).astype(np.int64) * size >> 16), time)


def signatures(doc: np.ndarray, h: np.ndarray, weight: np.ndarray, count: int, size: int, seed: int = 1) -> np.ndarray:
    """A ``count`` x ``size`` matrix; two bags agree in a component with the probability of their weighted likeness.

    Weights are positive whole numbers. An element of weight w owns the interval [0, w) of the weight axis. A Poisson
    process runs over every block of that axis, at a rate of ``size`` a unit of weight and time; a point falls on a
    component and on a place of the block, and counts if that place lies below w. A component is the time of its first
    point. Points come from hashes alone, drawn stretch by stretch: first how many, then each one's time and component.
    A text's processes end at the stretch by which all its components are all but surely filled; the texts with one
    still empty are done again with twice the time. Rows of empty bags stay infinite.
    """
    sig = np.full(count * size, np.inf)
    total = np.bincount(doc, weight, count)
    unit = STRETCH * EXPECTED * 64 / size  # so that a block of width 1 expects EXPECTED points a stretch
    need = np.divide(np.log(size) + 2.5, total, out=np.zeros(count), where=total > 0)
    last = np.ceil(need / unit).astype(np.int64)
    begin = np.zeros(count, np.int64)
    doc, key, low, width, weight = _blocks(doc, h ^ mix(np.full(1, seed, np.uint64)), weight)
    while len(doc):
        plain = np.flatnonzero(width == 1)
        at, stretch = _fan((last - begin)[doc[plain]])
        stretch += begin[doc[plain[at]]]
        _draw(sig, key[plain[at]], stretch, doc[plain[at]], size, unit, stretch)
        wide = np.flatnonzero(width > 1)
        if len(wide):  # a block of width v has v streams a stretch, one for each unit of it
            at, turn = _fan((last - begin)[doc[wide]] * width[wide])
            at = wide[at]
            turn += begin[doc[at]] * width[at]
            used = low[at] + turn % width[at] < weight[at]
            at, turn = at[used], turn[used]
            _draw(sig, key[at], turn, doc[at], size, unit, turn // width[at])
        short = np.isinf(sig.reshape(count, size)).any(axis=1) & (total > 0)
        again = short[doc]
        doc, key, low, width, weight = (x[again] for x in (doc, key, low, width, weight))
        begin, last = last, last * 2
    return sig.reshape(count, size)


def sketches(sig: np.ndarray) -> np.ndarray:
    """Two bits of each of 64 components, as two 64-bit numbers: they differ in about (1 - likeness) / 2 of the bits."""
    bits = mix(np.ascontiguousarray(sig[:, :64]).view(np.uint64))
    halves = [np.packbits((bits >> np.uint64(i) & np.uint64(1)).astype(np.uint8), axis=1).view(np.int64) for i in (0, 1)]
    return np.concatenate(halves, axis=1)


def bands(sig: np.ndarray, rows: int) -> np.ndarray:
    """64-bit keys of groups of ``rows`` components each; what is left over is in none."""
    count, size = len(sig), sig.shape[1] // rows * rows
    bits = np.ascontiguousarray(sig[:, :size]).view(np.uint64).reshape(count, size // rows, rows)
    out = np.broadcast_to(mix(np.arange(size // rows, dtype=np.uint64) + GOLD), bits.shape[:2]).copy()
    for i in range(rows):
        out = mix(out * GOLD + bits[:, :, i])
    return out.view(np.int64)
