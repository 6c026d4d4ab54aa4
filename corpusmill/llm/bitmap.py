"""Sets of 64-bit keys, and levels of keys, as bitmaps sized by the number of keys and bounded.

They only save work: a key's bit is always set; a key outside may pass as well, one in ``ROOM`` at most while the bitmap is below its bound, and
the more the fuller it is beyond. What passes is always counted or compared exactly afterwards.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits for each key, and bits at most: 32 MB a plane.
ROOM, MOST = 16, 1 << 28


class Bits:
    """Planes of bits by the lower digits of keys; a key's level is the number its bits make up, 0 for a key that is not there."""

    def __init__(self, size: int, planes: list[np.ndarray]):
        self.mask, self.planes = np.uint64(size - 1), planes

    def levels(self, keys: np.ndarray) -> np.ndarray:
        spots = np.ascontiguousarray(keys).view(np.uint64) & self.mask
        cell, bit = (spots >> np.uint64(6)).astype(np.int64), spots & np.uint64(63)
        out = np.zeros(len(spots), np.uint64)
        for i, plane in enumerate(self.planes):
            out |= (plane[cell] >> bit & np.uint64(1)) << np.uint64(i)
        return out.astype(np.int64)

    def passes(self, keys: np.ndarray) -> np.ndarray:
        """Which of the keys may be in the set."""
        return self.levels(keys) > 0


def bitmap(keys: DataFrame, number: int, *, planes: int = 1, most: int | None = None) -> Bits:
    """The bitmap of ``keys(key bigint[, level])``, of which there are ``number`` at most. Keys are evenly spread in their lower bits, as hashes are;
    null keys are left out, of several levels on one place the highest counts. A row for each 64 places reaches the driver."""
    size = 64
    while size < min((most or MOST) // planes, ROOM * max(1, number)):
        size *= 2
    level = F.col("level").cast("int") if "level" in keys.columns else F.lit(1)
    spots = keys.where("key is not null").select(F.expr(f"key & {size - 1}L").alias("spot"), level.alias("level")).groupBy("spot").agg(F.max("level").alias("level"))
    own = [F.expr(f"bit_or(if(level & {1 << i} <> 0, shiftleft(1L, cast(spot & 63 as int)), 0L))").alias(f"p{i}") for i in range(planes)]
    got = spots.groupBy(F.expr("shiftright(spot, 6)").alias("cell")).agg(*own).toArrow()
    out = []
    for i in range(planes):
        plane = np.zeros(size // 64, np.int64)
        plane[got.column("cell").to_numpy()] = got.column(f"p{i}").to_numpy()
        out.append(plane.view(np.uint64))
    return Bits(size, out)
