"""A bit table of 64-bit hashes, of bounded size whatever it is built from, to drop in each task rows that can't join."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_LEAST_BITS, _MOST_BITS = 20, 28  # 128 kB to 32 MB


class BitTable:
    """Tells whether a hash may be among those it was built from; it never denies one that is. Beyond some ten million
    hashes it lets more through, which the join that follows drops."""

    def __init__(self, words: np.ndarray, bits: int):
        self.words, self.bits = words, bits

    def _set(self, place: np.ndarray) -> np.ndarray:
        return ((self.words[place >> 5] >> (place & 31).astype(np.uint32)) & np.uint32(1)).astype(bool)

    def maybe(self, hashes: np.ndarray) -> np.ndarray:
        """Positions of the hashes that may be in the table."""
        hit = np.flatnonzero(self._set((hashes >> np.uint64(64 - self.bits)).astype(np.int64)))
        return hit[self._set((hashes[hit] >> np.uint64(64 - 2 * self.bits)).astype(np.int64) & (1 << self.bits) - 1)]


def bit_table(hashes: DataFrame, column: str) -> BitTable:
    """Built by Spark; at most 8 million words of 32 bits reach the driver, for 256 bits a hash."""
    bits = min(_MOST_BITS, max(_LEAST_BITS, (256 * max(hashes.count(), 1)).bit_length()))
    h: Column = F.col(column)
    places = F.array(F.shiftrightunsigned(h, 64 - bits), F.shiftrightunsigned(h, 64 - 2 * bits).bitwiseAND(F.lit((1 << bits) - 1)))
    found = hashes.select(F.explode(places).alias("p")).groupBy(F.shiftright("p", 5).alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(p & 31 AS int)))").alias("b")).toArrow()
    words = np.zeros(1 << bits - 5, np.uint32)
    words[found["w"].to_numpy()] = found["b"].to_numpy().astype(np.uint32)
    return BitTable(words, bits)
