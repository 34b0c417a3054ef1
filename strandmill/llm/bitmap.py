"""Bitmaps of bounded size that thin out rows before an exact join.

A bitmap knows about ``per_value`` bits per hash, and never has more than ``MOST_BITS``, so what is
broadcast is bounded whatever the table.  A full bitmap lets more rows pass; the join after it stays
exact.  It is a plain (words, shift) pair: broadcast values are not sent with this package's code.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_BITS = 1 << 27


def bitmap_of(hashes: DataFrame, column: str, per_value: int = 16) -> tuple[np.ndarray, int]:
    """``column`` holds well-mixed 64-bit hashes, of which the top bits are used."""
    bits = min(MOST_BITS, 1 << max(16, (per_value * hashes.count()).bit_length()))
    shift = 64 - bits.bit_length() + 1
    place = hashes.select(F.shiftrightunsigned(column, shift).alias("p"))
    words = place.select(F.shiftrightunsigned("p", 6).alias("i"), F.expr("shiftleft(1L, cast(p & 63 as int))").alias("b"))
    found = words.groupBy("i").agg(F.bit_or("b").alias("b")).toPandas()
    out = np.zeros(bits // 64, np.uint64)
    out[found["i"].to_numpy(np.int64)] = found["b"].to_numpy(np.int64).view(np.uint64)
    return out, shift


def passes(bitmap: tuple[np.ndarray, int], hashes: np.ndarray) -> np.ndarray:
    """Which of the hashes may be among those of the table; none that is gets lost."""
    words, shift = bitmap
    place = hashes >> np.uint64(shift)
    return ((words[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1)).astype(bool)
