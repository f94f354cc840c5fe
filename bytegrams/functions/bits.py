"""Sets of 64-bit hashes as bit maps of a fixed size: a hash whose bit is not set is not in the set."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of a map, as a power of two: 2 ** 26 bits are 8 MB, however large the set is.
BITS = 26


def bit_map(hashes: DataFrame, column: str, bits: int = BITS) -> np.ndarray:
    """Words of 64 bits, in which the leading ``bits`` bits of each hash (a long) name the bit that is set. The tasks put bits
    together to words, so 2 ** (bits - 6) rows reach the driver at most. Nulls set none."""
    place = F.shiftrightunsigned(F.col(column), 64 - bits)
    one = F.expr("shiftleft(1L, cast(place & 63 as int))")
    rows = hashes.filter(F.col(column).isNotNull()).select(place.alias("place")).select(F.shiftright("place", 6).alias("word"), one.alias("bit"))
    found = rows.groupBy("word").agg(F.bit_or("bit").alias("bit")).toArrow()
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[found.column("word").to_numpy()] = found.column("bit").to_numpy().view(np.uint64)
    return out


def probed(words: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether the bit of each hash (uint64) is set."""
    place = hashes >> np.uint64(58 - (len(words) - 1).bit_length())
    return (words[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63)) & np.uint64(1)).astype(bool)
