"""A filter of fixed size for hashes: sure of absence, not of presence.

It spares a shuffle of rows that a join would drop. Where it holds very many hashes it
lets more rows pass than need be; the join that follows sorts them out.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 26


def filter_of(hashes: DataFrame, column: str) -> np.ndarray:
    """Bits at the places that the leading bits of the (long) hashes name, 8 MB in all, which
    come to the driver as at most 2 ** 20 pairs of a place and 64 bits."""
    place = F.shiftrightunsigned(F.col(column), 64 - BITS)
    at = hashes.select((place / 64).cast("long").alias("at"), F.pmod(place, F.lit(64)).cast("int").alias("bit"))
    got = at.groupBy("at").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("word")).toArrow()
    words = np.zeros(1 << BITS - 6, np.dtype("<i8"))
    words[got.column("at").to_numpy()] = got.column("word").to_numpy()
    return words.view(np.uint8)


def passes(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether each hash may be one of the filter's, which has a power of 2 of bits."""
    place = hashes.view(np.uint64) >> np.uint64(65 - (8 * len(bits)).bit_length())
    return (bits[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def id_hash(column: Column | str) -> Column:
    return F.xxhash64(column)
