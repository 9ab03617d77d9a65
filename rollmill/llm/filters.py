"""Bit filters of a fixed size: a broadcast whose size does not grow with the data.

A filter holds one bit for each value of a 64-bit hash's head. It never misses a member; with more
members it lets more strangers through, which costs work and never changes a result, as what
passes is judged exactly afterwards.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of a filter: 2**27 bits are 16 MB.
FILTER_BITS = 27
_PIECE = 32768  # bits of one bitmap of Spark's bitmap aggregates


def bit_filter(hashes: DataFrame, column: str, bits: int = FILTER_BITS) -> np.ndarray:
    """The filter of a column of hashes as packed bits; 2**(bits-3) bytes in all."""
    head = F.shiftrightunsigned(F.col(column), 64 - bits) + 1
    rows = hashes.groupBy(F.bitmap_bucket_number(head).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(head)).alias("b"))
    out = np.zeros(max(1 << bits, _PIECE) // 8, np.uint8)
    for k, b in rows.toLocalIterator():
        out[(k - 1) * _PIECE // 8 : k * _PIECE // 8] = np.frombuffer(bytes(b), np.uint8)[: _PIECE // 8]
    return out


def passes(bitmap: np.ndarray, hashes: np.ndarray, bits: int = FILTER_BITS) -> np.ndarray:
    head = hashes >> np.uint64(64 - bits)
    return (bitmap[(head >> np.uint64(3)).astype(np.int64)] >> (head & np.uint64(7)).astype(np.uint8)) & np.uint8(1) != 0
