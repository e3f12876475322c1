"""Bit tables of fixed size that say which hashes may be in a set.

A table has 2**bits bits however large the set is: what it lets through besides the set
grows as it fills, and a full one lets everything through. It never keeps out a member, so
it only saves work in front of an exact step.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

_PART = 15  # bits of a row, as a number


def bit_table(keys: DataFrame, key: Column | str, bits: int) -> np.ndarray:
    """The table of 64-bit hashes; hashes count by their first ``bits`` bits, 15 at least."""
    place = F.shiftrightunsigned(key, 64 - bits)
    parts = keys.select(F.shiftright(place, _PART).alias("part"), (place % (1 << _PART)).alias("bit")).groupBy("part").agg(
        F.bitmap_construct_agg("bit").alias("bits")).collect()  # at most 2**bits bits
    table = np.zeros(1 << (bits - 3), np.uint8)
    for part, own in parts:
        own = np.frombuffer(bytes(own), np.uint8)
        table[part << _PART - 3 : (part << _PART - 3) + len(own)] = own
    return table


def places(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Where in the table the unsigned hashes stand."""
    return keys >> np.uint64(65 - (8 * len(table)).bit_length())


def maybe_in(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which of the unsigned hashes the table lets through."""
    place = places(table, keys)
    return table[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8) & 1 != 0
