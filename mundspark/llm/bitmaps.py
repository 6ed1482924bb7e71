"""Membership bitmaps of a fixed size, for prefilters."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of a membership bitmap. The bitmap is the only thing sent to every task: 1 MiB, whatever the data's size.
BITMAP_BITS = 1 << 23


def bitmap(df: DataFrame, col: str) -> np.ndarray:
    """A Bloom bitmap (one hash function, BITMAP_BITS bits) of a long column, for prefilters that may let through too
    much but never too little. The driver receives at most BITMAP_BITS / 64 rows, whatever the size of df."""
    slot = F.pmod(F.xxhash64(F.col(col)), F.lit(BITMAP_BITS))
    words = df.where(F.col(col).isNotNull()).select(F.shiftright(slot, 6).alias("w"), F.pmod(slot, F.lit(64)).cast("int").alias("b"))
    rows = words.groupBy("w").agg(F.bit_or(F.expr("shiftleft(1L, b)")).alias("m")).toPandas()
    out = np.zeros(BITMAP_BITS // 64, dtype=np.int64)
    out[rows["w"].to_numpy(dtype=np.int64)] = rows["m"].to_numpy(dtype=np.int64)
    return out


def in_bitmap(bits: np.ndarray, slots: np.ndarray) -> np.ndarray:
    """Which of the slots (see slot_of) are set."""
    return (bits[slots >> 6] >> (slots & 63)) & 1 == 1


def slot_of(c: Column) -> Column:
    """The bitmap slot of a long column; computed in the JVM, tested in Python with in_bitmap."""
    return F.pmod(F.xxhash64(c), F.lit(BITMAP_BITS))
