"""A bitmap of fixed size over 64-bit hashes: may pass others, never loses one.

It travels to every task, so its size is a parameter and not a matter of the data; beyond
some millions of hashes it passes more, and what follows stays right.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 22


def slot(value: Column, bits: int = BITS) -> Column:
    return value.bitwiseAND((1 << bits) - 1)


def collect(hashes: DataFrame, column: str, bits: int = BITS) -> np.ndarray:
    """The bitmap of a column of longs; what reaches the driver is ``2**bits / 64`` numbers at most."""
    slots = hashes.select(slot(F.col(column), bits).alias("slot"))
    own = F.expr("shiftleft(1L, cast(slot & 63 as int))")
    words = slots.groupBy(F.shiftright("slot", 6).alias("word")).agg(F.bit_or(own).alias("bits")).collect()
    bitmap = np.zeros((1 << bits) // 64, "<i8")
    if words:
        at, value = zip(*words, strict=True)
        bitmap[list(at)] = value
    return bitmap.view(np.uint8)


def passes(packed: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which of some unsigned 64-bit hashes may be in the bitmap."""
    at = (hashes & np.uint64(8 * len(packed) - 1)).astype(np.int64)
    return (packed[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
