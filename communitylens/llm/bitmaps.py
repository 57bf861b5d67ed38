"""Bitmaps of fixed size over 64-bit hashes, built by an aggregation whose result is bounded by that size."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bitmap(df: DataFrame, column: str, log2_bits: int) -> np.ndarray:
    """Two bits per hash of ``column`` in 2**log2_bits bits; at most 2**(log2_bits - 6) rows reach the driver.

    Members always test positive. Callers use it only to leave out rows early; what
    passes is still joined exactly, so a full bitmap costs time and never results.
    """
    mask = F.lit((1 << log2_bits) - 1)
    high = F.shiftrightunsigned(column, 32)
    bit = F.explode(F.array(F.col(column).bitwiseAND(mask), high.bitwiseAND(mask)))
    words = (
        df.select(bit.alias("bit"))
        .groupBy(F.shiftright("bit", 6).alias("place"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("bits"))
    )
    out = np.zeros(1 << (log2_bits - 6), np.int64)
    table = words.toArrow()
    out[table.column("place").to_numpy()] = table.column("bits").to_numpy()
    return out.view(np.uint64)
