"""A one-hash Bloom filter of fixed size over a bigint column.

It only spares a shuffle of rows that cannot match: every use is followed by an
exact join or aggregate, so false hits cost time and nothing else. It has about
16 bits a value and ``most`` / 8 bytes at most, whatever the input, which is the
proven bound for the broadcast. Beyond most / 16 values it fills up: then more
rows are shuffled, at worst all, and the result stays the same.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Most bits: 16 MB.
BITS = 1 << 27


def bits_for(n: int, most: int = BITS) -> int:
    """A power of two of about 16 bits a value, within 2^16 and ``most``."""
    return min(most, 1 << max(16, (16 * n - 1).bit_length()))


def build(df: DataFrame, column: str, most: int = BITS):
    """Broadcast bitmap of the low bits of ``column``, sized by the number of rows.

    It is made in one distributed bit_or, of which at most bits / 32 small rows return.
    """
    bits = bits_for(df.count(), most)
    at = F.col(column).bitwiseAND(F.lit(bits - 1))
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), at.bitwiseAND(31).cast("int")).alias("b")
    rows = df.where(F.col(column).isNotNull()).select(F.shiftrightunsigned(at, 5).cast("int").alias("w"), bit)
    got = rows.groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    words = np.zeros(bits // 32, np.uint32)
    words[got["w"].to_numpy()] = got["b"].to_numpy().astype(np.uint64).astype(np.uint32)
    return df.sparkSession.sparkContext.broadcast(words)


def hit(words: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Mask of the values that may be in the set."""
    at = values.astype(np.uint64, copy=False) & np.uint64(len(words) * 32 - 1)
    return (words[(at >> np.uint64(5)).astype(np.int64)] >> (at & np.uint64(31)).astype(np.uint32)) & np.uint32(1) != 0
