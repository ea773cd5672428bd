"""Content hashes and distances of 64-bit fingerprints."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Distance of a fingerprint that cannot be parsed; a fixed value, beyond any real distance.
UNPARSABLE = 999


def md5_of(content: Column) -> Column:
    return F.md5(content.cast("binary"))


def from_hex(text: Column) -> Column:
    """The signed 64-bit pattern of 1 to 16 hex digits, null for anything else."""
    return F.when(text.rlike("^[0-9A-Fa-f]{1,16}$"), F.conv(text, 16, -10).cast("bigint"))


def distance(a: Column, b: Column) -> Column:
    """Number of differing bits of two 64-bit patterns."""
    return F.bit_count(a.bitwiseXOR(b)).cast("int")


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two hex fingerprints; ``UNPARSABLE`` where either is none."""
    return F.coalesce(distance(from_hex(a), from_hex(b)), F.lit(UNPARSABLE))


def bands(code: Column, count: int) -> Column:
    """array<struct<band, value>>: the pattern cut in ``count`` parts. Two patterns that differ in fewer bits share a part."""
    edges = [64 * k // count for k in range(count + 1)]
    parts = []
    for k in range(count):
        width = edges[k + 1] - edges[k]
        part = F.shiftrightunsigned(code, edges[k])
        parts.append(F.struct(F.lit(k).alias("band"), (part.bitwiseAND(F.lit((1 << width) - 1)) if width < 64 else part).alias("value")))
    return F.array(*parts)
