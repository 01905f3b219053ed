"""Pseudo-random values that depend on keys only, never on partitions or order.

One MD5 of the key text gives two 52-bit uniforms, so any engine with MD5 gets the same values.
"""

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

_STEPS = float(1 << 52)


def digest(*parts: Column | int | str) -> Column:
    columns = [p if isinstance(p, Column) else F.lit(p) for p in parts]
    return F.md5(F.concat_ws(":", *[c.cast("string") for c in columns]))


def uniform(hexes: Column, which: int = 0) -> Column:
    """A value in (0, 1) from hex digits 1-13 (`which` 0) or 14-26 (`which` 1)."""
    bits = F.conv(F.substring(hexes, 1 + 13 * which, 13), 16, 10).cast("bigint").cast("double")
    return (bits + F.lit(0.5)) / F.lit(_STEPS)


def normal(hexes: Column) -> Column:
    """A standard normal value from the two uniforms of a digest (Box-Muller)."""
    radius = F.sqrt(F.lit(-2.0) * F.ln(uniform(hexes, 0)))
    return radius * F.cos(F.lit(2.0 * math.pi) * uniform(hexes, 1))
