"""Counter-based random draws.

A draw is a pure function of its seed and counters, so it does not depend on
partitioning, task retries or row order, and any engine with md5 repeats it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .expr import col


def draw_int(*parts) -> Column:
    """A 32-bit integer from the given seed and counters."""
    text = F.concat_ws("/", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p))
                              for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def draw_unit(*parts) -> Column:
    """A uniform number in (0, 1)."""
    return (draw_int(*parts) + F.lit(0.5)) / F.lit(4294967296.0)


def draw_index(n, *parts) -> Column:
    """A uniform index in 0..n-1."""
    return F.pmod(draw_int(*parts), col(n).cast("bigint")).cast("int")


def gumbel(*parts) -> Column:
    """A standard Gumbel draw."""
    return -F.ln(-F.ln(draw_unit(*parts)))


# Bounds of `gumbel`, a little wider than the draws at the ends of `draw_unit`.
GUMBEL_LOW = -math.log(-math.log(0.5 / 4294967296.0)) - 1e-6
GUMBEL_HIGH = -math.log(-math.log(1.0 - 0.5 / 4294967296.0)) + 1e-6
