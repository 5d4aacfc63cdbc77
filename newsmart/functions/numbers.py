"""Arithmetic shared by every score."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_half_up(c: Column, digits: int) -> Column:
    """floor(x * 10^d + 0.5) / 10^d on doubles: the same rule in any engine."""
    scale = float(10**digits)
    return F.floor(c * F.lit(scale) + F.lit(0.5)).cast("double") / F.lit(scale)


def clamp(c: Column, low: float, high: float) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), c))


def hash_sum(c: Column) -> Column:
    """Aggregate: sum of 60 bits of each value's SHA-256. The order does not matter and nothing is gathered."""
    return F.sum(F.conv(F.substring(F.sha2(c.cast("string"), 256), 1, 15), 16, 10).cast("decimal(38,0)"))


def fixed(c: Column, digits: int) -> Column:
    """Text with exactly that many decimals."""
    return F.format_string(f"%.{digits}f", c)
