"""Positions of a write-ahead log, written `high/low` in hex and spanning all unsigned 64-bit values.

They are held as biased longs, position - 2^63, which sort as the positions do.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SHAPE = r"^[\s ]*0*([0-9A-Fa-f]{1,8})/0*([0-9A-Fa-f]{1,8})[\s ]*$"
HALF = 1 << 31
WORD = 1 << 32


def biased(c: Column) -> Column:
    """The position as a biased long; null where the text is null or unreadable."""
    part = lambda k: F.conv(F.regexp_extract(c, SHAPE, k), 16, 10).cast("long")
    return F.when(c.rlike(SHAPE), (part(1) - HALF) * F.lit(WORD).cast("long") + part(2))


def shown(c: Column) -> Column:
    """A biased long as `high/low` in upper case without leading zeros."""
    high = F.shiftright(c, 32) + F.lit(HALF).cast("long")
    return F.concat(F.hex(high), F.lit("/"), F.hex(c.bitwiseAND(F.lit(WORD - 1).cast("long"))))


def as_decimal(c: Column) -> Column:
    """The position itself, for arithmetic beyond a long."""
    return (c.cast("decimal(20,0)") + F.lit(str(1 << 63)).cast("decimal(20,0)")).cast("decimal(20,0)")
