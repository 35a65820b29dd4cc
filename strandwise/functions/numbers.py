"""Column functions of probabilities, frequencies and strands."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalized_probs(p0: Column, p1: Column) -> tuple[Column, Column]:
    """Both probabilities over their sum, the first rounded to six digits and the second what it leaves."""
    first = F.bround(p0 / (p0 + p1), 6).cast("decimal(7,6)")
    return first, (F.lit(1) - first).cast("decimal(7,6)")


def percent(rmet: Column) -> Column:
    """Whole percent of a frequency: a thousandth is added, then half goes to even."""
    return F.bround(rmet * 100 + F.lit(0.001)).cast("int")


def percent_even(rmet: Column) -> Column:
    """Whole percent, half to even."""
    return F.bround(rmet * 100).cast("int")


def percent_floor(rmet: Column) -> Column:
    """Whole percent of a frequency that is rounded to two digits first; the rest is cut off."""
    return (F.round(rmet + F.lit(0.000001), 2) * F.lit(100.0)).cast("int")


def around(x: Column, digits: int = 6) -> Column:
    """A double of so many digits as NumPy's around makes it: scaled, to the nearest whole number (half to even), and back. A little below zero is -0.0."""
    return F.rint(x * F.lit(10.0**digits)) / F.lit(10.0**digits)


def genome_position(strand: Column, start: Column, length: Column, at: Column) -> Column:
    """The forward coordinate of a place in a read."""
    return F.when(strand == "-", start + length - 1 - at).otherwise(start + at)


def strand_position(strand: Column, pos: Column, contig_length: Column) -> Column:
    """The coordinate on a site's own strand, -1 where the contig's length is unknown."""
    return F.when(contig_length.isNull(), F.lit(-1)).when(strand == "-", contig_length - 1 - pos).otherwise(pos).cast("long")


def divided(a: Column, b: Column) -> Column:
    """a / b, or 0 where b is 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
