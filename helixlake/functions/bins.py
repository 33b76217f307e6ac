"""Hierarchical bins: six levels of equal intervals, of 2^29 positions at level 0 down to 2^14 at level 5.

An interval belongs to the smallest bin that holds all of it, so what overlaps a region lies in the few bins that overlap the region, and what a level holds
is no longer than the level's bins. Intervals are half-open and begin at 0.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bits of a bin's size and number of the first bin, from the smallest bins to the largest.
LEVELS = [(14, 4681), (17, 585), (20, 73), (23, 9), (26, 1), (29, 0)]
WINDOW_BITS = 14


def bin_number(start: int, stop: int) -> int:
    last = max(stop - 1, start)
    return next((first + (start >> bits) for bits, first in LEVELS[:-1] if start >> bits == last >> bits), 0)


def bins_over(start: int, stop: int) -> list[range]:
    """The numbers of all bins that overlap an interval, a range a level."""
    return [range(first + (start >> bits), first + (max(stop - 1, start) >> bits) + 1) for bits, first in LEVELS]


def bin_of(start: Column, stop: Column) -> Column:
    last = F.greatest(stop - 1, start)
    out = F.lit(0)
    for bits, first in LEVELS[-2::-1]:
        out = F.when(F.shiftright(start, bits) == F.shiftright(last, bits), (F.lit(first) + F.shiftright(start, bits)).cast("int")).otherwise(out)
    return out


def level_of(start: Column, stop: Column) -> Column:
    """5 for the smallest bins, 0 for the largest."""
    last = F.greatest(stop - 1, start)
    out = F.lit(0)
    for level, (bits, _) in enumerate(LEVELS[-2::-1], 1):
        out = F.when(F.shiftright(start, bits) == F.shiftright(last, bits), level).otherwise(out)
    return out


def level_span(level: int) -> int:
    """No interval of the level is longer."""
    return 1 << LEVELS[len(LEVELS) - 1 - level][0]
