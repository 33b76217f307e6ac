"""Reproducible draws: a hash of seed, file, marker and stream, the same for any partitioning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


#: Steps of a permutation that falls outside its range, each with a chance of less than 3 in 4.
WALKS = 250


def draw(seed: Column | int, file_idx: Column, rsid: Column, stream: str) -> Column:
    """An integer from 0 to 2^32 - 1."""
    seed = F.lit(seed) if isinstance(seed, int) else seed
    text = F.concat_ws(":", seed.cast("string"), file_idx.cast("string"), rsid.cast("string"), F.lit(stream))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def happens(h: Column, frequency: float) -> Column:
    return h < F.lit(int(round(frequency * 2**32)))


def fixed(ticks: Column, digits: int) -> Column:
    """Ticks of 10^-digits as text with that many decimals."""
    return (ticks / F.lit(10**digits)).cast(f"decimal(12,{digits})").cast("string")


def gs(h: Column) -> Column:
    return fixed(F.lit(2000) + h % 8001, 4)


def baf(h: Column) -> Column:
    return fixed(h % 1001, 3)


def lrr(h: Column) -> Column:
    return fixed(h % 10001 - 5000, 4)


def permuted(number: Column, size: int, seed: int, stream: str) -> Column:
    """Where a keyed permutation of 0 .. size - 1 takes a number: each place is computed by itself, without a sort.

    Four Feistel rounds permute the numbers of an even number of bits, at least size and less than four times that; what falls outside
    is sent on until it falls inside. More than WALKS steps have a chance below 10^-30 and end the query with an error.
    """
    if not 0 < size <= 1 << 62:
        raise ValueError("the range must have 1 to 2^62 numbers")
    half = max(1, -(-(size - 1).bit_length() // 2))
    low = F.lit((1 << half) - 1).cast("bigint")

    def rounds(x: Column) -> Column:
        start = F.struct(F.shiftright(x, half).alias("l"), x.bitwiseAND(low).alias("r"))
        mixed = lambda a, k: F.struct(a["r"].alias("l"), a["l"].bitwiseXOR(draw(seed, k, a["r"], stream).bitwiseAND(low)).alias("r"))
        return F.aggregate(F.array(*map(F.lit, range(4))), start, mixed, lambda a: F.shiftleft(a["l"], half) + a["r"])

    inside = lambda x: x < F.lit(size).cast("bigint")
    walked = F.aggregate(F.sequence(F.lit(1), F.lit(WALKS)), rounds(number.cast("bigint")), lambda x, _: F.when(inside(x), x).otherwise(rounds(x)))
    return F.transform(F.array(walked), lambda x: F.when(inside(x), x).otherwise(F.raise_error(F.lit("the permutation does not come back")).cast("bigint")))[0]
