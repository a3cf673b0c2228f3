"""Whole numbers and flags in BINARY columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _little(order: Column | str) -> Column:
    return (F.lit(order) if isinstance(order, str) else order) == "little"


def _reversed(cut: Column, size: int) -> Column:
    """Bytes back to front. ``reverse`` would read them as UTF-8 and keep sequences together."""
    return F.concat(*[F.substring(cut, at, 1) for at in range(size, 0, -1)])


def unpack(data: Column, offset: int, size: int, order: Column | str = "big") -> Column:
    """Unsigned whole number of ``size`` bytes as BIGINT; null where the bytes end early."""
    cut = F.substring(data, offset + 1, size)
    cut = F.when(_little(order), _reversed(cut, size)).otherwise(cut)
    number = F.conv(F.hex(cut), 16, 10).cast("long")
    return F.when(F.octet_length(cut) == size, number)


def pack(value: Column, size: int, order: Column | str = "big") -> Column:
    """A whole number in ``size`` bytes (negative ones in two's complement); null if it does not fit."""
    value = value.cast("long")
    word = F.lpad(F.hex(value), 16, "0")
    cut = F.unhex(F.substring(word, 17 - 2 * size, 2 * size))
    cut = F.when(_little(order), _reversed(cut, size)).otherwise(cut)
    return cut if size >= 8 else F.when(value.between(-(1 << 8 * size - 1), (1 << 8 * size) - 1), cut)


def flags_to_number(flags: Column) -> Column:
    """Array of booleans, bit 0 first, as one number."""
    return F.aggregate(
        F.reverse(flags), F.lit(0).cast("long"), lambda n, bit: n * 2 + bit.cast("long")
    )
