"""Seeded draws: the same seed gives the same value on any partitioning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def digest(*parts: Column | str) -> Column:
    """Hex digest of the parts joined by colons; plain strings are labels."""
    return F.md5(F.concat_ws(":", *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]))


def draw(n: int | Column, *parts: Column | str) -> Column:
    """Whole number from 0 to n - 1."""
    number = F.conv(F.substring(digest(*parts), 1, 8), 16, 10).cast("long")
    return F.pmod(number, F.lit(n) if isinstance(n, int) else n)


def pick(options: list[str], *parts: Column | str) -> Column:
    choices = F.array(*[F.lit(o) for o in options])
    return F.element_at(choices, (draw(len(options), *parts) + 1).cast("int"))


def seeded_order(ids: Column, *parts: Column | str) -> Column:
    """The ids of a row in a seeded random order."""
    ranked = F.array_sort(F.transform(ids, lambda i: F.struct(digest(*parts, i).alias("r"), i.alias("i"))))
    return F.transform(ranked, lambda pair: pair["i"])


def identifier(given: Column, *keys: Column | str) -> Column:
    """The given id, or one made from the keys where none (or an empty one) is given.

    A random id would differ when a lost task runs again.
    """
    return F.coalesce(F.nullif(given, F.lit("")), digest(*keys))
