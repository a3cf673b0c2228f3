"""Text helpers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unicode character classes, and only \n as a line end.
DIALECT = "(?dU)"
FENCE = "```"


def strip(text: Column) -> Column:
    return F.regexp_replace(text, DIALECT + r"^\s+|\s+$", "")


def strip_fences(answer: Column) -> Column:
    """Content of the first fenced block (plain or ``python``).

    Without a complete block, a text that starts with a fence loses its fence lines;
    any other text is returned trimmed.
    """
    code = strip(answer)
    block = DIALECT + r"(?s)```(?:python)?\s*\n(.*?)```"
    kept = F.filter(F.split(code, "\n"), lambda line: ~F.startswith(strip(line), F.lit(FENCE)))
    return (
        F.when(code.rlike(block), F.regexp_extract(code, block, 1))
        .when(F.startswith(code, F.lit(FENCE)), F.array_join(kept, "\n"))
        .otherwise(code)
    )


def first_yaml(answer: Column) -> Column:
    """Content of the first plain or ``yaml`` block, else the whole text."""
    block = DIALECT + r"(?s)```(?:yaml)?\s*\n(.*?)```"
    return F.when(answer.rlike(block), F.regexp_extract(answer, block, 1)).otherwise(answer)


def in_order(text: Column, parts: list[str]) -> Column:
    """All parts occur, and their first occurrences come in the given order."""
    places = [F.locate(part, text) for part in parts]
    ok = places[0] > 0
    for left, right in zip(places, places[1:]):
        ok = ok & (right > left)
    return ok


def two_places(value: Column) -> Column:
    """Two decimals, rounded half to even on the exact binary value; negative zero keeps its sign.

    The fraction of a double is exact, so it is scaled by 2**60 and rounded with integer
    shifts (digits below 2**-60 only matter to a fraction that is far from a tie). From
    2**53 on a double has no fraction. Infinities and NaN are written as such.
    """
    size = F.abs(value)
    ordinary = size < float(1 << 53)  # NaN is larger than any number here
    safe = F.when(ordinary, size).otherwise(0.0)
    units = F.floor(safe).cast("long")
    low30 = F.lit((1 << 30) - 1)
    scaled = ((safe - units) * F.lit(float(1 << 60))).cast("long")
    low = scaled.bitwiseAND(low30) * 100
    high = F.shiftright(scaled, 30) * 100 + F.shiftright(low, 30)
    whole, rest = F.shiftright(high, 30), high.bitwiseAND(low30)
    tail, half = low.bitwiseAND(low30), F.lit(1 << 29)
    up = (rest > half) | ((rest == half) & ((tail > 0) | (whole % 2 == 1)))
    cents = whole + F.when(up, 1).otherwise(0)
    sign = F.when(F.startswith(value.cast("string"), F.lit("-")), "-").otherwise("")
    number = F.format_string("%s%d.%02d", sign, units + F.floor(cents / 100).cast("long"), cents % 100)
    large = F.when(size <= 1.7976931348623157e308, F.format_string("%.2f", value)).otherwise(F.lower(value.cast("string")))
    return F.when(ordinary, number).otherwise(large)
