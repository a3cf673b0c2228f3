"""Reproducible shuffle into shards: a Feistel permutation with cycle walking over row numbers.

Row ``x`` of ``n`` goes to place ``P(x)``; its shard is ``P(x) mod shards`` and its slot
``P(x) div shards``. Both can be computed from the row number alone, and ``row_at`` turns a
shard and a slot back into the row number, so a reader can find any row without a lookup.

``P`` is an alternating Feistel network over pairs (left, right) with ``left < a`` and
``right < b``, where ``a * b`` is the smallest such rectangle that holds ``n``. Fewer than
``a`` places of it are outside of ``0 .. n - 1``; a row that lands there is enciphered again.
How often that can happen at most is computed from those places alone, so the walk is
exact and has no step limit.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from episodica.llm.common import numbered, session
from episodica.session import durable

ROUNDS = 8


@dataclass(frozen=True)
class Permutation:
    """The permutation of ``0 .. n - 1`` that ``seed`` gives."""

    n: int
    seed: int
    walk: int  # enciphering steps that always suffice

    @property
    def a(self) -> int:
        return max(1, math.isqrt(max(self.n - 1, 0)) + 1)

    @property
    def b(self) -> int:
        return max(1, -(-self.n // self.a))

    def step(self, place: Column, inverse: bool = False) -> Column:
        """A place of the rectangle enciphered once, or deciphered.

        Rounds are folded over their numbers, so the expression has one round in it whatever
        ROUNDS is; written out, each round would hold the one before it twice.
        """
        sign = F.lit(-1 if inverse else 1)
        a, b = F.lit(self.a).cast("long"), F.lit(self.b).cast("long")

        def turn(pair: Column, number: Column) -> Column:
            left, right, odd = pair["l"], pair["r"], number % 2 == 1
            size = F.when(odd, a).otherwise(b)
            key = F.pmod(F.xxhash64(F.when(odd, right).otherwise(left), number, F.lit(self.seed).cast("long")), size)
            changed = F.pmod(F.when(odd, left).otherwise(right) + sign * key, size)
            return F.struct(F.when(odd, changed).otherwise(left).alias("l"), F.when(odd, right).otherwise(changed).alias("r"))

        start = F.struct(F.call_function("div", place, b).alias("l"), F.pmod(place, b).alias("r"))
        rounds = F.array(*[F.lit(n) for n in range(ROUNDS)[:: -1 if inverse else 1]])
        return F.aggregate(rounds, start, turn, lambda pair: pair["l"] * b + pair["r"])

    def apply(self, df: DataFrame, row: str, place: str, inverse: bool = False) -> DataFrame:
        """Add ``place``, the permuted ``row``; with ``inverse`` the row of a place.

        The walk is folded as well: a place outside of the range goes on, others stay.
        """
        walked = F.aggregate(
            F.sequence(F.lit(1), F.lit(self.walk)), F.col(row).cast("long"),
            lambda at, turn: F.when((turn == 1) | (at >= self.n), self.step(at, inverse)).otherwise(at),
        )
        return df.withColumn(place, walked)


def permutation(spark: SparkSession, n: int, seed: int) -> Permutation:
    """Find how long a walk can be: follow the places outside of the range that rows reach."""
    start = Permutation(n, seed, 1)
    if start.a * start.b == n or not n:
        return start
    walk = 1
    outside = spark.range(n, start.a * start.b)
    ahead = outside.where(start.step(F.col("id"), inverse=True) < n)
    while ahead.count():  # fewer than a places, and each walk ends in the range
        walk += 1
        ahead = durable(ahead.select(start.step(F.col("id")).alias("id"))).where(F.col("id") >= n)
    return Permutation(n, seed, walk)


def shard_rows(df: DataFrame, order: list[str], shards: int, seed: int = 1) -> tuple[DataFrame, Permutation]:
    """``df`` with row_number, place, shard (int) and slot, and the permutation used.

    Row numbers follow ``order``; nulls come first and rows equal in ``order`` are
    interchangeable. Shard sizes differ by one row at most and slots have no gaps. Columns
    of ``df`` that carry one of the added names are replaced. An empty table gives no rows.
    """
    if shards < 1:
        raise ValueError("at least one shard")
    rows = numbered(df.drop("row_number", "place", "shard", "slot"), "row_number", order)
    made = permutation(session(df.sparkSession), rows.count(), seed)
    out = made.apply(rows, "row_number", "place")
    return out.withColumns({
        "shard": F.pmod(F.col("place"), F.lit(shards)).cast("int"),
        "slot": F.floor(F.col("place") / F.lit(shards).cast("decimal(10,0)")).cast("long"),
    }), made


def row_at(df: DataFrame, made: Permutation, shards: int, row: str = "row_number") -> DataFrame:
    """The row number for ``shard`` and ``slot``: the way back."""
    place: Column = F.col("slot") * F.lit(shards) + F.col("shard")
    return made.apply(df.withColumn("__place", place), "__place", row, inverse=True).drop("__place")


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, size in bytes plus 16 (a null text has none) and CRC-32 of the text (null: of no bytes)."""
    text = F.col("text")
    return docs.select(
        "doc_id",
        (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 16).alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
    )
