"""Joins and ordered windows that stay balanced when one key holds most rows.

* ``keyed_join`` leaves the strategy to Spark: the plan's statistics or the sizes seen at run
  time decide on a broadcast, and adaptive execution splits the partitions of hot keys.
* ``ordered`` computes running values per key. Keys above ``slice_rows`` are cut into
  ordered slices of about that many rows; each slice is computed on its own and the
  small per-slice totals are carried forward. Keys below it get a plain window.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from episodica.session import durable

# A table that is planned to be smaller needs no look for hot keys: one task can sort it.
SMALL_BYTES = 64 * 1024 * 1024
HOT_ROWS = 1_000_000
HOT_KEYS = 1_000_000
SLICE = "_slice"


def planned_bytes(df: DataFrame) -> int:
    """Size of a table by the optimizer's statistics; runs nothing. Unknown sizes are huge."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def keyed_join(fact: DataFrame, dim: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Join a fact table (or a stream) to a lookup table; nothing is counted or hinted beforehand.

    Hot keys and null keys of the fact side make large shuffle partitions, which the
    session's adaptive skew rule splits (see ``session.SETTINGS``).
    """
    return fact.join(dim, on, how)


def key_sizes(df: DataFrame, keys: list[str]) -> tuple[DataFrame, int, int]:
    """Rows per key (lazy), rows of the largest key, and rows in all."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    largest, total = counts.agg(F.max("_n"), F.sum("_n")).first()
    return counts, largest or 0, total or 0


def _hot_limit(asked: int, total: int) -> int:
    """At least ``total / HOT_KEYS`` rows, so that there are never more hot keys than that."""
    return max(asked, total // HOT_KEYS)


def _same_keys(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    """Null-safe equality of ``keys`` with the columns of ``right`` prefixed by ``_k_``."""
    return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[f"_k_{k}"]) for k in keys])


def _prefixed(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.withColumnsRenamed({k: f"_k_{k}" for k in keys})


@dataclass(frozen=True)
class Sliced:
    """Rows tagged with a slice number; only hot keys have more than one slice."""

    rows: DataFrame
    keys: list[str]
    order: list[str]
    largest: int
    split: bool


def slice_keys(
    df: DataFrame, keys: list[str], order: list[str], slice_rows: int = HOT_ROWS,
    counted: DataFrame | None = None, need_largest: bool = False,
) -> Sliced:
    """Cut every key above ``slice_rows`` into ordered slices of about that size.

    A table planned to be small is not counted at all, unless the caller wants to know its
    ``largest`` key (else 0).

    ``counted`` may name a cheaper table with the same keys and no fewer rows, such as the
    input of a join, to count instead.

    The slices are range partitions on key and order, so ties and bursts do not matter.
    They are written to the shared folder: a recomputed task must not move a boundary.
    """
    if not need_largest and slice_rows >= HOT_ROWS and planned_bytes(df) <= SMALL_BYTES:
        return Sliced(df.withColumn(SLICE, F.lit(0)), keys, order, 0, False)
    counts, largest, total = key_sizes(df if counted is None else counted, keys)
    if largest <= slice_rows:
        return Sliced(df.withColumn(SLICE, F.lit(0)), keys, order, largest, False)
    limit = _hot_limit(slice_rows, total)
    hot = _prefixed(counts.where(F.col("_n") > limit), keys)
    marked = df.join(hot, _same_keys(df, hot, keys), "left").drop(*[f"_k_{k}" for k in keys])
    cold = marked.where(F.col("_n").isNull()).drop("_n").withColumn(SLICE, F.lit(0))
    cut = (
        marked.where(F.col("_n").isNotNull())
        .drop("_n")
        .repartitionByRange(-(-total // limit), *keys, *order)
        .withColumn(SLICE, F.spark_partition_id() + 1)
    )
    return Sliced(cold.unionByName(durable(cut)), keys, order, largest, True)


def ordered(
    df: DataFrame | Sliced,
    keys: list[str],
    order: list[str],
    *,
    number: str | None = None,
    running: dict[str, Column] | None = None,
    carry: dict[str, Column] | None = None,
    previous: dict[str, Column] | None = None,
    following: dict[str, Column] | None = None,
    total: str | None = None,
    slice_rows: int = HOT_ROWS,
    keep_slice: bool = False,
) -> DataFrame:
    """Add ordered values per key.

    ``number``: position from 1. ``total``: rows of the key. ``running``: inclusive running sum. ``carry``: last
    non-null value up to the row. ``previous`` / ``following``: value of the
    neighbouring row. All of them share one shuffle and one sort.
    """
    running, carry = running or {}, carry or {}
    previous, following = previous or {}, following or {}
    sliced = df if isinstance(df, Sliced) else slice_keys(df, keys, order, slice_rows)
    rows = sliced.rows
    at = Window.partitionBy(*keys, SLICE).orderBy(*order)
    upto = at.rowsBetween(Window.unboundedPreceding, 0)
    added: dict[str, Column] = {}
    if number:
        added[number] = F.row_number().over(at).cast("long")
    if total:
        added[total] = F.count(F.lit(1)).over(Window.partitionBy(*keys, SLICE))
    for name, value in running.items():
        added[name] = F.sum(value).over(upto)
    for name, value in carry.items():
        added[name] = F.last(value, ignorenulls=True).over(upto)
    for name, value in previous.items():
        added[name] = F.lag(F.struct(value.alias("v"))).over(at)
    for name, value in following.items():
        added[name] = F.lead(F.struct(value.alias("v"))).over(at)
    out = rows.withColumns(added)
    if sliced.split:
        out = _carry_in(out, rows, keys, order, number, total, running, carry, previous, following)
    out = out.withColumns({n: F.col(n)["v"] for n in (*previous, *following)})
    return out if keep_slice else out.drop(SLICE)


def _carry_in(out, rows, keys, order, number, total, running, carry, previous, following):
    """Bring the totals of earlier (or the next) slices into each slice of a hot key."""
    at = F.struct(*order)
    totals = [F.count(F.lit(1)).alias("_in_number")]
    totals += [F.sum(v).alias(f"_in_{n}") for n, v in running.items()]
    totals += [F.max_by(v, F.when(v.isNotNull(), at)).alias(f"_in_{n}") for n, v in carry.items()]
    totals += [F.max_by(F.struct(v.alias("v")), at).alias(f"_in_{n}") for n, v in previous.items()]
    totals += [F.min_by(F.struct(v.alias("v")), at).alias(f"_in_{n}") for n, v in following.items()]
    # One row per slice of a hot key: no more rows than there were range partitions and keys.
    per_slice = rows.where(F.col(SLICE) > 0).groupBy(*keys, SLICE).agg(*totals)
    chain = Window.partitionBy(*keys).orderBy(SLICE)
    before = chain.rowsBetween(Window.unboundedPreceding, -1)
    carried = {
        "_in_number": F.sum("_in_number").over(before),
        "_in_total": F.sum("_in_number").over(Window.partitionBy(*keys)),
    }
    carried |= {f"_in_{n}": F.sum(f"_in_{n}").over(before) for n in running}
    carried |= {f"_in_{n}": F.last(f"_in_{n}", ignorenulls=True).over(before) for n in carry}
    carried |= {f"_in_{n}": F.lag(f"_in_{n}").over(chain) for n in previous}
    carried |= {f"_in_{n}": F.lead(f"_in_{n}").over(chain) for n in following}
    inflow = per_slice.select(*keys, SLICE, *[c.alias(n) for n, c in carried.items()])
    inflow = _prefixed(inflow, [*keys, SLICE])
    at_slice = _same_keys(out, inflow, [*keys, SLICE])
    out = out.join(inflow, at_slice, "left").drop(*[f"_k_{k}" for k in (*keys, SLICE)])
    fixed: dict[str, Column] = {}
    if number:
        fixed[number] = F.col(number) + F.coalesce("_in_number", F.lit(0))
    if total:
        fixed[total] = F.coalesce("_in_total", F.col(total))
    for name in running:
        had = F.col(f"_in_{name}").isNotNull()
        fixed[name] = F.when(had, F.col(f"_in_{name}") + F.coalesce(F.col(name), F.lit(0))).otherwise(F.col(name))
    for name in (*carry, *previous, *following):
        fixed[name] = F.coalesce(F.col(name), F.col(f"_in_{name}"))
    return out.withColumns(fixed).drop(*carried)
