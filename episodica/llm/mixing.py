"""Interleave sources in proportion to target weights by Pfair scheduling.

Each source's rows are shuffled and cut into blocks. The target is a flow: at any time the
sources that still have blocks get shares in proportion to their exact weights, over the
whole run. With ``S(v)`` the slots that are filled when a source of weight ``w`` has had
``w * v`` blocks (or all it has), its block ``j`` is released at slot ``floor(S(j / w))`` and due
by slot ``ceil(S((j + 1) / w))``; each slot takes the released block with the earliest deadline.
The flow itself meets these windows, so every deadline is met, and at any slot a source is
less than one block away from its target, however long the run is.

A source that runs out leaves the rest to the others in proportion to their weights. Sources
of weight 0 come when all others have run out. Every row comes exactly once.

One task makes the schedule and holds one block of each source; it handles blocks, not rows.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left
from collections import deque
from collections.abc import Iterator
from itertools import accumulate, islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from episodica.llm.common import numbered, unused, with_rows
from episodica.session import durable

BLOCK = 32  # rows
PERIOD = 1000  # slots, at most, of one period; a period also ends where a source runs out
TEMPERATURE = 0.5
BATCH_SLOTS = 50_000
_SLOTS = "__source string, __block long, period long, slot long"
NEAR = 1e-6  # a slot's number that is this close to a whole one is meant to be whole


def schedule(counts: list[int], weights: list[float]) -> Iterator[tuple[int, int, int]]:
    """(source, block of it, period) for each slot of a mix of ``counts`` blocks by ``weights``, all positive."""
    ends = sorted((c / w, c, w) for c, w in zip(counts, weights) if c)
    if not ends:
        return
    at = [e for e, _, _ in ends]
    gone = list(accumulate((c for _, c, _ in ends), initial=0))  # blocks of the first k to run out
    active = list(accumulate((w for _, _, w in reversed(ends)), initial=0.0))[::-1]  # weight of the others

    def filled(v: float) -> float:
        k = bisect_left(at, v)
        return gone[k] + v * active[k]

    waiting = [(0, math.ceil(filled(1 / w) - NEAR), i, 0) for i, (c, w) in enumerate(zip(counts, weights)) if c]
    heapq.heapify(waiting)
    ready: list[tuple[int, int, int]] = []
    stops = deque(sorted({math.floor(filled(v) + NEAR) for v in at}))
    period = start = 0
    for slot in range(gone[-1]):
        while stops and stops[0] <= slot:
            if stops.popleft() > start:
                period, start = period + 1, slot
        if slot - start >= PERIOD:
            period, start = period + 1, slot
        while waiting and (waiting[0][0] <= slot or not ready):
            heapq.heappush(ready, heapq.heappop(waiting)[1:])
        _, i, j = heapq.heappop(ready)
        yield i, j, period
        if j + 1 < counts[i]:
            released = math.floor(filled((j + 1) / weights[i]) + NEAR)
            heapq.heappush(waiting, (released, math.ceil(filled((j + 2) / weights[i]) - NEAR), i, j + 1))


def earliest_deadline(counts: list[int]) -> list[tuple[int, int]]:
    """(source, block of it) for each slot of a mix that gives source ``i`` its ``counts[i]`` all along."""
    return [(i, j) for i, j, _ in schedule(counts, [float(c) for c in counts])]


def _phases(counts: list[int], weights: list[float]) -> Iterator[tuple[int, int, int]]:
    """The sources with a weight; then those without, by the roots of their sizes."""
    period = 0
    for some in ([i for i, w in enumerate(weights) if w > 0], [i for i, w in enumerate(weights) if not w > 0]):
        own = [weights[i] if weights[i] > 0 else counts[i] ** TEMPERATURE for i in some]
        last = -1
        for i, j, p in schedule([counts[i] for i in some], own):
            yield some[i], j, period + p
            last = p
        period += last + 1


def _slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(source, block, period, slot) of the whole mix from one task's rows (source, blocks, weight)."""
    rows = sorted((r for b in batches for r in b.to_pylist()), key=lambda r: (r["source"] is not None, r["source"] or ""))
    names, slot = [r["source"] for r in rows], 0
    order = _phases([r["blocks"] for r in rows], [r["weight"] for r in rows])
    while some := list(islice(order, BATCH_SLOTS)):
        yield pa.RecordBatch.from_arrays([
            pa.array([names[i] for i, _, _ in some], pa.string()), pa.array([j for _, j, _ in some], pa.int64()),
            pa.array([p for _, _, p in some], pa.int64()), pa.array(range(slot, slot + len(some)), pa.int64()),
        ], ["__source", "__block", "period", "slot"])
        slot += len(some)


def weighed(sources: DataFrame, weights: dict[str, float] | None, block: int) -> DataFrame:
    """(source, blocks, weight) for ``sources`` (source, n).

    Without ``weights`` a source weighs its rows to the power TEMPERATURE. With them,
    sources that they do not name weigh 0.
    """
    weight: Column = F.pow(F.col("n").cast("double"), F.lit(TEMPERATURE))
    if weights is not None:
        weight = F.lit(0.0)
        for name, value in weights.items():
            weight = F.when(F.col("source") == name, F.lit(float(value))).otherwise(weight)
    return sources.select("source", F.ceil(F.col("n") / block).cast("long").alias("blocks"), weight.alias("weight"))


def mix(rows: DataFrame, weights: dict[str, float] | None = None, seed: int = 1, block: int = BLOCK) -> DataFrame:
    """``rows`` (source, others narrow) with block, period, slot and place.

    ``slot`` numbers the blocks of the mix without gaps; ``place`` orders the rows in it (the
    last block of a source may be short). A null source is a source. Repeated rows keep
    their number. Rows are shuffled by a hash of all their columns and ``seed``. An
    empty table gives no rows. ``rows`` must not have the four names added.
    """
    mixed = F.xxhash64(F.lit(seed), *[F.col(c) for c in rows.columns])
    own = numbered(rows.withColumn("__mixed", mixed), "__n", ["__mixed"], ["source"]).drop("__mixed")
    own = durable(own.withColumn("block", F.floor(F.col("__n") / block)))
    sources = own.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    slots = durable(weighed(sources, weights, block).repartition(1).mapInArrow(_slots, _SLOTS))
    same = F.col("source").eqNullSafe(F.col("__source")) & (F.col("block") == F.col("__block"))
    placed = own.join(slots, same).drop("__source", "__block")
    return placed.withColumn("place", F.col("slot") * block + F.pmod(F.col("__n"), F.lit(block))).drop("__n")


def mixed_order(docs: DataFrame, weights: dict[str, float] | None = None, seed: int = 1) -> DataFrame:
    """All rows and columns of ``docs``, whatever their names, in the order of the mix (part files are in order too)."""
    row, place = unused(docs, "__row"), unused(docs, "__place")
    rows = with_rows(docs, row)
    places = mix(rows.select(F.col(row).alias("__row"), "doc_id", "source"), weights, seed).select(F.col("__row").alias(row), F.col("place").alias(place))
    return rows.join(places, row).repartitionByRange(place).sortWithinPartitions(place).drop(row, place)
