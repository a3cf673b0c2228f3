"""Event rows: filter, map, windows, de-duplication, error rates and gates."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from math import gcd

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from episodica.plans.skew import HOT_ROWS, keyed_join, ordered
from episodica.session import durable

CHUNK = 4  # spans in a chunk of the join within a span
HOT_CHUNKS = 100_000  # rows of the table of hot chunks that may be broadcast
SWEPT = 65_536  # pairs in a batch

MONEY = "decimal(18,2)"


def filter_map(events: DataFrame, types: list[str]) -> DataFrame:
    """Keep some types; purchases keep their amount, anything else counts 1."""
    value = F.when(F.col("event_type") == "purchase", F.col("value")).otherwise(1.0)
    return events.where(F.col("event_type").isin(types)).select(
        "event_id", "ts", "user_id", F.col("event_type").alias("action"), value.alias("value")
    )


def _pane(width: str, step: str | None) -> str:
    """The widest span that divides a window and its step."""
    spans = [pd.Timedelta(span).value // 1000 for span in (width, step or width)]
    return f"{gcd(*spans)} microseconds"


def windowed(rows: DataFrame, keys: list[str], ts: str, width: str, step: str | None = None) -> DataFrame:
    """Count, exact sum and distinct actions per window and key, for tables and streams alike.

    Rows are summed per pane, key and action first; windows are put together from those sums, so no row is
    copied into the windows it lies in, and distinct actions are a count of sums: no task and no state holds
    the set of a window's actions. Null actions count as rows, not as distinct ones; rows without a time
    are in no window.
    """
    sums = rows.groupBy(F.window(ts, _pane(width, step)).alias("window"), *keys, "action").agg(
        F.count(F.lit(1)).alias("_rows"), F.sum(F.col("value").cast(MONEY)).alias("_value")
    )
    if step:
        sums = sums.groupBy(F.window("window", width, step).alias("window"), *keys, "action").agg(
            F.sum("_rows").alias("_rows"), F.sum("_value").alias("_value")
        )
    out = sums.groupBy("window", *keys).agg(
        F.sum("_rows").alias("action_count"),
        F.sum("_value").cast("double").alias("total_value"),
        F.count("action").alias("unique_actions"),
    )
    return out.select(
        F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *keys,
        "action_count", "total_value", "unique_actions",
    )


def dedup_within(
    rows: DataFrame, keys: list[str], order: list[str], seconds: int, slice_rows: int = HOT_ROWS
) -> DataFrame:
    """Keep a row unless the same key occurred within the span before it.

    A chain of repeats keeps only its first row. The streaming form differs: there the
    span starts at the first row that was kept.
    """
    before = ordered(rows, keys, order, previous={"_before": F.col(order[0])}, slice_rows=slice_rows)
    gap = F.unix_micros(F.col(order[0]).cast("timestamp")) - F.unix_micros(F.col("_before").cast("timestamp"))
    return before.where(F.col("_before").isNull() | (gap > seconds * 1_000_000)).drop("_before")


def error_rate(is_error: Column) -> list[Column]:
    """Aggregates: number of events, and the share that are errors."""
    return [F.count(F.lit(1)).alias("events"), F.avg(F.when(is_error, 1.0).otherwise(0.0)).alias("error_rate")]


def exact_percentiles(
    rows: DataFrame, keys: list[str], value: str, tie: str, shares: dict[str, float],
    others: list[Column] = (), slice_rows: int = HOT_ROWS,
) -> DataFrame:
    """Nearest-rank percentiles per key by rank, so a key of any size is exact.

    ``others`` are further aggregates over the same rows, taken in the same pass.
    """
    placed = ordered(rows, keys, [value, tie], number="_rank", total="_total", slice_rows=slice_rows)
    picked = [
        F.max(F.when(F.col("_rank") == F.ceil(F.col("_total") * F.lit(share)), F.col(value))).alias(name)
        for name, share in shares.items()
    ]
    return placed.groupBy(*keys).agg(*others, *picked)


def error_rate_window(
    rows: DataFrame, ts: str, width: str, value: str, tie: str, is_error: Column, keys: list[str] = (),
    slice_rows: int = HOT_ROWS,
) -> DataFrame:
    """Error rate and latency percentiles per window, in one pass."""
    rows = rows.withColumn("window_start", F.window(ts, width)["start"])
    shares = {"p50": 0.5, "p99": 0.99}
    return exact_percentiles(rows, ["window_start", *keys], value, tie, shares, error_rate(is_error), slice_rows)


# Ranks of a merged sketch are off by 0.13 % of the values at most (99 of 100 times); up to this many are kept whole.
SKETCH = 4_096


def latency_panes(
    rows: DataFrame, keys: list[str], ts: str, width: str, value: str, is_error: Column, size: int = SKETCH
) -> DataFrame:
    """Events, errors and a quantile sketch of ``value`` per pane and key, for tables and streams alike.

    Null and NaN values count as events only. What is kept of a pane is bounded by ``size``, not by its events.
    """
    number = F.when(~F.isnan(value), F.col(value))
    panes = rows.groupBy(F.window(ts, width).alias("window"), *keys).agg(
        F.count(F.lit(1)).alias("events"), F.count(F.when(is_error, 1)).alias("errors"),
        F.kll_sketch_agg_double(number, F.lit(size)).alias("sketch"),
    )
    return panes.select(F.col("window.start").alias("pane"), *keys, "events", "errors", "sketch")


def merged_panes(panes: DataFrame, keys: list[str], size: int = SKETCH) -> DataFrame:
    """Panes rolled up to ``keys``; the result can be rolled up again. No event is read."""
    return panes.groupBy(*keys).agg(
        F.sum("events").alias("events"), F.sum("errors").alias("errors"),
        F.kll_merge_agg_double("sketch", F.lit(size)).alias("sketch"),
    )


def with_percentiles(panes: DataFrame, shares: dict[str, float]) -> DataFrame:
    """Error rate and percentiles of (merged) panes; null where a pane has no values.

    Up to ``SKETCH`` values the nearest-rank ones, beyond that values whose rank is off as little as said there.
    """
    filled = F.kll_sketch_get_n_double("sketch") > 0
    at = {name: F.when(filled, F.kll_sketch_get_quantile_double("sketch", F.lit(share))) for name, share in shares.items()}
    return panes.withColumn("error_rate", F.col("errors") / F.col("events")).withColumns(at)


def value_panes(rows: DataFrame, keys: list[str], ts: str, width: str, value: str, is_error: Column) -> DataFrame:
    """Per pane and key: events and errors of every distinct ``value``, which is what exact percentiles need.

    Null and NaN values share the null one: they count as events only. No row holds more than one value of a pane.
    """
    number = F.when(~F.isnan(value), F.col(value))
    panes = rows.groupBy(F.window(ts, width).alias("window"), *keys, number.alias("value")).agg(
        F.count(F.lit(1)).alias("events"), F.count(F.when(is_error, 1)).alias("errors")
    )
    return panes.select(F.col("window.start").alias("pane"), *keys, "value", "events", "errors")


def merged_values(panes: DataFrame, keys: list[str]) -> DataFrame:
    """Value counts rolled up to ``keys``; the result can be rolled up again. No event is read."""
    return panes.groupBy(*keys, "value").agg(F.sum("events").alias("events"), F.sum("errors").alias("errors"))


def value_percentiles(
    panes: DataFrame, keys: list[str], shares: dict[str, float], slice_rows: int = HOT_ROWS
) -> DataFrame:
    """Events, error rate and exact nearest-rank percentiles of (merged) value counts; null where there are no values.

    Takes one row per key and value, so running sums of the events are ranks, whatever a key's size.
    """
    # Written once, as the sums and the ranks both read it.
    counted = durable(panes.withColumn("_known", F.when(F.col("value").isNotNull(), F.col("events")).otherwise(0)))
    sums = counted.groupBy(*keys).agg(F.sum("events").alias("events"), F.sum("errors").alias("errors"), F.sum("_known").alias("_total"))
    known = counted.where("value is not null").select(*keys, "value", "_known")
    ranked = ordered(known, keys, ["value"], running={"_upto": F.col("_known")}, slice_rows=slice_rows)
    totals = sums.select(*[F.col(k).alias(f"_k_{k}") for k in keys], "_total")
    same = reduce(lambda a, b: a & b, [ranked[k].eqNullSafe(totals[f"_k_{k}"]) for k in keys])
    picked = [
        F.min(F.when(F.col("_upto") >= F.ceil(F.col("_total") * F.lit(share)), F.col("value"))).alias(name)
        for name, share in shares.items()
    ]
    at = ranked.join(totals, same).groupBy(*[F.col(k).alias(f"_k_{k}") for k in keys]).agg(*picked)
    same = reduce(lambda a, b: a & b, [sums[k].eqNullSafe(at[f"_k_{k}"]) for k in keys])
    out = sums.join(at, same, "left").withColumn("error_rate", F.col("errors") / F.col("events"))
    return out.select(*keys, "events", "errors", "error_rate", *shares)


def gate_limits(phases: DataFrame) -> DataFrame:
    """Limits named in the gate text of each phase; a phase may name either or neither."""
    def limit(metric: str) -> Column:
        text = F.regexp_extract("metrics_gate", metric + r"\s*<\s*([0-9.]+)", 1)
        return F.nullif(text, F.lit("")).try_cast("double")

    return phases.select(
        "phase", limit("p99_latency_ms").alias("latency_limit"), limit("error_rate").alias("error_limit")
    )


def canary_gate(metrics: DataFrame, phases: DataFrame) -> DataFrame:
    """Whether the figures of each phase stay under the limits of its gate."""
    joined = keyed_join(metrics, gate_limits(phases), ["phase"])
    latency = F.col("latency_limit").isNull() | (F.col("p99") < F.col("latency_limit"))
    errors = F.col("error_limit").isNull() | (F.col("error_rate") < F.col("error_limit"))
    return joined.withColumn("gate_ok", latency & errors)


def stale(rows: DataFrame, sent_ms: str, received_ms: str, seconds: int = 30) -> DataFrame:
    """Requests at most ``seconds`` old when received; times are epoch milliseconds."""
    sent, received = F.timestamp_millis(F.col(sent_ms)), F.timestamp_millis(F.col(received_ms))
    return rows.where(received - sent <= F.expr(f"INTERVAL {seconds} SECONDS"))


def clean_numeric(rows: DataFrame, column: str, fill: float | None = None) -> DataFrame:
    """Text to numbers; what does not parse is filled, or dropped without a fill."""
    out = rows.withColumn(column, F.col(column).try_cast("double"))
    return out.na.drop(subset=[column]) if fill is None else out.na.fill({column: fill})


def _sweep(key: str, names: list[str], micros: int):
    """Pairs of one task's rows, which come in order of key, chunk, salt and time, left rows first among equals.

    Left rows are carried from batch to batch only as long as a right row can still reach them.
    """
    group = [key, "_chunk", "_salt"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, number, last = None, 0, None  # left rows with their group's number; the last row's group
        for batch in batches:
            if not batch.num_rows:
                continue
            new = np.zeros(batch.num_rows, dtype=bool)
            for name in group:
                column = batch[name]
                new[1:] |= pc.not_equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False)
            first = tuple(batch[name][0].as_py() for name in group)
            new[0] = last is not None and first != last
            last = tuple(batch[name][-1].as_py() for name in group)
            groups = number + np.cumsum(new)
            number = int(groups[-1])
            at, is_right = batch["_at"].to_numpy(), batch["_side"].to_numpy() == 1
            ours = np.flatnonzero(~is_right)
            lefts = pa.table({"row": batch["_left"].take(pa.array(ours)), "group": groups[ours], "at": at[ours]})
            held = lefts if held is None else pa.concat_tables([held, lefts]).combine_chunks()
            own, when = held["group"].to_numpy(), held["at"].to_numpy()
            theirs = np.flatnonzero(is_right)
            if len(theirs) and held.num_rows:
                # Held rows are in order, so those a right row meets are a run of them: up to itself, and from span before.
                upto = _places(own, when, groups[theirs], at[theirs], True)
                since = _places(own, when, groups[theirs], at[theirs] - micros, False)
                yield from _pairs(_one_chunk(held["row"]), batch["_right"], since, upto, theirs, names)
            held = held.filter(pa.array((own == number) & (when >= at[-1] - micros)))

    return run


def _one_chunk(column: pa.ChunkedArray) -> pa.Array:
    whole = column.combine_chunks()
    return whole if isinstance(whole, pa.Array) else pa.concat_arrays(whole.chunks)


def _places(groups: np.ndarray, times: np.ndarray, of: np.ndarray, at: np.ndarray, after_equal: bool) -> np.ndarray:
    """How many of the rows (in order of group and time) come before each (``of``, ``at``), or up to it."""
    n = len(groups)
    tie = np.concatenate([np.ones(n, dtype=np.int8), np.full(len(of), 2 if after_equal else 0, dtype=np.int8)])
    order = np.lexsort((tie, np.concatenate([times, at]), np.concatenate([groups, of])))
    counted = np.empty(len(order), dtype=np.int64)
    counted[order] = np.cumsum(order < n)
    return counted[n:]


def _pairs(
    lefts: pa.StructArray, rights: pa.StructArray, since: np.ndarray, upto: np.ndarray, rows: np.ndarray, names: list[str]
) -> Iterator[pa.RecordBatch]:
    """Left rows ``since`` to ``upto`` next to right row ``rows``, in batches of about SWEPT pairs."""
    length = np.maximum(upto - since, 0)
    ends = np.cumsum(length)
    for start in range(0, int(ends[-1]), SWEPT):
        pair = np.arange(start, min(start + SWEPT, int(ends[-1])))
        right = np.searchsorted(ends, pair, side="right")
        left = since[right] + pair - (ends[right] - length[right])
        columns = lefts.take(pa.array(left)).flatten() + rights.take(pa.array(rows[right])).flatten()
        yield pa.RecordBatch.from_arrays(columns, names)


def join_within(
    left: DataFrame, right: DataFrame, key: str, left_ts: str, right_ts: str, seconds: int, slice_rows: int = HOT_ROWS
) -> DataFrame:
    """Pairs of one key whose right row follows within the span, by a sweep in time order.

    Gives all columns of the left side, then those of the right side but its key; their names must differ. The rows of a key are cut
    into chunks of CHUNK spans. A right row goes to its own chunk only; a left row of a chunk's last span goes to
    the next one as well, so a quarter of them is sent twice. A task merges both sides in order of time and holds
    the left rows of one span. The right rows of a chunk with more than ``slice_rows`` of them are dealt to
    several tasks, and only its left rows are sent to each. Rows without key or time have no pairs.
    """
    micros = lambda column: F.unix_micros(F.col(column).cast("timestamp"))
    span = seconds * 1_000_000
    width = span * CHUNK or 1
    packed = lambda names: F.struct(*[F.col(c) for c in names])
    others = [c for c in right.columns if c != key]
    chunk = F.floor(F.col("_at") / F.lit(width)).cast("long")
    l_rows = left.where(F.col(key).isNotNull() & F.col(left_ts).isNotNull()).select(key, micros(left_ts).alias("_at"), packed(left.columns).alias("_left"))
    r_rows = right.where(F.col(key).isNotNull() & F.col(right_ts).isNotNull()).select(key, micros(right_ts).alias("_at"), packed(others).alias("_right"))
    l_rows = l_rows.withColumn("_chunk", F.explode(F.sequence(chunk, F.floor((F.col("_at") + span) / F.lit(width)).cast("long"))))
    r_rows = r_rows.withColumn("_chunk", chunk)

    # At most one row of this for every slice_rows right rows.
    counts = r_rows.groupBy(key, "_chunk").agg(F.count(F.lit(1)).alias("_n"))
    hot = counts.where(F.col("_n") > slice_rows).select(key, "_chunk", F.ceil(F.col("_n") / slice_rows).cast("int").alias("_parts"))
    hot = durable(hot)
    n_hot = hot.count()
    if n_hot:
        parts = F.coalesce("_parts", F.lit(1))
        side = F.broadcast(hot) if n_hot <= HOT_CHUNKS else hot
        l_rows = l_rows.join(side, [key, "_chunk"], "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), parts - 1)))
        r_rows = r_rows.join(side, [key, "_chunk"], "left").withColumn("_salt", F.pmod(F.xxhash64("_at", "_right"), parts).cast("int"))
    else:
        l_rows, r_rows = l_rows.withColumn("_salt", F.lit(0)), r_rows.withColumn("_salt", F.lit(0))

    place = [key, "_chunk", "_salt", "_at"]
    l_type, r_type = l_rows.schema["_left"].dataType, r_rows.schema["_right"].dataType
    both = l_rows.select(*place, F.lit(0).alias("_side"), "_left", F.lit(None).cast(r_type).alias("_right")).unionByName(
        r_rows.select(*place, F.lit(1).alias("_side"), F.lit(None).cast(l_type).alias("_left"), "_right")
    )
    dealt = both.repartition(key, "_chunk", "_salt").sortWithinPartitions(*place, "_side")
    fields = StructType([StructField(f.name, f.dataType) for f in (*l_type.fields, *r_type.fields)])
    return dealt.mapInArrow(_sweep(key, fields.names, span), fields)


def pivot_sum(rows: DataFrame, keys: list[str], kind: str, value: str, kinds: list[str], rest: str = "other") -> DataFrame:
    """Sum of ``value`` per key in a column for each of ``kinds``, and for all other kinds (null too) in ``rest``."""
    name = F.when(F.col(kind).isin(kinds), F.col(kind)).otherwise(F.lit(rest))
    total = F.sum(F.col(value).cast(MONEY)).cast("double")
    return rows.withColumn("_kind", name).groupBy(*keys).pivot("_kind", [*kinds, rest]).agg(total)
