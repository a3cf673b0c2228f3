"""Versioned rows: time travel, version ranges, and joins to the version in force."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from episodica.plans.skew import HOT_ROWS, keyed_join, ordered


def row_versions(
    df: DataFrame, keys: list[str], order: list[str], slice_rows: int = HOT_ROWS
) -> DataFrame:
    """Add ``valid_to``: the start of the key's next version (null for the last).

    ``order`` starts with ``valid_from``. Of two versions at one instant the earlier one
    gets an empty span, so it is never in force.
    """
    return ordered(df, keys, order, following={"valid_to": F.col(order[0])}, slice_rows=slice_rows)


def _instant(at: str) -> Column:
    return F.lit(at).cast("timestamp_ntz")


def as_of(versions: DataFrame, at: str) -> DataFrame:
    """Rows in force at an instant: start included, end excluded."""
    t = _instant(at)
    return versions.where((F.col("valid_from") <= t) & (F.col("valid_to").isNull() | (t < F.col("valid_to"))))


def as_of_ago(versions: DataFrame, now: str, interval: str) -> DataFrame:
    """Rows in force an interval before a stated instant."""
    t = _instant(now) - F.expr(f"INTERVAL {interval}")
    return versions.where((F.col("valid_from") <= t) & (F.col("valid_to").isNull() | (t < F.col("valid_to"))))


def versions_between(versions: DataFrame, low: str, high: str) -> DataFrame:
    """All versions whose span meets [low, high]."""
    ends_later = F.col("valid_to").isNull() | (F.col("valid_to") > _instant(low))
    return versions.where((F.col("valid_from") <= _instant(high)) & ends_later)


def temporal_join_fixed(left: DataFrame, right: DataFrame, on: list[str], at: str) -> DataFrame:
    """Equi-join of both sides as they were at one instant."""
    spans = ["valid_from", "valid_to"]
    return keyed_join(as_of(left, at).drop(*spans), as_of(right, at).drop(*spans), on)


def temporal_join_asof(
    facts: DataFrame, versions: DataFrame, key: str, at: str, value: str, tie: str,
    slice_rows: int = HOT_ROWS,
) -> DataFrame:
    """Each fact with the version of its key in force at its own time (null before the first).

    Versions and facts are merged in time order and the last version is carried along, so
    no pairs are formed. ``tie`` orders versions of one instant; versions come before the
    facts of their instant.
    """
    started = versions.select(
        key, F.col("valid_from").alias("_at"), F.lit(0).alias("_late"), F.col(tie).alias("_tie"),
        F.struct(F.col(value), F.col("valid_from")).alias("_version"),
    )
    wanted = facts.select(
        key, F.col(at).alias("_at"), F.lit(1).alias("_late"), F.struct(*facts.columns).alias("_fact")
    )
    merged = started.unionByName(wanted, allowMissingColumns=True)
    carried = ordered(
        merged, [key], ["_at", "_late", "_tie"], carry={"_in_force": F.col("_version")}, slice_rows=slice_rows
    )
    return carried.where(F.col("_late") == 1).select("_fact.*", "_in_force.*")


def temporal_agg(df: DataFrame, key: str, ts: str, value: str, amount: str) -> DataFrame:
    """Daily average of one column beside the weekly maximum and minimum of another.

    The weekly figures are taken over the daily rows, of which a key has at most seven in
    a week, so that window stays small whatever the key.
    """
    daily = df.groupBy(key, F.window(ts, "1 day").alias("day")).agg(
        F.avg(value).alias("avg_daily"), F.max(amount).alias("_max"), F.min(amount).alias("_min")
    )
    daily = daily.select(key, F.col("day.start").alias("day"), "avg_daily", "_max", "_min")
    week = Window.partitionBy(key, "_week")
    return (
        daily.withColumn("_week", F.window("day", "1 week")["start"])
        .withColumns({"max_weekly": F.max("_max").over(week), "min_weekly": F.min("_min").over(week)})
        .drop("_week", "_max", "_min")
    )
