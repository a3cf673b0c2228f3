"""Water levels: daily figures, flood days, severity and rankings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from episodica.plans.skew import HOT_ROWS, keyed_join, ordered


def daily_levels(levels: DataFrame) -> DataFrame:
    """Highest, mean and lowest level per station and day; days without data do not appear."""
    day = F.to_date("ts").alias("day")
    return levels.groupBy("station_id", day).agg(
        F.max("level").alias("level"), F.avg("level").alias("mean_level"), F.min("level").alias("low_level")
    )


def _flooded(daily: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Days at or above the station's threshold; stations without one drop out."""
    joined = keyed_join(daily, thresholds.select("station_id", "flood"), ["station_id"])
    return joined.where(F.col("level") >= F.col("flood"))


def flood_days(daily: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Rows at or above the threshold per station, for stations that have any."""
    return _flooded(daily, thresholds).groupBy("station_id").agg(F.count(F.lit(1)).alias("flood_days"))


def flood_dates(daily: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Sorted flood dates. Daily rows bound each list by the calendar."""
    dates = F.array_sort(F.collect_set("day"))
    return _flooded(daily, thresholds).groupBy("station_id").agg(dates.alias("dates"))


def severity(level: Column) -> Column:
    """Highest class whose threshold the level reaches."""
    return (
        F.when(level >= F.col("major"), "major")
        .when(level >= F.col("moderate"), "moderate")
        .when(level >= F.col("flood"), "minor")
        .when(level >= F.col("action"), "action")
        .otherwise("normal")
    )


def flood_severity(daily: DataFrame, thresholds: DataFrame) -> DataFrame:
    return keyed_join(daily, thresholds, ["station_id"]).withColumn("severity", severity(F.col("level")))


def ranked(counts: DataFrame) -> DataFrame:
    """Stations by flood days, most first; ties by station."""
    return counts.orderBy(F.desc("flood_days"), "station_id")


def flood_report(levels: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Instantaneous levels to ranked flood days."""
    return ranked(flood_days(daily_levels(levels), thresholds))


def consecutive_failures(
    rows: DataFrame, keys: list[str], order: list[str], failed: Column, least: int = 3,
    slice_rows: int = HOT_ROWS,
) -> DataFrame:
    """Runs of at least ``least`` failures in a row.

    A run is named by the number of successes before it, which is a running sum.
    """
    rows = rows.withColumn("_failed", failed)
    good = F.when(F.col("_failed"), 0).otherwise(1)
    numbered = ordered(rows, keys, order, running={"_run": good}, slice_rows=slice_rows)
    at = F.struct(*order)
    return (
        numbered.where("_failed")
        .groupBy(*keys, "_run")
        .agg(F.count(F.lit(1)).alias("failures"), F.min(at).alias("first"), F.max(at).alias("last"))
        .where(F.col("failures") >= least)
        .drop("_run")
    )


def rate_limit_flag(rows: DataFrame, key: str, ts: str, limit: int = 100, seconds: int = 60) -> DataFrame:
    """Each request with the count of its key in the trailing span, and whether it is over.

    Requests are counted per key and second first. Seconds are then windowed per key and
    block of one hour; a second near the end of a block is also lent to the next block, so
    blocks are independent and no window holds more than an hour and a span of one key.
    """
    second = F.unix_seconds(F.col(ts).cast("timestamp"))
    rows = rows.withColumn("_second", second)
    per_second = rows.groupBy(key, "_second").agg(F.count(F.lit(1)).alias("_n"))
    block = F.lit(max(3600, seconds))
    own = F.floor(F.col("_second") / block)
    lent = F.floor((F.col("_second") + seconds - 1) / block)
    blocks = per_second.withColumn("_block", F.explode(F.array_distinct(F.array(own, lent))))
    span = Window.partitionBy(key, "_block").orderBy("_second").rangeBetween(-(seconds - 1), 0)
    counted = (
        blocks.withColumn("in_span", F.sum("_n").over(span))
        .where(F.col("_block") == own)
        .select(key, "_second", "in_span")
    )
    # One row per key and second on the right: a burst within one second is the only skew left.
    out = keyed_join(rows, counted, [key, "_second"])
    return out.withColumn("limited", F.col("in_span") > limit).drop("_second")
