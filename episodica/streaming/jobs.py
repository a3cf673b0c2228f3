"""Streaming forms of the event operators, over any file feed (or other source)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from episodica.operators.events import latency_panes, windowed
from episodica.session import fresh_dir
from episodica.sources.schemas import EVENTS

FEED_SCHEMA = EVENTS.replace("TIMESTAMP", "TIMESTAMP_NTZ")


def event_source(
    spark: SparkSession, folder: str, *, pattern: str | None = None, form: str = "parquet",
    delay: str | None = None, schema: str = FEED_SCHEMA, per_trigger: dict[str, str] | None = None,
) -> DataFrame:
    """Event feed from the files of a folder, with event time ``ts`` and its watermark.

    ``per_trigger`` bounds a micro-batch: ``maxFilesPerTrigger`` or ``maxBytesPerTrigger``.
    """
    reader = spark.readStream.format(form).schema(schema).options(**(per_trigger or {}))
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    feed = reader.load(folder).withColumn("ts", F.col("ts").cast("timestamp"))
    return feed.withWatermark("ts", delay) if delay else feed


def new_place(spark: SparkSession) -> tuple[str, str]:
    """Folders for the sink and the progress of one stream."""
    return fresh_dir(spark, "sink"), fresh_dir(spark, "progress")


def drain(stream: DataFrame, place: tuple[str, str] | None = None, mode: str = "append") -> DataFrame:
    """Run a stream over all data there is into a parquet sink, and read the sink.

    Sink and progress live in the shared folder, so a lost executor or driver resumes, and
    a later run with the same ``place`` goes on where this one ended.
    """
    spark = stream.sparkSession
    sink, progress = place or new_place(spark)
    query = (
        stream.writeStream.format("parquet").outputMode(mode).option("path", sink)
        .option("checkpointLocation", progress).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(sink)


def drain_batches(
    stream: DataFrame, write: Callable[[DataFrame, int], None], mode: str = "append", progress: str | None = None
) -> None:
    """Run a stream over all data there is, handing each micro-batch to a writer."""
    query = (
        stream.writeStream.foreachBatch(write).outputMode(mode)
        .option("checkpointLocation", progress or fresh_dir(stream.sparkSession, "progress"))
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()


def tumbling(feed: DataFrame, keys: list[str], width: str, step: str | None = None) -> DataFrame:
    """Windowed count, sum and distinct actions; a window appears once it is closed.

    These are chained stateful aggregates: the first keeps one sum per pane, key and action.
    """
    return windowed(feed, keys, "ts", width, step)


def dedup(feed: DataFrame, keys: list[str]) -> DataFrame:
    """First row of a key within the watermark delay, which is the span here."""
    return feed.dropDuplicatesWithinWatermark(keys)


def join_within(left: DataFrame, right: DataFrame, key: str, seconds: int) -> DataFrame:
    """Pairs of one key whose right row follows within the span.

    Both sides carry watermarks, and the span bounds the state kept for each.
    """
    span = F.expr(f"INTERVAL {seconds} SECONDS")
    l, r = left.alias("l"), right.alias("r")
    return l.join(
        r,
        (F.col(f"l.{key}") == F.col(f"r.{key}"))
        & (F.col("r.ts") >= F.col("l.ts"))
        & (F.col("r.ts") <= F.col("l.ts") + span),
    )


def error_rates(feed: DataFrame, width: str, is_error: Column) -> DataFrame:
    """Error rate per closed window, with a sketch of the values that later roll-ups merge."""
    panes = latency_panes(feed, [], "ts", width, "value", is_error)
    return panes.withColumnRenamed("pane", "window_start").withColumn("error_rate", F.col("errors") / F.col("events"))
