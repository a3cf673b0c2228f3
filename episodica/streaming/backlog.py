"""A backlog of event files as a stream in order of event time, and the rows that a watermark drops.

Files of a backlog come to a stream by age, and their ages say nothing about the times in
them: with several micro-batches a watermark would drop the rows of a file that comes after
a later one. Here the rows are dealt by range of time into slices of bounded size, written
once, and the stream gets the slices one after another. No row of a slice is older than
one of a slice before, so none is late, whatever the files' order, number and size.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from episodica.session import fresh_dir
from episodica.streaming import jobs

SLICE_BYTES = 16 << 30  # of input files; a slice is one micro-batch
FILE_BYTES = 128 << 20


def _store(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def file_bytes(spark: SparkSession, pattern: str) -> int:
    """Bytes of all files that the pattern names, as the file system counts them."""
    place, store = _store(spark, pattern)
    return sum(store.getContentSummary(found.getPath()).getLength() for found in store.globStatus(place) or [])


class Backlog:
    """Event files (one file, or folders of part files) as a feed of slices in order of event time.

    A backlog of one slice is read where it lies. A larger one is written once, by range of
    time, and ``advance`` shows the stream one slice more; that is a rename, which object
    stores carry out as a copy. Slices end between two times, so equal times share one. Rows without
    a time are in the first slice. A feed that is given a ``folder`` to go on with does not deal again.
    """

    def __init__(self, spark: SparkSession, pattern: str, slice_bytes: int = SLICE_BYTES, ts: str = "ts", folder: str | None = None):
        self.spark, self.folder = spark, folder or fresh_dir(spark, "feed")
        slices = -(-file_bytes(spark, pattern) // slice_bytes)
        self.sliced = slices > 1
        if not self.sliced:
            self.path = pattern
            return
        self.path = f"{self.folder}/shown/*"
        place, store = _store(spark, f"{self.folder}/dealt/_SUCCESS")
        if not store.exists(place):
            self._deal(pattern, slices, max(1, slice_bytes // FILE_BYTES), ts)
        shown, store = _store(spark, f"{self.folder}/shown")
        store.mkdirs(shown)
        if not store.listStatus(shown):
            self.advance()

    def _deal(self, pattern: str, slices: int, files: int, ts: str) -> None:
        """Range partitions of time, ``files`` of them a slice. Equal times lie in one partition."""
        rows = self.spark.read.schema(jobs.FEED_SCHEMA).parquet(pattern).repartitionByRange(slices * files, F.col(ts).asc_nulls_first())
        slice_number = F.format_string("%07d", F.floor(F.spark_partition_id() / files).cast("int"))
        rows.withColumn("slice", slice_number).write.mode("overwrite").partitionBy("slice").parquet(f"{self.folder}/dealt")

    def advance(self) -> bool:
        """Show the stream the next slice; false if there is none."""
        if not self.sliced:
            return False
        dealt, store = _store(self.spark, f"{self.folder}/dealt")
        waiting = sorted(s.getPath().getName() for s in store.listStatus(dealt) if s.isDirectory())
        if not waiting:
            return False
        whole = _store(self.spark, f"{self.folder}/dealt/{waiting[0]}")[0]
        if not store.rename(whole, _store(self.spark, f"{self.folder}/shown/{waiting[0]}")[0]):
            raise OSError(f"cannot move {whole}")
        return True

    def rows(self, delay: str | None = None) -> DataFrame:
        """The feed as a stream with its watermark. Several streams, or both sides of a join, may read it."""
        return jobs.event_source(self.spark, self.path, delay=delay)

    def drain(self, stream: DataFrame, place: tuple[str, str] | None = None) -> DataFrame:
        """Run ``stream`` over all slices, from its saved progress at each, and read its sink."""
        place = place or jobs.new_place(self.spark)
        out = jobs.drain(stream, place)
        while self.advance():
            out = jobs.drain(stream, place)
        return out

    def drain_batches(self, stream: DataFrame, write: Callable[[DataFrame, int], None]) -> None:
        """The same, handing micro-batches to a writer."""
        progress = fresh_dir(self.spark, "progress")
        jobs.drain_batches(stream, write, progress=progress)
        while self.advance():
            jobs.drain_batches(stream, write, progress=progress)


def late_writer(folder: str, width: str, delay: str, ts: str = "ts") -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` function that keeps the rows a windowed aggregate over the same feed drops as late.

    A row is late if its window had ended when the batch began, by the newest time of all
    earlier batches less ``delay``. Each batch writes its own folders, newest time included, so
    a replayed batch leaves no copies and a restarted stream goes on with the same mark.
    Rows without a time are in no window, and not late.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        marks = read_batches(spark, f"{folder}/marks", "newest timestamp, batch int").where(F.col("batch") < number)
        newest = marks.agg(F.unix_millis(F.max("newest"))).first()[0]
        mark = F.timestamp_millis(F.lit(newest).cast("long")) - F.expr(f"INTERVAL {delay}")
        late = batch.where(F.window(ts, width)["end"] <= mark)
        late.write.mode("overwrite").parquet(f"{folder}/late/batch={number}")
        batch.agg(F.max(ts).alias("newest")).write.mode("overwrite").parquet(f"{folder}/marks/batch={number}")

    return write


def read_batches(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """What batches wrote under ``folder``; no rows before the first."""
    place, store = _store(spark, folder)
    return spark.read.schema(schema).parquet(folder) if store.exists(place) else spark.createDataFrame([], schema)
