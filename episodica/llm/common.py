"""What several operators share: gapless numbers, words, text functions over Arrow batches."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import lru_cache, wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from episodica.session import durable, prepare

# Rows and bytes of one Arrow batch: long texts must not meet in one batch by the thousand.
BATCH = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20),
}


def session(spark: SparkSession) -> SparkSession:
    prepare(spark)
    for key, value in BATCH.items():
        spark.conf.set(key, value)
    return spark


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return session(spark).read.parquet(f"{folder}/{name}.parquet")


def fit_rows(df: DataFrame, limit: int, *keys: str) -> DataFrame:
    """A bounded sample to fit on: the ``limit`` rows of smallest key hash, so the same on every run.

    ``keys`` name a row (or nearly so). Rows far above the hash of the last one that can be
    in the sample go before the sort, so that no task gets more than about twice the limit.
    """
    mark = F.pmod(F.xxhash64(*keys), F.lit(1 << 32))
    n = df.count()
    if n > 2 * limit:
        df = df.where(mark < int((1 << 32) * 2 * limit / n))
    return df.orderBy(mark, *keys).limit(limit)


def unused(df: DataFrame, name: str) -> str:
    """``name``, or a longer one that ``df`` has no column of."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def with_rows(df: DataFrame, name: str) -> DataFrame:
    """``df`` with a number of each row, written once: later scans may be split in other ways."""
    return durable(df.withColumn(name, F.monotonically_increasing_id()))


def numbered(df: DataFrame, name: str, order: list[str], group: list[str] | None = None) -> DataFrame:
    """``df`` with gapless numbers from 0 in ``order``, per ``group`` if given.

    Rows are range-partitioned by group and order; a number is the row's place in its
    partition plus the rows of earlier partitions. A group that holds a third of all rows
    spreads over as many partitions as its size asks for, and equal rows are cut apart by
    their place in the input. The partitions are written to the shared folder, so a
    recomputed task cannot move a number.
    """
    group = group or []
    cut = durable(
        df.withColumn("__tie", F.monotonically_increasing_id())
        .repartitionByRange(*[F.col(c) for c in (*group, *order)], F.col("__tie"))
        .sortWithinPartitions(*group, *order, "__tie")
        .withColumn("__part", F.spark_partition_id())
        .withColumn("__at", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1))
        .drop("__tie")
    )
    # One row per partition and group that meets it.
    parts = cut.groupBy("__part", *group).agg(F.count(F.lit(1)).alias("__n"), F.min("__at").alias("__first"))
    before = Window.partitionBy(*group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    shift = parts.select(
        F.col("__part").alias("__p"), *[F.col(c).alias(f"__g_{c}") for c in group],
        (F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__first")).alias("__shift"),
    )
    same = F.col("__part") == F.col("__p")
    for c in group:
        same = same & F.col(c).eqNullSafe(F.col(f"__g_{c}"))
    if not group:
        shift = F.broadcast(shift)  # one row per partition
    return (
        cut.join(shift, same)
        .withColumn(name, F.col("__at") + F.col("__shift"))
        .drop("__part", "__at", "__p", "__shift", *[f"__g_{c}" for c in group])
    )


def words(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` in UTF-8; ``bytes.split`` cuts at exactly these characters."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


@lru_cache(maxsize=1)
def _trim():
    return getattr(ctypes.CDLL(None), "malloc_trim", None)


def release() -> None:
    """Give back what a task has freed: a worker lives on, and other stages need its memory."""
    pa.default_memory_pool().release_unused()
    if trim := _trim():
        trim(0)


def tidied(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` over batches, with the task's freed memory given back at its end."""

    @wraps(run)
    def both(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return both


def per_text(each: Callable[[], Callable[[list], pa.Array]], kind: str) -> Callable[[Column], Column]:
    """A column function over Arrow batches of texts.

    ``each`` is called once in every task and gives the function from a list of texts to an
    Arrow array, so a tokenizer or an automaton is built once and not per batch.
    """

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        work = each()
        try:
            for batch in batches:
                yield work(batch.to_pylist())
        finally:
            release()

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, kind)
