"""Session settings and the shared folder for checkpoints, feeds and sinks."""

from __future__ import annotations

import tempfile
import uuid

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Runtime settings every job relies on. Partition counts stay with the cluster.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Also where the split costs a further shuffle.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.ansi.enabled": "true",
}

_local_dirs: dict[str, str] = {}
_cuts: list[str] = []  # folders that durable has written


def prepare(spark: SparkSession) -> SparkSession:
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a scratch one only in local mode."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _local_dirs:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        _local_dirs[app] = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    return _local_dirs[app]


def fresh_dir(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage: write the rows to the shared folder and read them back.

    A lost executor loses nothing then, values tied to a partition stay as they are, and
    later steps read only the columns they use.
    """
    path = fresh_dir(df.sparkSession, "cut")
    _cuts.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def cuts() -> Iterator[list[str]]:
    """The list given holds, after the block, the folders that ``durable`` wrote in it."""
    before, made = len(_cuts), []
    try:
        yield made
    finally:
        made += _cuts[before:]


def drop_cuts(spark: SparkSession, folders: list[str], reads: DataFrame) -> list[str]:
    """Remove folders of ``durable`` once what they led to is written; gives those that stay.

    All stay if ``reads``, the table to go on with, still reads from one of them.
    """
    files = reads.inputFiles()
    if any(f"/{folder.rsplit('/', 1)[-1]}/" in file for file in files for folder in folders):
        return folders
    for folder in folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return []
