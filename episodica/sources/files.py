"""Readers and writers for bank tables, gauge data, threshold reports and results."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from episodica.plans.skew import keyed_join
from episodica.sources import schemas
from episodica.sources.codecs import graph_lines, graph_tables

MISSING = -9999.0  # fixed value: the sentinel of the threshold report


def read_skills(spark: SparkSession, path: str, form: str = "parquet") -> DataFrame:
    return spark.read.schema(schemas.SKILLS).format(form).load(path)


def read_tasks(spark: SparkSession, path: str, form: str = "parquet") -> DataFrame:
    """Task bank; ``source`` and ``template`` are null where a task has none."""
    return spark.read.schema(schemas.TASKS).format(form).load(path)


def read_thresholds(spark: SparkSession, path: str) -> DataFrame:
    """Threshold report: CSV with a header, ids kept as text, sentinel values dropped."""
    fields = "`usgs id` STRING, `flood stage` STRING, `moderate flood stage` STRING, `major flood stage` STRING"
    raw = spark.read.option("header", True).schema(fields).csv(path)

    def stage(name: str) -> Column:
        value = F.col(f"`{name}`").try_cast("double")
        return F.when(value != MISSING, value)

    return raw.select(
        F.col("`usgs id`").alias("station_id"),
        stage("flood stage").alias("flood"),
        stage("moderate flood stage").alias("moderate"),
        stage("major flood stage").alias("major"),
    ).where(F.col("flood").isNotNull())


def gauge_rows(
    levels: DataFrame, sites: DataFrame, start: str, end: str, parameter: str
) -> DataFrame:
    """Rows of the given sites in [start, end) for one parameter code.

    The range and code reach the scan as pushed filters; the sites come as a table.
    """
    asked = levels.where(
        (F.col("ts") >= F.lit(start).cast("timestamp_ntz"))
        & (F.col("ts") < F.lit(end).cast("timestamp_ntz"))
        & (F.col("parameter") == parameter)
    )
    return keyed_join(asked, sites.select("station_id").distinct(), ["station_id"], "left_semi")


def write_partitioned(df: DataFrame, path: str, by: list[str]) -> None:
    """Result table partitioned by a few low-cardinality columns."""
    df.write.mode("overwrite").partitionBy(*by).parquet(path)


def routed(df: DataFrame, routes: dict[str, Column], default: str = "default") -> DataFrame:
    """Name of the first route whose condition holds."""
    name = F.lit(None).cast("string")
    for route, condition in reversed(routes.items()):
        name = F.when(condition, F.lit(route)).otherwise(name)
    return df.withColumn("route", F.coalesce(name, F.lit(default)))


def branch_writer(
    routes: dict[str, Column], folder: str, default: str = "default"
) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` function: one pass over a micro-batch, one folder per route.

    Each batch overwrites its own folder, so a replayed batch leaves no copies.
    """

    def write(batch: DataFrame, number: int) -> None:
        out = routed(batch, routes, default)
        out.write.mode("overwrite").partitionBy("route").parquet(f"{folder}/batch={number}")

    return write


def read_sink(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """What ``branch_writer`` wrote; a stream that had no rows has written no folder."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.read.schema(schema).parquet(folder)
    return spark.createDataFrame([], schema)


def decoded(df: DataFrame, text: str, schema: str) -> DataFrame:
    """Parse JSON text; undecodable rows keep their text in ``bad``."""
    fields = f"{schema}, bad STRING"
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "bad"}
    return df.withColumn("parsed", F.from_json(text, fields, options))


def dead_letters(df: DataFrame, text: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Rows that decode, and rows that do not."""
    parsed = decoded(df, text, schema)
    bad = F.col("parsed").isNull() | F.col("parsed.bad").isNotNull()
    return parsed.where(~bad), parsed.where(bad).drop("parsed")


GRAPH_FILES = "script_id string, file string, nodes long, edges long"


def _graph_name(script_id: str | None) -> str:
    """Readable, and without the percent signs that paths are escaped with."""
    return "null.json" if script_id is None else f"id-{quote(script_id, safe='').replace('%', '=')}.json"


def _graph_writer(folder: str):
    names = [f.split()[0] for f in GRAPH_FILES.split(", ")]
    schema = pa.schema([(n, pa.string() if n in ("script_id", "file") else pa.int64()) for n in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = pafs.FileSystem.from_uri(folder)
        attempt = f"{root}/_attempt-{TaskContext.get().taskAttemptId()}"
        current, out, counts, part = None, None, [0, 0], 0

        def close() -> pa.RecordBatch:
            """The frame is closed and the file gets its name: only whole documents are ever seen under it."""
            if part == 0:
                out.write(b'\n],"edges":[')
            out.write(b"\n]}\n")
            out.close()
            name = _graph_name(current)
            if store.get_file_info(f"{root}/{name}").type != pafs.FileType.NotFound:
                store.delete_file(f"{root}/{name}")
            store.move(f"{attempt}/{name}", f"{root}/{name}")
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip([current, name, *counts], schema)], schema=schema)

        try:
            for batch in batches:
                for script_id, kind, line in zip(*(c.to_pylist() for c in batch.columns)):
                    if out is None or script_id != current:
                        if out is not None:
                            yield close()
                        store.create_dir(attempt, recursive=True)
                        current, counts, part = script_id, [0, 0], 0
                        out = store.open_output_stream(f"{attempt}/{_graph_name(script_id)}", compression=None)
                        out.write(b'{"nodes":[')
                    if kind != part:
                        out.write(b'\n],"edges":[')
                        part = kind
                    # A line feed inside of a text is escaped in JSON, so an object is one line.
                    out.write((b",\n" if counts[kind] else b"\n") + line.encode("utf-8", "surrogatepass"))
                    counts[kind] += 1
            if out is not None:
                yield close()
        finally:
            if out is not None:
                out.close()
                store.delete_dir(attempt)

    return run


def write_graphs(nodes: DataFrame, edges: DataFrame, folder: str) -> DataFrame:
    """One JSON document a graph in ``folder``, of any size; gives the list of files as GRAPH_FILES.

    A task gets the objects of its graphs in order and writes them on as they come, one a
    line, so it holds no document. A file appears under its name when it is whole, and a task
    that runs again writes the same. The list is lazy: files are written when it is read.
    """
    lines = graph_lines(nodes, edges).withColumn("script_id", F.col("script_id").cast("string"))
    parts = lines.repartition("script_id").sortWithinPartitions("script_id", "part", "line")
    return parts.select("script_id", "part", "line").mapInArrow(_graph_writer(folder), GRAPH_FILES)


def read_graphs(spark: SparkSession, folder: str, id_type: str = "string") -> tuple[DataFrame, DataFrame]:
    """Node and edge tables of the documents in ``folder``; a large file is read by many tasks, line by line."""
    name = F.regexp_extract(F.col("_metadata.file_name"), "^id-(.*)[.]json$", 1)
    given = F.when(F.col("_metadata.file_name") != "null.json", F.url_decode(F.replace(name, F.lit("="), F.lit("%"))).cast(id_type))
    lines = spark.read.text(folder).select(given.alias("script_id"), F.col("value").alias("line"))
    return graph_tables(lines)
