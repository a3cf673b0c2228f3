"""Files of one header and then records, of any size; a large file is decoded by many tasks.

Where a record begins is known only from the one before it. So a file is cut into spans, and
every span guesses its first record: the first byte from which records follow one another.
It then walks to its end and says where the next span should begin. Guesses that do not meet
the span before them are walked again from the right byte, and only those, until all meet:
the result is that of one walk from the header. Guesses are nearly always right, as a wrong
start soon meets a byte that is no type tag.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from episodica.operators.records import HEADER_BYTES, RECORD_SCHEMA, TAGS, decode_header, encode_header, field_rows
from episodica.session import durable

SPAN_BYTES = 16 << 20
FILE_BYTES = 64 << 20
GUESS_RECORDS = 16  # records in a row that make a guess
UNREACHED = -1  # the walk met a broken record before this span
_KINDS = frozenset(TAGS.values())


def _open(path: str):
    """A file by the path that Spark gives (file:/a is file:///a)."""
    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path.removeprefix("file:")
    store, name = pafs.FileSystem.from_uri(path)
    return store.open_input_file(name)


class _Bytes:
    """Part of a file, read on as far as records need it."""

    def __init__(self, file, start: int, end: int, size: int):
        self.file, self.start, self.size = file, start, size
        self.data = file.read_at(min(size, end + (1 << 16)) - start, start) if start < size else b""

    def reach(self, end: int) -> bool:
        """Whether the file has bytes up to ``end``; they are at hand then."""
        if end > self.size:
            return False
        have = self.start + len(self.data)
        if end > have:
            more = min(self.size - have, max(end - have, len(self.data)))
            self.data += self.file.read_at(more, have)
        return True

    def number(self, at: int, width: int) -> int:
        return int.from_bytes(self.data[at - self.start : at - self.start + width], "big")


def _next(part: _Bytes, at: int) -> int | None:
    """Where the record at ``at`` ends; null if there is none."""
    if not part.reach(at + 2):
        return None
    count, at = part.number(at, 2), at + 2
    for _ in range(count):
        if not part.reach(at + 3) or part.number(at, 1) not in _KINDS:
            return None
        at += 3 + part.number(at + 1, 2)
        if not part.reach(at + 4):
            return None
        at += 4 + part.number(at, 4)
        if not part.reach(at):
            return None
    return at


def _guess(part: _Bytes, start: int, end: int) -> int:
    for first in range(start, end):
        if not part.reach(first + 3) or part.number(first, 2) and part.number(first + 2, 1) not in _KINDS:
            continue
        at: int | None = first
        for _ in range(GUESS_RECORDS):
            at = _next(part, at)
            if at is None or at >= end:
                break
        if at is not None:
            return first
    return end


_WALKED = "path string, size long, start long, end long, first long, next long, offsets array<long>"
_WALKED_ARROW = pa.schema(
    [("path", pa.string()), *[(n, pa.int64()) for n in ("size", "start", "end", "first", "next")], ("offsets", pa.list_(pa.int64()))]
)


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The records that begin in each span, from ``first`` (null: guessed), and where the next span begins."""
    for batch in batches:
        for r in batch.to_pylist():
            first, end, offsets = r["first"], r["end"], []
            if first is None or 0 <= first < end:
                with _open(r["path"]) as file:
                    part = _Bytes(file, r["start"], end, r["size"])
                    first = _guess(part, r["start"], end) if first is None else first
                    at = first
                    while at < end:
                        offsets.append(at)
                        after = _next(part, at)
                        if after is None:
                            at = UNREACHED
                            break
                        at = after
            else:
                at = first
            row = [r["path"], r["size"], r["start"], end, first, at, offsets]
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, _WALKED_ARROW)], schema=_WALKED_ARROW)


def spans(spark: SparkSession, folder: str, span_bytes: int = SPAN_BYTES) -> DataFrame:
    """(path, size, start, end) of all parts of all files; only names and lengths are read."""
    files = spark.read.format("binaryFile").load(folder).select("path", F.col("length").alias("size"))
    parts = F.when(F.col("size") > 0, F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(span_bytes).cast("long")))
    cut = files.select("path", "size", F.explode(parts).alias("start"))
    return cut.withColumn("end", F.least(F.col("start") + span_bytes, F.col("size")))


def record_index(spark: SparkSession, folder: str, span_bytes: int = SPAN_BYTES) -> tuple[DataFrame, int]:
    """Spans of all files with the offsets of the records that begin in them, and how many walks it took.

    A record that cannot be walked to its end is the last one of its file.
    """
    first = F.when(F.col("start") == 0, F.lit(HEADER_BYTES).cast("long"))
    todo = durable(spans(spark, folder, span_bytes).withColumn("first", first))
    tasks = max(1, min(todo.count(), 4 * spark.sparkContext.defaultParallelism))
    found, rounds = None, 0
    while True:
        walked = todo.select("path", "size", "start", "end", "first").repartition(tasks, "path", "start").mapInArrow(_walk, _WALKED)
        rest = None if found is None else found.join(todo.select("path", "start"), ["path", "start"], "left_anti")
        found = durable(walked if rest is None else rest.select(walked.columns).unionByName(walked))
        rounds += 1
        before = F.lag("next").over(Window.partitionBy("path").orderBy("start"))
        narrow = found.select("path", "size", "start", "end", F.col("first").alias("had"), before.alias("first"))
        # A span whose predecessor is wrong itself is walked again when that one is right, if it has to be.
        todo = durable(narrow.where("first is not null and first <> had").drop("had"))
        if not todo.count():
            return found, rounds


def _decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for row in (batch.slice(i, 1) for batch in batches for i in range(batch.num_rows)):
        r = row.to_pylist()[0]  # offsets of one span at a time
        if not r["offsets"]:
            continue
        with _open(r["path"]) as file:
            part = _Bytes(file, r["start"], r["end"], r["size"])
            ends = [*r["offsets"][1:], r["next"] if r["next"] >= 0 else r["size"]]
            part.reach(ends[-1])
            view = memoryview(part.data)  # a record is cut off at its end without a copy of the span before it
            for block in field_rows((at, view[: end - r["start"]], at - r["start"]) for at, end in zip(r["offsets"], ends)):
                columns = [pa.array([r["path"]] * block.num_rows, pa.string()), *block.columns]
                columns[1 + block.schema.get_field_index("next_offset")] = pc.add(block["next_offset"], r["start"])
                yield pa.RecordBatch.from_arrays(columns, ["path", *block.schema.names])


def read_records(spark: SparkSession, folder: str, span_bytes: int = SPAN_BYTES) -> DataFrame:
    """One row per field of every record in the files of ``folder``: path, record_id (its offset), then as columns decode.

    A broken record gives one error row, and what follows it in its file cannot be read.
    """
    index, _ = record_index(spark, folder, span_bytes)
    return index.mapInArrow(_decoded, f"path string, {RECORD_SCHEMA}")


def read_headers(spark: SparkSession, folder: str, magic: str, flag_names: list[str], order: str = "big") -> DataFrame:
    """The header of every file: path, length and the fields of the header; only the first bytes are decoded."""
    names = F.array(*map(F.lit, flag_names)) if flag_names else F.array().cast("array<string>")
    files = spark.read.format("binaryFile").load(folder)
    head = F.substring("content", 1, HEADER_BYTES)
    return files.select("path", "length", decode_header(head, F.lit(magic), names, order).alias("h")).select("path", "length", "h.*")


def write_records(records: DataFrame, folder: str, magic: str = "RECS", version: int = 0x0100, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Records (column data) into files of about ``file_bytes`` with a header each; gives file and records, lazily.

    A task holds one file at a time, since the header counts its records. Null data is left out.
    """
    spark = records.sparkSession
    counted = F.col("id")
    made = encode_header(F.lit(magic), F.lit(version), counted, F.array(F.lit(False)))
    blank = bytes(spark.range(1).select(made.alias("h")).first()["h"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib

        store, root = pafs.FileSystem.from_uri(folder)
        task, number, held, weight = TaskContext.get().partitionId(), 0, [], 0

        def flush() -> pa.RecordBatch:
            nonlocal number, held, weight
            head = blank[:6] + len(held).to_bytes(4, "big") + blank[10:12]
            name = f"part-{task:05d}-{number:05d}.bin"
            store.create_dir(root, recursive=True)
            with store.open_output_stream(f"{root}/{name}", compression=None) as out:
                out.write(head + zlib.crc32(head).to_bytes(4, "big"))
                out.write(b"".join(held))
            row = pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(held)], pa.int64())], ["file", "records"])
            number, held, weight = number + 1, [], 0
            return row

        for batch in batches:
            for data in batch["data"].to_pylist():
                if data is not None:
                    held.append(data)
                    weight += len(data)
                    if weight >= file_bytes:
                        yield flush()
        if held:
            yield flush()

    return records.select("data").mapInArrow(run, "file string, records long")
