"""WARC archives that are written with an index, and read by byte ranges.

Each task writes its rows as gzip members of rolling ``.warc.gz`` files and returns one index
row per record: file, offset, length, URL, digest. The index is what counts: a file that
a failed attempt left behind has no row in it. Reading selects index rows, sorts them by
place and joins neighbours into ranges, so a range is one read.

Records of equal payloads are written once: the row with the smallest page_id is the
response, others are revisits of it. The archives live under the folder named by
``spark.checkpoint.dir``, which must be one that pyarrow can open (local or shared
mounts, hdfs, s3, gs).
"""

from __future__ import annotations

import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from episodica.llm.common import with_rows
from episodica.session import durable, fresh_dir

LEAST_PAYLOAD = 100  # bytes from which equal payloads are revisits
FILE_BYTES = 256 << 20
RANGE_BYTES = 8 << 20
GAP_BYTES = 64 << 10
MOST_READERS = 20_000  # partitions of a read, at most
BROADCAST_ROWS = 500_000
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_INDEX = "file string, offset long, length long, page_id long, url string, payload_digest string, payload_bytes long, record_type string, refers_to long"
_READ = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _record_id(row: int, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{row}/{digest}')}>"


def record(row: dict) -> bytes:
    """One WARC record. Fields without a value are left out; line breaks in a URL are escaped."""
    revisit = row["record_type"] == "revisit"
    block = _HTTP if revisit else _HTTP + (row["payload"] or b"")
    url = None if row["url"] is None else re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", row["url"])
    head = {
        "WARC-Type": row["record_type"], "WARC-Record-ID": _record_id(row["row"], row["payload_digest"]), "WARC-Date": DATE,
        "WARC-Target-URI": url, "WARC-Payload-Digest": f"sha256:{row['payload_digest']}",
        "WARC-Profile": PROFILE if revisit else None, "WARC-Refers-To": _record_id(row["head_row"], row["payload_digest"]) if revisit else None,
        "X-Page-ID": row["page_id"], "X-Refers-To-Page-ID": row["refers_to"], "X-Payload-Length": row["payload_bytes"],
        "Content-Type": "application/http; msgtype=response", "Content-Length": len(block),
    }
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items() if v is not None)
    return f"WARC/1.1\r\n{lines}\r\n".encode() + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Fields and payload of one record, checked against its own digest."""
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    fields = dict(line.split(": ", 1) for line in lines)
    block = rest[: int(fields["Content-Length"])]
    if not version.startswith("WARC/") or rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("not a WARC record")
    payload = block.partition(b"\r\n\r\n")[2]
    if fields["WARC-Type"] == "response" and hashlib.sha256(payload).hexdigest() != fields["WARC-Payload-Digest"].removeprefix("sha256:"):
        raise ValueError(f"digest of {fields['WARC-Record-ID']} does not fit its payload")
    return fields, payload


def _write(folder: str, file_bytes: int):
    names = [f.split()[0] for f in _INDEX.split(", ")]
    types = [pa.string() if f.endswith("string") else pa.int64() for f in _INDEX.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = pafs.FileSystem.from_uri(folder)
        task = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}"
        out, name, offset, files = None, "", 0, 0
        try:
            for batch in batches:
                index = []
                for row in batch.to_pylist():
                    if out is None or offset >= file_bytes:
                        if out is not None:
                            out.close()
                        name, offset, files = f"{task}-{files:04d}.warc.gz", 0, files + 1
                        store.create_dir(root, recursive=True)
                        out = store.open_output_stream(f"{root}/{name}", compression=None)
                    data = gzip.compress(record(row), 6, mtime=0)
                    out.write(data)
                    index.append(row | {"file": name, "offset": offset, "length": len(data)})
                    offset += len(data)
                yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in index], t) for n, t in zip(names, types)], names)
        finally:
            if out is not None:
                out.close()

    return run


def prepared(pages: DataFrame) -> DataFrame:
    """Pages with payload, its digest and size, and what kind of record each becomes."""
    payload = F.coalesce(F.col("html").cast("binary"), F.lit("").cast("binary"))
    rows = pages.select("page_id", "url", payload.alias("payload"))
    rows = with_rows(rows.withColumns({"payload_digest": F.sha2("payload", 256), "payload_bytes": F.length("payload").cast("long")}), "row")
    first = F.min(F.struct(F.col("page_id").isNull().alias("none"), F.col("page_id").alias("id"), F.col("row").alias("row")))
    heads = (
        rows.where(F.col("payload_bytes") >= LEAST_PAYLOAD).groupBy(F.col("payload_digest").alias("__digest"))
        .agg(first.alias("head"), F.count(F.lit(1)).alias("n")).where("n > 1").select("__digest", "head")
    )
    heads = durable(heads)
    side = F.broadcast(heads) if heads.count() <= BROADCAST_ROWS else heads
    revisit = F.col("head").isNotNull() & (F.col("head.row") != F.col("row"))
    joined = rows.join(side, F.col("payload_digest") == F.col("__digest"), "left")
    return joined.select(
        "row", "page_id", "url", F.when(~F.coalesce(revisit, F.lit(False)), F.col("payload")).alias("payload"), "payload_digest", "payload_bytes",
        F.when(F.coalesce(revisit, F.lit(False)), "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("head.id")).alias("refers_to"), F.when(revisit, F.col("head.row")).alias("head_row"),
    )


def write(pages: DataFrame, file_bytes: int = FILE_BYTES) -> tuple[DataFrame, str]:
    """Write a record per row of ``pages`` (page_id, url, html); the index and the archives' folder.

    A null html is an empty payload; null ids and URLs are left out of the record. Equal
    payloads below LEAST_PAYLOAD bytes are all responses. Among rows that repeat the
    smallest id one is the response. An empty table gives an empty index.
    """
    folder = fresh_dir(pages.sparkSession, "warc")
    return durable(prepared(pages).mapInArrow(_write(folder, file_bytes), _INDEX)), folder


def ranges(index: DataFrame) -> DataFrame:
    """Index rows with ``span``: rows of one file and span lie close together, in one read."""
    at = Window.partitionBy("file").orderBy("offset")  # as many rows as one file has records
    gap = F.col("offset") - F.lag(F.col("offset") + F.col("length")).over(at)
    island = F.sum(F.when(F.coalesce(gap, F.lit(0)) > GAP_BYTES, 1).otherwise(0)).over(at)
    return index.withColumn("span", F.concat_ws("-", island, F.floor(F.col("offset") / RANGE_BYTES)))


def _read(folder: str, with_payload: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = pafs.FileSystem.from_uri(folder)
        number = lambda x: None if x is None else int(x)

        def fetched(rows: list[dict]) -> pa.RecordBatch:
            start, stop = rows[0]["offset"], rows[-1]["offset"] + rows[-1]["length"]
            with store.open_input_file(f"{root}/{rows[0]['file']}") as f:
                data = memoryview(f.read_at(stop - start, start))
            found = []
            for r in rows:
                fields, payload = parse(zlib.decompress(data[r["offset"] - start :][: r["length"]], 31))
                response = fields["WARC-Type"] == "response"
                found.append((
                    number(fields.get("X-Page-ID")), fields.get("WARC-Target-URI"), len(payload) if response else int(fields["X-Payload-Length"]),
                    fields["WARC-Payload-Digest"].removeprefix("sha256:"), fields["WARC-Type"], number(fields.get("X-Refers-To-Page-ID")),
                    payload if response else None,
                ))
            types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()][: 6 + with_payload]
            names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"][: 6 + with_payload]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), types)], names)

        waiting: list[dict] = []
        for batch in batches:
            for row in batch.to_pylist():
                if waiting and (row["file"], row["span"]) != (waiting[0]["file"], waiting[0]["span"]):
                    yield fetched(waiting)
                    waiting = []
                waiting.append(row)
        if waiting:
            yield fetched(waiting)

    return run


def read(index: DataFrame, folder: str, selected: Column | None = None, with_payload: bool = False) -> DataFrame:
    """Records of the selected index rows, read back from the archives by coalesced ranges.

    There are as many partitions as the selected records fill ranges: the few bytes of
    their index rows say nothing about the work.
    """
    chosen = index if selected is None else index.where(selected)
    total = chosen.agg(F.sum("length")).first()[0] or 0
    readers = min(MOST_READERS, max(1, -(-total // RANGE_BYTES)))
    rows = ranges(chosen).select("file", "span", "offset", "length")
    rows = rows.repartition(readers, "file", "span").sortWithinPartitions("file", "offset")
    return rows.mapInArrow(_read(folder, with_payload), _READ + ", payload binary" * with_payload)
