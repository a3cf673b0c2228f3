"""Pack token sequences into rows of fixed length, balanced by attention cost.

The cost of a piece of ``n`` tokens is ``n + QUADRATIC * n * n``: linear layers and
attention inside the document. Each task reads its documents as a stream and packs one
window of tokens after another: as many sequences as the window fills, documents in
descending length, each to the sequence of lowest cost that still has room for it. A
document that fits nowhere whole is cut at the cheapest sequence with any room. A window
holds exactly a whole number of sequences, the rest of its last document opens the next
window, so nothing is padded; the last tokens of a task go to sequences whose lengths are
powers of two.

No shuffle and no group: memory is one window and one document. A task's output depends on
its input rows only, so a rerun task gives the same rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from episodica.llm.common import tidied
from episodica.llm.tokenizing import coder

LENGTH = 4096
WINDOW = 256  # sequences packed at a time
QUADRATIC = 1 / 4096
FIELDS = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_SCHEMA = pa.schema([(f.split()[0], pa.int64()) for f in FIELDS.split(", ")])


def cost(length: int | np.ndarray) -> float | np.ndarray:
    return length + QUADRATIC * length * length


def assign(lengths: list[int], rooms: list[int]) -> list[tuple[int, int, int, int]]:
    """(document, start in it, length, sequence) for documents that fill ``rooms`` exactly or less."""
    room, load, out = np.array(rooms, dtype=np.int64), np.zeros(len(rooms)), []
    for doc in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        start, rest = 0, lengths[doc]
        while rest:
            fits = room >= rest
            free = fits if fits.any() else room > 0
            at = int(np.argmin(np.where(free, load, np.inf)))
            take = min(rest, int(room[at]))
            out.append((doc, start, take, at))
            room[at] -= take
            load[at] += cost(take)
            start, rest = start + take, rest - take
    return out


class _Packer:
    def __init__(self, first_sequence: int, length: int):
        self.next, self.length = first_sequence, length
        self.docs: list[tuple[int | None, int, int, bytes]] = []  # id, start, tokens of the whole document, ids
        self.tokens = 0

    def add(self, doc_id: int | None, ids: bytes) -> Iterator[list[tuple]]:
        total, at = len(ids) // 4, 0
        while at < total:
            take = min(total - at, self.length * WINDOW - self.tokens)
            self.docs.append((doc_id, at, total, ids[4 * at : 4 * (at + take)]))
            self.tokens += take
            at += take
            if self.tokens == self.length * WINDOW:
                yield self.pack()

    def pack(self) -> list[tuple]:
        whole, rest = divmod(self.tokens, self.length)
        rooms = [self.length] * whole + [1 << i for i in range(rest.bit_length())[::-1] if rest >> i & 1]
        if not rooms:
            return []
        filled, rows = [0] * len(rooms), []
        for doc, start, take, at in assign([len(d[3]) // 4 for d in self.docs], rooms):
            doc_id, base, total, ids = self.docs[doc]
            crc = zlib.crc32(ids[4 * start : 4 * (start + take)])
            rows.append((doc_id, base + start, take, crc, total, self.next + at, filled[at]))
            filled[at] += take
        self.next += len(rooms)
        self.docs, self.tokens = [], 0
        return rows


def _run(path: str, end: int, length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, close = coder(path), np.array([end], dtype="<u4").tobytes()
        packer = _Packer(TaskContext.get().partitionId() << 40, length)

        def out(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], schema=_SCHEMA)

        for batch in batches:
            for doc_id, ids in zip(batch["doc_id"].to_pylist(), code(batch["text"].to_pylist())):
                yield from map(out, packer.add(doc_id, ids + close))
        if rows := packer.pack():
            yield out(rows)

    return run


def pack(docs: DataFrame, path: str, end: int, length: int = LENGTH) -> DataFrame:
    """One row per piece of every document: FIELDS.

    ``path``: tokenizer file; a document is its ids and then ``end``. A null or empty text is
    ``end`` alone; repeated rows are packed each; a null doc_id stays null. An empty table
    gives no rows. Only doc_id and text are read. Pieces cover a document without gap or
    overlap; a sequence is ``length`` long, or a power of two.
    """
    if length & (length - 1):
        raise ValueError("the length of a sequence is a power of two")
    return docs.select("doc_id", "text").mapInArrow(tidied(_run(path, end, length)), FIELDS)


def in_written_order(docs: DataFrame) -> DataFrame:
    """doc_id and text of a table of part files, in the order in which they were written.

    A scan takes files by size and puts several into a partition; here partitions follow the
    numbers of the files and the places in them, so that ``pack`` numbers sequences in that order.
    """
    name = F.col("_metadata.file_name")
    number = F.regexp_extract(name, "^part-([0-9]+)", 1).try_cast("long")
    order = {"__file": number, "__name": name, "__at": F.col("_metadata.row_index")}
    rows = docs.select("doc_id", "text", *[c.alias(n) for n, c in order.items()])
    return rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
