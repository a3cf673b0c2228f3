"""Token counts of whole texts, with overlap resynchronisation for huge ones.

Texts up to ``chunk`` characters are counted where they are. A longer text is cut into
chunks that overlap; chunks are spread over the cluster, encoded with offsets, and spliced
where two neighbours agree.

Why a splice is exact: the pre-tokenizer scans from left to right and remembers nothing but
its position. The chunk before the splice is right up to a boundary that lies further from
its end than any special string or look-ahead reaches; the chunk after it has a boundary at
the same place, so from there on it scans as the whole text does. Where no boundary is
shared, the overlap is widened and the text is encoded anew; at last one chunk is the text.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from episodica.llm.common import per_text
from episodica.llm.tokenizing import UNSURE, counter, kind, load, longest_special
from episodica.session import durable

CHUNK = 32_768
OVERLAP = 256
WIDEN = 8
MARGIN = 8  # characters that the pre-tokenizer's pattern may look ahead, with room

_MARK = pa.list_(pa.struct([("pos", pa.int64()), ("before", pa.int64())]))
_ENCODED = pa.schema([
    ("key", pa.string()), ("idx", pa.int64()), ("last", pa.bool_()), ("tokens", pa.int64()), ("left", _MARK), ("right", _MARK),
])
_ENCODED_SQL = (
    "key string, idx long, last boolean, tokens long, "
    "left array<struct<pos:long,before:long>>, right array<struct<pos:long,before:long>>"
)


def count_column(path: str):
    """Column function: tokens of a text, 0 for null."""

    def make():
        count = counter(path)
        return lambda texts: pa.array(count(texts), pa.int64())

    return per_text(make, "long")


def _cut(chunk: int, overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text in zip(batch["key"].to_pylist(), batch["text"].to_pylist()):
                # Libraries may disagree on these characters: such a text is not cut.
                size = len(text) if UNSURE.search(text) else chunk
                at, idx = 0, 0
                while True:
                    last = at + size >= len(text)
                    yield pa.RecordBatch.from_pydict({
                        "key": [key], "idx": pa.array([idx], pa.int64()), "at": pa.array([at], pa.int64()), "last": [last], "part": [text[at : at + size]],
                    })
                    if last:
                        break
                    at, idx = at + size - overlap, idx + 1

    return run


def _encode(path: str, overlap: int, margin: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = load(path)
        for batch in batches:
            for row in batch.to_pylist():
                made = tokenizer.encode(row["part"], add_special_tokens=False)
                left, right, size = [], [], len(row["part"])
                before, end = None, 0
                for n, (word, (start, stop)) in enumerate(zip(made.word_ids, made.offsets)):
                    if word != before and start == end:  # a boundary between two pre-tokens
                        if row["idx"] and start <= overlap - margin:
                            left.append({"pos": row["at"] + start, "before": n})
                        if not row["last"] and size - overlap <= start <= size - margin:
                            right.append({"pos": row["at"] + start, "before": n})
                    before, end = word, stop
                yield pa.RecordBatch.from_pylist([{
                    "key": row["key"], "idx": row["idx"], "last": row["last"], "tokens": len(made.ids), "left": left, "right": right,
                }], schema=_ENCODED)

    return run


def _spliced(encoded: DataFrame) -> DataFrame:
    """key and n_tokens; n_tokens is null where two neighbours share no boundary."""
    a = encoded.where(~F.col("last")).select("key", (F.col("idx") + 1).alias("idx"), F.col("tokens").alias("a_tokens"), "right")
    pairs = a.join(encoded.select("key", "idx", "left"), ["key", "idx"])
    at = lambda marks: F.transform(marks, lambda m: m["pos"])
    shared = pairs.withColumn("pos", F.array_min(F.array_intersect(at("right"), at("left"))))
    before = lambda marks: F.filter(marks, lambda m: m["pos"] == F.col("pos"))[0]["before"]
    # Counted twice: what the first chunk has after the splice and the second before it.
    double = F.col("a_tokens") - before(F.col("right")) + before(F.col("left"))
    cuts = shared.groupBy("key").agg(
        F.sum(F.when(F.col("pos").isNotNull(), double)).alias("twice"), F.count_if(F.col("pos").isNull()).alias("failed")
    )
    totals = encoded.groupBy("key").agg(F.sum("tokens").alias("tokens"))
    return totals.join(cuts, "key", "left").select(
        "key", F.when(F.coalesce("failed", F.lit(0)) == 0, F.col("tokens") - F.coalesce("twice", F.lit(0))).alias("n_tokens")
    )


def count_huge(texts: DataFrame, path: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """key and n_tokens of huge texts, from ``texts`` (key string, unique; text).

    Rounds: one for each widening, so at most log(longest text / overlap) of them.
    """
    special = longest_special(path)
    margin = MARGIN + special
    if kind(path) != "bytes":
        return texts.select("key", count_column(path)("text").alias("n_tokens"))
    # A boundary must be out of reach of the end, whatever overlap was asked for.
    overlap = max(overlap, 2 * margin)
    done, left = None, texts
    while True:
        chunk = max(chunk, 4 * overlap)
        parts = left.mapInArrow(_cut(chunk, overlap), "key string, idx long, at long, last boolean, part string")
        spread = parts.repartition("key", "idx")  # the chunks of one text go to many tasks
        encoded = durable(spread.mapInArrow(_encode(path, overlap, margin), _ENCODED_SQL))
        found = durable(_spliced(encoded))
        good = found.where(F.col("n_tokens").isNotNull())
        done = good if done is None else done.unionByName(good)
        failed = found.where(F.col("n_tokens").isNull())
        if not failed.head(1):
            return done
        left = left.join(failed.select("key"), "key", "left_semi")
        overlap *= WIDEN


def token_counts(docs: DataFrame, path: str, limit: int, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row of ``docs`` (doc_id, text).

    A null or empty text has no bytes and no tokens. Repeated rows and ids stay repeated.
    Only doc_id and text are read, so other columns may carry any name.
    """
    rows = docs.select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    long = F.char_length("text") > chunk
    short = rows.where(F.col("text").isNull() | ~long).select("doc_id", "n_bytes", count_column(path)("text").alias("n_tokens"))
    huge = rows.where(long).withColumn("key", F.sha2(F.col("text").cast("binary"), 256))
    out = short
    if huge.head(1):
        # Equal huge texts are encoded once.
        counted = count_huge(huge.groupBy("key").agg(F.first("text").alias("text")), path, chunk, overlap)
        out = short.unionByName(huge.drop("text").join(counted, "key").select("doc_id", "n_bytes", "n_tokens"))
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
