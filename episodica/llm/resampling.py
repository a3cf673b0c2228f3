"""Draw the documents that look most like a target text, by importance weights of hashed features.

A feature is a run of consecutive words; its bucket is its CRC-32 modulo the number of
buckets. The gain of a bucket is the log ratio of its smoothed share in the target and in
all documents, a document's weight the mean gain of its features, and adding Gumbel noise
to the weight makes the highest scores a sample without replacement.

CRCs are taken for many features at once: the distinct features of a batch are grouped by
length, each group is a matrix of bytes, and every column updates all CRCs of its group.

Two passes read the texts, without a shuffle of them: tasks count buckets (one row per
bucket leaves a task), then weigh. Ranks come from range-partitioned scores.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from episodica.llm.common import numbered, session
from episodica.session import durable

BUCKETS = 10_000
SEED = 2024
PERCENT = 10
LEAST_WORDS = 20
SLAB = 1 << 20
TOGETHER = 4 << 20  # bytes of text whose distinct features are grouped at a time
LONG = 512  # longer features are too few for a matrix; the CRC runs along each


def _lowered() -> bytes:
    """Bytes of words stay (A-Z as a-z), all others become a space."""
    out = bytearray(b" " * 256)
    for b in range(256):
        if b >= 0x80 or chr(b).isalnum():
            out[b] = ord(chr(b).lower()) if b < 0x80 else b
    return bytes(out)


LOWERED = _lowered()


def _crc_table() -> np.ndarray:
    row = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        row = np.where(row & 1, (row >> 1) ^ np.uint32(0xEDB88320), row >> 1)
    return row


CRC_TABLE = _crc_table()


def crc32s(features: list[bytes]) -> np.ndarray:
    """Unsigned CRC-32 of each feature."""
    out = np.zeros(len(features), dtype=np.uint32)
    lengths = np.fromiter(map(len, features), dtype=np.int64, count=len(features))
    order = np.argsort(lengths, kind="stable")
    cuts = np.flatnonzero(np.diff(lengths[order])) + 1
    for group in np.split(order, cuts):
        if not len(group):
            continue
        n = int(lengths[group[0]])
        if n > LONG:
            out[group] = [zlib.crc32(features[i]) for i in group]
            continue
        matrix = np.frombuffer(b"".join([features[i] for i in group]), dtype=np.uint8).reshape(len(group), n).T.copy()
        crc = np.full(len(group), 0xFFFFFFFF, dtype=np.uint32)
        for column in matrix:
            crc = CRC_TABLE[(crc ^ column) & 0xFF] ^ (crc >> 8)
        out[group] = ~crc
    return out


def word_slabs(text: str | None) -> Iterator[list[bytes]]:
    """The words of a text, in lists of about SLAB bytes."""
    if not text:
        return
    data, at = text.encode("utf-8", "surrogatepass").translate(LOWERED), 0
    while at < len(data):
        end = data.find(b" ", at + SLAB)
        end = len(data) if end < 0 else end
        yield data[at:end].split()
        at = end


def feature_slabs(text: str | None, longest: int) -> Iterator[tuple[int, list[bytes]]]:
    """(words, features) of each slab: all runs of 1 to ``longest`` words that end in it."""
    held: list[bytes] = []
    for words in word_slabs(text):
        found, both, old = list(words), held + words, len(held)
        for n in range(2, longest + 1):
            found += [b" ".join(both[i - n + 1 : i + 1]) for i in range(max(old, n - 1), len(both))]
        yield len(words), found
        held = both[max(0, len(both) - longest + 1) :] if longest > 1 else []


def _grouped(batches: Iterator[pa.RecordBatch], longest: int) -> Iterator[list[tuple[int, int, list[bytes]]]]:
    """Lists of (row, words, features) of about TOGETHER bytes; the rows of a batch count on from the last."""
    row, held, weight = 0, [], 0
    for batch in batches:
        for text in batch["text"].to_pylist():
            for n, features in feature_slabs(text, longest):
                held.append((row, n, features))
            weight += len(text or "")
            row += 1
            if weight >= TOGETHER:
                yield held
                held, weight = [], 0
    if held:
        yield held


def _counting(longest: int, buckets: int):
    schema = pa.schema([("bucket", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for held in _grouped(batches, longest):
            seen: Counter = Counter()
            for _, _, features in held:
                seen.update(features)
            at = crc32s(list(seen)).astype(np.int64) % buckets
            np.add.at(total, at, np.fromiter(seen.values(), dtype=np.int64, count=len(seen)))
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], schema=schema)

    return run


def bucket_counts(texts: DataFrame, longest: int = 1, buckets: int = BUCKETS) -> list[int]:
    """Features of all ``texts`` (column text) in each bucket; ``buckets`` numbers reach the driver."""
    rows = texts.select("text").mapInArrow(_counting(longest, buckets), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = [0] * buckets
    for r in rows.collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(source: list[int], target: list[int]) -> list[int]:
    """Thousandths of the log ratio of each bucket's smoothed shares, rounded down."""
    k, s_all, t_all = len(source), sum(source), sum(target)
    return [math.floor(1000 * math.log((t + 1.0) * (s_all + k) / ((s + 1.0) * (t_all + k)))) for s, t in zip(source, target)]


_WEIGHED = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_features", pa.int64()), ("weight", pa.int64())])


def _weighing(gain: list[int], longest: int):
    table = np.array(gain, dtype=np.int64)

    def weigh(held: list[tuple[int, int, list[bytes]]], sums: dict[int, list[int]]) -> None:
        distinct = list(set().union(*[features for _, _, features in held]))
        value = dict(zip(distinct, table[crc32s(distinct).astype(np.int64) % len(table)].tolist()))
        for row, n, features in held:
            one = sums[row]
            one[0] += n
            one[1] += len(features)
            one[2] += sum(map(value.__getitem__, features))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = {i: [0, 0, 0] for i in range(batch.num_rows)}
            for held in _grouped(iter([batch]), longest):
                weigh(held, sums)
            words, counts, totals = zip(*sums.values()) if sums else ((), (), ())
            weights = [t // c if c else 0 for t, c in zip(totals, counts)]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *[pa.array(x, pa.int64()) for x in (words, counts, weights)]], schema=_WEIGHED)

    return run


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Thousandths of Gumbel noise from the SHA-256 of ``seed:doc_id`` (a null id: empty), rounded down."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def resample(
    docs: DataFrame, target: DataFrame, longest: int = 1, buckets: int = BUCKETS, percent: int = PERCENT,
    least_words: int = LEAST_WORDS, seed: int = SEED,
) -> DataFrame:
    """Every document with its weight, score and, if it is drawn, its rank: doc_id, n_features, weight, score, rank.

    ``percent`` of the documents of at least ``least_words`` words are drawn, rounded down.
    Null and empty texts have no feature and weight 0. Ranks have no ties: equal scores are
    in order of doc_id (null first), and repeated rows each have a rank of their own. Only
    doc_id and text are read. Without a target text all gains come from the documents alone;
    an empty table gives no rows.
    """
    session(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    gain = gains(bucket_counts(texts, longest, buckets), bucket_counts(target, longest, buckets))
    spec = "doc_id long, n_words long, n_features long, weight long"
    weighed = durable(texts.mapInArrow(_weighing(gain, longest), spec))
    enough = F.col("n_words") >= least_words
    drawn = weighed.where(enough).count() * percent // 100
    scored = weighed.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)).withColumns({"few": ~enough, "down": -F.col("score")})
    ranked = numbered(scored, "at", ["few", "down", "doc_id"])
    rank = F.when(F.col("at") < drawn, F.col("at") + 1)
    return ranked.select("doc_id", "n_features", "weight", "score", rank.alias("rank"))
