"""Keyed message digests over Arrow batches."""

from __future__ import annotations

import hmac
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

HASHES = ("md5", "sha256", "sha384", "sha512")
KEPT_KEYS = 10_000


def _digests(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """A key is padded and hashed once; its state is copied for every message."""
    started: dict[tuple[str, bytes], hmac.HMAC] = {}
    for algos, keys, messages in batches:
        out = []
        for algo, key, message in zip(algos.to_pylist(), keys.to_pylist(), messages.to_pylist()):
            if key is None or message is None or algo not in HASHES:
                out.append(None)
                continue
            state = started.get((algo, key))
            if state is None:
                if len(started) >= KEPT_KEYS:
                    started.clear()
                state = started[algo, key] = hmac.new(key, digestmod=algo)
            state = state.copy()
            state.update(message)
            out.append(state.digest())
        yield pa.array(out, pa.binary())


_digests.__annotations__ = {"batches": Iterator[tuple[pa.Array, pa.Array, pa.Array]], "return": Iterator[pa.Array]}


def with_hmac(df: DataFrame, name: str, algo: Column, key: Column, message: Column) -> DataFrame:
    """Add the HMAC of a string or binary message, with the hash named per row.

    Null for a null key or message and for a hash that is none of HASHES. Rows of one key that
    lie together share the work on it.
    """
    digest = F.arrow_udf(_digests, BinaryType())
    return df.withColumn(name, digest(algo, key.cast("binary"), message.cast("binary")))
