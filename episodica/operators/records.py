"""Fixed 16-byte headers and tag/length/value records in BINARY columns.

Header: magic (4), version (2), record count (4), flags (2), CRC32 of bytes 0-11 (4).
Record: field count (2), then per field a type tag (1), name length (2), name,
value length (4), value. Record numbers are big-endian.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from episodica.functions.binary import flags_to_number, pack, unpack

HEADER_BYTES = 16
MOST_FIELDS = 65_535
DECODED_ROWS = 10_000  # handed on at a time
# Type tags of record fields.
TAGS = {"int32": 1, "float64": 2, "string": 3, "bool": 4}


def encode_header(
    magic: Column, version: Column, count: Column, flags: Column, order: Column | str = "big"
) -> Column:
    """``flags`` is an array of booleans, bit 0 first. A number above its field gives null, not other bytes."""
    body = F.concat(
        magic.cast("binary"), pack(version, 2, order), pack(count, 4, order),
        pack(flags_to_number(flags), 2, order),
    )
    return F.concat(body, pack(F.crc32(body), 4, order))


def decode_header(
    data: Column, magic: Column, flag_names: Column, order: Column | str = "big"
) -> Column:
    """Header fields, named flags, and whether magic and checksum hold.

    Nothing is rejected here; callers filter on ``magic_ok`` and ``crc_ok``. A header cut
    short gives nulls and ``crc_ok = false``.
    """
    flags, stored = unpack(data, 10, 2, order), unpack(data, 12, 4, order)
    at = F.slice(F.sequence(F.lit(0), F.size(flag_names)), 1, F.size(flag_names))  # empty without names
    values = F.transform(at, lambda i: F.getbit(flags, i) == 1)
    body = F.substring(data, 1, 12)
    return F.struct(
        unpack(data, 4, 2, order).cast("int").alias("version"),
        unpack(data, 6, 4, order).alias("record_count"),
        flags.cast("int").alias("flags"),
        F.map_from_arrays(flag_names, values).alias("flag_values"),
        stored.alias("checksum"),
        F.coalesce(F.substring(data, 1, 4) == magic.cast("binary"), F.lit(False)).alias("magic_ok"),
        F.coalesce(F.crc32(body) == stored, F.lit(False)).alias("crc_ok"),
    )


@F.arrow_udf(BinaryType())
def float64_bytes(values: pa.Array) -> pa.Array:
    """Big-endian IEEE 754 bytes, null for null; Spark has no built-in for them."""
    raw = values.fill_null(0.0).to_numpy(zero_copy_only=False).astype(">f8").tobytes()
    known = values.is_valid().to_pylist()
    return pa.array([raw[8 * i : 8 * i + 8] if ok else None for i, ok in enumerate(known)], pa.binary())


def int32_field(name: str | Column, value: Column) -> Column:
    return _field("int32", name, F.when(value.between(-(1 << 31), (1 << 31) - 1), pack(value, 4)))


def float64_field(name: str | Column, value: Column) -> Column:
    return _field("float64", name, float64_bytes(value))


def string_field(name: str | Column, value: Column) -> Column:
    return _field("string", name, value.cast("binary"))


def bool_field(name: str | Column, value: Column) -> Column:
    return _field("bool", name, pack(value.cast("int"), 1))


def _field(kind: str, name: str | Column, value: Column) -> Column:
    name = (F.lit(name) if isinstance(name, str) else name).cast("binary")
    return F.concat(
        pack(F.lit(TAGS[kind]), 1), pack(F.octet_length(name), 2), name,
        pack(F.octet_length(value), 4), value,
    )


def encode_record(fields: list[Column]) -> Column:
    """Record from encoded fields, in order."""
    return F.concat(pack(F.lit(len(fields)), 2), *fields)


def encode_records(rows: DataFrame) -> DataFrame:
    """Records from a long table (record_id, field_no, field BINARY).

    The format allows 65,535 fields in a record, which bounds each list. ``data`` is null and
    ``error`` says why where a record has more, or a field that could not be encoded.
    """
    listed = F.array_sort(F.collect_list(F.struct("field_no", "field")))
    fields = F.transform(listed, lambda f: F.hex(f["field"]))
    lost, count = F.count_if(F.col("field").isNull()), F.count(F.lit(1))
    error = F.when(count > MOST_FIELDS, F.lit("too many fields")).when(lost > 0, F.lit("a value does not fit its field"))
    data = F.concat(pack(count, 2), F.unhex(F.array_join(fields, "")))
    return rows.groupBy("record_id").agg(F.when(error.isNull(), data).alias("data"), error.alias("error"))


RECORD_SCHEMA = (
    "record_id long, field_no int, name string, type string, int_value int, float_value double, "
    "string_value string, bool_value boolean, next_offset long, error string"
)
_NAMES = {tag: kind for kind, tag in TAGS.items()}
_READERS = {
    "int32": lambda raw: ("int_value", struct.unpack(">i", raw)[0]),
    "float64": lambda raw: ("float_value", struct.unpack(">d", raw)[0]),
    "string": lambda raw: ("string_value", str(raw, "utf-8")),
    "bool": lambda raw: ("bool_value", raw[0] != 0),
}


def _take(data: bytes | memoryview, at: int, size: int) -> tuple[bytes | memoryview, int]:
    if at + size > len(data):
        raise ValueError(f"record ends at byte {len(data)}, {at + size} needed")
    return data[at : at + size], at + size


def _fields(data: bytes | memoryview, at: int):
    raw, at = _take(data, at, 2)
    for number in range(int.from_bytes(raw, "big")):
        raw, at = _take(data, at, 3)
        kind = _NAMES.get(raw[0])
        if kind is None:
            raise ValueError(f"unknown type tag {raw[0]}")
        name, at = _take(data, at, int.from_bytes(raw[1:], "big"))
        raw, at = _take(data, at, 4)
        value, at = _take(data, at, int.from_bytes(raw, "big"))
        column, parsed = _READERS[kind](value)
        yield {"field_no": number, "name": str(name, "utf-8"), "type": kind, column: parsed, "next_offset": at}


_COLUMNS = {
    "record_id": pa.int64(), "field_no": pa.int32(), "name": pa.string(), "type": pa.string(), "int_value": pa.int32(),
    "float_value": pa.float64(), "string_value": pa.string(), "bool_value": pa.bool_(), "next_offset": pa.int64(), "error": pa.string(),
}


def field_rows(records: Iterable[tuple[int | None, bytes | memoryview | None, int | None]]) -> Iterator[pa.RecordBatch]:
    """One row per field of records (id, bytes, offset in them), in batches; a bad record gives one error row."""

    def out(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], t) for n, t in _COLUMNS.items()], list(_COLUMNS))

    rows: list[dict] = []
    for record, data, offset in records:
        try:
            if data is None or offset is None:
                raise ValueError("no data")
            rows += [{"record_id": record, **field} for field in list(_fields(data, offset))]
        except (ValueError, struct.error, IndexError) as error:
            rows.append({"record_id": record, "error": str(error)})
        if len(rows) >= DECODED_ROWS:
            yield out(rows)
            rows = []
    if rows:
        yield out(rows)


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield from field_rows(zip(*(batch[c].to_pylist() for c in ("record_id", "data", "offset"))))


def decode_records(df: DataFrame) -> DataFrame:
    """One row per field from (record_id, data, offset); a bad record gives one error row."""
    return df.select("record_id", "data", "offset").mapInArrow(_decode, RECORD_SCHEMA)
