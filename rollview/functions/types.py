"""Logical column types and how they live in Spark."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import SchemaError
from .wide import decimal_to_bytes

# Accepted spellings in lower case, by logical type.
SPELLINGS = {
    "UInt64": ("uint64",),
    "Int64": ("int64", "bigint"),
    "Float64": ("float64", "double"),
    "UInt256": ("uint256",),
    "String": ("string", "varchar", "text"),
    "DateTime": ("datetime", "timestamp"),
    "Boolean": ("boolean", "bool"),
    "Bytes": ("bytes", "bytea", "varbinary", "blob"),
    "Base58": ("base58",),
    "JSON": ("json", "jsonb"),
}
_LOGICAL = {s: name for name, all_ in SPELLINGS.items() for s in all_}
_SPARK = {
    "UInt64": T.LongType(), "Int64": T.LongType(), "Float64": T.DoubleType(), "UInt256": T.BinaryType(), "String": T.StringType(),
    "DateTime": T.LongType(), "Boolean": T.BooleanType(), "Bytes": T.BinaryType(), "Base58": T.BinaryType(), "JSON": T.StringType(),
}
INTEGERS = {"UInt64", "Int64", "DateTime"}
NUMBERS = INTEGERS | {"Float64"}


def logical(name: str) -> str:
    """The logical type of a spelling."""
    try:
        return _LOGICAL[name.lower()]
    except KeyError:
        raise SchemaError(f"unknown type {name!r}") from None


def spark_type(type_: str) -> T.DataType:
    """DateTime is a long of epoch milliseconds; UInt64 is a long (values below 2^63); JSON is its text."""
    return _SPARK[type_]


def of_spark(type_: T.DataType) -> str:
    """The logical type nearest to a Spark type."""
    if isinstance(type_, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "Int64"
    if isinstance(type_, T.NumericType):
        return "Float64"
    if isinstance(type_, (T.TimestampType, T.TimestampNTZType)):
        return "DateTime"
    return {T.BooleanType: "Boolean", T.BinaryType: "Bytes", T.StringType: "String"}.get(type(type_), "JSON")


def to_uint256(column: Column, kind: T.DataType) -> Column:
    """A column as 32 bytes: from bytes, integers, 0x strings or decimal strings; what is none of them is null."""
    if isinstance(kind, T.BinaryType):
        return F.lpad(column, 32, F.lit(b"\0"))
    if isinstance(kind, T.IntegralType):
        return F.when(column >= 0, F.unhex(F.lpad(F.hex(column.cast("long")), 64, "0")))
    text = column.cast("string")
    from_hex = F.when(F.lower(text).rlike("^0x[0-9a-f]{1,64}$"), F.unhex(F.lpad(F.substring(text, 3, 64), 64, "0")))
    return from_hex.when(text.rlike("^[0-9]{1,78}$"), decimal_to_bytes(text))


def ingest_column(column: Column, kind: T.DataType, type_: str) -> Column:
    """A column of an incoming table as its declared type; what can't be read as that type is null."""
    if type_ == "UInt256":
        return to_uint256(column, kind)
    if type_ == "DateTime" and isinstance(kind, T.TimestampType):
        return F.unix_millis(column)
    if type_ == "DateTime" and isinstance(kind, T.TimestampNTZType):  # its wall clock counts as UTC, whatever the session's zone
        return F.unix_millis(F.from_utc_timestamp(column.cast("timestamp"), F.current_timezone()))
    if type_ == "JSON" and isinstance(kind, (T.StructType, T.ArrayType, T.MapType)):
        return F.to_json(column)
    if isinstance(kind, T.StringType) and type_ in NUMBERS | {"Boolean"}:
        return column.try_cast(spark_type(type_))
    return column.cast(spark_type(type_))


def default_of(type_: str, text: str | None) -> object:
    """The value that a state field starts with; what can't be read is the type's zero."""
    if type_ in INTEGERS:
        try:
            return int(text or 0)
        except ValueError:
            return 0
    if type_ == "Float64":
        try:
            return float(text or 0)
        except ValueError:
            return 0.0
    if type_ == "Boolean":
        return (text or "").lower() in ("true", "1")
    if type_ == "String":
        return text or ""
    if type_ == "JSON":
        try:
            return json.loads(text) if text else None
        except ValueError:
            return None
    return b"" if type_ in ("Bytes", "Base58") else bytes(32)
