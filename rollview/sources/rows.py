"""Incoming rows: decoded host rows, files, and where they are kept."""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..ddl.model import Table
from ..errors import InvalidOperation, SchemaError
from ..functions.types import spark_type
from ..plans.dataflow import typed_rows
from .msgpack import pack, unpack


def _cell(value: Any, type_: str) -> Any:
    """A host value as the declared type takes it; what it can't take is null."""
    if value is None:
        return None
    if type_ == "UInt256":
        return hex(value) if isinstance(value, int) else "0x" + bytes(value).hex() if isinstance(value, (bytes, bytearray)) else str(value)
    if type_ == "JSON":
        return value if isinstance(value, str) else json.dumps(value)
    if type_ in ("Bytes", "Base58"):
        return bytes(value) if isinstance(value, (bytes, bytearray)) else bytes.fromhex(value.removeprefix("0x")) if isinstance(value, str) else None
    if type_ == "String":
        return value if isinstance(value, str) else json.dumps(value)
    if type_ == "Boolean":
        return value if isinstance(value, bool) else None
    if isinstance(value, bool) or not isinstance(value, (int, float)):
        try:
            return (float if type_ == "Float64" else int)(value) if isinstance(value, str) else None
        except ValueError:
            return None
    return float(value) if type_ == "Float64" else int(value)


def host_rows(spark: SparkSession, table: Table, rows: Iterable[Mapping[str, Any]]) -> DataFrame:
    """Rows of a host program. Each needs a non-negative integer ``block_number``; its place in its block is its place here."""
    columns = [c for c in table.columns if c.name != "block_number"]
    counts: dict[int, int] = {}
    out = []
    for row in rows:
        block = row.get("block_number")
        if not isinstance(block, int) or isinstance(block, bool) or block < 0:
            raise InvalidOperation(f"a row of {table.name!r} has no block_number")
        index = counts.get(block, 0)
        counts[block] = index + 1
        out.append((block, index, *(_cell(row.get(c.name), c.type) for c in columns)))
    fields = [T.StructField("block_number", T.LongType()), T.StructField("_row_index", T.LongType())]
    fields += [T.StructField(c.name, T.StringType() if c.type == "UInt256" else spark_type(c.type)) for c in columns]
    return typed_rows(spark.createDataFrame(out, T.StructType(fields)), table.columns)


def msgpack_rows(spark: SparkSession, table: Table, data: bytes) -> DataFrame:
    """Rows of a host program as a MessagePack list of maps."""
    rows = unpack(data)
    if not isinstance(rows, list) or not all(isinstance(r, dict) for r in rows):
        raise InvalidOperation(f"rows of {table.name!r} must be a list of maps")
    return host_rows(spark, table, rows)


def msgpack_tables(spark: SparkSession, tables: Mapping[str, Table], data: bytes) -> dict[str, DataFrame]:
    """Rows by table from one MessagePack map, as :meth:`Engine.ingest` takes them."""
    given = unpack(data)
    if not isinstance(given, dict) or (unknown := [t for t in given if t not in tables]):
        raise InvalidOperation("rows by table must be a map" if not isinstance(given, dict) else f"unknown table {unknown[0]!r}")
    return {name: msgpack_rows(spark, tables[name], pack(rows)) for name, rows in given.items()}


def json_rows(spark: SparkSession, table: Table, lines: DataFrame, column: str = "value", order_by: list[str] | None = None) -> DataFrame:
    """Rows from a column of JSON objects, parsed with the table's schema."""
    kinds = {c.name: T.StringType() if c.type in ("UInt256", "JSON") else spark_type(c.type) for c in table.columns}
    schema = T.StructType([T.StructField(n, t) for n, t in ({"block_number": T.LongType(), "_row_index": T.LongType()} | kinds).items()])
    parsed = lines.withColumn("__row", F.from_json(column, schema))
    columns = ["block_number", *([] if order_by else ["_row_index"]), *(c.name for c in table.columns if c.name != "block_number")]
    return typed_rows(parsed.select(*(F.col("__row")[c].alias(c) for c in columns), *(order_by or [])), table.columns, order_by)


def file_rows(spark: SparkSession, table: Table, path: str, format_: str = "parquet", order_by: list[str] | None = None, **options: Any) -> DataFrame:
    """Rows of files in any format that Spark reads; pruned to the declared columns."""
    return typed_rows(spark.read.format(format_).options(**options).load(path), table.columns, order_by)


def block_scan(rows: DataFrame, first: int, last: int) -> DataFrame:
    """Rows of the blocks ``first`` to ``last``; the filter reaches the Parquet scan."""
    if first > last:
        raise SchemaError(f"blocks {first} to {last} are none")
    return rows.where(F.col("block_number").between(first, last))


def to_msgpack_records(log: DataFrame, table: str, keys: list[str], values: list[str]) -> DataFrame:
    """Change records as MessagePack maps with the fields of :func:`to_json_records`; bytes stay bytes."""
    columns = ["_op", *keys, *values, *(f"_prev_{v}" for v in values)]

    def run(batches):
        for batch in batches:
            records = []
            for row in batch.to_pylist():
                key = {k: row[k] for k in keys}
                before = None if row["_op"] == "insert" else {v: row[f"_prev_{v}"] for v in values}
                records.append(pack({"table": table, "operation": row["_op"], "key": key, "values": key | {v: row[v] for v in values}, "prevValues": before}))
            yield pa.RecordBatch.from_arrays([pa.array(records, pa.binary())], names=["value"])

    return log.select(*columns).mapInArrow(run, "value binary")


def to_json_records(log: DataFrame, table: str, keys: list[str], values: list[str]) -> DataFrame:
    """Change records as JSON text, bytes in hex: {"table", "operation", "key", "values", "prevValues"}."""
    binary = {f.name for f in log.schema.fields if isinstance(f.dataType, T.BinaryType)}
    shown = lambda c, n: (F.lower(F.hex(c)) if c in binary else F.col(c)).alias(n)
    part = lambda names, prefix="": F.struct(*(shown(f"{prefix}{n}", n) for n in names))
    previous = F.when(F.col("_op") != "insert", part(values, "_prev_"))
    record = F.struct(F.lit(table).alias("table"), F.col("_op").alias("operation"), part(keys).alias("key"), part([*keys, *values]).alias("values"), previous.alias("prevValues"))
    return log.select(F.to_json(record).alias("value"))
