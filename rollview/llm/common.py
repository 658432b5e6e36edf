"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Stands for a null id inside an operator; it sorts before every other id, and a row with this very id counts as one without.
NULL_ID = -(1 << 63)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder the cluster names; where none is named, make a temporary one if all runs on this machine."""
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not re.fullmatch(r"local(\[.*\])?", context.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="rollview-"))


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder: lineage ends there, partitions and their row order stay."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def id_key(df: DataFrame, column: str) -> Column:
    """The ids in ``column`` as longs, null ones as :data:`NULL_ID`. Ids are integers: others are an error, before any job."""
    kind = df.schema[column].dataType
    if not isinstance(kind, (T.IntegralType, T.NullType)):
        raise TypeError(f"{column!r} must hold integer ids, not {kind.simpleString()}")
    return F.coalesce(F.col(column).cast("long"), F.lit(NULL_ID))


def unused(df: DataFrame, name: str) -> str:
    """``name``, or the first of ``name_1``, ``name_2``, ... that no column of ``df`` has."""
    have, names = {c.lower() for c in df.columns}, (f"{name}_{k}" if k else name for k in range(len(df.columns) + 1))
    return next(n for n in names if n.lower() not in have)


def id_back(column: str | Column) -> Column:
    column = F.col(column) if isinstance(column, str) else column
    return F.when(column != NULL_ID, column)


def slices(batch: pa.RecordBatch, text_column: int, limit: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each slice holds about ``limit`` bytes of text; one long text is a slice of its own."""
    start, size = 0, 0
    lengths = pa.compute.binary_length(batch.column(text_column)).to_pylist() if batch.num_rows else []
    for i, n in enumerate(lengths):
        if size and size + (n or 0) > limit:
            yield batch.slice(start, i - start)
            start, size = i, 0
        size += n or 0
    if start < len(lengths):
        yield batch.slice(start)


def map_texts(df: DataFrame, columns: list[Column], make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` over ``columns``, whose last is the text (null: empty).

    ``make`` runs once per partition and returns the function for one batch, so tables and caches are made there.
    """

    def run(batches):
        work = make()
        for batch in batches:
            for part in slices(batch, batch.num_columns - 1):
                yield work(part)

    return df.select(*columns[:-1], F.coalesce(columns[-1], F.lit("")).alias("text")).mapInArrow(run, schema)
