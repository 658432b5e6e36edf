"""Change records: differences of view states, and the net effect of several.

A change log has ``_op`` (insert, update, delete), the key columns, the values, and the values before under ``_prev_``
names. A log of several steps also has ``_order``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

INSERT, UPDATE, DELETE = "insert", "update", "delete"


def _match(keys: list[str], a: str, b: str) -> Column:
    """Null-safe equality of keys; true where there are none."""
    return reduce(lambda x, y: x & y, (F.col(f"{a}.`{k}`").eqNullSafe(F.col(f"{b}.`{k}`")) for k in keys), F.lit(True))


def _differs(values: list[str], a: str, b: str) -> Column:
    return reduce(lambda x, y: x | y, (~F.col(f"{a}.`{v}`").eqNullSafe(F.col(f"{b}.`{v}`")) for v in values), F.lit(False))


def diff(before: DataFrame, after: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """What turns ``before`` into ``after``. Both have at most one row per key.

    One aggregation over both sides instead of a full outer join: equal keys meet whatever is null in them, and the
    shuffle carries partial rows.
    """
    side = lambda df, n: df.select(*keys, F.lit(n).alias("_side"), F.struct(*values).alias("_values"))
    pick = lambda n: F.max(F.when(F.col("_side") == n, F.col("_values"))).alias("b" if n == 0 else "a")
    both = side(before, 0).unionByName(side(after, 1)).groupBy(*keys).agg(pick(0), pick(1))
    op = F.when(F.col("b").isNull(), INSERT).when(F.col("a").isNull(), DELETE).when(_differs(values, "a", "b"), UPDATE)
    now = F.coalesce("a", "b")
    return both.where("a is not null or b is not null").withColumn("_op", op).where("_op is not null").select("_op", *keys, *(now[v].alias(v) for v in values), *(F.col("b")[v].alias(f"_prev_{v}") for v in values))


def merge(log: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """The net effect of a log, at most one record per key: the first record tells whether the key was there before, the
    last whether it is there after. An update whose values end where they began stays an update."""
    record = F.struct("_order", "_op", F.struct(*values).alias("now"), F.struct(*(F.col(f"_prev_{v}").alias(v) for v in values)).alias("prev"))
    ends = log.groupBy(*keys).agg(F.min_by(record, "_order").alias("first"), F.max_by(record, "_order").alias("last"))
    was, is_ = F.col("first._op") != INSERT, F.col("last._op") != DELETE
    op = F.when(~was & is_, INSERT).when(was & is_, UPDATE).when(was & ~is_, DELETE)
    return ends.withColumn("_op", op).where("_op is not null").select("_op", *keys, *(F.col("last.now")[v].alias(v) for v in values), *(F.when(was, F.col("first.prev")[v]).alias(f"_prev_{v}") for v in values))


def apply(state: DataFrame, log: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """The state after a merged log: what an idempotent consumer holds. Deletes go, inserts and updates replace."""
    marked = state.select(*keys, *values, F.lit(0).alias("_order"), F.lit(UPDATE).alias("_op")).unionByName(log.select(*keys, *values, F.lit(1).alias("_order"), "_op"))
    last = marked.groupBy(*keys).agg(F.max_by(F.struct("_op", *values), "_order").alias("x"))
    return last.where(F.col("x._op") != DELETE).select(*keys, *(F.col("x")[v].alias(v) for v in values))


def raw_inserts(rows: DataFrame, columns: list[str]) -> DataFrame:
    return rows.select(F.lit(INSERT).alias("_op"), "block_number", "_row_index", *columns)


def raw_deletes(rows: DataFrame, columns: list[str], fork: int) -> DataFrame:
    """Deletes of the rows after block ``fork``, with the stored values."""
    return rows.where(F.col("block_number") > fork).select(F.lit(DELETE).alias("_op"), "block_number", "_row_index", *columns)
