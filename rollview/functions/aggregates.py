"""The seven aggregates as partials per block, their merge, and their value.

A view's state is a table of partials, one row per key and block. Merging partials is associative, so Spark combines them
map-side; dropping a block's partials undoes it; merging the partials of finalized blocks compacts them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..ddl.model import Item
from .types import INTEGERS, spark_type
from .wide import divide, limbs, limbs_to_bytes

ORDER = ("block_number", "_row_index", "_emit_index")
LONG_MIN, LONG_MAX = -(1 << 63), (1 << 63) - 1


def order_struct() -> Column:
    return F.struct(*ORDER)


def _to_long(total: Column) -> Column:
    """An exact integer sum as a long, held at the ends of its range."""
    return F.greatest(F.least(total, F.lit(LONG_MAX).cast("decimal(38,0)")), F.lit(LONG_MIN).cast("decimal(38,0)")).cast("long")


@dataclass(frozen=True)
class Aggregate:
    """One aggregate column of a view, over a column of logical type ``type_``."""

    item: Item
    type_: str

    @property
    def names(self) -> list[str]:
        a, f = self.item.name, self.item.function
        wide = self.type_ == "UInt256" and f in ("sum", "avg")
        return {
            "count": [f"{a}__n"], "sum": [f"{a}__{'l' if wide else 's'}", f"{a}__n"], "avg": [f"{a}__{'l' if wide else 's'}", f"{a}__n"],
            "min": [f"{a}__m"], "max": [f"{a}__m"], "first": [f"{a}__v"], "last": [f"{a}__v"],
        }[f]

    def _cell(self) -> Column:
        """The column without what doesn't count: nulls always, NaN for min and max."""
        c = F.col(self.item.column)
        return F.when(~F.isnan(c), c) if self.type_ == "Float64" and self.item.function in ("min", "max") else c

    def partial(self) -> list[Column]:
        f = self.item.function
        if f == "count":
            return [F.count(F.lit(1) if self.item.column is None else F.col(self.item.column)).alias(self.names[0])]
        c = self._cell()
        if f in ("sum", "avg"):
            if self.type_ == "UInt256":
                total = F.array(*(F.coalesce(F.sum(x), F.lit(0)) for x in limbs(c)))
            else:
                total = F.sum(c.cast("decimal(38,0)" if self.type_ in INTEGERS else "double"))
            return [total.alias(self.names[0]), F.count(c).alias(self.names[1])]
        if f in ("min", "max"):
            return [(F.min if f == "min" else F.max)(c).alias(self.names[0])]
        pair, order = F.when(c.isNotNull(), F.struct(order_struct().alias("at"), c.alias("value"))), F.when(c.isNotNull(), order_struct())
        return [(F.min_by if f == "first" else F.max_by)(pair, order).alias(self.names[0])]

    def merge(self, over=None) -> list[Column]:
        """Merged partials: of a group, or of a window."""
        on = (lambda c: c.over(over)) if over is not None else (lambda c: c)
        out = []
        for name in self.names:
            kind, c = name[-1], F.col(name)
            if kind in "sn":
                merged = on(F.sum(c))
            elif kind == "l":
                merged = F.array(*(on(F.coalesce(F.sum(c[k]), F.lit(0))) for k in range(8)))
            elif kind == "m":
                merged = on((F.min if self.item.function == "min" else F.max)(c))
            else:
                merged = on((F.min_by if self.item.function == "first" else F.max_by)(c, c["at"]))
            if kind == "s" and self.type_ in INTEGERS:
                merged = merged.cast("decimal(38,0)")
            out.append(merged.alias(name))
        return out

    def value(self) -> Column:
        f, c = self.item.function, F.col(self.names[0])
        if f == "count":
            out = c
        elif f == "sum":
            out = limbs_to_bytes(c) if self.type_ == "UInt256" else _to_long(F.coalesce(c, F.lit(0))) if self.type_ in INTEGERS else F.coalesce(c, F.lit(0.0))
        elif f == "avg":
            n = F.col(self.names[1])
            out = divide(limbs_to_bytes(c), n) if self.type_ == "UInt256" else F.when(n > 0, c.cast("double") / n)
        else:
            out = c if f in ("min", "max") else c["value"]
        return out.alias(self.item.name)

    def has_data(self) -> Column:
        """Whether the merged partials hold anything; a count always does."""
        if self.item.function == "count":
            return F.lit(True)
        return F.col(self.names[1]) > 0 if self.item.function in ("sum", "avg") else F.col(self.names[0]).isNotNull()

    def result_type(self) -> T.DataType:
        f = self.item.function
        if f == "count":
            return T.LongType()
        if f == "avg":
            return T.BinaryType() if self.type_ == "UInt256" else T.DoubleType()
        return spark_type(self.type_)
