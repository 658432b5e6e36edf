"""Materialized views over block-structured rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..ddl.model import View
from ..functions.aggregates import Aggregate
from .changes import DELETE, INSERT, UPDATE, _differs


#: Blocks, and milliseconds at least, of the ranges in which ends of blocks are sought.
_BLOCKS, _MILLIS = 4096, 3_600_000


class ViewPlan:
    """Plans of one view. ``types`` has the logical type of each source column.

    Rows have ``block_number``, ``_row_index`` and ``_emit_index``. Partials are one row per key and block.
    """

    def __init__(self, view: View, types: dict[str, str]):
        self.view = view
        self.aggregates = [Aggregate(i, types.get(i.column, "Float64")) for i in view.aggregates]
        self.keys = [i.name for i in view.keys]
        self.values = [i.name for i in view.aggregates]
        self.columns = [i.name for i in view.items]

    @property
    def parts(self) -> list[str]:
        return [n for a in self.aggregates for n in a.names]

    def _key_columns(self) -> list:
        """Keys under their names; a bucket is the start of its interval, rounded toward zero, 0 without a time."""
        out = []
        for i in self.view.keys:
            c = F.col(i.column)
            if i.kind == "bucket":
                c = F.coalesce(c.cast("long"), F.lit(0))
                c = c - c % F.lit(i.interval_ms) if i.interval_ms else c
            out.append(c.alias(f"__k_{i.name}"))
        return out

    def _out(self, merged: DataFrame) -> DataFrame:
        """Values of merged partials, groups without data left out."""
        has = reduce(lambda a, b: a | b, (a.has_data() for a in self.aggregates), F.lit(not self.aggregates))
        by_name = {a.item.name: a.value() for a in self.aggregates}
        return merged.where(has).select(*(by_name.get(c, F.col(c)) for c in self.columns))

    def _grouped(self, rows: DataFrame, *by: str) -> DataFrame:
        keys = self._key_columns()
        read = {a.item.column for a in self.aggregates if a.item.column}
        rows = rows.select(*keys, *sorted({"block_number", "_row_index", "_emit_index"} | read))
        return rows.groupBy(*(f"__k_{k}" for k in self.keys), *by).agg(*(p for a in self.aggregates for p in a.partial()) or [F.count(F.lit(1)).alias("__rows")])

    def partials(self, rows: DataFrame) -> DataFrame:
        return self._grouped(rows, "block_number").select(*(F.col(f"__k_{k}").alias(k) for k in self.keys), F.col("block_number").alias("_block"), *self.parts)

    def whole(self, rows: DataFrame, spans: DataFrame | None = None) -> DataFrame:
        """The view over all ``rows`` in one aggregation, where nothing will be undone or added. ``spans`` as for :meth:`state`."""
        if self.view.sliding:
            rows = rows.join(spans.where("_end is null").select(F.col("_block").alias("block_number")), "block_number", "left_semi")
        return self._out(self._grouped(rows).withColumnsRenamed({f"__k_{k}": k for k in self.keys}))

    def merge(self, partials: DataFrame, *by: str) -> DataFrame:
        aggregated = [m for a in self.aggregates for m in a.merge()] or [F.count(F.lit(1)).alias("__rows")]
        return partials.groupBy(*self.keys, *by).agg(*aggregated)

    def compact(self, partials: DataFrame, finalized: int) -> DataFrame:
        """Partials of the blocks up to ``finalized`` merged to one row per key. Sliding views keep theirs."""
        if self.view.sliding:
            return partials
        old = self.merge(partials.where(F.col("_block") <= finalized)).withColumn("_block", F.lit(finalized).cast("long"))
        return old.select(partials.columns).unionByName(partials.where(F.col("_block") > finalized))

    def block_times(self, rows: DataFrame) -> DataFrame:
        """(_block, _time): the latest time in each block, null where it has none."""
        return rows.groupBy(F.col("block_number").alias("_block")).agg(F.max(F.col(self.view.sliding.time_column).cast("long")).alias("_time"))

    def spans(self, times: DataFrame) -> DataFrame:
        """(_block, _end, _time): a block counts from itself up to, not including, ``_end``; null: to this day.

        The watermark after a block is the latest time so far; a block without a time takes the watermark. A block ends
        with the first one whose watermark is more than the window's width ahead of its time. Both are running extremes, found
        within ranges of blocks and of times; what is carried from range to range is one row per range.
        """
        within = Window.partitionBy("_range").orderBy("_block").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        ranged = times.withColumn("_range", F.floor(F.col("_block") / F.lit(_BLOCKS)))
        carried = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
        tops = ranged.groupBy("_range").agg(F.max("_time").alias("_top")).select("_range", F.max("_top").over(carried).alias("_before"))
        mark = F.greatest(F.lit(0).cast("long"), F.max("_time").over(within), F.col("_before"))
        marked = ranged.join(tops, "_range").withColumn("_mark", mark).withColumn("_time", F.coalesce("_time", "_mark"))
        past = marked.select((F.col("_time") + self.view.sliding.width_ms).alias("at"), F.lit(1).alias("side"), F.col("_block").alias("of"), "_time", F.lit(None).cast("long").alias("by"))
        marks = marked.select(F.col("_mark").alias("at"), F.lit(0).alias("side"), F.lit(None).cast("long").alias("of"), F.lit(None).cast("long").alias("_time"), F.col("_block").alias("by"))
        # marks only grow with blocks, so the first block past a time is the least one that sorts after it
        both = past.unionByName(marks).withColumn("_range", F.floor(F.col("at") / F.lit(max(self.view.sliding.width_ms, _MILLIS))))
        after = Window.partitionBy("_range").orderBy("at", "side").rowsBetween(1, Window.unboundedFollowing)
        later = Window.orderBy("_range").rowsBetween(1, Window.unboundedFollowing)
        firsts = both.groupBy("_range").agg(F.min("by").alias("_by")).select("_range", F.min("_by").over(later).alias("_later"))
        found = both.withColumn("_own", F.min("by").over(after)).where("side = 1").join(firsts, "_range").withColumn("_end", F.coalesce("_own", "_later"))
        end = F.when(F.col("_end").isNotNull(), F.greatest("_end", "of"))  # greatest alone would pass over the null
        return found.select(F.col("of").alias("_block"), end.alias("_end"), "_time")

    def state(self, partials: DataFrame, spans: DataFrame | None = None, upto: int | None = None) -> DataFrame:
        """The view after block ``upto``, or after all. ``spans`` are needed for sliding views, over the same blocks."""
        if upto is not None:
            partials = partials.where(F.col("_block") <= upto)
        if self.view.sliding:
            live = spans.where(F.col("_end").isNull() if upto is None else F.col("_end").isNull() | (F.col("_end") > upto)).select("_block")
            partials = partials.join(live, "_block", "left_semi")
        return self._out(self.merge(partials))

    def changelog(self, partials: DataFrame, spans: DataFrame | None = None) -> DataFrame:
        """All changes, block by block: ``_block`` tells when."""
        states = self._sliding_states(partials, spans) if self.view.sliding else self._running_states(partials)
        values = F.struct(*self.values) if self.values else F.struct(F.lit(1).alias("_"))
        window = Window.partitionBy(*self.keys).orderBy("_block")
        steps = states.withColumn("now", F.when(F.col("_data"), values)).withColumn("prev", F.lag("now").over(window))
        op = F.when(F.col("now").isNotNull() & F.col("prev").isNull(), INSERT).when(F.col("now").isNull() & F.col("prev").isNotNull(), DELETE)
        op = op.when(F.col("now").isNotNull() & _differs(self.values, "now", "prev"), UPDATE)
        kept = F.coalesce("now", "prev")
        return steps.withColumn("_op", op).where("_op is not null").select("_block", "_op", *self.keys, *(kept[v].alias(v) for v in self.values), *(F.col("prev")[v].alias(f"_prev_{v}") for v in self.values))

    def _running_states(self, partials: DataFrame) -> DataFrame:
        window = Window.partitionBy(*self.keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        merged = partials.select(*self.keys, "_block", *(m for a in self.aggregates for m in a.merge(window)))
        return self._with_data(merged)

    def _with_data(self, merged: DataFrame) -> DataFrame:
        has = reduce(lambda a, b: a | b, (F.coalesce(a.has_data(), F.lit(False)) for a in self.aggregates), F.lit(not self.aggregates))
        return merged.select(*self.keys, "_block", has.alias("_data"), *(a.value() for a in self.aggregates))

    def _sliding_states(self, partials: DataFrame, spans: DataFrame) -> DataFrame:
        """State of each key at every block where a partial of it begins or ends.

        A partial covers the blocks of its span. Blocks are cut into ranges as long as the longest span, so a span meets
        two ranges at most and the range condition becomes a join on key and range.
        """
        placed = partials.join(spans.select("_block", "_end"), "_block")
        widest, latest, oldest = spans.agg(F.max(F.col("_end") - F.col("_block")), F.max("_block"), F.min(F.when(F.col("_end").isNull(), F.col("_block")))).first()
        last = (latest or 0) + 1
        size = max(1, widest or 1, last - oldest if oldest is not None else 1)
        end = F.coalesce("_end", F.lit(last).cast("long"))
        over = lambda c: F.floor(c / F.lit(size)).cast("long")
        key = F.struct(*self.keys).alias("_key") if self.keys else F.struct(F.lit(1).alias("_")).alias("_key")
        moments = placed.select(key, F.col("_block").alias("_at")).unionByName(placed.where("_end is not null").select(key, F.col("_end").alias("_at"))).distinct().withColumn("_range", over(F.col("_at")))
        ranged = placed.where(end > F.col("_block")).select(key, F.col("_block").alias("_from"), end.alias("_to"), *self.parts, F.explode(F.sequence(over(F.col("_block")), over(end - 1))).alias("_range"))
        met = moments.join(ranged, ["_key", "_range"]).where((F.col("_from") <= F.col("_at")) & (F.col("_at") < F.col("_to")))
        merged = met.groupBy("_key", "_at").agg(*(m for a in self.aggregates for m in a.merge()))
        states = moments.select("_key", "_at").join(merged, ["_key", "_at"], "left").select(*(F.col("_key")[k].alias(k) for k in self.keys), F.col("_at").alias("_block"), *self.parts)
        return self._with_data(states)
