"""Query catalogue of the incremental engine over the driver's tables, with the SQL each query is compared with.

The event stream is read as blocks of 100 events: block = event_id div 100 + 1, place in the block = event_id % 100, time =
milliseconds of ts. Every query runs over its whole table, unless its SQL names the blocks it is about.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ddl.model import Column, Native, Reducer, Schema, StateField, Table
from .operators import changes
from .operators.reducers import state_at
from .plans.dataflow import Dataflow
from .plans.engine import Cursor, Engine
from .sources.shared import shared_folder
from .sources.sinks import SnapshotTable

EVENTS = "CREATE TABLE events (event_id Int64, t DateTime, user_id Int64, event_type String, value Float64);\n"
#: The stream as DuckDB sees it.
SQL_EVENTS = "WITH e AS (SELECT event_id, event_id // 100 + 1 AS b, event_id % 100 AS i, epoch_us(ts) // 1000 AS t, user_id, event_type, value FROM events)"


def stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = spark.read.parquet(f"{sf_dir}/events.parquet")
    return raw.select("event_id", F.expr("event_id div 100 + 1").alias("block_number"), F.expr("event_id % 100").alias("_row_index"), F.col("ts").alias("t"), "user_id", "event_type", "value")


def flow(spark: SparkSession, sf_dir: str, ddl: str, change: Callable[[DataFrame], DataFrame] | None = None) -> Dataflow:
    rows = stream(spark, sf_dir)
    return Dataflow(EVENTS + ddl, {"events": change(rows) if change else rows})


def rounded(df: DataFrame, *names: str, digits: int = 4) -> DataFrame:
    """Sums of doubles depend on their order in the last digits."""
    return df.withColumns({n: F.round(n, digits) for n in names})


_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return add


def _simple(name: str, ddl: str, sql: str, *floats: str) -> None:
    """A query that is the state of the view ``v`` of ``ddl``."""
    query(name, sql)(lambda spark, sf_dir: rounded(flow(spark, sf_dir, ddl).state("v"), *floats))


# views
_simple("mv_sum_count", "CREATE MATERIALIZED VIEW v AS SELECT event_type, sum(value) AS total, count() AS n FROM events GROUP BY event_type",
        f"{SQL_EVENTS} SELECT event_type, round(sum(value), 4) AS total, count(*) AS n FROM e GROUP BY 1", "total")
_simple("mv_all_aggs", """CREATE MATERIALIZED VIEW v AS SELECT user_id, sum(value) AS s, count(value) AS n, min(value) AS lo, max(value) AS hi,
        avg(value) AS mean, first(value) AS head, last(value) AS tail FROM events GROUP BY user_id""",
        f"""{SQL_EVENTS} SELECT user_id, round(sum(value), 4) AS s, count(value) AS n, min(value) AS lo, max(value) AS hi, round(sum(value) / count(value), 4) AS mean,
        arg_min(value, event_id) AS head, arg_max(value, event_id) AS tail FROM e GROUP BY 1""", "s", "mean")  # fmt: skip
_simple("mv_global", "CREATE MATERIALIZED VIEW v AS SELECT sum(value) AS total, count() AS n, max(t) AS latest FROM events",
        f"{SQL_EVENTS} SELECT round(sum(value), 4) AS total, count(*) AS n, max(t) AS latest FROM e", "total")


@query("mv_uint64_sum", f"{SQL_EVENTS} SELECT event_type, CAST(sum(user_id) AS BIGINT) AS ids, round(CAST(sum(user_id) AS DOUBLE) / count(user_id), 4) AS mean, min(user_id) AS lo, arg_max(user_id, event_id) AS tail FROM e GROUP BY 1")
def mv_uint64_sum(spark, sf_dir):
    ddl = "CREATE TABLE u (id UInt64, event_type String); CREATE MATERIALIZED VIEW v AS SELECT event_type, sum(id) AS ids, avg(id) AS mean, min(id) AS lo, last(id) AS tail FROM u GROUP BY event_type"
    return rounded(Dataflow(ddl, {"u": stream(spark, sf_dir).withColumn("id", F.col("user_id").cast("string"))}).state("v"), "mean")


_simple("mv_first_last_text", "CREATE MATERIALIZED VIEW v AS SELECT user_id, first(event_type) AS head, last(event_type) AS tail FROM events GROUP BY user_id",
        f"{SQL_EVENTS} SELECT user_id, arg_min(event_type, event_id) AS head, arg_max(event_type, event_id) AS tail FROM e GROUP BY 1")
_simple("projection_rename", "CREATE MATERIALIZED VIEW v AS SELECT user_id AS who, event_type AS what, count() AS n FROM events GROUP BY user_id, event_type",
        f"{SQL_EVENTS} SELECT user_id AS who, event_type AS what, count(*) AS n FROM e GROUP BY 1, 2")

_NULLS = lambda df: df.withColumn("value", F.when(F.col("user_id") % 3 != 0, F.col("value")))
_SQL_NULLS = "CASE WHEN user_id % 3 <> 0 THEN value END"


@query("mv_count_col_nulls", f"{SQL_EVENTS} SELECT user_id, count({_SQL_NULLS}) AS n, count(*) AS n_rows FROM e GROUP BY 1")
def mv_count_col_nulls(spark, sf_dir):
    return flow(spark, sf_dir, "CREATE MATERIALIZED VIEW v AS SELECT user_id, count(value) AS n, count() AS n_rows FROM events GROUP BY user_id", _NULLS).state("v")


@query("mv_sum_empty_zero", f"{SQL_EVENTS} SELECT user_id, round(coalesce(sum({_SQL_NULLS}), 0), 4) AS total, count(*) AS n, min({_SQL_NULLS}) AS lo FROM e GROUP BY 1")
def mv_sum_empty_zero(spark, sf_dir):
    ddl = "CREATE MATERIALIZED VIEW v AS SELECT user_id, sum(value) AS total, count() AS n, min(value) AS lo FROM events GROUP BY user_id"
    return rounded(flow(spark, sf_dir, ddl, _NULLS).state("v"), "total")


@query("mv_invisible_groups", f"{SQL_EVENTS} SELECT user_id, round(sum({_SQL_NULLS}), 4) AS total FROM e GROUP BY 1 HAVING count({_SQL_NULLS}) > 0")
def mv_invisible_groups(spark, sf_dir):
    """Groups whose aggregates hold no data are not in the view."""
    return rounded(flow(spark, sf_dir, "CREATE MATERIALIZED VIEW v AS SELECT user_id, sum(value) AS total FROM events GROUP BY user_id", _NULLS).state("v"), "total")


@query("mv_uint256_sum", f"""{SQL_EVENTS} SELECT event_type, lower(lpad(printf('%x', CAST(sum(user_id) AS BIGINT)), 64, '0')) AS total,
       lower(lpad(printf('%x', CAST(max(user_id) AS BIGINT)), 64, '0')) AS hi, lower(lpad(printf('%x', CAST(sum(user_id) // count(*) AS BIGINT)), 64, '0')) AS mean FROM e GROUP BY 1""")
def mv_uint256_sum(spark, sf_dir):
    ddl = "CREATE TABLE wide (id UInt256, event_type String); CREATE MATERIALIZED VIEW v AS SELECT event_type, sum(id) AS total, max(id) AS hi, avg(id) AS mean FROM wide GROUP BY event_type"
    rows = stream(spark, sf_dir).withColumn("id", F.concat(F.lit("0x"), F.hex("user_id")))
    return Dataflow(ddl, {"wide": rows}).state("v").select("event_type", *(F.lower(F.hex(c)).alias(c) for c in ("total", "hi", "mean")))


@query("mv_wide_lineitem", """SELECT l_returnflag AS flag, l_linestatus AS status, round(sum(l_quantity), 2) AS qty, round(sum(l_extendedprice), 2) AS price,
       count(*) AS n, min(l_discount) AS lo, max(l_tax) AS hi, round(avg(l_quantity), 4) AS mean FROM lineitem GROUP BY 1, 2""")
def mv_wide_lineitem(spark, sf_dir):
    """The same plans over a wide fact table, blocks of orders."""
    ddl = """CREATE TABLE lineitem (l_orderkey Int64, l_linenumber Int64, l_quantity Float64, l_extendedprice Float64, l_discount Float64, l_tax Float64, l_returnflag String, l_linestatus String);
    CREATE MATERIALIZED VIEW v AS SELECT l_returnflag AS flag, l_linestatus AS status, sum(l_quantity) AS qty, sum(l_extendedprice) AS price, count() AS n,
    min(l_discount) AS lo, max(l_tax) AS hi, avg(l_quantity) AS mean FROM lineitem GROUP BY l_returnflag, l_linestatus"""
    raw = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    rows = raw.withColumn("block_number", F.expr("l_orderkey div 1000 + 1")).withColumn("_row_index", F.expr("l_orderkey % 1000 * 8 + l_linenumber"))
    return rounded(rounded(Dataflow(ddl, {"lineitem": rows}).state("v"), "qty", "price", digits=2), "mean")


# tumbling buckets
def _tumble(unit: str) -> str:
    return f"""CREATE MATERIALIZED VIEW v AS SELECT event_type, toStartOfInterval(t, INTERVAL {unit}) AS w, first(value) AS open, max(value) AS high, min(value) AS low,
    last(value) AS close, sum(value) AS volume, count() AS n FROM events GROUP BY event_type, w"""


def _sql_tumble(ms: int) -> str:
    return f"""{SQL_EVENTS} SELECT event_type, (t // {ms}) * {ms} AS w, arg_min(value, event_id) AS open, max(value) AS high, min(value) AS low,
    arg_max(value, event_id) AS close, round(sum(value), 4) AS volume, count(*) AS n FROM e GROUP BY 1, 2"""


for _name, _unit, _ms in (("tumble_5m_ohlcv", "5 MINUTE", 300_000), ("tumble_1h", "1 HOUR", 3_600_000), ("tumble_1d", "1 DAY", 86_400_000), ("tumble_30s", "30 SECOND", 30_000)):
    _simple(_name, _tumble(_unit), _sql_tumble(_ms), "volume")


@query("tumble_negative_times", f"{SQL_EVENTS}, x AS (SELECT *, (event_id - 500) * 61000 AS moment FROM e) SELECT event_type, moment - moment % 3600000 AS w, count(*) AS n, round(sum(value), 4) AS volume FROM x GROUP BY 1, 2")
def tumble_negative_times(spark, sf_dir):
    """Buckets of times before and after 0 are rounded toward 0."""
    ddl = """CREATE TABLE x (event_type String, moment Int64, value Float64);
    CREATE MATERIALIZED VIEW v AS SELECT event_type, toStartOfInterval(moment, INTERVAL 1 HOUR) AS w, count() AS n, sum(value) AS volume FROM x GROUP BY event_type, w"""
    return rounded(Dataflow(ddl, {"x": stream(spark, sf_dir).withColumn("moment", F.expr("(event_id - 500) * 61000"))}).state("v"), "volume")


_simple("mergeable_moments", """CREATE REDUCER sq SOURCE events GROUP BY user_id STATE () WHEN row.value >= 0 THEN EMIT x = row.value, xx = row.value * row.value END;
        CREATE MATERIALIZED VIEW v AS SELECT user_id, count() AS n, sum(x) AS sx, sum(xx) AS sxx FROM sq GROUP BY user_id""",
        f"{SQL_EVENTS} SELECT user_id, count(*) AS n, round(sum(value), 4) AS sx, round(sum(value * value), 4) AS sxx FROM e WHERE value >= 0 GROUP BY 1", "sx", "sxx")

# sliding windows
_SLIDING = "CREATE MATERIALIZED VIEW v AS SELECT event_type, sum(value) AS total, count() AS n FROM events GROUP BY event_type WINDOW SLIDING INTERVAL {} BY t"
_SQL_LIVE = SQL_EVENTS + ", bt AS (SELECT b, max(t) AS bt FROM e GROUP BY 1), live AS (SELECT b FROM bt WHERE bt >= (SELECT max(bt) FROM bt) - {})"
_simple("sliding_6h_final", _SLIDING.format("6 HOURS"), _SQL_LIVE.format(21_600_000) + " SELECT event_type, round(sum(value), 4) AS total, count(*) AS n FROM e SEMI JOIN live USING (b) GROUP BY 1", "total")
_simple("sliding_1d_all_aggs", """CREATE MATERIALIZED VIEW v AS SELECT user_id, sum(value) AS s, count() AS n, min(value) AS lo, max(value) AS hi, avg(value) AS mean, first(value) AS head, last(value) AS tail
        FROM events GROUP BY user_id WINDOW SLIDING INTERVAL 1 DAY BY t""",
        _SQL_LIVE.format(86_400_000) + """ SELECT user_id, round(sum(value), 4) AS s, count(*) AS n, min(value) AS lo, max(value) AS hi, round(avg(value), 4) AS mean,
        arg_min(value, event_id) AS head, arg_max(value, event_id) AS tail FROM e SEMI JOIN live USING (b) GROUP BY 1""", "s", "mean")  # fmt: skip

_SQL_SPANS = (
    SQL_EVENTS
    + """, bt AS (SELECT b, max(t) AS bt FROM e GROUP BY 1), wm AS (SELECT b, bt, max(bt) OVER (ORDER BY b) AS wm FROM bt),
sp AS (SELECT a.b, min(c.b) AS e FROM wm a LEFT JOIN wm c ON c.b >= a.b AND c.wm - {} > a.bt GROUP BY 1),
p AS (SELECT event_type, b, sum(value) AS s, count(*) AS n FROM e GROUP BY 1, 2), q AS (SELECT p.*, sp.e FROM p JOIN sp USING (b)),
m AS (SELECT event_type, b AS k FROM q UNION SELECT event_type, e FROM q WHERE e IS NOT NULL),
st AS (SELECT m.event_type, m.k, sum(q.s) AS total, count(q.s) AS parts, CAST(sum(q.n) AS BIGINT) AS n FROM m LEFT JOIN q ON q.event_type = m.event_type AND q.b <= m.k AND (q.e IS NULL OR m.k < q.e) GROUP BY 1, 2),
sr AS (SELECT event_type, k, CASE WHEN parts > 0 THEN round(total, 4) END AS total, CASE WHEN parts > 0 THEN n END AS n FROM st),
lg AS (SELECT *, lag(total) OVER w AS pt, lag(n) OVER w AS pn FROM sr WINDOW w AS (PARTITION BY event_type ORDER BY k))
SELECT k AS block, CASE WHEN n IS NOT NULL AND pn IS NULL THEN 'insert' WHEN n IS NULL THEN 'delete' ELSE 'update' END AS op,
event_type, coalesce(total, pt) AS total, coalesce(n, pn) AS n, pt AS prev_total, pn AS prev_n
FROM lg WHERE (n IS NOT NULL OR pn IS NOT NULL) AND (total IS DISTINCT FROM pt OR n IS DISTINCT FROM pn)"""
)


@query("sliding_changelog", _SQL_SPANS.format(21_600_000))
def sliding_changelog(spark, sf_dir):
    """Inserts, updates and deletes of a rolling view, by block."""
    log = flow(spark, sf_dir, _SLIDING.format("6 HOURS")).changelog("v")
    return rounded(log.selectExpr("_block as block", "_op as op", "event_type", "total", "n", "_prev_total as prev_total", "_prev_n as prev_n"), "total", "prev_total")


# change logs
_PLAIN = "CREATE MATERIALIZED VIEW v AS SELECT event_type, sum(value) AS total, count() AS n FROM events GROUP BY event_type"
_SQL_RUN = SQL_EVENTS + """, p AS (SELECT event_type, b, sum(value) AS s, count(*) AS c FROM e GROUP BY 1, 2),
r AS (SELECT event_type, b, sum(s) OVER w AS total, CAST(sum(c) OVER w AS BIGINT) AS n FROM p WINDOW w AS (PARTITION BY event_type ORDER BY b)),
lg AS (SELECT *, lag(total) OVER w AS pt, lag(n) OVER w AS pn FROM r WINDOW w AS (PARTITION BY event_type ORDER BY b))"""


@query("changelog_plain", _SQL_RUN + """ SELECT b AS block, CASE WHEN pn IS NULL THEN 'insert' ELSE 'update' END AS op, event_type, round(total, 4) AS total, n,
       round(pt, 4) AS prev_total, pn AS prev_n FROM lg""")
def changelog_plain(spark, sf_dir):
    log = flow(spark, sf_dir, _PLAIN).changelog("v")
    return rounded(log.selectExpr("_block as block", "_op as op", "event_type", "total", "n", "_prev_total as prev_total", "_prev_n as prev_n"), "total", "prev_total")


_SQL_DIFF = """, x AS (SELECT event_type, sum(value) AS total, count(*) AS n FROM e WHERE {0} GROUP BY 1), y AS (SELECT event_type, sum(value) AS total, count(*) AS n FROM ({1}) GROUP BY 1)
SELECT CASE WHEN x.n IS NULL THEN 'insert' WHEN y.n IS NULL THEN 'delete' ELSE 'update' END AS op, coalesce(y.event_type, x.event_type) AS event_type,
round(coalesce(y.total, x.total), 4) AS total, coalesce(y.n, x.n) AS n, round(x.total, 4) AS prev_total, x.n AS prev_n
FROM x FULL JOIN y ON x.event_type = y.event_type WHERE x.n IS DISTINCT FROM y.n OR x.total IS DISTINCT FROM y.total"""
_NET = ["_op as op", "event_type", "total", "n", "_prev_total as prev_total", "_prev_n as prev_n"]


@query("changelog_merged", SQL_EVENTS + _SQL_DIFF.format("b <= 50", "SELECT * FROM e WHERE b <= 90"))
def changelog_merged(spark, sf_dir):
    """Blocks 51 to 90 as one batch."""
    log = flow(spark, sf_dir, _PLAIN).changelog("v", upto=90).where("_block > 50").withColumnRenamed("_block", "_order")
    return rounded(changes.merge(log, ["event_type"], ["total", "n"]).selectExpr(*_NET), "total", "prev_total")


@query("rollback_view", f"{SQL_EVENTS} SELECT event_type, round(sum(value), 4) AS total, count(*) AS n FROM e WHERE b <= 60 GROUP BY 1")
def rollback_view(spark, sf_dir):
    """The view once the blocks after 60 are undone: partials dropped, nothing recomputed."""
    f = flow(spark, sf_dir, _PLAIN)
    return rounded(f.views["v"].state(f.partials("v"), upto=60), "total")


@query("rollback_compensation", SQL_EVENTS + _SQL_DIFF.format("true", "SELECT * FROM e WHERE b <= 60"))
def rollback_compensation(spark, sf_dir):
    """What a rollback to block 60 tells consumers."""
    f = flow(spark, sf_dir, _PLAIN)
    parts, plan = f.partials("v"), f.views["v"]
    return rounded(changes.diff(plan.state(parts), plan.state(parts, upto=60), ["event_type"], ["total", "n"]).selectExpr(*_NET), "total", "prev_total")


@query("raw_rollback_deletes", f"{SQL_EVENTS} SELECT 'delete' AS op, b AS block_number, i AS row_index, event_id, value FROM e WHERE b > 60")
def raw_rollback_deletes(spark, sf_dir):
    rows = flow(spark, sf_dir, "").source("events")
    return changes.raw_deletes(rows, ["event_id", "value"], 60).withColumnsRenamed({"_op": "op", "_row_index": "row_index"})


@query("raw_inserts", f"{SQL_EVENTS} SELECT 'insert' AS op, b AS block_number, i AS row_index, event_id, t FROM e")
def raw_inserts(spark, sf_dir):
    return changes.raw_inserts(flow(spark, sf_dir, "").source("events"), ["event_id", "t"]).withColumnsRenamed({"_op": "op", "_row_index": "row_index"})


@query("raw_range_scan", f"{SQL_EVENTS} SELECT b AS block_number, i AS row_index, user_id, value FROM e WHERE b BETWEEN 20 AND 40")
def raw_range_scan(spark, sf_dir):
    rows = flow(spark, sf_dir, "").source("events").where(F.col("block_number").between(20, 40))
    return rows.select("block_number", F.col("_row_index").alias("row_index"), "user_id", "value")


@query("reingest_after_fork", f"{SQL_EVENTS} SELECT event_type, round(sum(CASE WHEN b > 60 THEN 2 * value ELSE value END), 4) AS total, count(*) AS n FROM e GROUP BY 1")
def reingest_after_fork(spark, sf_dir):
    """Blocks after 60 replaced by others: old partials cut at the fork, new ones added."""
    f = flow(spark, sf_dir, _PLAIN)
    again = flow(spark, sf_dir, _PLAIN, lambda df: df.where("block_number > 60").withColumn("value", F.col("value") * 2))
    parts = f.partials("v").where("_block <= 60").unionByName(again.partials("v"))
    return rounded(f.views["v"].state(parts), "total")


@query("finalize_compaction", f"""{SQL_EVENTS} SELECT user_id, round(sum(value), 4) AS s, count(*) AS n, arg_min(value, event_id) AS head, arg_max(value, event_id) AS tail FROM e GROUP BY 1""")
def finalize_compaction(spark, sf_dir):
    """Partials up to block 70 compacted to one row per key; the view is the same."""
    f = flow(spark, sf_dir, "CREATE MATERIALIZED VIEW v AS SELECT user_id, sum(value) AS s, count() AS n, first(value) AS head, last(value) AS tail FROM events GROUP BY user_id")
    plan = f.views["v"]
    return rounded(plan.state(plan.compact(f.partials("v"), 70)), "s")


@query("apply_changes", f"{SQL_EVENTS} SELECT event_type, round(sum(value), 4) AS total, count(*) AS n FROM e GROUP BY 1")
def apply_changes(spark, sf_dir):
    """A consumer's table after it applies the change log in two batches."""
    f = flow(spark, sf_dir, _PLAIN)
    log = f.changelog("v").withColumnRenamed("_block", "_order")
    table = None
    for batch in (log.where("_order <= 55"), log.where("_order > 55")):
        net = changes.merge(batch, ["event_type"], ["total", "n"])
        table = changes.apply(net.select("event_type", "total", "n").limit(0) if table is None else table, net, ["event_type"], ["total", "n"])
    return rounded(table, "total")


@query("virtual_table_changes", f"{SQL_EVENTS} SELECT 'v' AS source, event_type, count(*) AS n FROM e GROUP BY 2 UNION ALL SELECT 'kept', event_type, 1 FROM e")
def virtual_table_changes(spark, sf_dir):
    """A virtual table puts out no records of its own, another table does; the view over the virtual one does."""
    ddl = "CREATE VIRTUAL TABLE ev (event_type String); CREATE TABLE kept (event_type String); CREATE MATERIALIZED VIEW v AS SELECT event_type, count() AS n FROM ev GROUP BY event_type"
    engine, rows = Engine.open(spark, ddl, shared_folder(spark, "engine")), stream(spark, sf_dir)
    tables = engine.ingest({"ev": rows, "kept": rows}).tables
    return reduce(DataFrame.unionByName, (log.select(F.lit(name).alias("source"), "event_type", (F.col("n") if "n" in log.columns else F.lit(1)).cast("long").alias("n")) for name, log in sorted(tables.items())))


# reducers
_TOTAL = """CREATE REDUCER run SOURCE events GROUP BY user_id STATE (total Float64 DEFAULT 0)
    WHEN row.value >= 0 THEN SET state.total = state.total + row.value EMIT event_id = row.event_id, running = state.total END;\n"""
_SQL_TOTAL = "sum(CASE WHEN value >= 0 THEN value END) OVER (PARTITION BY user_id ORDER BY event_id)"


@query("reducer_running_total", f"{SQL_EVENTS}, r AS (SELECT event_id, user_id, value, {_SQL_TOTAL} AS x FROM e) SELECT event_id, user_id, round(x, 4) AS running FROM r WHERE value >= 0")
def reducer_running_total(spark, sf_dir):
    return rounded(flow(spark, sf_dir, _TOTAL).source("run").select("event_id", "user_id", "running"), "running")


@query("reducer_chained_double", f"{SQL_EVENTS}, r AS (SELECT event_id, user_id, value, {_SQL_TOTAL} AS x FROM e) SELECT user_id, round(2 * arg_max(x, event_id), 4) AS doubled FROM r WHERE value >= 0 GROUP BY 1")
def reducer_chained_double(spark, sf_dir):
    ddl = _TOTAL + """CREATE REDUCER twice SOURCE run GROUP BY user_id STATE () WHEN row.running = row.running THEN EMIT x = row.running * 2 END;
    CREATE MATERIALIZED VIEW v AS SELECT user_id, last(x) AS doubled FROM twice GROUP BY user_id"""
    return rounded(flow(spark, sf_dir, ddl).state("v"), "doubled")


@query("reducer_when_filter", f"{SQL_EVENTS} SELECT event_id, user_id, CASE WHEN value > 50 THEN 'high' ELSE 'mid' END AS band, round(value / 2, 6) AS half FROM e WHERE value > 10")
def reducer_when_filter(spark, sf_dir):
    """The first WHEN that holds decides; rows without one emit nothing."""
    ddl = """CREATE REDUCER r SOURCE events GROUP BY user_id STATE () WHEN row.value > 50 THEN EMIT event_id = row.event_id, band = 'high', half = row.value / 2
    WHEN row.value > 10 THEN LET h = row.value / 2 EMIT row.event_id AS event_id, band = 'mid', half = h END"""
    return rounded(flow(spark, sf_dir, ddl).source("r").select("event_id", "user_id", "band", "half"), "half", digits=6)


@query("reducer_always_emit", f"""{SQL_EVENTS}, r AS (SELECT *, last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM e)
       SELECT event_id, user_id, coalesce(p, 0.0) AS last_purchase, CASE WHEN event_type = 'purchase' THEN 1 END AS hit FROM r""")
def reducer_always_emit(spark, sf_dir):
    ddl = """CREATE REDUCER r SOURCE events GROUP BY user_id STATE (p Float64 DEFAULT 0) WHEN row.event_type = 'purchase' THEN SET state.p = row.value EMIT hit = 1
    ALWAYS EMIT event_id = row.event_id, last_purchase = state.p END"""
    return flow(spark, sf_dir, ddl).source("r").selectExpr("event_id", "user_id", "last_purchase", "cast(hit as int) as hit")


@query("reducer_empty_emit_counts", f"{SQL_EVENTS} SELECT user_id, count(*) AS n FROM e WHERE event_type = 'click' GROUP BY 1")
def reducer_empty_emit_counts(spark, sf_dir):
    """A WHEN that matches without EMIT still puts out a row of its keys."""
    ddl = """CREATE REDUCER r SOURCE events GROUP BY user_id STATE () WHEN row.event_type = 'click' THEN LET x = 1 END;
    CREATE MATERIALIZED VIEW v AS SELECT user_id, count() AS n FROM r GROUP BY user_id"""
    return flow(spark, sf_dir, ddl).state("v")


@query("expr_semantics", f"""{SQL_EVENTS}, x AS (SELECT event_id, user_id, {_SQL_NULLS} AS v, event_type FROM e) SELECT event_id,
       CASE WHEN v IS NULL THEN NULL WHEN user_id % 5 = 0 THEN 0.0 ELSE round(v / CAST(user_id % 5 AS DOUBLE), 6) END AS div0, v IS NULL AS is_null, coalesce(v > 20, false) AS gt, coalesce(v <= 20, false) AS le,
       CASE WHEN v <> 0 AND event_type <> 'view' THEN 'both' ELSE 'not' END AS cond, round(1 + v * 2 - 6 / 4.0, 6) AS mixed, round((1 + v) * (2 - 6) / 4.0, 6) AS grouped,
       coalesce(v > 90 OR v > 10 AND v < 20, false) AS both FROM x""")
def expr_semantics(spark, sf_dir):
    ddl = """CREATE TABLE x (event_id Int64, user_id Int64, m Int64, v Float64, event_type String);
    CREATE REDUCER r SOURCE x GROUP BY user_id STATE ()
    WHEN 1 = 1 THEN LET q = row.v / row.m
      EMIT event_id = row.event_id, div0 = q, is_null = row.v = row.nothing, gt = v > 20, le = v <= 20, cond = IF(row.v AND row.event_type != 'view', 'both', 'not'),
        mixed = 1 + row.v * 2 - 6 / 4, grouped = (1 + row.v) * (2 - 6) / 4, both = row.v > 90 OR row.v > 10 AND row.v < 20 END"""
    rows = _NULLS(stream(spark, sf_dir)).withColumn("m", F.col("user_id") % 5).withColumnRenamed("value", "v")
    return rounded(Dataflow(ddl, {"x": rows}).source("r").select("event_id", "div0", "is_null", "gt", "le", "cond", "mixed", "grouped", "both"), "div0", "mixed", "grouped", digits=6)


_BATTERY = """CREATE TABLE readings (event_id Int64, meter Int64, kind String, kwh Float64);
CREATE REDUCER battery SOURCE readings GROUP BY meter STATE (charge Float64 DEFAULT 40)
  WHEN row.kind = 'sun' THEN LET full = state.charge + row.kwh * 0.9 SET state.charge = IF(full > 120, 120, full) EMIT sold = IF(full > 120, full - 120, 0)
  WHEN row.kind = 'use' THEN LET rest = state.charge - row.kwh SET state.charge = IF(rest < 0, 0, rest) EMIT bought = IF(rest < 0, 0 - rest, 0)
  ALWAYS EMIT level = state.charge END;
CREATE MATERIALIZED VIEW v AS SELECT meter, sum(bought) AS bought, sum(sold) AS sold, last(level) AS level, count() AS n FROM battery GROUP BY meter"""
_SQL_BATTERY = f"""{SQL_EVENTS.replace('WITH e', 'WITH RECURSIVE e')}, o AS (SELECT user_id AS meter, CASE WHEN event_type IN ('view', 'click') THEN 'use' WHEN event_type = 'signup' THEN 'off' ELSE 'sun' END AS kind, value AS kwh,
       row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM e),
       f AS (SELECT meter, CAST(0 AS BIGINT) AS k, CAST(40 AS DOUBLE) AS level, CAST(0 AS DOUBLE) AS bought, CAST(0 AS DOUBLE) AS sold FROM o WHERE k = 1
       UNION ALL SELECT o.meter, o.k, CASE kind WHEN 'sun' THEN least(120.0, level + kwh * 0.9) WHEN 'use' THEN greatest(0.0, level - kwh) ELSE level END,
       CASE WHEN kind = 'use' THEN greatest(0.0, kwh - level) ELSE 0.0 END, CASE WHEN kind = 'sun' THEN greatest(0.0, level + kwh * 0.9 - 120.0) ELSE 0.0 END FROM f JOIN o ON o.meter = f.meter AND o.k = f.k + 1)
       SELECT meter, round(sum(bought), 3) AS bought, round(sum(sold), 3) AS sold, round(arg_max(level, k), 3) AS level, count(*) FILTER (WHERE k > 0) AS n FROM f GROUP BY 1"""


def _readings(spark, sf_dir):
    return stream(spark, sf_dir).selectExpr("event_id", "block_number", "_row_index", "user_id as meter", "case when event_type in ('view', 'click') then 'use' when event_type = 'signup' then 'off' else 'sun' end as kind", "value as kwh")


@query("reducer_battery", _SQL_BATTERY)
def reducer_battery(spark, sf_dir):
    """A battery that loses a tenth of what it is given, is never over full or below empty: a fold that windows can't express."""
    return rounded(Dataflow(_BATTERY, {"readings": _readings(spark, sf_dir)}).state("v"), "bought", "sold", "level", digits=3)


@query("script_battery", _SQL_BATTERY)
def script_battery(spark, sf_dir):
    """The same fold as a script."""
    ddl = """CREATE TABLE readings (event_id Int64, meter Int64, kind String, kwh Float64);
    CREATE MODULE limits LANGUAGE LUA AS $$ return { split = function(x, low, high) return math.max(low, math.min(high, x)), math.max(0, x - high), math.max(0, low - x) end } $$;
    CREATE REDUCER battery SOURCE readings GROUP BY meter STATE (charge Float64 DEFAULT 40) REQUIRE limits LANGUAGE lua PROCESS $$
      local sold, bought = 0.0, 0.0
      if row.kind == "sun" then
        state.charge, sold = limits.split(state.charge + row.kwh * 0.9, 0.0, 120.0)
      elseif row.kind == "use" then
        local over
        state.charge, over, bought = limits.split(state.charge - row.kwh, 0.0, 120.0)
      end
      emit { sold = sold * 1.0, bought = bought * 1.0, level = state.charge * 1.0 }
    $$;
    CREATE MATERIALIZED VIEW v AS SELECT meter, sum(bought) AS bought, sum(sold) AS sold, last(level) AS level, count() AS n FROM battery GROUP BY meter"""
    return rounded(Dataflow(ddl, {"readings": _readings(spark, sf_dir)}).state("v"), "bought", "sold", "level", digits=3)


@query("script_late_alarms", f"""{SQL_EVENTS}, o AS (SELECT *, sum(value) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM e WHERE event_type = 'error'),
       h AS (SELECT user_id, min(event_id) AS hit FROM o WHERE run >= 150 GROUP BY 1)
       SELECT o.user_id, o.event_id, greatest(o.event_id, h.hit) AS told_at, 'u' || o.user_id || '/' || upper(event_type) AS tag FROM o JOIN h USING (user_id)""")
def script_late_alarms(spark, sf_dir):
    """Errors are kept in a JSON list until a user's total reaches 150, then all are emitted at once, and later ones as they come."""
    ddl = """CREATE REDUCER alarms SOURCE events GROUP BY user_id STATE (total Float64 DEFAULT 0, loud Boolean DEFAULT false, kept JSON DEFAULT '[]') LANGUAGE lua PROCESS $$
      if row.event_type ~= "error" then return end
      local function tell(id) emit({event_id = id, told_at = row.event_id, tag = string.format("u%d/%s", row.user_id, string.upper(row.event_type))}) end
      local id = row.event_id
      if state.loud then tell(id) return end
      state.total = state.total + row.value
      table.insert(state.kept, id)
      if state.total < 150 then return end
      state.loud = true
      for _, old in ipairs(state.kept) do tell(old) end
      state.kept = {}
    $$"""
    emits = (Column("event_id", "Int64"), Column("told_at", "Int64"), Column("tag", "String"))
    return Dataflow(EVENTS + ddl, {"events": stream(spark, sf_dir)}, {"alarms": (None, emits)}).source("alarms").select("user_id", "event_id", "told_at", "tag")


@query("reducer_enrich_asof", f"""{SQL_EVENTS}, r AS (SELECT *, last_value(CASE WHEN event_type = 'signup' THEN value END IGNORE NULLS) OVER (ORDER BY event_id) AS ref FROM e)
       SELECT event_id, round(value * coalesce(ref, 0.0), 6) AS priced FROM r WHERE event_type = 'purchase'""")
def reducer_enrich_asof(spark, sf_dir):
    """Last known reference price, one key for all rows: the windows run per block."""
    ddl = """CREATE TABLE x (event_id Int64, one String, event_type String, value Float64);
    CREATE REDUCER r SOURCE x GROUP BY one STATE (ref Float64 DEFAULT 0) WHEN row.event_type = 'signup' THEN SET state.ref = row.value
    WHEN row.event_type = 'purchase' THEN EMIT event_id = row.event_id, priced = row.value * state.ref END"""
    rows = stream(spark, sf_dir).withColumn("one", F.lit("all"))
    return rounded(Dataflow(ddl, {"x": rows}).source("r").where("event_id is not null").select("event_id", "priced"), "priced", digits=6)


@query("state_snapshot_at_block", f"""{SQL_EVENTS} SELECT user_id, round(sum(value), 4) AS total FROM e WHERE value >= 0 AND b <= 40 GROUP BY 1
       UNION ALL SELECT user_id, 0.0 FROM e WHERE b <= 40 GROUP BY 1 HAVING count(*) FILTER (WHERE value >= 0) = 0""")
def state_snapshot_at_block(spark, sf_dir):
    """Reducer state as a rollback to block 40 restores it."""
    states = state_at(flow(spark, sf_dir, _TOTAL).snapshots("run"), ["user_id"], 40)
    return rounded(states.select("user_id", F.get_json_object("_state", "$.total").cast("double").alias("total")), "total")


@query("reducer_classifier_multi_emit", f"""{SQL_EVENTS}, o AS (SELECT *, sum(value) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM e WHERE event_type = 'purchase'),
       h AS (SELECT user_id, min(event_id) AS hit FROM o WHERE run >= 200 GROUP BY 1)
       SELECT o.user_id, o.event_id, greatest(o.event_id, h.hit) AS detected_at, value FROM o JOIN h USING (user_id)""")
def reducer_classifier_multi_emit(spark, sf_dir):
    """Purchases are held back until a user's total reaches 200, then all come out at once, and later ones as they come."""
    def classify(state, row, ctx):
        if row["event_type"] != "purchase":
            return
        now = {"event_id": row["event_id"], "value": row["value"], "detected_at": row["event_id"]}
        if state["hit"]:
            ctx.emit(now)
            return
        state["held"] = [*state["held"], now]
        state["total"] += row["value"]
        if state["total"] >= 200:
            state["hit"] = True
            for held in state["held"]:
                ctx.emit(held | {"detected_at": row["event_id"]})
            state["held"] = []

    emits = (Column("event_id", "Int64"), Column("value", "Float64"), Column("detected_at", "Int64"))
    state = (StateField("hit", "Boolean"), StateField("total", "Float64"), StateField("held", "JSON", "[]"))
    table = Table("events", tuple(Column(n, t) for n, t in (("event_id", "Int64"), ("user_id", "Int64"), ("event_type", "String"), ("value", "Float64"))))
    schema = Schema({"events": table}, reducers={"r": Reducer("r", "events", ("user_id",), state, Native(classify, emits))})
    return Dataflow(schema, {"events": stream(spark, sf_dir)}).source("r").select("user_id", "event_id", "detected_at", "value")


# the engine itself: blocks of the stream go in, changes come out and are acknowledged
_ENGINE = EVENTS + _PLAIN + ";"
_SQL_LAST = "(SELECT max(b) FROM e)"


def _engine(spark) -> Engine:
    return Engine.open(spark, _ENGINE, shared_folder(spark, "engine"))


def _chain(first: int, last: int, tag: str = "h") -> list[Cursor]:
    return [Cursor(k, f"{tag}{k}") for k in range(max(1, first), last + 1)]


def _blocks(spark, sf_dir, first: int = 1, last: int | None = None) -> DataFrame:
    rows = stream(spark, sf_dir).where(F.col("block_number") >= first)
    return rows if last is None else rows.where(F.col("block_number") <= last)


def _last(spark, sf_dir) -> int:
    return stream(spark, sf_dir).agg(F.max("block_number")).first()[0]


@query("fork_resolution", SQL_EVENTS + _SQL_DIFF.format("true", f"SELECT * FROM e WHERE b <= {_SQL_LAST} // 2").replace("SELECT CASE", f"SELECT {_SQL_LAST} // 2 AS cursor, CASE"))
def fork_resolution(spark, sf_dir):
    """An engine that holds all blocks meets a chain that agrees with its own up to the middle: where it goes back to, and what it
    tells its consumers."""
    engine, last = _engine(spark), _last(spark, sf_dir)
    engine.ack(engine.ingest({"events": _blocks(spark, sf_dir)}, _chain(last // 2 - 2, last)).sequence)
    cursor, batch = engine.handle_fork([*_chain(last // 2 + 1, last, "x"), *_chain(last // 2 - 2, last // 2)])
    return rounded(batch.tables["v"].selectExpr(f"{cursor.number}L as cursor", *_NET), "total", "prev_total")


@query("engine_inline_fork", SQL_EVENTS + _SQL_DIFF.format(f"b <= {_SQL_LAST} * 3 // 4", f"SELECT event_id, b, i, t, user_id, event_type, CASE WHEN b > {_SQL_LAST} // 2 THEN 2 * value ELSE value END AS value FROM e"))
def engine_inline_fork(spark, sf_dir):
    """The engine holds three quarters of the blocks; the second half of another chain comes in: the call rolls back by itself and
    gives one net change per key."""
    engine, last = _engine(spark), _last(spark, sf_dir)
    held, half = last * 3 // 4, last // 2
    engine.ack(engine.ingest({"events": _blocks(spark, sf_dir, 1, held)}, _chain(half - 2, held)).sequence)
    other = _blocks(spark, sf_dir, half + 1).withColumn("value", F.col("value") * 2)
    return rounded(engine.ingest({"events": other}, [*_chain(half - 2, half), *_chain(half + 1, held, "x")]).tables["v"].selectExpr(*_NET), "total", "prev_total")


@query("engine_recovery", f"{SQL_EVENTS} SELECT event_type, round(sum(value), 4) AS total, count(*) AS n FROM e GROUP BY 1")
def engine_recovery(spark, sf_dir):
    """A batch is lost before its acknowledgement; the engine is opened anew, knows only what was acknowledged, and goes on."""
    engine, half = _engine(spark), _last(spark, sf_dir) // 2
    engine.ack(engine.ingest({"events": _blocks(spark, sf_dir, 1, half)}, _chain(half - 2, half), finalized_head=Cursor(half - 1, f"h{half - 1}")).sequence)
    engine.ingest({"events": _blocks(spark, sf_dir, half + 1)})
    again = Engine.open(spark, _ENGINE, engine.store.home)
    batch = again.ingest({"events": _blocks(spark, sf_dir, again.latest_block + 1)}, finalized_head=Cursor(half, f"h{half}"))
    again.ack(batch.sequence)
    again.ack(batch.sequence)
    return rounded(Engine.open(spark, _ENGINE, engine.store.home).view("v"), "total")


@query("engine_net_of_delete_and_insert", f"""{SQL_EVENTS}, x AS (SELECT round(sum(value), 4) AS total, count(*) AS n FROM e WHERE event_type = 'view')
       SELECT 'delete' AS op, 'view' AS event_type, total, n, total AS prev_total, n AS prev_n FROM x UNION ALL SELECT 'insert', 'seen', total, n, NULL, NULL FROM x""")
def engine_net_of_delete_and_insert(spark, sf_dir):
    """All blocks are replaced by ones in which one key has another name: a delete and an insert of a key make an update or
    nothing, keys that only one chain has make a delete and an insert."""
    engine, last = _engine(spark), _last(spark, sf_dir)
    engine.ack(engine.ingest({"events": _blocks(spark, sf_dir)}, _chain(1, last)).sequence)
    other = _blocks(spark, sf_dir).withColumn("event_type", F.when(F.col("event_type") == "view", "seen").otherwise(F.col("event_type")))
    net = engine.ingest({"events": other}, _chain(1, last, "x")).tables["v"]
    return rounded(net.where("_op <> 'update' or round(total, 4) <> round(_prev_total, 4) or n <> _prev_n").selectExpr(*_NET), "total", "prev_total")


@query("sink_repeated_delivery", f"{SQL_EVENTS} SELECT event_type, round(sum(value), 4) AS total, count(*) AS n FROM e WHERE b <= {_SQL_LAST} * 3 // 4 GROUP BY 1")
def sink_repeated_delivery(spark, sf_dir):
    """Every batch, that of a fork too, is delivered twice; the table of the sink is that of the view."""
    engine, sink = _engine(spark), SnapshotTable(spark, shared_folder(spark, "sink"), "v", ["event_type"], ["total", "n"])
    last = _last(spark, sf_dir)
    for first, end in ((1, last // 2), (last // 2 + 1, last)):
        batch = engine.ingest({"events": _blocks(spark, sf_dir, first, end)}, _chain(first, end))
        for _ in range(2):
            sink.apply(batch)
        engine.ack(batch.sequence)
    _, batch = engine.handle_fork(_chain(last * 3 // 4 - 2, last * 3 // 4))
    for _ in range(2):
        sink.apply(batch)
    engine.ack(batch.sequence)
    return rounded(sink.read(), "total")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
