"""Continuous mode, sources and sinks."""

import json

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from rollview.plans.dataflow import Dataflow
from rollview.plans.engine import Engine
from rollview.ddl.parser import parse
from rollview.sources.rows import block_scan, file_rows, host_rows, json_rows, to_json_records
from rollview.sources.sinks import SnapshotTable
from rollview.streaming.adapters import run_blocks, stream_reducer

DDL = "CREATE TABLE t (k String, x Float64); CREATE MATERIALIZED VIEW v AS SELECT k, sum(x) AS s, count() AS n FROM t GROUP BY k;"
SCHEMA = "block_number long, _row_index long, k string, x double"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def write_blocks(spark, path, blocks):
    data = [(b, i, "ab"[i % 2], float(b + i)) for b in blocks for i in range(4)]
    spark.createDataFrame(data, SCHEMA).coalesce(1).write.mode("append").parquet(str(path))


def test_stream_of_blocks_is_exactly_once(spark, tmp_path):
    source, sink = tmp_path / "in", SnapshotTable(spark, str(tmp_path / "sink"), "v", ["k"], ["s", "n"])
    for blocks in (range(1, 4), range(4, 6)):
        write_blocks(spark, source, blocks)
        engine = Engine.open(spark, DDL, str(tmp_path / "engine"))  # opened anew: what is committed is on disk
        stream = spark.readStream.schema(SCHEMA).parquet(str(source))
        run_blocks(engine, stream, "t", sink.apply, str(tmp_path / "checkpoint")).awaitTermination()
    whole = Dataflow(DDL, {"t": spark.read.parquet(str(source))}).state("v")
    assert rows(engine.view("v")) == rows(sink.read()) == rows(whole)
    again = run_blocks(engine, spark.readStream.schema(SCHEMA).parquet(str(source)), "t", sink.apply, str(tmp_path / "lost checkpoint"))
    again.awaitTermination()  # all files come again: known blocks are passed over
    assert rows(engine.view("v")) == rows(whole)


@pytest.mark.parametrize("late", [[(3, 4, "a", 1.0)], [(2, i, "ab"[i % 2], 9.0) for i in range(4)], [(2, 0, "a", 2.0)]])
def test_stream_rejects_old_blocks_that_are_no_replay(spark, tmp_path, late):
    """The rest of a split block, a replacement, and a part of a known block."""
    source, sink = tmp_path / "in", SnapshotTable(spark, str(tmp_path / "sink"), "v", ["k"], ["s", "n"])
    write_blocks(spark, source, range(1, 4))
    engine = Engine.open(spark, DDL, str(tmp_path / "engine"))
    start = lambda: run_blocks(engine, spark.readStream.schema(SCHEMA).parquet(str(source)), "t", sink.apply, str(tmp_path / "checkpoint"))
    start().awaitTermination()
    before = rows(engine.view("v"))
    spark.createDataFrame(late, SCHEMA).coalesce(1).write.mode("append").parquet(str(source))
    with pytest.raises(StreamingQueryException, match="ingested already"):
        start().awaitTermination()
    assert rows(engine.view("v")) == before


@pytest.mark.parametrize("body", [
    "STATE (s Float64 DEFAULT 0) WHEN row.x > 0 THEN SET state.s = state.s + row.x EMIT run = state.s END;",
    "STATE (held JSON DEFAULT '[]') LANGUAGE lua PROCESS $$ table.insert(state.held, row.x) local s = 0.0 for _, x in ipairs(state.held) do s = s + x end emit({run = s}) $$;",
])
def test_stream_reducer(spark, tmp_path, body):
    ddl = DDL + "CREATE REDUCER r SOURCE t GROUP BY k " + body
    source = tmp_path / "in"
    write_blocks(spark, source, range(1, 6))
    flow = Dataflow(ddl, {"t": spark.read.parquet(str(source))})
    stream = spark.readStream.schema(SCHEMA).parquet(str(source)).withColumn("_emit_index", F.lit(0).cast("long"))
    out = stream_reducer(flow.reducers["r"], stream).writeStream.format("memory").queryName("emitted" + str(len(body))).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    out.awaitTermination()
    same = flow.source("r").select("run", "k", "block_number", "_row_index")
    assert rows(spark.table("emitted" + str(len(body))).select("run", "k", "block_number", "_row_index")) == rows(same)


def test_sources(spark, tmp_path):
    schema = parse("CREATE TABLE t (k String, x Float64, big UInt256, at DateTime, j Json);")
    table = schema.tables["t"]
    data = [{"block_number": 2, "k": "a", "x": "1.5", "big": 7, "at": 5, "j": {"q": [1]}, "unknown": 1}, {"block_number": 2, "k": None, "x": "no"}]
    got = host_rows(spark, table, data)
    assert [(r.block_number, r._row_index, r.k, r.x, r.at, r.j) for r in got.orderBy("_row_index").collect()] == [(2, 0, "a", 1.5, 5, '{"q": [1]}'), (2, 1, None, None, None, None)]
    assert int(got.where("k = 'a'").first().big.hex(), 16) == 7
    lines = spark.createDataFrame([(json.dumps(d | {"_row_index": i, "x": 1.5}),) for i, d in enumerate(data)], "value string")
    assert json_rows(spark, table, lines).where("k = 'a'").select("block_number", "_row_index", "k", "x").collect()[0] == (2, 0, "a", 1.5)
    lines.coalesce(1).selectExpr("2L as block_number", "'z' as k", "value").write.parquet(str(tmp_path / "p"))
    from_files = file_rows(spark, table, str(tmp_path / "p"), order_by=["value"])
    assert rows(from_files.select("_row_index", "k")) == [(0, "z"), (1, "z")]
    assert block_scan(from_files, 3, 9).count() == 0


def test_scan_is_pruned_and_pushed_down(spark, tmp_path):
    write_blocks(spark, tmp_path / "p", range(1, 9))
    flow = Dataflow(DDL.replace("sum(x) AS s, ", ""), {"t": spark.read.parquet(str(tmp_path / "p"))})
    plan = flow.state("v", upto=4)._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(block_number,4)" in plan and "x#" not in plan.split("ReadSchema")[1]


def test_json_records(spark):
    flow = Dataflow(DDL, {"t": spark.createDataFrame([(1, 0, "a", 2.0), (2, 0, "a", 3.0)], SCHEMA)})
    records = [json.loads(r.value) for r in to_json_records(flow.changelog("v"), "v", ["k"], ["s", "n"]).collect()]
    assert {"table": "v", "operation": "update", "key": {"k": "a"}, "values": {"k": "a", "s": 5.0, "n": 2}, "prevValues": {"s": 2.0, "n": 1}} in records
