"""The engine's protocol, on hand-computed cases."""

import pytest

from rollview.ddl.model import Column, Native, Reducer, StateField
from rollview.errors import InvalidOperation, PendingAck, Poisoned, RollbackError, SchemaError, WrongAckSequence
from rollview.ddl.parser import parse
from rollview.operators.reducers import ReducerPlan
from rollview.plans.dataflow import Dataflow
from rollview.plans.engine import Cursor, Engine
from rollview.plans.pipeline import Pipeline, agg, interval, parse_duration
from rollview.sources.msgpack import pack, unpack
from rollview.sources.rows import msgpack_tables, to_msgpack_records
from rollview.sources.sinks import SnapshotTable
from rollview.streaming.adapters import Fork, follow

PARCELS = """CREATE TABLE parcels (depot String, weight Float64);
CREATE MATERIALIZED VIEW v AS SELECT depot, sum(weight) AS total, count() AS n FROM parcels GROUP BY depot;"""
METERS = """CREATE TABLE readings (meter String, kind String, kwh Float64, tariff Float64);
CREATE REDUCER bill SOURCE readings GROUP BY meter STATE (credit Float64 DEFAULT 5, peak Float64 DEFAULT 0)
  WHEN row.kind = 'feed' THEN LET worth = row.kwh * row.tariff / 2 SET state.credit = state.credit + worth EMIT paid = 0
  WHEN row.kind = 'draw' THEN LET price = row.kwh * row.tariff LET left = state.credit - price
    SET state.peak = IF(row.kwh > state.peak, row.kwh, state.peak) SET state.credit = IF(left < 0, 0, left) EMIT paid = IF(left < 0, 0 - left, 0)
  ALWAYS EMIT state.peak AS highest, credit = state.credit
END;
CREATE MATERIALIZED VIEW s AS SELECT meter, sum(paid) AS paid, last(highest) AS highest, last(credit) AS credit, count() AS n FROM bill GROUP BY meter;"""


def chain(*numbers, tag="h"):
    return [Cursor(n, f"{tag}{n}") for n in numbers]


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_protocol(spark, tmp_path):
    e = Engine.open(spark, PARCELS, str(tmp_path))
    batch = e.ingest({"parcels": [{"block_number": k, "depot": "east", "weight": 10.0 * k} for k in range(1, 6)]}, chain(*range(1, 6)), Cursor(1, "h1"))
    assert rows(batch.tables["v"]) == [("insert", "east", 150.0, 5, None, None)]
    with pytest.raises(PendingAck):
        e.ingest({})
    with pytest.raises(WrongAckSequence):
        e.ack(batch.sequence + 1)
    again = Engine.open(spark, PARCELS, str(tmp_path))  # a crash before the acknowledgement: nothing was taken in
    assert again.latest_block == 0 and again.view("v") is None
    e.ack(batch.sequence)
    e.ack(batch.sequence)
    cursor, undo = e.handle_fork([Cursor(5, "x5"), Cursor(3, "x3"), Cursor(2, "h2")])
    assert cursor == Cursor(2, "h2")
    assert rows(undo.tables["v"]) == [("update", "east", 30.0, 2, 150.0, 5)]
    assert len(rows(undo.tables["parcels"])) == 3
    e.ack(undo.sequence)
    with pytest.raises(InvalidOperation):
        e.ingest({"parcels": [{"block_number": 2, "depot": "east", "weight": 1.0}]})
    with pytest.raises(RollbackError):
        e.handle_fork([Cursor(2, "nobody")])
    reopened = Engine.open(spark, PARCELS, str(tmp_path))
    assert reopened.latest_cursor == Cursor(2, "h2")
    assert rows(reopened.view("v")) == [("east", 30.0, 2)]
    assert reopened.ingest({}, chain(3), Cursor(2, "h2")) is None and reopened.finalized_block == 2


def test_inline_fork(spark, tmp_path):
    e = Engine.open(spark, PARCELS, str(tmp_path))
    b = e.ingest({"parcels": [{"block_number": k, "depot": "a", "weight": 1.0} for k in (1, 2, 3)]}, chain(1, 2, 3))
    e.ack(b.sequence)
    b = e.ingest({"parcels": [{"block_number": 3, "depot": "b", "weight": 5.0}]}, [Cursor(3, "x3"), Cursor(2, "h2")])
    assert rows(b.tables["v"]) == [("insert", "b", 5.0, 1, None, None), ("update", "a", 2.0, 2, 3.0, 3)]


def test_reducer_state_over_batches_and_forks(spark, tmp_path):
    e = Engine.open(spark, METERS, str(tmp_path))
    read = lambda b, kind, kwh, tariff=0.5: {"block_number": b, "meter": "m1", "kind": kind, "kwh": kwh, "tariff": tariff}
    b = e.ingest({"readings": [read(1, "draw", 6.0), read(1, "feed", 8.0)]}, chain(1))  # credit 5 - 3 + 2
    assert rows(b.tables["s"]) == [("insert", "m1", 0.0, 6.0, 4.0, 2, None, None, None, None)]
    e.ack(b.sequence)
    b = e.ingest({"readings": [read(2, "draw", 20.0)]}, chain(2))  # 10 due, 4 of it by credit
    assert rows(b.tables["s"]) == [("update", "m1", 6.0, 20.0, 0.0, 3, 0.0, 6.0, 4.0, 2)]
    e.ack(b.sequence)
    _, undo = e.handle_fork([Cursor(1, "h1")])
    e.ack(undo.sequence)
    b = e.ingest({"readings": [read(2, "draw", 4.0, 0.25)]}, chain(2, tag="y"))  # the credit is 4 again
    assert rows(b.tables["s"]) == [("update", "m1", 0.0, 6.0, 3.0, 3, 0.0, 6.0, 4.0, 2)]


def test_replay_and_batch_callbacks(spark, tmp_path):
    ddl = """CREATE TABLE t (k String, x Float64); CREATE REDUCER r SOURCE t GROUP BY k STATE (s Float64 DEFAULT 0) LANGUAGE EXTERNAL;
    CREATE REDUCER twice SOURCE r GROUP BY k WHEN row.run > 0 THEN EMIT y = row.run * 2 END;
    CREATE MATERIALIZED VIEW v AS SELECT k, last(run) AS run, count() AS n FROM r GROUP BY k; CREATE MATERIALIZED VIEW w AS SELECT k, sum(y) AS y FROM twice GROUP BY k;"""
    e, calls = Engine.open(spark, ddl, str(tmp_path / "a")), []

    def by_block(groups):
        (group,) = groups
        total, out = group["state"]["s"], []
        for row in group["rows"]:
            total += row["x"]
            out.append({"run": total})
        return [{"state": {"s": total}, "emits": out if len(out) > 1 else [*out, {"run": 0.0}]}]

    e.register_batch_callback("r", by_block, [Column("run", "Float64")])
    b = e.ingest({"t": [{"block_number": 1, "k": "a", "x": 1.5}, {"block_number": 1, "k": "a", "x": 2.0}, {"block_number": 1, "k": "b", "x": 1.0}]}, chain(1))
    e.ack(b.sequence)
    assert rows(e.view("v")) == [("a", 3.5, 2), ("b", 0.0, 2)] and rows(e.view("w")) == [("a", 10.0), ("b", 2.0)]
    e.ack(e.ingest({"t": [{"block_number": 2, "k": "a", "x": 1.0}, {"block_number": 2, "k": "a", "x": 1.0}]}, chain(2)).sequence)
    assert rows(e.view("v")) == [("a", 5.5, 4), ("b", 0.0, 2)]
    again = Engine.open(spark, ddl, str(tmp_path / "a"))  # the same schema with other code for the reducer

    def plus_one(state, row):
        state["s"] += row["x"] + 1
        return [{"run": state["s"]}]

    again.register_callback("r", plus_one, [Column("run", "Float64")])
    b = again.replay("r")
    assert rows(b.tables["v"]) == [("update", "a", 9.5, 4, 5.5, 4), ("update", "b", 2.0, 1, 0.0, 2)]
    assert rows(b.tables["w"]) == [("update", "a", 2 * (2.5 + 5.5 + 7.5 + 9.5), 2 * (1.5 + 3.5 + 4.5 + 5.5)), ("update", "b", 4.0, 2.0)]
    again.ack(b.sequence)
    b = again.ingest({"t": [{"block_number": 3, "k": "a", "x": 1.0}]}, chain(3))  # goes on from the replayed state
    assert rows(b.tables["v"]) == [("update", "a", 11.5, 5, 9.5, 4)]
    again.ack(b.sequence)
    late = Reducer("late", "t", ("k",), (StateField("n", "Int64", "0"),), Native(lambda state, row, ctx: (state.update(n=state["n"] + 1), ctx.emit({"n": state["n"]})), (Column("n", "Int64"),)))
    assert again.register_reducer(late) is None and again.has_reducer("late")
    assert rows(again._read(again.manifest, "emits/late", "block_number").select("block_number", "k", "n")) == [(1, "a", 1), (1, "a", 2), (1, "b", 1), (2, "a", 3), (2, "a", 4), (3, "a", 5)]


def test_follow_forks_and_failed_delivery(spark, tmp_path):
    e, told = Engine.open(spark, PARCELS, str(tmp_path), max_buffer=2), []
    parcel = lambda b, weight: {"parcels": [{"block_number": b, "depot": "p", "weight": weight}]}
    script = [(parcel(1, 1.0), chain(1), Cursor(1, "h1")), (parcel(2, 2.0), chain(2), Cursor(1, "h1")), Fork([Cursor(2, "x2"), Cursor(1, "h1")]), (parcel(2, 5.0), [Cursor(2, "x2")], Cursor(1, "h1"))]
    asked = []

    def read(cursor):
        asked.append(cursor)
        while script:
            step = script.pop(0)
            if isinstance(step, Fork):
                raise step
            yield step

    def deliver(batch):
        told.append(rows(batch.tables["v"]))
        if len(told) == 2:
            raise ConnectionError("the consumer is away")

    with pytest.raises(ConnectionError):
        follow(e, read, deliver)
    assert e.is_awaiting_ack and not e.is_backpressured()
    follow(e, read, deliver)
    assert told == [[("insert", "p", 1.0, 1, None, None)], *[[("update", "p", 3.0, 2, 1.0, 1)]] * 2, [("update", "p", 1.0, 1, 3.0, 2)], [("update", "p", 6.0, 2, 1.0, 1)]]
    assert asked == [None, Cursor(2, "h2"), Cursor(1, "h1")] and not e.is_awaiting_ack
    with pytest.raises(InvalidOperation):
        follow(e, lambda cursor: [(parcel(3, 1.0), chain(3), None)], deliver)


def test_msgpack(spark):
    values = [None, True, False, 0, 127, 128, 65536, 1 << 63, (1 << 64) - 1, -1, -32, -33, -129, -(1 << 31) - 1, -(1 << 63), 1.5, "", "é" * 40, "x" * 70000, b"\x00\xff", bytes(300), [1, [2, {"a": None}]], {"k": list(range(20)), **{f"f{i}": i for i in range(20)}}]
    for v in values:
        assert unpack(pack(v)) == v and type(unpack(pack(v))) is type(v)
    assert pack({"a": [1, -1, "x"]}) == b"\x81\xa1a\x93\x01\xff\xa1x" and unpack(pack(1 << 200)) == (1 << 200).to_bytes(32, "big") and unpack(b"\xca\x3f\x80\x00\x00") == 1.0
    for bad in (b"", b"\xc1", b"\xa5ab", b"\x92\x01", b"\x01\x02"):
        with pytest.raises(InvalidOperation):
            unpack(bad)
    tables = parse("CREATE TABLE t (k String, n UInt64, w UInt256, raw Bytes, ok Boolean)").tables
    data = pack({"t": [{"block_number": 1, "k": "a", "n": 7, "w": 1 << 200, "raw": b"\x01", "ok": True, "other": 1}, {"block_number": 1, "k": None}]})
    got = msgpack_tables(spark, tables, data)["t"]
    assert rows(got.selectExpr("block_number", "_row_index", "k", "n", "hex(w) as w", "hex(raw) as raw", "ok")) == [(1, 0, "a", 7, f"{1 << 200:064X}", "01", True), (1, 1, None, None, None, None, None)]
    log = spark.createDataFrame([("insert", "a", 1.0, None), ("update", "b", 2.0, 1.0)], "_op string, k string, s double, _prev_s double")
    found = [unpack(bytes(r.value)) for r in to_msgpack_records(log, "v", ["k"], ["s"]).collect()]
    assert found == [{"table": "v", "operation": "insert", "key": {"k": "a"}, "values": {"k": "a", "s": 1.0}, "prevValues": None}, {"table": "v", "operation": "update", "key": {"k": "b"}, "values": {"k": "b", "s": 2.0}, "prevValues": {"s": 1.0}}]


def test_expired_blocks_stay_expired_after_a_fork(spark, tmp_path):
    ddl = "CREATE TABLE t (k String, at DateTime, x Float64); CREATE MATERIALIZED VIEW v AS SELECT k, sum(x) AS s FROM t GROUP BY k WINDOW SLIDING INTERVAL 10 SECONDS BY at"
    e = Engine.open(spark, ddl, str(tmp_path))
    tick = lambda b, at, x: {"block_number": b, "k": "a", "at": at, "x": x}
    e.ack(e.ingest({"t": [tick(1, 0, 1.0), tick(2, 8000, 2.0)]}, chain(1, 2)).sequence)
    e.ack(e.ingest({"t": [tick(3, 15_000, 4.0)]}, chain(3)).sequence)  # block 1 expires
    assert rows(e.view("v")) == [("a", 6.0)]
    _, undo = e.handle_fork(chain(1, 2))
    assert rows(undo.tables["v"]) == [("update", "a", 2.0, 6.0)]  # block 1 does not come back
    e.ack(undo.sequence)
    again = Engine.open(spark, ddl, str(tmp_path))
    b = again.ingest({"t": [tick(3, 1000, 8.0)]}, chain(3, tag="x"))  # the watermark is 8000 again, so this block counts
    assert rows(b.tables["v"]) == [("update", "a", 10.0, 2.0)]


def test_failed_ingest_and_merged_segments(spark, tmp_path):
    ddl = PARCELS + "CREATE REDUCER r SOURCE parcels GROUP BY depot STATE (n Int64 DEFAULT 0) LANGUAGE lua PROCESS $$ if row.weight < 0 then error('negative') end state.n = state.n + 1 emit({n = state.n}) $$;"
    e = Engine.open(spark, ddl, str(tmp_path), compact_after=2)
    parcel = lambda b, weight: {"parcels": [{"block_number": b, "depot": "p", "weight": weight}]}
    for b in range(1, 8):
        if b == 3:
            with pytest.raises(Exception, match="negative"):
                e.ingest(parcel(3, -1.0), chain(3))
            assert e.latest_block == 2 and not e.is_awaiting_ack and rows(e.view("v")) == [("p", 3.0, 2)]
        e.ack(e.ingest(parcel(b, float(b)), chain(b)).sequence)
    assert len(e.manifest.segments["raw/parcels"]) < 5 and len(e.manifest.segments["emits/r"]) < 5
    assert [r.block_number for r in e.raw("parcels").orderBy("block_number").collect()] == list(range(1, 8))
    _, undo = e.handle_fork(chain(2))
    e.ack(undo.sequence)
    assert rows(e.raw("parcels").select("block_number")) == [(1,), (2,)] and rows(e.view("v")) == [("p", 3.0, 2)]
    e.ack(e.ingest(parcel(3, 5.0), chain(3, tag="x")).sequence)
    held = e._read(e.manifest, "emits/r", "block_number")
    assert rows(held.select("block_number", "n")) == [(1, 1), (2, 2), (3, 3)]


def test_small_print_of_schemas():
    ddl = """-- a table
    CREATE TABLE t (k String, x Float64); CREATE REDUCER r SOURCE t GROUP BY k -- by key
      STATE (a String DEFAULT 'it''s', b UInt64 DEFAULT x1, c Boolean DEFAULT true, d Boolean DEFAULT 0, e Float64 DEFAULT -1.5, f UInt256 DEFAULT 7, g JSON DEFAULT '[1]')
      WHEN row.x > 0 THEN EMIT y = 'a''b' -- quoted
    END;"""
    (r,) = parse(ddl).reducers.values()
    plan = ReducerPlan(r, {"k": "String", "x": "Float64"})
    assert plan.defaults() == {"a": "it's", "b": 0, "c": True, "d": False, "e": -1.5, "f": bytes(32), "g": [1]}
    assert r.body.whens[0].actions[0].items[0][1].value == "a'b"


def test_heads_without_rows(spark, tmp_path):
    """Finality only grows and may run ahead; heads alone change no view, not a rolling one either."""
    ddl = "CREATE TABLE t (k String, at DateTime, x Float64); CREATE MATERIALIZED VIEW v AS SELECT k, sum(x) AS s FROM t GROUP BY k WINDOW SLIDING INTERVAL 1 SECOND BY at"
    e = Engine.open(spark, ddl, str(tmp_path), compact_after=1)
    for b in (1, 2, 3):
        e.ack(e.ingest({"t": [{"block_number": b, "k": "a", "at": 100 * b, "x": 1.0}]}, chain(b)).sequence)
    assert e.ingest({}, (), Cursor(9, "h9")) is None and e.finalized_cursor == Cursor(9, "h9") and e.latest_block == 3
    with pytest.raises(InvalidOperation):
        e.ingest({}, (), Cursor(8, "h8"))
    assert rows(e.view("v")) == [("a", 3.0)]
    parts = e._read(e.manifest, "partials/v", "_block")
    assert rows(parts.select("_block")) == [(1,), (2,), (3,)]  # each block may still expire by itself


def test_poisoned_after_a_failed_commit(spark, tmp_path, monkeypatch):
    e = Engine.open(spark, PARCELS, str(tmp_path))
    monkeypatch.setattr(e.store, "write_manifest", lambda manifest: (_ for _ in ()).throw(OSError("full")))
    with pytest.raises(OSError):
        e.ingest({}, chain(1), Cursor(0, None))
    assert e.is_poisoned
    with pytest.raises(Poisoned):
        e.ingest({})


def test_split_batches_equal_one(spark, tmp_path):
    data = [{"block_number": k // 3 + 1, "depot": "ab"[k % 2], "weight": float(k)} for k in range(30)]
    one, many = Engine.open(spark, PARCELS, str(tmp_path / "one")), Engine.open(spark, PARCELS, str(tmp_path / "many"), compact_after=2)
    sink = SnapshotTable(spark, str(tmp_path / "sink"), "v", ["depot"], ["total", "n"])
    b = one.ingest({"parcels": data})
    one.ack(b.sequence)
    for k in (1, 4, 7, 10):
        b = many.ingest({"parcels": [r for r in data if k <= r["block_number"] < k + 3]}, finalized_head=Cursor(max(0, k - 1), None))
        assert sink.apply(b) and not sink.apply(b)
        many.ack(b.sequence)
    assert rows(one.view("v")) == rows(many.view("v")) == rows(sink.read())


def test_external_reducer_and_builder(spark, tmp_path):
    ddl = "CREATE TABLE t (k String, x Float64); CREATE REDUCER r SOURCE t GROUP BY k STATE (s Float64 DEFAULT 0) LANGUAGE EXTERNAL; CREATE MATERIALIZED VIEW v AS SELECT k, last(run) AS run FROM r GROUP BY k;"
    e = Engine.open(spark, ddl, str(tmp_path / "a"))
    with pytest.raises(InvalidOperation):
        e.register_callback("nobody", lambda s, r: [], [])

    def run(state, row):
        state["s"] += row["x"]
        return [{"run": state["s"]}]

    e.register_callback("r", run, [Column("run", "Float64")])
    b = e.ingest({"t": [{"block_number": 1, "k": "a", "x": 1.5}, {"block_number": 1, "k": "a", "x": 2.0}]})
    assert rows(b.tables["v"]) == [("insert", "a", 3.5, None)]
    p = Pipeline()
    t = p.table("t", {"k": "String", "x": "Float64", "at": "DateTime"})

    def twice(state, row, ctx):
        state["n"] += 1
        ctx.emit({"y": 2 * row["x"], "n": state["n"], "at": row["at"]})

    r = t.create_reducer("r", group_by="k", initial={"n": 0}, reduce=twice, emits={"y": "Float64", "n": "Int64", "at": "DateTime"})
    r.create_view("v", select=lambda a: {"k": a.key("k"), "w": interval("at", "5 minutes"), "total": a.sum("y"), "n": a.last("n")})
    assert "toStartOfInterval(at, INTERVAL 5 MINUTE)" in p.to_ddl() and parse(p.to_ddl())
    e = p.build(spark, str(tmp_path / "b"))
    b = e.ingest({"t": [{"block_number": 1, "k": "a", "x": 1.0, "at": 10}, {"block_number": 1, "k": "a", "x": 2.0, "at": 300_000}]})
    assert rows(b.tables["v"]) == [("insert", "a", 0, 2.0, 1, None, None), ("insert", "a", 300000, 4.0, 2, None, None)]


def test_durations():
    assert parse_duration("5 minutes") == 300_000 and parse_duration("1h") == 3_600_000 and parse_duration("2 days") == 172_800_000
    assert agg.sum("x").item().name == "sum_x"


@pytest.mark.parametrize("ddl", [
    "CREATE TABLE t (a Int64); CREATE MATERIALIZED VIEW v AS SELECT a, count() FROM t WHERE a > 1 GROUP BY a",
    "CREATE TABLE t (a Int64); CREATE MATERIALIZED VIEW v AS SELECT * FROM t",
    "CREATE TABLE t (a Int64); CREATE MATERIALIZED VIEW v AS SELECT sum(b) FROM t",
    "CREATE TABLE t (a String); CREATE MATERIALIZED VIEW v AS SELECT min(a) FROM t",
    "CREATE TABLE t (a Int64); CREATE MATERIALIZED VIEW v AS SELECT a, count() AS n FROM t",
    "CREATE TABLE t (a Int64); CREATE REDUCER r SOURCE r GROUP BY a WHEN 1 = 1 THEN EMIT x = 1 END",
    "CREATE TABLE t (a String); CREATE MATERIALIZED VIEW v AS SELECT count() AS n FROM t WINDOW SLIDING INTERVAL 1 HOUR BY a",
    "CREATE TABLE t (a Wrong)",
])
def test_rejected(ddl):
    with pytest.raises(SchemaError):
        parse(ddl)


def test_sliding_boundaries(spark):
    """Windows of 10 s: a block at the boundary stays; late blocks expire by their own time; keys without rows expire too."""
    ddl = "CREATE TABLE t (k String, at DateTime, x Float64); CREATE MATERIALIZED VIEW v AS SELECT k, sum(x) AS s FROM t GROUP BY k WINDOW SLIDING INTERVAL 10 SECONDS BY at"
    make = lambda data: Dataflow(ddl, {"t": spark.createDataFrame([(b, 0, k, t, x) for b, (k, t, x) in enumerate(data, 1)], "block_number long, _row_index long, k string, at long, x double")})
    assert rows(make([("a", 0, 10.0), ("a", 10_000, 20.0)]).state("v")) == [("a", 30.0)]
    assert rows(make([("a", 5000, 10.0), ("a", 2000, 20.0), ("a", 13_000, 30.0)]).state("v")) == [("a", 40.0)]
    log = make([("a", 0, 1.0), ("b", 10_001, 2.0)]).changelog("v")
    assert rows(log.select("_block", "_op", "k", "s")) == [(1, "insert", "a", 1.0), (2, "delete", "a", 1.0), (2, "insert", "b", 2.0)]
