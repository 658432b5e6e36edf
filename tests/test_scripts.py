"""Scripted reducers: the language, the values that cross its border, and scripts in a schema."""

import json
import math

import pytest
from pyspark.errors import PythonException

from rollview.ddl.model import Column
from rollview.errors import SchemaError
from rollview.functions import lua
from rollview.plans.dataflow import Dataflow
from rollview.plans.engine import Cursor, Engine


def run(source, **known):
    space = lua.new_globals()
    space.update(known)
    return lua.compile_chunk(source, space)()


@pytest.mark.parametrize(("source", "want"), [
    ("return 1 + 1, 7 // 2, 7 % -3, 7 / 2, 2 ^ 3, 'a' .. 1 .. 2.0", (2, 3, -2, 3.5, 8.0, "a12.0")),
    ("return math.maxinteger + 1 == math.mininteger, 1 / 0, -1 / 0, 10 // 0.0, -7 // 2", (True, math.inf, -math.inf, math.inf, -4)),
    ("return 2 ^ -1, -2 ^ 2, not nil == true, '10' + 5, 0x10, 1e2, 3 & 5, 1 << 4, ~0, 7 ~ 2", (0.5, -4.0, True, 15, 16, 100.0, 1, 16, -1, 5)),
    ("return 1 == 1.0, '1' == 1, true == 1, nil == false, 'a' < 'b'", (True, False, False, False, True)),
    ("local x = nil; return x and x.y or 'd', not x, 0 and 'zero is true', '' and 1", ("d", True, "zero is true", 1)),
    ("local t = {1, 2, nil, x = 4, [10] = 5}; return #t, t.x, t[2], t[10]", (2, 4, 2, 5)),
    ("local t = {} t[true] = 1 t[1] = 2 t[2.0] = 3 return t[true], t[1], t[2], #t", (1, 2, 3, 2)),
    ("local s = 0 for i = 1, 10 do if i % 2 == 0 then goto continue end s = s + i ::continue:: end return s", 25),
    ("local n = 0 for i = 3, 1, -1 do n = n * 10 + i end for x = 0, 1, 0.5 do n = n + x end return n", 322.5),
    ("local i = 0 repeat local j = i i = i + 1 until j >= 3 return i", 4),
    ("local n = 0 while true do n = n + 1 if n > 5 then break end end return n", 6),
    ("local function f(n) if n < 2 then return n end return f(n - 1) + f(n - 2) end return f(15)", 610),
    ("local c = 0; local function up() c = c + 1 return c end up() up() return c", 2),
    ("local function f(...) local a, b = ... return #{...}, a, b, select('#', ...) end return f(1, nil, 3)", (1, 1, None, 3)),
    ("local a, b = (function() return 1, 2 end)() a, b = b, a return a, b, (select(2, 'x', 'y', 'z'))", (2, 1, "y")),
    ("local a <const> = 3 do local a = 4 end return a", 3),
    ("local s = '' for k, v in pairs({5, 6, a = 1}) do s = s .. k .. v end for i, v in ipairs({7, nil, 8}) do s = s .. i .. v end return s", "1526a117"),
    ("local t = {3, 1, 2} table.sort(t, function(a, b) return a > b end) table.insert(t, 1, 9) local r = table.remove(t) return r, table.concat(t, ','), table.unpack({1, 2})", (1, "9,3,2", 1, 2)),
    ("local t = {k = 2, f = function(self, x) return self.k + x end} return t:f(3), ('hi'):upper(), ('hello'):sub(2, -2), #'\\u{e9}'", (5, "HI", "ell", 2)),
    ("return string.format('%5.2f|%d|%s|%x|%%', 3.14159, 42, 'hi', 255)", " 3.14|42|hi|ff|%"),
    ("return string.match('key = val', '^(%w+)%s*=%s*(%w+)$'), (string.gsub('a b c', '%s', '_'))", ("key", "a_b_c")),
    ("local s = 0 for w in string.gmatch('1 22 3', '%d+') do s = s + tonumber(w) end return s, string.find('a.b', '.', 1, true)", (26, 2, 2)),
    ("return pcall(function() error('x') end)", (False, "x")),
    ("return json.encode({1, 2.5, {a = true}}), json.encode({}), json.decode('{\"a\": [1, null, 2]}').a[3]", ('[1,2.5,{"a":true}]', "{}", 2)),
    ("return tostring(1e15), tostring(2 ^ 53), tostring(nil), tonumber('0x1f'), tonumber('ff', 16), tonumber('no')", ("1e+15", "9.007199254741e+15", "nil", 31, 255, None)),
    ("return os, io, debug, load, loadfile, dofile, rawget, rawset, require, package", (None,) * 10),
    ("--[[ long\ncomment ]] -- short\nreturn [==[a]]b]==], \"\\65\\x42\\n\"", ("a]]b", "AB\n")),
])
def test_language(source, want):
    found = run(source)
    assert found == want and [type(x) for x in lua.many(found)] == [type(x) for x in lua.many(want)]


@pytest.mark.parametrize("source", ["x = = 1", "local t = nil; return t.x", "return 1 < 'a'", "return {} + 1", "return ('x')()", "error({code = 1})", "return 1 // 0", "return json.decode('{')", "goto nowhere", "return ..."])
def test_failures(source):
    if source == "return ...":
        assert run(source) == ()
        return
    with pytest.raises(lua.LuaError):
        run(source)


#: A water works: pumps fill a tank, taps drain it; what a pump brings beyond the brim is spilled.
TANKS = """CREATE TABLE flows (tank String, what String, litres Float64, at DateTime, n UInt64);
CREATE MODULE rules LANGUAGE LUA AS $$
  local M = {}
  function M.level(held, litres, brim) return math.min(brim, math.max(0, held + litres)) end
  return M
$$;
CREATE REDUCER tank SOURCE flows GROUP BY tank STATE (held Float64 DEFAULT 0, seen UInt64 DEFAULT 0, taps JSON DEFAULT '{}') REQUIRE rules LANGUAGE lua PROCESS $$
  if row.litres == nil then return end
  state.seen = state.seen + 1
  local before = state.held
  if row.what == "pump" then
    state.held = rules.level(before, row.litres, 100)
    emit({spilled = math.max(0, before + row.litres - 100), held = state.held, at = row.at, tap = "none"})
  else
    local used = state.taps[row.what]
    if not used then used = {litres = 0, times = 0} end
    used.litres = used.litres + row.litres
    used.times = used.times + 1
    state.taps[row.what] = used
    state.held = rules.level(before, -row.litres, 100)
    for name, u in pairs(state.taps) do
      emit {spilled = 0.0, held = state.held, at = row.at, tap = name .. ":" .. u.times}
    end
  end
$$;
CREATE MATERIALIZED VIEW v AS SELECT tank, sum(spilled) AS spilled, last(held) AS held, last(tap) AS tap, last(at) AS at, count() AS n FROM tank GROUP BY tank;"""


def flow(block, what, litres, tank="a"):
    return {"block_number": block, "tank": tank, "what": what, "litres": litres, "at": 1000 * block, "n": 1}


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_scripts_over_batches_and_forks(spark, tmp_path):
    e = Engine.open(spark, TANKS, str(tmp_path))
    b = e.ingest({"flows": [flow(1, "pump", 80.0), flow(1, "sink", 30.0), flow(2, "pump", 70.0), flow(2, None, None)]}, [Cursor(1, "h1"), Cursor(2, "h2")])
    assert rows(b.tables["v"]) == [("insert", "a", 20.0, 100.0, "none", 2000, 3, None, None, None, None, None)]
    e.ack(b.sequence)
    b = e.ingest({"flows": [flow(3, "bath", 40.0), flow(3, "pump", 1.0, "b")]}, [Cursor(3, "h3")])
    e.ack(b.sequence)
    assert rows(e.view("v")) == [("a", 20.0, 60.0, "bath:1", 3000, 5), ("b", 0.0, 1.0, "none", 3000, 1)]
    _, undo = e.handle_fork([Cursor(2, "h2")])
    e.ack(undo.sequence)
    b = e.ingest({"flows": [flow(3, "sink", 99.0)]}, [Cursor(3, "x3")])  # the state is that after block 2
    e.ack(b.sequence)
    assert rows(e.view("v")) == [("a", 20.0, 1.0, "sink:2", 3000, 4)]


def test_emitted_columns_and_reads(spark):
    flow_ = Dataflow(TANKS, {"flows": spark.createDataFrame([], "block_number long, _row_index long, tank string, what string, litres double, at long, n long")})
    plan = flow_.reducers["tank"]
    assert {c.name: c.type for c in plan.emits} == {"spilled": "Float64", "held": "Float64", "at": "DateTime", "tap": "String"}
    assert plan.process.reads == {"litres", "what", "at"} and flow_.source("tank").count() == 0
    unknown = "CREATE TABLE t (k String, x Float64); CREATE REDUCER r SOURCE t GROUP BY k LANGUAGE lua PROCESS $$ emit({y = helper(row.x)}) $$;"
    frame = spark.createDataFrame([(1, 0, "a", 2.0)], "block_number long, _row_index long, k string, x double")
    with pytest.raises(SchemaError, match="cannot be told"):
        Dataflow(unknown, {"t": frame})
    with pytest.raises(PythonException, match="attempt to call a nil value"):
        Dataflow(unknown, {"t": frame}, {"r": (None, (Column("y", "Float64"),))}).source("r").collect()


def test_values(spark):
    ddl = """CREATE TABLE t (k String, u UInt64, f Float64, b Boolean, raw Bytes, doc JSON);
    CREATE REDUCER r SOURCE t GROUP BY k STATE (keep JSON DEFAULT '[]', n UInt64 DEFAULT 0) LANGUAGE lua PROCESS $$
      state.n = state.n + 1
      state.leak = (state.leak or 0) + 1
      if row.u == 3 then emit({}) return end
      table.insert(state.keep, row.u)
      emit({u = row.u, half = row.u / 2, whole = row.u // 2, f = row.f, b = row.b, kind = math.type(row.u), size = #row.raw, first = tostring(row.doc.list[1]), text = json.encode(state.keep), tbl = row.k, leak = state.leak + 0, none = nil, big = 9007199254740993})
    $$;"""
    big = (1 << 62) + 1
    data = [(1, i, "k", u, 0.5, True, b"\xff\x00", '{"list": [7]}') for i, u in enumerate([2, 3, big])]
    df = spark.createDataFrame(data, "block_number long, _row_index long, k string, u long, f double, b boolean, raw binary, doc string")
    d = Dataflow(ddl, {"t": df}, {"r": (None, tuple(Column(n, t) for n, t in (("u", "Int64"), ("half", "Float64"), ("whole", "Int64"), ("f", "Float64"), ("b", "Boolean"), ("kind", "String"), ("size", "Int64"), ("first", "String"), ("text", "String"), ("tbl", "String"), ("leak", "Int64"), ("big", "Int64"))))})
    found = rows(d.source("r").select("u", "half", "whole", "f", "b", "kind", "size", "first", "text", "tbl", "leak", "big"))
    assert found == [(2, 1.0, 1, 0.5, True, "integer", 2, "7", "[2]", "k", 1, 9007199254740993), (big, big / 2, big // 2, 0.5, True, "integer", 2, "7", f"[2,{big}]", "k", 3, 9007199254740993)]
    assert json.loads(d.snapshots("r").collect()[0]._state) == {"keep": [2, big], "n": 3}
