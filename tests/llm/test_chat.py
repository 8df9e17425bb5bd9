import json

import duckdb
from pyspark.sql import functions as F

from clicklake.llm import chat

CALLS = "conv_id long, call_id string, seq long, name string, arguments string, needs array<string>, _conv int, position string"
RESULTS = "conv_id long, call_id string, seq long, content string, _result int"
TOOLS = {
    "add": {"properties": {"a": {"type": "integer", "minimum": 1, "maximum": 9}, "b": {"type": "number"}}, "required": ["a"]},
    "say": {"properties": {"how": {"type": "string", "enum": ["loud", "soft"]}, "to": {"type": "array"}, "more": {"type": "object"}, "ok": {"type": "boolean"}}},
}


def link(spark, calls, results=()):
    made = [(c, i, s, n, a, needs, 1, "x") for c, i, s, n, a, needs in calls]
    rows = chat.linked(
        spark.createDataFrame(made, CALLS), spark.createDataFrame([(*r, 1) for r in results], RESULTS), TOOLS
    ).collect()
    return {(r["conv_id"], r["call_id"]): r for r in rows}, rows


def test_sql(spark, sf_dir):
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW conversations AS SELECT * FROM '{sf_dir}/conversations.parquet'")
    cursor = connection.execute(chat.OP1_SQL)
    names = [c[0] for c in cursor.description]
    frame = chat.op1_chat(spark, sf_dir)
    rows = frame.select(*names).collect()
    assert sorted(map(repr, map(tuple, rows))) == sorted(map(repr, cursor.fetchall()))
    assert {r["status"] for r in rows} == {"ok", "invalid", "orphan", "unanswered"}


def test_arguments(spark):
    cases = {
        '{"b":1.5,"a":3}': "",
        '{"a":0}': "range:a",
        '{"a":"3","c":1,"B":2}': "type:a,unexpected:B,unexpected:c",
        '{"b":null}': "missing:a,type:b",
        "[1]": "not_an_object",
        '{"a":1': "invalid_json",
        '{"a":1,"a":2}': "invalid_json",
        '{"a":2,"b":7}': "",
    }
    found, _ = link(spark, [(1, f"c{n}", n, "add", a, []) for n, a in enumerate(cases)])
    assert {a: ",".join(found[1, f"c{n}"]["errors"]) for n, a in enumerate(cases)} == cases
    more = {'{"how":"loud","to":[],"more":{},"ok":true}': "", '{"how":"LOUD","to":{},"ok":1}': "choice:how,type:ok,type:to"}
    found, _ = link(spark, [(1, f"c{n}", n, "say", a, []) for n, a in enumerate(more)] + [(1, "x", 9, "no", "{}", None), (1, "y", 9, None, None, None)])
    assert {a: ",".join(found[1, f"c{n}"]["errors"]) for n, a in enumerate(more)} == more
    assert found[1, "x"]["errors"] == found[1, "y"]["errors"] == ["unknown_tool"]


def test_canonical_json(spark):
    found, _ = link(
        spark,
        [(1, "a", 0, "add", ' { "b" : 2.50, "a" : 1 } ', ["q", "q", None]), (1, "q", 1, "say", '{"more":{"z":1,"é":"\\u00fc\\n","a":[{"y":1,"x":null}]}}', [])],
        [(1, "a", 2, "é \"x\"\n/")],
    )
    assert found[1, "a"]["message"] == '{"arguments":{"a":1,"b":2.5},"call_id":"a","name":"add","needs":["q"],"result":"é \\"x\\"\\n/"}'
    text = found[1, "q"]["message"]
    assert text == '{"arguments":{"more":{"a":[{"x":null,"y":1}],"z":1,"é":"ü\\n"}},"call_id":"q","name":"say"}'
    assert json.loads(text)["arguments"]["more"]["z"] == 1
    assert (found[1, "a"]["position"], found[1, "q"]["position"]) == (1, 0)
    assert (found[1, "a"]["status"], found[1, "q"]["status"]) == ("ok", "unanswered")


def test_order_with_long_ways_circles_and_missing_needs(spark):
    n = 6
    calls = [(1, f"r{i}", n - i, "add", '{"a":1}', [f"r{i - 1}"] if i else []) for i in range(n)]
    calls += [(2, f"f{i}", i, "add", '{"a":1}', [f"f{j}" for j in range(i)]) for i in range(n)]
    calls += [(3, "a", 0, "add", '{"a":1}', ["b"]), (3, "b", 1, "add", '{"a":1}', ["a"]), (3, "c", 2, "add", '{"a":1}', []), (3, "s", 3, "add", '{"a":1}', ["s", "gone"])]
    calls += [(4, "d1", 5, "add", '{"a":1}', ["d3", "d2"]), (4, "d2", 4, "add", '{"a":1}', ["d4"]), (4, "d3", 9, "add", '{"a":1}', ["d4"]), (4, "d4", 1, "add", '{"a":1}', [])]
    found, rows = link(spark, calls)
    assert [found[1, f"r{i}"]["position"] for i in range(n)] == list(range(n))
    assert [found[2, f"f{i}"]["position"] for i in range(n)] == list(range(n))
    assert {i: found[3, i]["status"] for i in "abcs"} == {"a": "circle", "b": "circle", "c": "unanswered", "s": "circle"}
    assert found[3, "s"]["errors"] == ["no_call:gone"]
    for conv, call, _, _, _, needs in calls:
        if conv != 3:
            assert all(found[conv, need]["position"] < found[conv, call]["position"] for need in needs)
    for conv in (1, 2, 3, 4):
        places = sorted(r["position"] for r in rows if r["conv_id"] == conv)
        assert places == list(range(len(places)))


def test_nulls_repeated_rows_and_orphans(spark):
    calls = [(1, "a", 2, "add", '{"a":2}', None), (1, "a", 1, "add", '{"a":1}', None), (1, "a", 1, "add", '{"a":1}', None)]
    calls += [(None, "a", None, None, None, None), (1, None, 0, "add", '{"a":1}', ["a"]), (1, None, 0, "add", '{"a":1}', ["a"]), (None,) * 6]
    results = [(1, "a", 5, "late"), (1, "a", 3, "early"), (1, "z", 1, None), (None, "a", None, None), (1, None, 0, "nobody"), (None,) * 4]
    found, rows = link(spark, calls, results)
    first = found[1, "a"]
    assert (first["n_calls"], first["n_results"], first["status"], first["position"]) == (3, 2, "ok", 0)
    assert json.loads(first["message"]) == {"arguments": {"a": 1}, "call_id": "a", "name": "add", "result": "early"}
    assert found[1, "z"]["status"] == "orphan" and found[1, "z"]["message"] == '{"call_id":"z"}'
    assert found[None, "a"]["errors"] == ["unknown_tool"]
    assert sum(r["n_calls"] for r in rows) == len(calls) and sum(r["n_results"] for r in rows) == len(results)
    nameless = sorted((r["n_calls"], r["n_results"], r["status"]) for r in rows if r["conv_id"] == 1 and r["call_id"] is None)
    assert nameless == [(0, 1, "orphan"), (2, 0, "unanswered")]
    assert link(spark, [])[1] == []
    assert [r["status"] for r in link(spark, [], results[:1])[1]] == ["orphan"]


def test_the_main_path_has_no_python(spark, sf_dir, plan_of):
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    plan = plan_of(chat.linked(*chat.turns_as_calls(turns), TOOLS))
    assert not any(word in plan for word in ("Python", "Arrow", "ExistingRDD", "Cartesian"))
    assert chat.op1_chat(spark, sf_dir).select(F.max("position")).first()[0] == 3
