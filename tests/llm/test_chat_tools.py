import json

from shopweave.llm import chat_tools

PARAMETERS = [("find", "query", "string", True, None), ("find", "limit", "integer", False, 10.0), ("sum", "values", "array", True, None)]


def calls(*items):
    return json.dumps({"tool_calls": list(items)})


def call(id, name="find", arguments=None, after=None):
    return {"id": id, "name": name, "arguments": {"query": "x"} if arguments is None else arguments, "after": after or []}


def result(id, content="ok"):
    return json.dumps({"tool_call_id": id, "content": content})


def linked(spark, rows):
    turns = spark.createDataFrame([(*r, "extra") for r in rows], "conv_id long, turn long, role string, text string, id string")
    parameters = spark.createDataFrame(PARAMETERS, "name string, parameter string, type string, required boolean, most double")
    return {(r.conv_id, r.call_id, r.status): r for r in chat_tools.link_messages(turns, parameters).collect()}


def test_links_levels_and_json(spark):
    got = linked(
        spark,
        [
            (1, 0, "user", "hello"), (1, 1, "assistant", calls(call("c", after=["b", "a"]), call("a", arguments={"query": "é \"q\"", "limit": 3}), call("b", after=["a"]))),
            (1, 2, "tool", result("a", "line\n2")), (1, 3, "tool", result("c")), (1, 4, "tool", result("zz")), (1, 5, "tool", result("a", "again")),
            (2, 0, "assistant", calls(call("a"))), (2, 1, "assistant", "no json with tool_calls"), (2, 2, "assistant", None), (2, 3, "tool", ""), (None, 1, "assistant", calls(call("a"))),
        ],
    )
    assert {k[1]: got[k].level for k in got if k[0] == 1 and k[2] in ("linked", "unanswered")} == {"a": 0, "b": 1, "c": 2}
    assert set(got) == {(1, "a", "linked"), (1, "b", "unanswered"), (1, "c", "linked"), (1, "zz", "orphan"), (1, "a", "repeated"), (2, "a", "unanswered"), (None, "a", "unidentified")}
    assert got[1, "a", "linked"].record == '{"arguments":{"limit":3,"query":"é \\"q\\""},"id":"a","name":"find","result":"line\\n2"}'
    assert got[2, "a", "unanswered"].valid


def test_problems(spark):
    got = linked(
        spark,
        [
            (1, 0, "assistant", calls(
                call("ok", "sum", {"values": [1]}), call("type", arguments={"query": 5}), call("missing", arguments={"limit": 1}), call("large", arguments={"query": "q", "limit": 11}),
                call("unknown", "nope"), call("extra", arguments={"query": "q", "z": 1}), call("lost", after=["gone"]), call("null", arguments={"query": None}), call("text", arguments="query"),
                call("r1", after=["r2"]), call("r2", after=["r1"]), call("r3", after=["r2"]), call("self", after=["self"]),
                call("spaced", arguments='\n\t{"query":"q"}'), call("whole", arguments={"query": "q", "limit": 1.0}), call("half", arguments={"query": "q", "limit": 1.5}), call("list", arguments="[1]"),
            )),
        ],
    )
    said = {k[1]: (r.problems, r.level) for k, r in got.items()}
    assert said["ok"] == ("", 0) and said["type"][0] == "query: not string" and said["missing"][0] == "query: missing" and said["large"][0] == "limit: too large"
    assert said["unknown"][0] == "name: unknown; query: unknown" and said["extra"][0] == "z: unknown" and said["lost"] == ("after: gone", 0)
    assert "query: missing" in said["null"][0] and said["text"][0] == "arguments: no object"
    assert [said[k][1] for k in ("r1", "r2", "r3", "self")] == [None] * 4
    assert said["spaced"][0] == said["whole"][0] == "" and said["half"][0] == "limit: not integer" and said["list"][0] == "arguments: no object"


def test_repeated_rows(spark):
    """Equal rows: one call meets one result, the others are repeated."""
    turns = [(1, 0, "assistant", calls(call("a"))), (1, 1, "tool", result("a"))] * 2 + [(1, 2, "tool", result(None))]
    frame = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").repartition(3)
    parameters = spark.createDataFrame(PARAMETERS, "name string, parameter string, type string, required boolean, most double")
    got = sorted(r.status for r in chat_tools.link_messages(frame, parameters).collect())
    assert got == ["linked", "repeated", "repeated", "unidentified"]


def test_long_chain_and_nothing(spark):
    n = 70
    got = linked(spark, [(1, i, "assistant", calls(call(f"c{i}", after=[f"c{i - 1}", f"c{i // 2}"] if i else []))) for i in range(n)])
    assert all(got[1, f"c{i}", "unanswered"].level == i for i in range(n))
    assert linked(spark, []) == {}
