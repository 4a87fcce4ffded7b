import json
import random

from veldrift.llm import chat, queries


def test_query_checks_stated_schemas_and_keeps_content(spark, tmp_path):
    tools = {"tools": [{"type": "function", "function": {"name": "add", "parameters": {"type": "object", "required": ["x"], "properties": {"x": {"type": "integer"}}}}}]}
    call = lambda i, name, args: {"id": i, "type": "function", "function": {"name": name, "arguments": json.dumps(args)}}
    several = {"content": "let me see", "tool_calls": [call("a", "add", {"x": 1}), call("b", "add", {"x": "1"}), call("c", "sub", {}), {"id": 5, "name": "add"}]}
    rows = [(1, 0, "system", json.dumps(tools)), (1, 1, "assistant", json.dumps(several)), (1, 2, "tool", '{"tool_call_id": "a", "content": 3}'), (2, 0, "assistant", json.dumps(call("z", "add", {"x": 1})))]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {(r.conv_id, r.turn, r.item): r for r in queries.op7_chat_format(spark, str(tmp_path)).collect()}
    assert len(got) == 8
    assert got[1, 1, -1].json == '{"content":"let me see","role":"assistant"}'
    assert (got[1, 1, 0].status, got[1, 1, 0].name, got[1, 1, 0].valid) == ("linked", "add", True)
    assert json.loads(got[1, 1, 0].json)["tool_call"] == {"id": "a", "name": "add", "arguments": {"x": 1}}
    assert got[1, 1, 1].problems == "$.x: not of type integer" and got[1, 1, 2].problems == "unknown tool"
    assert (got[1, 1, 3].status, got[1, 1, 3].problems) == ("no_id", "no id") and got[1, 2, 0].status == "linked"
    assert got[2, 0, 0].problems == "unknown tool"


def depths(calls):
    """Twice the longest chain before each call, by walking; none in or behind a cycle."""
    after = {c: {b for b in before if b in {x for x, _ in calls}} for c, before in calls}
    out, level = {}, 0
    while True:
        ready = [c for c in after if c not in out and all(b in out for b in after[c])]
        if not ready:
            return out
        for c in ready:
            out[c] = max((out[b] + 2 for b in after[c]), default=0)
        level += 1


def test_depths_of_chains_meshes_and_cycles(spark):
    rng = random.Random(3)
    chain = [(f"c{i}", [f"c{i - 1}"] if i else []) for i in range(300)]
    mesh = [(f"m{i}", [f"m{j}" for j in range(max(0, i - 3), i) if rng.random() < 0.5]) for i in range(60)]
    cycle = [("x", ["y"]), ("y", ["z"]), ("z", ["x"]), ("w", ["x"]), ("v", ["w", "c5"]), ("self", ["self"]), ("none", ["absent"]), ("t", ["m59", "c299", "c299"])]
    calls = chain + mesh + cycle
    d = spark.createDataFrame([(1, c, b) for c, b in calls] + [(2, "c7", ["c6"])], "conv_id long, call_id string, after array<string>")
    got = chat.call_depths(d).collect()
    assert {r.call_id: r.call_depth for r in got if r.conv_id == 1} == depths(calls) and len(got) == len(depths(calls)) + 1
    assert depths(calls)["t"] >= 600 and [r.call_depth for r in got if r.conv_id == 2] == [0]


def test_hostile_json_has_a_defined_result(spark):
    deep = '{"id": "a", "name": "f", "arguments": ' + "[" * 200_000 + "]" * 200_000 + "}"
    less = '{"id": "a", "name": "f", "arguments": ' + "[" * 3000 + "]" * 3000 + "}"
    texts = [
        deep, less, '{"id": "\\ud800", "name": "f\\udfff", "arguments": {"x": "\\ud83d"}}', '{"id": "b", "name": "f", "arguments": {"x": NaN}}',
        '{"id": "c", "name": "f", "arguments": {"x": 1e999}}', '{"id": "d", "name": "f", "arguments": "{\\"x\\": NaN}"}', '{"id": "e", "name": "f", "arguments": {"x": 1, "x": 2}}',
        '{"id": "f", "name": "f", "arguments": ' + "9" * 5000 + "}", "x" * 1_000_000,
    ]
    rows = [(i, 0, "assistant", t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    schemas = {"f": {"type": ["object", "null"], "required": [["x"], "y"], "properties": {"x": {"type": {}}}, "enum": 5}}
    got = {r.conv_id: r for r in chat.format_chats(df, schemas).collect()}
    assert len(got) == len(rows)
    assert [got[i].kind for i in (0, 3, 4, 7, 8)] == ["message"] * 5 and got[3].json == chat.canonical({"role": "assistant", "content": texts[3]})
    assert (got[2].call_id, got[2].name) == ("\\ud800", "f\\udfff") and '"x":"\\ud83d"' in got[2].json
    assert got[5].problems.startswith("$: not JSON") and '"x":2' in got[6].json and got[6].problems == "$.y: missing"


def test_a_hot_conversation_goes_through_the_links(spark):
    rows = [(1, t, "assistant" if t % 2 else "user", f"text {t}") for t in range(2000)] + [(2, 0, "system", None), (2, 1, "assistant", None), (None, 0, "user", "a"), (None, 1, "assistant", "b"), (3, None, "user", "b")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat.format_chats(chat.as_calls(df), chat.REPLY, stated=True)
    got = {(r.conv_id, r.turn): r for r in out.collect()}
    assert len(got) == len(rows)
    assert [got[1, t].depth for t in (0, 1, 2, 3, 1998, 1999)] == [0, 0, 1, 2, 1997, 1998]
    assert [got[1, t].status for t in (0, 1, 2, 1999)] == ["message", "linked", "linked", "no_result"]
    assert got[2, 1].problems == "$.text: not of type string" and got[3, None].status == "message"
    assert (got[None, 1].status, got[None, 1].depth) == ("no_result", 0)
    parts = sorted(chat.conversation_json(out, rows=300).filter("conv_id = 1").collect(), key=lambda r: r.part)
    order = [m.get("tool_call", {}).get("id") or m.get("tool_call_id") for r in parts for m in json.loads(r.json)][1:]
    assert order == [f"reply-1-{t if t % 2 else t - 1}" for t in range(1, 2000)]


def test_enum_and_integer_follow_json():
    assert chat.problems(True, {"enum": [1]}) and chat.problems([True], {"enum": [[1]]}) and chat.problems({"a": 0}, {"enum": [{"a": False}]})
    assert not chat.problems(1.0, {"enum": [1], "type": "integer"}) and not chat.problems(False, {"enum": [False]})
    assert chat.problems(1.5, {"type": "integer"}) and chat.problems(True, {"type": "integer"})
