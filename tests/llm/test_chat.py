"""Tool-call linking, validation and canonical JSON."""

import json

from cairn.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, line string"


def call(*calls):
    return json.dumps({"content": None, "tool_calls": [{"id": i, "type": "function", "function": {"name": n, "arguments": a}} for i, n, a in calls]})


def result(i, content="ok"):
    return json.dumps({"tool_call_id": i, "content": content})


def test_links_order_and_validation(spark):
    rows = [
        (1, 0, "user", "hello \"you\" é\n"), (1, 1, "tool", result("b", {"z": 1, "a": [2]})), (1, 2, "assistant", call(("a", "search", '{"query": "x", "limit": 3}'), ("b", "search", {"limit": "many"}))),
        (1, 3, "tool", result("a")), (1, 4, "tool", result("nobody")), (1, 5, "assistant", call(("a", "calculate", "{broken"), ("c", "calculate", {"expression": "1", "x": 2}), (None, "other", {}))),
        (2, 0, "tool", result("a")), (2, 1, None, None), (None, None, "assistant", call(("a", "search", {"query": "q"}))), (None, 3, "tool", result("a")), (3, 0, "user", '{"tool_calls": 5}'), (3, 1, "user", "{not json"), (3, 1, "user", "{not json"),
    ]
    got = chat.chat_lines(spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)).collect()
    assert len(got) == len(rows)
    of = {(r.conv_id, r.turn): r for r in got}
    assert [(r.turn, r.link) for r in sorted((r for r in got if r.conv_id == 1), key=lambda r: (r.order_turn, r.order_step, r.turn))] == [(0, None), (2, None), (1, "linked"), (3, "linked"), (4, "orphan"), (5, None)]
    assert (of[1, 2].n_calls, of[1, 2].n_bad_calls, of[1, 2].n_unanswered) == (2, 1, 0) and (of[1, 5].n_bad_calls, of[1, 5].n_unanswered) == (3, 1)
    assert of[2, 0].link == "orphan" and of[None, 3].link == "orphan"
    assert json.loads(of[1, 1].line) == {"content": '{"a":[2],"z":1}', "name": "search", "role": "tool", "tool_call_id": "b"}
    assert of[1, 0].line == '{"content":"hello \\"you\\" é\\n","role":"user"}' and of[2, 1].line == '{"content":"","role":""}'
    for r in got:
        assert r.line == chat.canonical(json.loads(r.line))
    assert chat.chat_lines(spark.createDataFrame([], SCHEMA)).count() == 0


def test_chains_and_cycles(spark):
    both = lambda answers, *calls: json.dumps({"tool_call_id": answers, "tool_calls": [{"id": i, "name": "search", "arguments": {"query": "q"}} for i in calls]})
    rows = [
        (1, 0, "tool", result("x")), (1, 1, "assistant", both("y", "x")), (1, 5, "assistant", call(("y", "search", {"query": "q"}))), (1, 3, "user", "hi"),
        (2, 4, "assistant", both("b", "a")), (2, 2, "assistant", both("a", "b")), (2, 1, "tool", result("a")), (2, 3, "assistant", both("s", "s")),
        *((3, 40 - k, "assistant", both(f"k{k - 1}", f"k{k}")) for k in range(1, 40)), (3, 41, "assistant", call(("k0", "search", {"query": "q"}), ("open", "search", {"query": "q"}))),
        (4, None, "assistant", both("late", "early")), (4, 7, "assistant", call(("late", "search", {"query": "q"}))), (4, 9, "tool", result("early")),
    ]
    got = chat.chat_lines(spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)).collect()
    order = lambda c: [r.turn for r in sorted((r for r in got if r.conv_id == c), key=lambda r: (r.order_turn, r.order_step, -1 if r.turn is None else r.turn))]
    of = {(r.conv_id, r.turn): r for r in got}
    assert order(1) == [3, 5, 1, 0] and of[1, 1].n_unanswered == 0
    assert of[2, 4].link == of[2, 2].link == of[2, 3].link == "cycle" and of[2, 1].link == "linked"
    assert order(2) == [2, 3, 4, 1]
    assert order(3) == list(range(41, 0, -1))[:1] + list(range(39, 0, -1)) and of[3, 41].n_unanswered == 1 and of[3, 1].n_unanswered == 1
    assert order(4) == [7, None, 9]


def test_odd_json_does_not_fail(spark):
    texts = [
        '{"tool_calls": [{"id": "a", "name": "search", "arguments": {"query": "q", "limit": 1e999}}]}', '{"tool_calls": [{"id": "a", "name": "search", "arguments": {"query": "q", "limit": NaN}}]}',
        '{"tool_calls": [{"id": "a", "name": "search", "arguments": "{\\"limit\\": Infinity}"}]}', '{"content": "\\ud800", "tool_call_id": "\\ud800x"}', '{"tool_calls": [{"id": 3, "name": ["a"], "arguments": []}]}',
        '{"tool_calls": [{"id": "\\udc00", "name": "\\udc00", "arguments": {"\\ud800": "\\ud83d\\ude00"}}]}', '{"tool_calls": ' + "[" * 100_000, '{"tool_calls": [7, null, {"function": []}], "content": {"a": 1}}', "{" * 50_000,
        '{"tool_calls": [{"arguments": ' + "9" * 5000 + "}]}", None, "",
    ]
    got = chat.chat_lines(spark.createDataFrame([(1, k, "assistant", t, "x") for k, t in enumerate(texts)], SCHEMA)).collect()
    of = {r.turn: r for r in got}
    assert len(got) == len(texts) and of[0].n_calls == of[1].n_calls == 0 and of[0].link is None
    assert of[2].n_bad_calls == 1 and json.loads(of[3].line)["content"] == "\ufffd" and of[3].link == "orphan"
    assert of[4].n_calls == of[4].n_bad_calls == 1 and of[5].n_bad_calls == 1 and of[7].n_calls == 3
    for r in got:
        json.loads(r.line)


def test_schema_violations():
    schema = {"type": "object", "properties": {"n": {"type": "integer"}, "s": {"enum": ["a"]}, "l": {"type": "array", "items": {"type": "number"}}}, "required": ["n"], "additionalProperties": False}
    assert chat.violations({"n": 1, "s": "a", "l": [1, 2.5]}, schema) == []
    assert chat.violations({"n": True, "s": "b", "l": [1, "x"], "q": 0}, schema) == ["$.l[1]: not number", "$.n: not integer", "$.q: unknown", "$.s: not listed"]
    assert chat.violations({}, schema) == ["$.n: missing"] and chat.violations([], schema) == ["$: not object"]
