"""Real tool calls and messages that belong to no call, through the query's own function."""

from __future__ import annotations

import json

from tracelab.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string"


def test_tool_calls_and_lone_messages_reach_records(spark):
    call = lambda i, after=(), **args: {"id": i, "name": "f", "arguments": args, "after": list(after)}
    rows = [
        (1, 0, "system", "be kind"), (1, 1, "assistant", "hello"), (1, 2, "user", "do it"), (1, 3, "assistant", json.dumps({"tool_calls": [call("b", ["a"], x=1), call("a", x="no")]})), (1, 4, "tool", json.dumps({"tool_call_id": "a", "content": {"z": 1, "y": 2}})),
        (1, 5, "tool", json.dumps({"tool_call_id": "zz", "content": "lost"})), (1, 6, "tool", "no json"), (1, 7, "assistant", "done"), (2, 0, "user", "hi"), (None, None, "system", None), (1, 7, "assistant", "done"),
    ]
    schema = chat.REPLY | {"f": {"properties": {"x": {"type": "integer"}}}}
    got = {(r["conv_id"], r["call_id"]): r for r in chat.format_conversations(spark.createDataFrame(rows, SCHEMA), schema).collect()}
    assert set(got) == {(1, "system-0"), (1, "assistant-1"), (1, "turn-2"), (1, "a"), (1, "b"), (1, "zz"), (1, "tool-6"), (2, "turn-0"), (None, "system-none")}
    assert {k: got[1, k]["status"] for k in ("system-0", "assistant-1", "zz", "tool-6")} == dict.fromkeys(("system-0", "assistant-1", "zz", "tool-6"), "orphan")
    assert (got[1, "a"]["status"], got[1, "a"]["level"], got[1, "a"]["valid"], json.loads(got[1, "a"]["json"])["results"]) == ("answered", 0, False, ['{"y":2,"z":1}'])
    assert (got[1, "b"]["status"], got[1, "b"]["level"], got[1, "b"]["valid"]) == ("unanswered", 1, True)
    # the tool calls' message is no answer in words
    assert json.loads(got[1, "turn-2"]["json"])["results"] == ["done"] and got[2, "turn-0"]["status"] == "unanswered"
    order = sorted((r["position"], r["call_id"]) for (c, _), r in got.items() if c == 1)
    assert [p for p, _ in order] == list(range(7)) and [i for _, i in order[:3]] == ["turn-2", "a", "b"]


def test_every_message_is_in_a_record(spark, sf):
    """Each distinct message of the table is the prompt or a result of exactly one record."""
    talks = spark.read.parquet(f"{sf}/conversations.parquet")
    said = sorted((r["conv_id"], r["text"] or "") for r in talks.select("conv_id", "turn", "role", "text").distinct().collect())
    found = []
    for r in chat.format_conversations(talks).collect():
        x = json.loads(r["json"])
        found += [(r["conv_id"], t) for t in x["results"]] + ([(r["conv_id"], x["arguments"]["prompt"])] if x["arguments"] else [])
    assert sorted(found) == said
