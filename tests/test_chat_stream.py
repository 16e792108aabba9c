"""C-3 goldens: block indices, argument deltas, reasoning fallback."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from gatemeter.operators.chat_stream import convert_chat_streams, convert_responses_streams


def _events(spark, raw: str):
    out = convert_chat_streams(spark.createDataFrame([(raw,)], "raw string"), [],
                               model="m").collect()[0].events
    evs = []
    for block in out.split("\n\n"):
        if not block:
            continue
        name, data = block.split("\n")
        evs.append((name[len("event: "):], json.loads(data[len("data: "):])))
    return evs


def _d(obj) -> str:
    return "data: " + json.dumps(obj) + "\n\n"


def test_tool_before_text_and_argument_deltas(spark):
    raw = (_d({"id": "x1", "choices": [{"delta": {"tool_calls": [
               {"id": "c1", "function": {"name": "Read", "arguments": ""}}]}}]})
           + _d({"choices": [{"delta": {"tool_calls": [{"function": {"arguments": "{\"a\":1}"}}]}}]})
           + _d({"choices": [{"delta": {"content": "hi"}}]})
           + _d({"choices": [{"delta": {"tool_calls": [
               {"id": "c2", "function": {"name": "Bash", "arguments": "{}"}}]}}]})
           + _d({"choices": [{"delta": {}, "finish_reason": "tool_calls"}]})
           + _d({"choices": [], "usage": {"prompt_tokens": 5, "completion_tokens": 7}})
           + "data: [DONE]\n\n")
    evs = _events(spark, raw)
    names = [n for n, _ in evs]
    assert names[0] == "message_start" and names[-1] == "message_stop"
    assert evs[0][1]["message"]["id"] == "x1"
    assert evs[0][1]["message"]["usage"]["input_tokens"] == 5
    starts = [(e["index"], e["content_block"]["type"]) for n, e in evs if n == "content_block_start"]
    # first tool opened before any text: index 0; text then takes index 0 too
    # (the gateway's rule); the second tool, after text started, is 1 + 1 = 2
    assert starts == [(0, "tool_use"), (0, "text"), (2, "tool_use")]
    args = [(e["index"], e["delta"]["partial_json"]) for n, e in evs
            if n == "content_block_delta" and e["delta"]["type"] == "input_json_delta"]
    assert args == [(0, '{"a":1}'), (2, "{}")]
    stops = [e["index"] for n, e in evs if n == "content_block_stop"]
    assert stops == [0, 1, 2]
    delta = [e for n, e in evs if n == "message_delta"][0]
    assert delta["delta"]["stop_reason"] == "tool_use" and delta["usage"]["output_tokens"] == 7


def test_reasoning_fallback_and_empty(spark):
    raw = (_d({"id": "r", "choices": [{"delta": {"reasoning": "thin"}}]})
           + _d({"choices": [{"delta": {"reasoning": "king"}}]})
           + _d({"choices": [{"delta": {}, "finish_reason": "length"}]}))
    evs = _events(spark, raw)
    text = "".join(e["delta"]["text"] for n, e in evs
                   if n == "content_block_delta" and e["delta"]["type"] == "text_delta")
    assert text == "thinking"
    assert [e["delta"]["stop_reason"] for n, e in evs if n == "message_delta"] == ["max_tokens"]
    assert _events(spark, "data: [DONE]\n\n") == []


def test_event_text_is_the_serialisers(spark):
    odd = 'é "q" \\ \n\t\x1f\x7f 😀\n'
    raw = (_d({"id": "x", "choices": [{"delta": {"content": odd}}]})
           + _d({"choices": [{"delta": {"tool_calls": [{"id": odd, "function": {"name": "N", "arguments": odd}}]}}]})
           + _d({"choices": [{"delta": {}, "finish_reason": "stop"}]}))
    out = convert_chat_streams(spark.createDataFrame([(raw,)], "raw string"), [], model="m").collect()[0].events
    data = [line[len("data: "):] for line in out.split("\n") if line.startswith("data: ")]
    assert data == [json.dumps(json.loads(x)) for x in data]
    assert json.loads(data[0])["message"] == {
        "id": "x", "type": "message", "role": "assistant", "model": "m", "content": [], "stop_reason": None,
        "stop_sequence": None, "usage": {"input_tokens": 0, "output_tokens": 0}}
    assert [json.loads(x)["delta"] for x in data if '"delta"' in x] == [
        {"type": "text_delta", "text": odd}, {"type": "input_json_delta", "partial_json": odd},
        {"stop_reason": "end_turn", "stop_sequence": None}]


def test_block_indices_of_random_streams(spark):
    """Indices by counting ids and looking for text in what came before each chunk."""
    import random

    rng = random.Random(6)
    streams, want = [], []
    for s in range(60):
        chunks = []
        for _ in range(rng.randint(1, 9)):
            delta = {}
            if rng.random() < 0.25:
                delta["content"] = rng.choice(["", "t"])
            if rng.random() < 0.35:
                delta["reasoning"] = "r"
            if rng.random() < 0.35:
                delta["tool_calls"] = [{"id": rng.choice(["", "i"]), "function": {"name": "n", "arguments": rng.choice(["", "a"])}}
                                       for _ in range(rng.randint(1, 3))]
            chunks.append((delta, rng.choice([None, None, "stop"])))
        streams.append((s, "".join(_d({"choices": [{"delta": d, "finish_reason": f}]}) for d, f in chunks)))
        text = False
        for n, (d, f) in enumerate(chunks):
            earlier = [t for x, _ in chunks[:n] for t in x.get("tool_calls", ())]
            fresh = bool(d.get("content")) and not text
            text = text or bool(d.get("content"))
            if d.get("content"):
                want += [(s, "start", 0)] * fresh + [(s, "delta", 0)]
            for j, t in enumerate(d.get("tool_calls", ())):
                k = sum(bool(x["id"]) for x in earlier + d["tool_calls"][:j + 1]) - 1 + text
                want += [(s, "start", k)] * bool(t["id"]) + [(s, "delta", k)] * bool(t["function"]["arguments"])
            tools = sum(bool(x["id"]) for x in earlier + d.get("tool_calls", []))
            if f:
                thought = any(x.get("reasoning") and not x.get("content") for x, _ in chunks[:n + 1])
                if thought and not text and not tools:
                    want += [(s, "start", 0), (s, "delta", 0)]
                    text = True
                want += [(s, "stop", i) for i in range(text + tools)]
    got = []
    rows = convert_chat_streams(spark.createDataFrame(streams, "s int, raw string"), ["s"], model="m").orderBy("s").collect()
    for r in rows:
        for line in r.events.split("\n"):
            if line.startswith("data: ") and "content_block_" in line:
                e = json.loads(line[len("data: "):])
                got.append((r.s, e["type"].removeprefix("content_block_"), e["index"]))
    assert got == want


def test_time_grows_with_the_chunks(spark):
    import time

    def seconds(n):
        raw = "".join(_d({"choices": [{"delta": {"content": f"w{i}"} if i % 3 else {"tool_calls": [
            {"id": f"c{i}", "function": {"name": "n", "arguments": "{}"}}]}}]}) for i in range(n))
        streams = spark.createDataFrame([(raw,)], "raw string")
        began = time.perf_counter()
        convert_chat_streams(streams, [], model="m").write.format("noop").mode("overwrite").save()
        return time.perf_counter() - began

    seconds(100)
    assert seconds(24_000) < 6 * max(seconds(6_000), 0.5)


def _r(name: str, obj, space: bool = True) -> str:
    return f"event: {name}\ndata:{' ' if space else ''}{json.dumps(obj)}\n\n"


def test_responses_to_chat_chunks(spark):
    raw = (_r("response.created", {}) + _r("response.in_progress", {}, space=False)
           + _r("response.output_text.delta", {"delta": "hel"})
           + _r("response.function_call_arguments.delta", {"output_index": 3, "delta": "{\"a\""})
           + _r("response.output_item.added", {"output_index": 3, "item": {
               "type": "function_call", "id": "fc", "call_id": "c3", "name": "Read"}})
           + _r("response.output_item.added", {"output_index": 5, "item": {
               "type": "function_call", "id": "fc5", "name": "Bash"}})
           + _r("response.function_call_arguments.delta", {"output_index": 5, "delta": "{}"})
           + "data: [DONE]\n\n"
           + _r("response.completed", {"response": {"usage": {"input_tokens": 2, "output_tokens": 3}}})
           + 'event: response.output_text.delta\ndata: {"delta": "tail"}')
    out = convert_responses_streams(spark.createDataFrame([(raw,)], "raw string"), [], F.lit("id1"),
                                    F.lit(7).cast("long"), model="m").collect()[0].chunks
    blocks = [b for b in out.split("\n\n") if b]
    assert blocks[-1] == "data: [DONE]"
    chunks = [json.loads(b[len("data: "):]) for b in blocks[:-1]]
    deltas = [c["choices"][0]["delta"] for c in chunks]
    assert deltas[0] == {"role": "assistant", "content": ""}      # role once
    assert deltas[1] == {"content": "hel"}
    # arguments before the item allocate index 0; the later item with the same
    # key emits nothing; the next key gets index 1
    assert deltas[2] == {"tool_calls": [{"index": 0, "function": {"arguments": "{\"a\""}}]}
    assert deltas[3]["tool_calls"][0] == {"index": 1, "id": "fc5", "type": "function",
                                          "function": {"name": "Bash", "arguments": ""}}
    assert deltas[4] == {"tool_calls": [{"index": 1, "function": {"arguments": "{}"}}]}
    last = chunks[-1]
    assert last["choices"][0]["finish_reason"] == "tool_calls"
    assert last["usage"] == {"prompt_tokens": 2, "completion_tokens": 3, "total_tokens": 5}
    assert chunks[0]["choices"][0]["finish_reason"] is None and "usage" not in chunks[0]
    assert all(c["id"] == "id1" and c["created"] == 7 for c in chunks)
    assert len(chunks) == 6   # the unterminated tail is never emitted
