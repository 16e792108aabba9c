"""Rows that wait for a Python helper, and joins of tables that both grow with the calls."""

from __future__ import annotations

import json
import re

from gatemeter.operators import bodies, convert
from gatemeter.operators.telemetry import attach_body_features, build_telemetry


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _bodies(spark):
    said = [{"role": "user", "content": "x" * 200}]
    used = [{"role": "assistant", "content": [{"type": "tool_use", "id": "u1", "name": "T", "input": {"b": 1.50, "a": []}}]}]
    rows = [("r1", json.dumps({"model": "gpt-5-mini", "messages": said})),
            ("r2", json.dumps({"model": "gpt-5-mini", "messages": used, "system": [{"type": "text", "text": "é"}]})),
            ("r3", json.dumps({"messages": [], "system": "four"})), ("r4", json.dumps({"system": []})), ("r5", "{")]
    return spark.createDataFrame(rows, "request_id string, body string")


def test_batches_of_tool_arguments_weigh_what_their_bodies_do(spark):
    chat = convert.to_chat_request(_bodies(spark)).select("request_id", "chat_body", "chat_messages")
    assert re.search(r"python_json_lists\(.*, _body#\d+\)", _plan(chat))
    got = {r.request_id: r for r in chat.collect()}
    assert sorted(got) == ["r1", "r2", "r3", "r4"]
    assert got["r2"].chat_messages[1].tool_calls[0].function.arguments == '{"b": 1.5, "a": []}'


def test_features_hold_no_bodies_while_python_measures(spark):
    features = bodies.body_features(_bodies(spark))
    held = re.search(r"ArrowEvalPython \[python_json_size\((.*)\)#\d+.*\], \[(.*)\], \d+", _plan(features))
    assert re.fullmatch(r"_structured#\d+", held.group(1)) and "_v#" not in held.group(2)
    sizes = {r.request_id: r.system_bytes for r in features.collect()}
    assert sizes == {"r1": 0, "r2": len('[{"type": "text", "text": "\\u00e9"}]'), "r3": 4, "r4": 0}


def test_body_features_are_not_broadcast(spark):
    calls = spark.sql("SELECT concat('r', id) AS request_id, TIMESTAMP'2026-01-01' AS ts, CAST(NULL AS STRING) AS user_id_raw, "
                      "'claude-opus-4-6' AS requested_model, 'native' AS route, CAST(NULL AS STRING) AS beta_requested, "
                      "1 AS input_tokens, 1 AS output_tokens, 0 AS cache_read_input_tokens, "
                      "0 AS cache_creation_input_tokens, true AS stream, 200 AS status, 5 AS elapsed_ms, 1 AS ttft_ms FROM range(1, 2)")
    fact = attach_body_features(build_telemetry(calls), bodies.body_features(_bodies(spark)))
    assert "SortMergeJoin" in _plan(fact) and "BroadcastHashJoin" not in _plan(fact)
    assert [r.n_messages for r in fact.collect()] == [1]


def test_responses_bodies_are_not_broadcast(spark):
    from conftest import SF_SMALL
    from gatemeter.plans.registry import QUERIES

    assert "Broadcast" not in _plan(QUERIES["responses_bodies"](spark, SF_SMALL))
