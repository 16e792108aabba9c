"""Rules worked out by hand: bodies, routes, errors, log rebuild, search usage, response facts."""

from __future__ import annotations

import json
import os
import subprocess
import sys

from pyspark.sql import functions as F

from gatemeter import fixed
from gatemeter.functions.models import ModelPolicy
from gatemeter.operators import bodies, responses, search, sse
from gatemeter.operators.telemetry import build_telemetry
from gatemeter.sources import request_log, sinks
from gatemeter.streaming import ingest

CALL = ("request_id string, ts timestamp, user_id_raw string, requested_model string, route string, "
        "beta_requested string, input_tokens long, output_tokens long, cache_read_input_tokens long, "
        "cache_creation_input_tokens long, stream boolean, status int, elapsed_ms int, ttft_ms int")


def call(spark, *rows):
    import datetime

    at = datetime.datetime(2024, 1, 1)
    return spark.createDataFrame([(i, at, None, "claude-opus-4-6", route, None, 10, 20, 0, 0, False, status, 100, None)
                                  for i, route, status in rows], CALL)


def features(spark, *texts):
    df = spark.createDataFrame(list(enumerate(texts)), "request_id long, body string")
    return [r.asDict() for r in bodies.body_features(df).orderBy("request_id").collect()]


def test_body_rules(spark):
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    system = [{"type": "text", "text": "é", "n": 1.0}]
    a, b, c, d = features(
        spark, '{"model":"m","system":%s,"messages":[{"role":"user","content":"x"}]}' % json.dumps(system),
        '{"messages":[],"input":"hello"}', '{"messages":[{"role":"user","content":"x"}],"input":1}',
        '{"model":"first","model":"last","messages":[]}')
    assert a["system_bytes"] == len(json.dumps(system).encode())
    assert [x["is_responses_body"] for x in (a, b, c, d)] == [False, True, False, False]
    assert d["model"] == "last"


def test_hosts_and_named_errors(spark):
    rows = {r.request_id: r for r in build_telemetry(call(
        spark, ("a", "openai", 200), ("b", "tavily", 400), ("c", "tavily", 502), ("d", "native", 429))).collect()}
    assert rows["a"].upstream_host == fixed.NATIVE_UPSTREAM_HOST
    assert [rows[k].error_type for k in "abcd"] == [None, "empty_search_query", "tavily_error", "http_429"]
    own = build_telemetry(call(spark, ("a", "openai", 200)), ModelPolicy(upstream_base_url="example.org")).first()
    assert own.upstream_host == "example.org"


def test_rebuild_takes_the_logged_model_as_it_is(spark):
    line = json.dumps({"ts": 1704067200.5, "path": "/v1/messages", "elapsed_ms": 500, "request": {
        "model": "claude-opus-4.8", "stream": True}, "response": {"status": 200, "stream": True, "usage": {"input_tokens": 5}}})
    parsed = request_log.parse_log_lines(spark.createDataFrame([(line,)], "value string"))
    r = request_log.rebuild_telemetry(parsed, ModelPolicy(no_opus=True)).first()
    assert (r.upstream_model, r.requested_model, r.downgraded, r.completed) == ("claude-opus-4.8", None, False, None)


def test_search_turn_carries_its_usage(spark):
    df = spark.createDataFrame([(1, "q", None, [("u", "t", "c" * 30)]), (2, "q", None, [])],
                               "search_id long, query string, answer string, results "
                               "array<struct<url:string,title:string,content:string>>")
    r = search.render_searches(df)
    f = {x.search_id: x for x in sse.facts_from_raw(r, ["search_id"], "sse").collect()}
    text = {x.search_id: x.markdown for x in r.collect()}
    assert [f[i].output_tokens for i in (1, 2)] == [max(1, len(text[i]) // 4) for i in (1, 2)]
    assert [f[i].web_search_requests for i in (1, 2)] == [1, 0]


def test_stream_facts_of_streams_without_events(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "data: [DONE]\n\ndata: {broken\n")], "k long, raw string")
    got = {r.k: r for r in sse.facts_from_raw(df, ["k"]).collect()}
    assert set(got) == {1, 2, 3}
    for r in got.values():
        assert not r.completed and r.stop_reason is None and r.input_tokens is None and (r.text or "") == ""


def test_message_response_facts(spark):
    ok = {"id": "m1", "stop_reason": "tool_use", "content": [{"type": "text", "text": "x"}, {"type": "tool_use", "name": "Read"}],
          "usage": {"input_tokens": 3, "cache_creation": {"ephemeral_5m_input_tokens": 7, "ephemeral_1h_input_tokens": 9},
                    "server_tool_use": {"web_search_requests": 2}}}
    bad = {"type": "error", "error": {"type": "overloaded_error", "message": "busy"}}
    df = spark.createDataFrame([("a", json.dumps(ok)), ("b", json.dumps(bad)), ("c", "not json"), ("d", None)],
                               "request_id string, body string")
    t = {r.request_id: r for r in responses.fact_rows(
        call(spark, ("a", "native", 200), ("b", "native", 529), ("c", "native", 500), ("d", "native", 200), ("e", "native", 500)),
        responses.message_response_facts(df)).collect()}
    a = t["a"]
    assert (a.input_tokens, a.cache_creation_5m, a.cache_creation_1h, a.web_search_requests) == (3, 7, 9, 2)
    assert (a.stop_reason, a.response_message_id, a.response_tool_names, a.completed) == ("tool_use", "m1", ["Read"], True)
    assert t["b"].error_message == json.dumps(bad["error"]) and t["b"].error_type == "http_529" and not t["b"].completed
    assert t["e"].input_tokens == 0 and t["c"].error_message is None and not t["d"].completed


def test_first_wins_by_key_alone(spark, tmp_dir):
    path = os.path.join(tmp_dir, "t")
    schema = "request_id string, day string, copy int"
    for rows in ([("r1", "d1", 0), ("r2", None, 0), (None, "d1", 0)], [("r1", "d2", 0), ("r2", None, 0), ("r2", "d1", 1)],
                 [(None, "d3", 0), ("r3", "d3", 0)]):
        sinks.dedupe_append(spark.createDataFrame(rows, schema), path, "request_id", ["copy"], partition_col="day")
    got = sorted((r.request_id or "", r.day or "") for r in spark.read.parquet(path).collect())
    assert got == [("", "d1"), ("r1", "d1"), ("r2", ""), ("r3", "d3")]


def test_rejects_and_replay_after_a_lost_checkpoint(spark, tmp_dir):
    landing, table, rejects = (os.path.join(tmp_dir, x) for x in ("landing", "table", "rejects"))
    rows = call(spark, ("a", "tavily", 200), ("b", "tavily", 200), (None, "native", 200))
    rows.unionByName(call(spark, ("c", "native", 200)).withColumn("ts", F.lit(None).cast("timestamp"))) \
        .repartition(3).write.parquet(landing)
    schema = spark.read.parquet(landing).schema
    for run, files in (("one", "1"), ("two", "3")):
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(landing)
        ingest.run_to_end(ingest.ingest_calls(stream, table, os.path.join(tmp_dir, f"ckpt-{run}"),
                                              rejects_path=os.path.join(rejects, run)), 300)
    assert sorted(r.request_id for r in spark.read.parquet(table).collect()) == ["a", "b"]
    spend = ingest.daily_spend(spark, table).collect()
    assert [(r.calls, round(r.spend_usd, 6)) for r in spend] == [(2, 0.016)]
    reasons = sorted(r.reject_reason for r in spark.read.parquet(os.path.join(rejects, "two")).collect())
    assert reasons == ["no_request_id", "no_ts"]


def test_workers_can_import_the_package_from_anywhere(tmp_dir):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = f"""
import sys
sys.path.insert(0, {root!r})
from gatemeter.session import get_spark, ship_package
spark = get_spark("local[1]", 1)
ship_package(spark)
from gatemeter.operators import bodies
df = spark.createDataFrame([(1, '{{"model":"m","messages":[{{"cache_control":{{"type":"e","scope":"x"}}}}]}}')], "request_id long, body string")
print(bodies.normalise_bodies(df).first().body)
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_dir, env=env, capture_output=True, text=True, timeout=300)
    assert '"cache_control": {"type": "e"}' in out.stdout, out.stderr[-2000:]
