"""Registered queries: name -> callable(spark, sf_dir) -> DataFrame.

Every query reads the landed tables under ``sf_dir`` (through the bridges in
:mod:`gatemeter.sources.bridges`) and runs over all of their rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gatemeter.functions.models import ModelPolicy, downgrade_to, downgraded, map_model_name
from gatemeter import fixed
from gatemeter.functions.requests import beta_forwarded, beta_stripped, derive_route, parse_user_id
from gatemeter.operators import (bodies, catalog, chat_stream, convert, messages, responses, search, sessions, spend,
                                 sse, summaries)
from gatemeter.operators.telemetry import attach_body_features, build_telemetry, telemetry_from_events
from gatemeter.plans import reports
from gatemeter.sources import bridges, fact_store
from gatemeter.sources import request_log as request_log_mod
from gatemeter.sources import sinks
from gatemeter.streaming import assembly, ingest
from gatemeter.sources.tables import read_table

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}


def query(name: str):
    def reg(fn: QueryFn) -> QueryFn:
        QUERIES[name] = fn
        return fn
    return reg


def fact_table(spark: SparkSession, sf_dir: str, policy: ModelPolicy | None = None) -> DataFrame:
    return telemetry_from_events(read_table(spark, sf_dir, "events"), policy)


def usage_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bridges.usage_raw(read_table(spark, sf_dir, "events"))


# --- published reports (A-1..A-5) -------------------------------------------
@query("usage_by_session")
def q_usage_by_session(spark, d):
    return reports.usage_by_session(fact_table(spark, d))


@query("cache_ratio_by_day")
def q_cache_ratio_by_day(spark, d):
    return reports.cache_ratio_by_day(fact_table(spark, d))


@query("cost_by_model")
def q_cost_by_model(spark, d):
    return reports.cost_by_model(fact_table(spark, d))


@query("throughput_by_model")
def q_throughput_by_model(spark, d):
    return reports.throughput_by_model(fact_table(spark, d))


@query("totals")
def q_totals(spark, d):
    return reports.totals(fact_table(spark, d))


# --- model names (P-1, P-2, P-13, J-3) -----------------------------------------
@query("map_model_name")
def q_map_model_name(spark, d):
    raw = usage_raw(spark, d)
    return raw.select("request_id", "requested_model",
                      map_model_name(F.col("requested_model")).alias("upstream_model"))


NO_OPUS_POLICY = ModelPolicy(no_opus=True, no_opus_target="claude-sonnet-4.6")


@query("map_model_no_opus")
def q_map_model_no_opus(spark, d):
    raw = usage_raw(spark, d)
    m = F.col("requested_model")
    return raw.select("request_id", "requested_model",
                      map_model_name(m, NO_OPUS_POLICY).alias("upstream_model"),
                      downgraded(m, NO_OPUS_POLICY).alias("downgraded"),
                      downgrade_to(m, NO_OPUS_POLICY).alias("downgrade_to"))


# --- request projections (P-10, P-16, P-19) ----------------------------------
@query("parse_user_id")
def q_parse_user_id(spark, d):
    raw = usage_raw(spark, d)
    ids = parse_user_id(F.col("user_id_raw"))
    return raw.select("request_id", ids["session_id"].alias("session_id"),
                      ids["account_id"].alias("account_id"))


@query("beta_split")
def q_beta_split(spark, d):
    raw = usage_raw(spark, d)
    b = F.col("beta_requested")
    return raw.select("request_id", beta_stripped(b).alias("beta_stripped"),
                      beta_forwarded(b).alias("beta_forwarded"))


@query("usage_fold")
def q_usage_fold(spark, d):
    return fact_table(spark, d).select(
        "request_id", "upstream_model", "input_tokens", "output_tokens", "cache_read_tokens",
        "cache_creation_tokens", "total_tokens", "cache_hit_ratio", "est_cost_micro_usd",
        "est_anthropic_cost_usd", "copilot_premium_multiplier", "ttft_ms",
        "output_tokens_per_sec", "tavily_cost_usd")


@query("error_features")
def q_error_features(spark, d):
    return fact_table(spark, d).select("request_id", "route", "status", "error_type", "completed",
                                       "upstream_host", "beta_stripped")


# --- search spend (A-18, W-1, J-5) ----------------------------------------------
@query("search_spend_daily")
def q_search_spend_daily(spark, d):
    return spend.daily_search_spend(fact_table(spark, d))


@query("search_spend_running")
def q_search_spend_running(spark, d):
    return spend.running_search_spend(fact_table(spark, d))


# --- model catalog (A-9, A-10) ----------------------------------------------------
@query("latest_model_per_tier")
def q_latest_model_per_tier(spark, d):
    return catalog.latest_per_tier(catalog.observed_catalog(fact_table(spark, d)))


@query("family_map")
def q_family_map(spark, d):
    return catalog.family_map(catalog.observed_catalog(fact_table(spark, d)))


# --- conversations and content blocks (A-6, A-7, W-5, P-25, J-6) ---------------
def conversations(spark, d):
    return read_table(spark, d, "conversations")


def content_blocks(spark, d):
    return bridges.blocks(conversations(spark, d))


@query("role_counts")
def q_role_counts(spark, d):
    return messages.role_counts(conversations(spark, d))


@query("last_user_message")
def q_last_user_message(spark, d):
    return messages.last_user_message(conversations(spark, d))


@query("tool_use_counts")
def q_tool_use_counts(spark, d):
    return messages.tool_use_counts(content_blocks(spark, d))


@query("tool_use_summary")
def q_tool_use_summary(spark, d):
    return messages.tool_use_summary(content_blocks(spark, d))


@query("read_paths")
def q_read_paths(spark, d):
    return messages.read_paths(content_blocks(spark, d))


@query("tool_pairing")
def q_tool_pairing(spark, d):
    return messages.tool_pairs(content_blocks(spark, d))


@query("tool_pairing_summary")
def q_tool_pairing_summary(spark, d):
    return messages.tool_pair_summary(content_blocks(spark, d))


# --- the same from request bodies: message and block tables of real payloads -----
@query("body_role_counts")
def q_body_role_counts(spark, d):
    return messages.role_counts(messages.message_rows(request_bodies(spark, d)), "request_id")


@query("body_last_user_message")
def q_body_last_user_message(spark, d):
    """W-5 and P-25 over block content: the text blocks of the last user message, joined by a blank."""
    blocks = messages.block_rows(bridges.block_bodies(conversations(spark, d)), "conv_id")
    return messages.last_user_message(messages.message_texts(blocks, "conv_id"))


@query("body_tool_uses")
def q_body_tool_uses(spark, d):
    blocks = messages.block_rows(bridges.block_bodies(conversations(spark, d)), "conv_id")
    return messages.tool_use_summary(blocks).join(messages.read_paths(blocks), "conv_id", "left")


@query("body_tool_pairs")
def q_body_tool_pairs(spark, d):
    return messages.tool_pairs(messages.block_rows(bridges.block_bodies(conversations(spark, d)), "conv_id"))


# --- SSE captures (SRC-4, A-11..A-16) -------------------------------------------
@query("sse_facts")
def q_sse_facts(spark, d):
    f = sse.facts_from_raw(bridges.sse_raw(conversations(spark, d)), ["conv_id", "turn"])
    return f.select("conv_id", "turn", "text", "input_tokens", "output_tokens",
                    "cache_read_input_tokens", "stop_reason", "message_id",
                    F.array_join("tool_names", ",").alias("tool_names"), "completed")


# --- session titles (SRC-3, A-8, J-2) -------------------------------------------
@query("session_titles")
def q_session_titles(spark, d):
    return sessions.session_titles(bridges.title_jsonl_lines(conversations(spark, d)))


@query("requests_with_titles")
def q_requests_with_titles(spark, d):
    titles = sessions.session_titles(bridges.title_jsonl_lines(conversations(spark, d)))
    fact = fact_table(spark, d)
    calls = fact.select("request_id", bridges.transcript_session_of(F.col("request_id"), bridges.conversation_count(conversations(spark, d)))
                        .alias("session_id"), "session_name")
    return sessions.attach_titles(calls, titles)


@query("transcript_titles")
def q_transcript_titles(spark, d):
    """SRC-3: titles read from transcript files of two projects; the first project with a title wins."""
    path = sinks.new_table_path(spark, "transcripts")
    found = sinks.write_transcripts(bridges.transcript_files(conversations(spark, d)), path)
    return sessions.session_titles(sessions.read_transcripts(spark, path, **found))


# --- request bodies (SRC-5, SRC-8, P-5..P-8, P-11, P-12, P-20, P-21) -------------
def request_bodies(spark, d):
    return bridges.request_bodies(read_table(spark, d, "events"), conversations(spark, d))


@query("request_features")
def q_request_features(spark, d):
    f = bodies.body_features(request_bodies(spark, d))
    return f.select("request_id", "n_messages", "system_bytes", "tool_count",
                    F.array_join("tool_names", ",").alias("tool_names"), "max_tokens",
                    "temperature", "top_p", "top_k", "thinking_enabled", "thinking_budget",
                    "stream", "search_only")


@query("unknown_fields")
def q_unknown_fields(spark, d):
    u = bodies.unknown_body_fields(request_bodies(spark, d))
    return u.select("request_id", F.array_join("unknown_fields", ",").alias("unknown_fields"))


@query("search_query")
def q_search_query(spark, d):
    return bodies.search_query(request_bodies(spark, d))


@query("body_rejects")
def q_body_rejects(spark, d):
    return bodies.body_rejects(request_bodies(spark, d)).select("request_id", "reject_reason")


@query("normalise_bodies")
def q_normalise_bodies(spark, d):
    n = bodies.normalise_bodies(request_bodies(spark, d))
    return n.select("request_id", "original_model", "model", "modified")


@query("forwarded_bodies")
def q_forwarded_bodies(spark, d):
    """P-7: the text of every forwarded body."""
    return bodies.normalise_bodies(request_bodies(spark, d)).select("request_id", "body")


@query("shape_by_model")
def q_shape_by_model(spark, d):
    """The fact table with request-shape columns filled from the bodies."""
    events = read_table(spark, d, "events")
    feats = bodies.body_features(request_bodies(spark, d))
    fact = build_telemetry(bridges.calls_from_usage_raw(bridges.usage_raw(events)),
                           body_features=feats)
    return (fact.groupBy("upstream_model")
            .agg(F.count(F.lit(1)).alias("calls"),
                 F.sum(F.col("n_messages").cast("long")).alias("messages"),
                 F.sum(F.col("tool_count").cast("long")).alias("tools"),
                 F.sum(F.col("system_bytes").cast("long")).alias("system_bytes"),
                 F.count_if(F.col("thinking_enabled")).alias("thinking_calls"),
                 F.sum(F.col("max_tokens").cast("long")).alias("max_tokens")))


# --- chat-format conversion (C-1, C-2) --------------------------------------------
@query("chat_requests")
def q_chat_requests(spark, d):
    """C-1 over the landed request bodies (string content, system, tools)."""
    c = convert.to_chat_request(request_bodies(spark, d))
    msgs = F.col("chat_messages")
    first = F.try_element_at(msgs, F.lit(1))
    return c.select(
        "request_id", "model",
        F.size(msgs).cast("long").alias("n_chat_messages"),
        F.array_join(F.transform(msgs, lambda m: m["role"]), ",").alias("chat_roles"),
        F.when(first["role"] == "system", first["content"]).alias("system_content"),
        F.aggregate(msgs, F.lit(0).cast("long"),
                    lambda acc, m: acc + F.coalesce(F.char_length(m["content"]), F.lit(0)))
        .alias("content_chars"),
        "max_tokens", F.coalesce(F.col("stream"), F.lit(False)).alias("stream"),
        "temperature", "top_p",
        F.coalesce(F.array_join(F.transform("tools", lambda t: t["function"]["name"]), ","),
                   F.lit("")).alias("chat_tools"))


@query("chat_bodies")
def q_chat_bodies(spark, d):
    """C-1: the text of every converted request body."""
    return convert.to_chat_request(request_bodies(spark, d)).select("request_id", "chat_body")


@query("tool_arguments")
def q_tool_arguments(spark, d):
    """C-1: arguments keep the client's key order, in the gateway's serialisation."""
    c = convert.to_chat_request(bridges.ordered_tool_bodies(conversations(spark, d)), key=["conv_id", "turn"])
    calls = F.element_at("chat_messages", -1)["tool_calls"]
    return c.select("conv_id", "turn", F.array_join(F.transform(calls, lambda t: t["function"]["name"]), ",").alias("names"),
                    calls[0]["function"]["arguments"].alias("first_arguments"),
                    calls[1]["function"]["arguments"].alias("second_arguments"))


@query("message_bodies")
def q_message_bodies(spark, d):
    """C-2: the text of every converted response."""
    return convert.from_chat_response(bridges.chat_responses(conversations(spark, d)), key=["conv_id", "turn"]).select(
        "conv_id", "turn", "message")


@query("chat_from_blocks")
def q_chat_from_blocks(spark, d):
    """C-1 over block-content bodies: tool results before user text, tool calls."""
    c = convert.to_chat_request(bridges.block_bodies(conversations(spark, d)), key="conv_id")
    msgs = F.col("chat_messages")
    no_calls = F.array().cast(T.ArrayType(convert.TOOL_CALL))
    calls = F.flatten(F.transform(msgs, lambda m: F.coalesce(m["tool_calls"], no_calls)))
    return c.select(
        "conv_id",
        F.size(msgs).cast("long").alias("n_chat_messages"),
        F.array_join(F.transform(msgs, lambda m: m["role"]), ",").alias("chat_roles"),
        F.array_join(F.transform(msgs, lambda m: m["tool_call_id"]), ",").alias("tool_result_ids"),
        F.array_join(F.transform(calls, lambda t: t["id"]), ",").alias("tool_call_ids"),
        F.array_join(F.transform(calls, lambda t: t["function"]["arguments"]), "|").alias("tool_call_args"),
        F.size(calls).cast("long").alias("n_tool_calls"))


@query("chat_responses_to_messages")
def q_chat_responses_to_messages(spark, d):
    """C-2 over chat-completions responses of every assistant turn."""
    m = convert.from_chat_response(bridges.chat_responses(conversations(spark, d)),
                                   key=["conv_id", "turn"])
    blocks = F.col("content")
    tools = F.filter(blocks, lambda b: b["type"] == "tool_use")
    first = F.try_element_at(blocks, F.lit(1))
    return m.select(
        "conv_id", "turn", "message_id",
        F.when(first["type"] == "text", first["text"]).alias("text"),
        F.size(blocks).cast("long").alias("n_blocks"),
        F.array_join(F.transform(tools, lambda b: b["name"]), ",").alias("tool_names"),
        F.array_join(F.transform(tools, lambda b: F.to_json(b["input"])), "|").alias("tool_inputs"),
        "stop_reason", "input_tokens", "output_tokens")


# --- request log (SRC-1, SNK-4) -----------------------------------------------------
def request_log(spark, d):
    return request_log_mod.parse_log_lines(bridges.request_log_lines(read_table(spark, d, "events")))


@query("rebuild_from_log")
def q_rebuild_from_log(spark, d):
    """SNK-4: the telemetry columns the log can give back, rebuilt from it."""
    return _rebuilt(request_log(spark, d))


def _rebuilt(parsed):
    f = request_log_mod.rebuild_telemetry(parsed)
    return f.select("ts", "session_id", "account_id", "upstream_model", "route", "n_messages",
                    "max_tokens", "stream", "tool_count",
                    F.array_join("tool_names", ",").alias("tool_names"),
                    "req_bytes", "resp_bytes", "status", "elapsed_ms", "input_tokens",
                    "output_tokens", "cache_read_tokens", "cache_creation_tokens", "total_tokens",
                    "est_cost_micro_usd", "tavily_cost_usd", "stop_reason")


@query("log_line_kinds")
def q_log_line_kinds(spark, d):
    """SRC-1: lines per shape (malformed, passthrough, search, translated, native)."""
    p = request_log(spark, d)
    e = F.col("entry")
    kind = (F.when(F.col("corrupt"), F.lit("corrupt"))
            .when(e["request"]["passthrough"].isNotNull(), F.lit("passthrough"))
            .when(F.coalesce(e["response"]["tavily"], F.lit(False)), F.lit("search"))
            .when(F.coalesce(e["response"]["translated"], F.lit(False)), F.lit("translated"))
            .otherwise(F.lit("native")))
    return p.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("lines"))


# --- sinks (SNK-1, SNK-2) ---------------------------------------------------------
def _keyed_fact(spark, d):
    f = fact_table(spark, d)
    return f.withColumn("_n", F.substring("request_id", 5, 1 << 20).cast("long")) \
            .withColumn("day", F.to_date("ts"))


@query("dedupe_append")
def q_dedupe_append(spark, d):
    """SNK-1: batch A (calls with n % 3 != 1) written twice (a replay), then
    batch B (every call, calls with n % 5 = 0 twice in the batch).  Each call
    must be stored once, by the first batch and the first copy that had it, also
    when batch B dates it a day later (n % 4 = 0) or not at all (n % 7 = 0)."""
    f = _keyed_fact(spark, d)
    cols = ["request_id", "ts", "day"]
    a = f.where(F.col("_n") % 3 != 1).select(*cols, F.lit("A").alias("batch"), F.lit(0).alias("copy"))
    b = (f.select(*cols, F.lit("B").alias("batch"), F.lit(0).alias("copy"))
         .unionByName(f.where(F.col("_n") % 5 == 0)
                      .select(*cols, F.lit("B").alias("batch"), F.lit(1).alias("copy"))))
    n = F.substring("request_id", 5, 1 << 20).cast("long")
    b = b.withColumn("day", F.when(n % 7 == 0, F.lit(None).cast("date"))
                     .when(n % 4 == 0, F.date_add("day", 1)).otherwise(F.col("day")))
    path = sinks.new_table_path(spark, "dedupe_append")
    for batch in (a, a, b, b):
        sinks.dedupe_append(batch, path, "request_id", ["copy"], partition_col="day")
    return spark.read.parquet(path).select("request_id", "ts", "batch", "copy")


@query("evolve_schema")
def q_evolve_schema(spark, d):
    """SNK-2: even calls written with four columns, odd calls with two more;
    read back with the merged schema."""
    f = _keyed_fact(spark, d)
    old = f.where(F.col("_n") % 2 == 0).select("request_id", "route", "status", "day")
    new = f.where(F.col("_n") % 2 == 1).select("request_id", "route", "status", "elapsed_ms",
                                                "stream", "day")
    path = sinks.new_table_path(spark, "evolve_schema")
    sinks.append_evolving(old, path, partition_col="day")
    sinks.append_evolving(new, path, partition_col="day")
    return (spark.read.option("mergeSchema", "true").parquet(path)
            .select("request_id", "route", "status", "elapsed_ms", "stream"))


# --- streaming (ST-1, ST-2, ST-3, ST-5, ST-7) ---------------------------------------
MICRO_BATCHES = 3
REJECT_FILES = 16


def _land_calls(spark, d, name):
    """Land B1's call records as one file per shuffle partition, dealt by a hash of the
    call, so each file holds calls of the whole period (arrival out of time order)."""
    raw = bridges.calls_from_usage_raw(usage_raw(spark, d))
    path = sinks.new_table_path(spark, f"{name}-landing")
    raw.repartition(F.xxhash64("request_id")).write.parquet(path)
    return path


def _call_stream(spark, landing):
    """The landed files in ``MICRO_BATCHES`` micro-batches, however many files there are."""
    files = spark.read.parquet(landing)
    n = files.select("_metadata.file_path").distinct().count()
    return (spark.readStream.schema(files.schema).option("maxFilesPerTrigger", str(max(1, -(-n // MICRO_BATCHES))))
            .parquet(landing))


@query("stream_ingest")
def q_stream_ingest(spark, d):
    """ST-1/2/5: stream the landed calls in three micro-batches until drained;
    then replay all of it under a fresh checkpoint: no call may appear twice."""
    landing = _land_calls(spark, d, "stream_ingest")
    table = sinks.new_table_path(spark, "stream_ingest")
    for run in ("first", "replay"):
        ckpt = sinks.new_table_path(spark, f"stream_ingest-ckpt-{run}")
        ingest.run_to_end(ingest.ingest_calls(_call_stream(spark, landing), table, ckpt))
    return spark.read.parquet(table).select(
        "request_id", "route", "status", "upstream_model", "input_tokens", "output_tokens",
        "total_tokens", "est_cost_micro_usd")


@query("stream_daily_spend")
def q_stream_daily_spend(spark, d):
    """ST-7: daily search spend of the ingested table, after a replay of everything."""
    landing = _land_calls(spark, d, "stream_daily_spend")
    table = sinks.new_table_path(spark, "stream_daily_spend")
    for run in ("first", "replay"):
        ckpt = sinks.new_table_path(spark, f"stream_daily_spend-ckpt-{run}")
        ingest.run_to_end(ingest.ingest_calls(_call_stream(spark, landing), table, ckpt))
    return ingest.daily_spend(spark, table)


def _land_in_time_order(spark, rows, name, slices):
    """Land rows as one file per slice of their time, in that order."""
    path = sinks.new_table_path(spark, f"{name}-landing")
    first, last = rows.agg(F.unix_micros(F.min(F.col("ts").cast("timestamp"))),
                           F.unix_micros(F.max(F.col("ts").cast("timestamp")))).first()
    width = ((last or 0) - (first or 0)) // slices + 1
    part = F.floor((F.unix_micros(F.col("ts").cast("timestamp")) - F.lit(first or 0)) / width)
    for i in range(slices):
        yield path, rows.where(part == i), rows.where(part == i - 1)


@query("stream_ingest_bounded")
def q_stream_ingest_bounded(spark, d):
    """ST-2 with bounded state: every slice of five days comes with the one before once more."""
    raw = bridges.calls_from_usage_raw(usage_raw(spark, d))
    for landing, now, again in _land_in_time_order(spark, raw, "stream_ingest_bounded", 6):
        now.unionByName(again).coalesce(1).write.mode("append").parquet(landing)
    stream = spark.readStream.schema(raw.schema).option("maxFilesPerTrigger", "1").parquet(landing)
    place = sinks.new_table_path(spark, "stream_ingest_bounded")
    ingest.run_to_end(ingest.ingest_within_watermark(stream, f"{place}/facts", f"{place}/ckpt", "11 days"))
    return spark.read.parquet(f"{place}/facts").select(
        "request_id", "route", "status", "upstream_model", "input_tokens", "output_tokens",
        "total_tokens", "est_cost_micro_usd")


@query("stream_running_spend")
def q_stream_running_spend(spark, d):
    """ST-7: the day's spend so far on every paid search as it arrives, over seven micro-batches that cut days."""
    fact = fact_table(spark, d).select("request_id", "ts", "route", "tavily_cost_usd")
    for landing, now, _ in _land_in_time_order(spark, fact, "stream_running_spend", 7):
        now.coalesce(1).write.mode("append").parquet(landing)
    stream = spark.readStream.schema(fact.schema).option("maxFilesPerTrigger", "1").parquet(landing)
    place = sinks.new_table_path(spark, "stream_running_spend")
    ingest.run_to_end(ingest.running_spend(stream, f"{place}/totals", f"{place}/rows", f"{place}/ckpt"))
    return spark.read.parquet(f"{place}/rows").select("request_id", "ts", "day", "cost_usd", "spend_today_usd")


@query("stream_rejects")
def q_stream_rejects(spark, d):
    """ST-3: calls that cannot be stored, by reason: no key, or token counts beyond the table's type."""
    raw = bridges.calls_from_usage_raw(usage_raw(spark, d))
    n = F.substring("request_id", 5, 1 << 20).cast("long")
    raw = raw.withColumn("output_tokens", F.when(n % 4999 == 17, F.lit(1 << 40)).otherwise(F.col("output_tokens")))
    raw = raw.withColumn("call", F.col("request_id")).withColumn(
        "request_id", F.when(n % 1000 != 3, F.col("request_id")))
    place = sinks.new_table_path(spark, "stream_rejects")
    # two micro-batches of as many files as tasks may write and read at once
    raw.repartition(2 * REJECT_FILES, F.xxhash64("call")).write.parquet(f"{place}/landing")
    stream = (spark.readStream.schema(raw.schema).option("maxFilesPerTrigger", str(REJECT_FILES))
              .parquet(f"{place}/landing"))
    ingest.run_to_end(ingest.ingest_calls(stream, f"{place}/facts", f"{place}/ckpt", rejects_path=f"{place}/rejects"))
    rejects = spark.read.option("recursiveFileLookup", "true").parquet(f"{place}/rejects")
    stored = spark.read.parquet(f"{place}/facts").select("request_id", F.lit(None).cast("string").alias("reason"))
    reason = F.when(F.col("reject_reason") == "no_request_id", F.col("reject_reason")).otherwise(F.lit("bad_value"))
    return stored.unionByName(rejects.select(F.col("call").alias("request_id"), reason.alias("reason")))


@query("stored_facts")
def q_stored_facts(spark, d):
    """SRC-2: the stored fact table joined to stored body features by bucket, read for three days."""
    place = sinks.new_table_path(spark, "stored_facts")
    suffix = place.rsplit("-", 1)[1]
    fact_store.write_bucketed(fact_table(spark, d), f"facts_{suffix}", f"{place}/facts")
    features = fact_store.write_bucketed(bodies.body_features(request_bodies(spark, d)), f"features_{suffix}",
                                         f"{place}/features", day=False)
    facts = spark.table(f"facts_{suffix}").where("day BETWEEN DATE'2024-01-03' AND DATE'2024-01-05'")
    joined = attach_body_features(facts, features)
    return (joined.groupBy(F.to_date("ts").alias("day"), "upstream_model")
            .agg(F.count(F.lit(1)).alias("calls"), F.sum(F.col("n_messages").cast("long")).alias("messages"),
                 F.sum(F.col("tool_count").cast("long")).alias("tools"),
                 F.sum(F.col("total_tokens").cast("long")).alias("tokens")))


# --- SSE reads (ST-8 batch, W-3, P-18) -------------------------------------------------
@query("sse_chunk_facts")
def q_sse_chunk_facts(spark, d):
    """Stream facts and TTFT from 7-byte reads of every captured stream."""
    f = sse.facts_from_chunks(bridges.sse_chunks(conversations(spark, d)), ["conv_id", "turn"])
    return f.select("conv_id", "turn", "text", "message_id", "stop_reason", "completed", "ttft_ms")


# --- search results (P-22, P-23, S-4, C-5) ---------------------------------------------
def rendered_searches(spark, d):
    return search.render_searches(bridges.search_responses(read_table(spark, d, "pages")))


@query("search_markdown")
def q_search_markdown(spark, d):
    r = rendered_searches(spark, d)
    return r.select("search_id", "query", F.col("n_results").cast("long").alias("n_results"),
                    F.array_join(F.transform("blocks", lambda b: b["url"]), " ").alias("result_urls"),
                    "markdown")


@query("search_events")
def q_search_events(spark, d):
    """C-5, read back through the SSE reader: the text deltas restore the
    Markdown, and the stream has 10 events plus one per 4096 characters."""
    r = rendered_searches(spark, d).select(
        "search_id", "sse", (F.size(F.split("sse", "\n\n")) - 1).cast("long").alias("n_events"))
    f = sse.facts_from_raw(r, ["search_id", "n_events"], raw_col="sse")
    return f.select("search_id", "n_events", F.col("text").alias("markdown"), "message_id",
                    "stop_reason", "completed", F.array_join("tool_names", ",").alias("tool_names"))


# --- summaries (P-9, P-24, P-26, P-27, P-28, P-30, P-31) -------------------------------
@query("request_summaries")
def q_request_summaries(spark, d):
    s = summaries.request_summaries(request_bodies(spark, d), log_content=True)
    e = F.col("log_entry")
    return s.select("request_id", "summary",
                    F.coalesce(F.array_join(e["tools"], ","), F.lit("")).alias("log_tools"),
                    e["user_id"].alias("log_user_id"), e["last_user_message"].alias("log_last_user"),
                    "is_responses", "n_input", "est_tokens")


@query("call_summaries")
def q_call_summaries(spark, d):
    return summaries.call_lines(request_log_mod.rebuild_telemetry(request_log(spark, d))) \
        .select("ts", "summary", "req_size", "resp_size")


# --- chat stream conversion (C-3, A-19) ------------------------------------------------
@query("chat_sse_to_events")
def q_chat_sse_to_events(spark, d):
    """C-3 over collected chat streams, read back through the SSE reader."""
    keys = ["conv_id", "turn"]
    ev = chat_stream.convert_chat_streams(bridges.chat_sse_raw(conversations(spark, d)), keys)
    idx = F.regexp_extract("events", r'"index": ([0-9]+), "content_block": \{"type": "tool_use"', 1)
    ev = ev.select(*keys, "events",
                   F.when(idx != "", idx.cast("long")).alias("tool_block_index"))
    f = sse.facts_from_raw(ev, [*keys, "tool_block_index"], raw_col="events")
    return f.select(*keys, "text", "message_id", "stop_reason", "input_tokens", "output_tokens",
                    F.array_join("tool_names", ",").alias("tool_names"), "tool_block_index",
                    "completed")


# --- routing (P-29) -------------------------------------------------
@query("route_derivation")
def q_route_derivation(spark, d):
    """P-29 under three policies: search key set; search key set and a forced
    non-Claude upstream model; no search key."""
    f = bodies.body_features(request_bodies(spark, d))
    so = F.col("search_only")
    default, forced = ModelPolicy(), ModelPolicy(upstream_model="gpt-5-mini")
    return f.select(
        "request_id",
        derive_route(default, True, so).alias("route_default"),
        derive_route(forced, True, so).alias("route_forced_model"),
        derive_route(default, False, so).alias("route_no_search_key"))


@query("forced_model_facts")
def q_forced_model_facts(spark, d):
    """P-29: a forced upstream model stands in the fact row of every call but searches, and prices it."""
    return fact_table(spark, d, ModelPolicy(upstream_model="claude-haiku-4.5")).select(
        "request_id", "requested_model", "upstream_model", (F.col("est_cost_micro_usd") > 0).alias("priced"))


@query("error_codes")
def q_error_codes(spark, d):
    """P-19: all three codes; every third translated call had no credentials."""
    calls = bridges.calls_from_usage_raw(usage_raw(spark, d))
    has_auth = ~((F.col("route") == "openai") & (F.substring("request_id", 5, 1 << 20).cast("long") % 3 == 0))
    calls = calls.withColumn("has_auth", has_auth).withColumn("status", F.when(has_auth, F.col("status")).otherwise(503))
    return build_telemetry(calls).select("request_id", "status", "error_type")


@query("responses_bodies")
def q_responses_bodies(spark, d):
    """P-28: bodies of the Responses kind among others (an input that is null counts, messages decide first)."""
    n = F.col("event_id")
    body = (F.when(n % 5 == 0, F.lit('{"model":"m","input":"text"}')).when(n % 5 == 1, F.lit('{"input":[{"a":1},{}]}'))
            .when(n % 5 == 2, F.lit('{"input":null}')).when(n % 5 == 3, F.lit('{"messages":[{"role":"user"}],"input":"x"}'))
            .otherwise(F.lit('{"messages":[]}')))
    landed = read_table(spark, d, "events").select(F.concat(F.lit("req_"), n.cast("string")).alias("request_id"), body.alias("body"))
    features = bodies.body_features(landed).select("request_id", "is_responses_body")
    # both sides grow with the calls: neither is broadcast, however small the planner guesses it
    return (summaries.request_summaries(landed).join(features.hint("merge"), "request_id")
            .select("request_id", "is_responses", "is_responses_body", "n_input"))


@query("response_previews")
def q_response_previews(spark, d):
    """P-26 and P-30 with content logging on: streams, bodies, and every fourth body that could not be read."""
    f = sse.facts_from_raw(bridges.sse_raw(conversations(spark, d)), ["conv_id", "turn"])
    status = F.when(F.col("turn") % 5 == 4, 500).otherwise(200)
    return f.select("conv_id", "turn", summaries.response_summary(
        status, F.col("conv_id") % 2 == 0, F.col("input_tokens"), F.col("output_tokens"),
        F.col("cache_read_input_tokens"), F.col("stop_reason"), F.col("text"), F.col("text"),
        F.col("turn") % 4 != 3).alias("summary"))


@query("oversized_bodies")
def q_oversized_bodies(spark, d):
    """SRC-8: bodies over the limit are refused unread, before every parser."""
    n = F.col("event_id")
    body = F.concat(F.lit('{"model":"gpt-5-mini","messages":[],"pad":"'), F.repeat(F.lit("x"), (n % 3000).cast("int")), F.lit('"}'))
    landed = read_table(spark, d, "events").select(F.concat(F.lit("req_"), n.cast("string")).alias("request_id"), body.alias("body"))
    refused = bodies.body_rejects(landed, max_bytes=2000).select("request_id", "req_bytes", F.col("reject_reason").alias("outcome"))
    converted = convert.to_chat_request(landed, max_bytes=2000).join(landed, "request_id").select(
        "request_id", F.octet_length("body").alias("req_bytes"), F.lit("converted").alias("outcome"))
    return refused.unionByName(converted)


@query("catalog_files")
def q_catalog_files(spark, d):
    """SRC-6: the observed models as a landed catalog payload, read back from its file; newest per tier."""
    seen = catalog.observed_catalog(fact_table(spark, d))
    path = sinks.new_table_path(spark, "catalog")
    listed = seen.agg(F.array_sort(F.collect_list(F.struct("pos", "id"))).alias("m"))  # one entry per model name
    listed.select(F.to_json(F.struct(F.transform("m", lambda x: F.struct(x["id"].alias("id"))).alias("data"))).alias("value")) \
        .write.text(path)
    return catalog.latest_per_tier(catalog.catalog_from_json(spark.read.option("wholetext", "true").text(path)))


@query("log_files")
def q_log_files(spark, d):
    """SNK-3, SRC-1: the log written to files and read back, rebuilt."""
    path = sinks.new_table_path(spark, "log")
    lines = bridges.request_log_lines(read_table(spark, d, "events"))
    request_log_mod.write_request_log(lines, path, "value")
    return _rebuilt(request_log_mod.read_request_log(spark, path))


@query("stream_ingest_titles")
def q_stream_ingest_titles(spark, d):
    """ST-6: the streaming ingest with session titles joined per micro-batch."""
    landing = _land_calls(spark, d, "stream_ingest_titles")
    n_conv = bridges.conversation_count(conversations(spark, d))
    table = sinks.new_table_path(spark, "stream_ingest_titles")
    ckpt = sinks.new_table_path(spark, "stream_ingest_titles-ckpt")
    cache = ingest.TitleCache(
        lambda: sessions.session_titles(bridges.title_jsonl_lines(conversations(spark, d))),
        sinks.new_table_path(spark, "titles"))
    q = ingest.ingest_calls(_call_stream(spark, landing), table, ckpt, titles=cache,
                            title_key=lambda f: bridges.transcript_session_of(f["request_id"], n_conv))
    ingest.run_to_end(q)
    t = spark.read.parquet(table)
    return t.select("request_id", bridges.transcript_session_of(F.col("request_id"), n_conv).alias("session_id"),
                    "session_name")


# --- Responses stream conversion (C-4) ----------------------------------------------------
@query("responses_to_chat")
def q_responses_to_chat(spark, d):
    """C-4 over collected Responses streams, then C-3 and the SSE reader: the
    chat chunks must carry the text, tool call, finish and usage through."""
    keys = ["conv_id", "turn"]
    chat_id = F.concat(F.lit("chatcmpl-"), F.col("conv_id").cast("string"), F.lit("-"),
                       F.col("turn").cast("string"))
    created = F.lit(bridges.STREAM_EPOCH_S).cast("long") + F.col("conv_id") * 3600
    chunks = chat_stream.convert_responses_streams(
        bridges.responses_sse_raw(conversations(spark, d)), keys, chat_id, created)
    ev = chat_stream.convert_chat_streams(chunks, keys, raw_col="chunks")
    idx = F.regexp_extract("events", r'"index": ([0-9]+), "content_block": \{"type": "tool_use"', 1)
    ev = ev.select(*keys, "events", F.when(idx != "", idx.cast("long")).alias("tool_block_index"))
    f = sse.facts_from_raw(ev, [*keys, "tool_block_index"], raw_col="events")
    return f.select(*keys, "text", "message_id", "stop_reason", "input_tokens", "output_tokens",
                    F.array_join("tool_names", ",").alias("tool_names"), "tool_block_index",
                    "completed")


# --- streams assembled while they arrive (ST-8, ST-9) ------------------------------------
STREAM_KEYS = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType())])
LIVE_SLICES = 4
LIVE_IDLE_S = 60.0


def _land_live_reads(spark, d, name):
    """Land live reads in slices of arrival time, two files each; every slice repeats a fifth of the one before."""
    reads = bridges.live_reads(conversations(spark, d)).persist()
    path = sinks.new_table_path(spark, f"{name}-reads")
    first, last = reads.agg(F.unix_micros(F.min("arrival_ts")), F.unix_micros(F.max("arrival_ts"))).first()
    width = ((last or 0) - (first or 0)) // LIVE_SLICES + 1
    part = F.floor((F.unix_micros("arrival_ts") - F.lit(first or 0)) / width)
    for i in range(LIVE_SLICES):
        again = (part == i - 1) & (F.col("seq") % 5 == 0)
        (reads.where((part == i) | again).repartition(2, F.xxhash64("conv_id", "turn", "seq"))
         .write.mode("append").parquet(path))
    reads.unpersist()
    return path


def _read_stream(spark, path):
    return (spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", "3").parquet(path))


@query("stream_assembly")
def q_stream_assembly(spark, d):
    """ST-8: facts of streams whose reads arrive over several micro-batches, out of order and repeated."""
    reads = _land_live_reads(spark, d, "stream_assembly")
    place = sinks.new_table_path(spark, "stream_assembly")
    store = assembly.StreamStore(spark, f"{place}/store", STREAM_KEYS)
    facts = f"{place}/facts"
    ingest.run_to_end(assembly.assemble_stream(_read_stream(spark, reads), store, facts, f"{place}/ckpt", LIVE_IDLE_S))
    assembly.close_open_streams(store, assembly.facts_folder(facts, "batch=closing"))
    return spark.read.parquet(facts).select(
        "conv_id", "turn", "text", "message_id", "stop_reason", "completed", "ttft_ms")


def _stream_calls(facts):
    """Call records of streams: the call row of the gateway with the stream's facts on it."""
    return facts.select(
        F.concat(F.lit("conv_"), F.col("conv_id").cast("string"), F.lit("_"),
                 F.col("turn").cast("string")).alias("request_id"),
        F.col("start").alias("ts"), F.lit(None).cast("string").alias("user_id_raw"),
        F.lit("claude-sonnet-4-6").alias("requested_model"), F.lit("native").alias("route"),
        F.lit(None).cast("string").alias("beta_requested"),
        "input_tokens", "output_tokens", "cache_read_input_tokens", "cache_creation_input_tokens",
        "cache_creation_5m", "cache_creation_1h", "web_search_requests",
        F.lit(True).alias("stream"), F.lit(200).alias("status"), "elapsed_ms", "ttft_ms",
        "stop_reason", "completed", F.col("message_id").alias("response_message_id"),
        F.col("tool_names").alias("response_tool_names"))


def _stream_fact_columns(fact):
    return fact.select("request_id", "upstream_model", "input_tokens", "output_tokens", "total_tokens",
                       "est_cost_micro_usd", "stop_reason", "completed", "response_message_id",
                       F.array_join("response_tool_names", ",").alias("response_tool_names"), "ttft_ms",
                       "cache_creation_5m", "cache_creation_1h", "web_search_requests")


@query("live_fact_rows")
def q_live_fact_rows(spark, d):
    """ST-9: one fact row per stream as it ends; streams that never end are closed when idle, with
    ``completed`` false, and their stragglers add no second row."""
    reads = _land_live_reads(spark, d, "live_fact_rows")
    place = sinks.new_table_path(spark, "live_fact_rows")
    store = assembly.StreamStore(spark, f"{place}/store", STREAM_KEYS)
    to_rows = lambda facts: build_telemetry(_stream_calls(facts)).withColumn("day", F.to_date("ts"))
    run = lambda: ingest.run_to_end(assembly.live_facts(
        _read_stream(spark, reads), store, f"{place}/facts", f"{place}/ckpt", to_rows, LIVE_IDLE_S))
    run()
    assembly.close_open_streams(store, assembly.fact_table(f"{place}/facts", to_rows))
    # stragglers of the streams that never ended: one more read of each, after it was closed
    landed = spark.read.parquet(reads)
    late = (landed.where((F.col("conv_id") + F.col("turn")) % 11 == 0).groupBy("conv_id", "turn", "start_ts")
            .agg((F.max("seq") + 1).alias("seq"), (F.max("arrival_ts") + F.expr("interval 1 hour")).alias("arrival_ts"))
            .withColumn("chunk", F.lit(b'data: {"type": "message_stop"}\n')))
    late.select(*landed.columns).coalesce(1).write.mode("append").parquet(reads)
    run()
    assembly.close_open_streams(store, assembly.fact_table(f"{place}/facts", to_rows))
    return _stream_fact_columns(spark.read.parquet(f"{place}/facts"))


# --- stream facts folded on the call row (A-20, ST-9 as batch) --------------------------
@query("stream_fact_rows")
def q_stream_fact_rows(spark, d):
    """A-20: one telemetry row per captured native stream, from its reads:
    usage, stop reason, message id, tools, completion, TTFT and elapsed time
    folded on the call record, then priced."""
    keys = ["conv_id", "turn"]
    f = sse.facts_from_chunks(bridges.sse_chunks(conversations(spark, d)), keys)
    start = F.timestamp_seconds(F.lit(bridges.STREAM_EPOCH_S) + F.col("conv_id") * 3600
                                + F.col("turn") * 60)
    return _stream_fact_columns(build_telemetry(_stream_calls(f.withColumn("start", start))))


# --- fact rows of every route (A-17, A-20, U-2, P-14, P-19, P-24) -----------------------
@query("response_fact_rows")
def q_response_fact_rows(spark, d):
    """Native responses, native streams, translated responses and search answers as one fact table."""
    conv = conversations(spark, d)
    ident = F.concat(F.col("conv_id").cast("string"), F.lit("_"), F.col("turn").cast("string"))
    keyed = lambda df, kind: df.withColumn("request_id", F.concat(F.lit(kind), ident))
    chat = bridges.chat_responses(conv)
    native = keyed(bridges.message_responses(conv), "n_")
    streams, translated = keyed(bridges.sse_raw(conv), "s_"), keyed(chat, "t_")
    found = rendered_searches(spark, d).withColumn("request_id", F.concat(F.lit("q_"), F.col("search_id").cast("string")))
    found = found.withColumn("status", F.when(F.col("search_id") % 5 == 4, 502).otherwise(200))
    calls = [df.select("request_id", F.lit(route).alias("route"), F.lit(stream).alias("stream"),
                       (F.col("status") if "status" in df.columns else F.lit(200)).alias("status"))
             for df, route, stream in ((native, "native", False), (streams, "native", True),
                                       (translated, "openai", False), (found, "tavily", False))]
    calls = responses.unite(*calls).select(
        "*", F.timestamp_seconds(F.lit(bridges.STREAM_EPOCH_S)).alias("ts"), F.lit(None).cast("string").alias("user_id_raw"),
        F.lit("claude-sonnet-4-6").alias("requested_model"), F.lit(None).cast("string").alias("beta_requested"),
        F.lit(1000).alias("elapsed_ms"), F.lit(None).cast("int").alias("ttft_ms"))
    facts = responses.unite(
        responses.message_response_facts(native), responses.stream_response_facts(streams),
        responses.translated_response_facts(translated),
        responses.search_response_facts(found.where(F.col("status") == 200)))
    t = responses.fact_rows(calls, facts)
    return t.select("request_id", "route", "stream", "status", "input_tokens", "output_tokens", "total_tokens",
                    "cache_creation_5m", "cache_creation_1h", "web_search_requests", "stop_reason", "completed",
                    "response_message_id", F.array_join("response_tool_names", ",").alias("response_tool_names"),
                    "error_type", "error_message", "tavily_cost_usd")


# --- ad hoc SQL over the fact table (SQL-1) ----------------------------------------------
@query("sql_cost_by_model")
def q_sql_cost_by_model(spark, d):
    """SQL-1: the fact table as the ``requests`` view, queried with SQL text
    (the published cost-by-model report, with the exact integer cost)."""
    fact_table(spark, d).createOrReplaceTempView("requests")
    return spark.sql("""
        SELECT upstream_model, count(*) AS calls, sum(CAST(total_tokens AS BIGINT)) AS tokens,
               CAST((sum(est_cost_micro_usd) + 5000) DIV 10000 AS DOUBLE) / 100.0 AS est_usd
        FROM requests GROUP BY upstream_model""")
