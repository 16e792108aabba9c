"""The JSONL request log: reader (SRC-1), writer (SNK-3) and the rebuild of
the telemetry table from it (SNK-4).

The log is read as text lines and parsed with one explicit schema, so the
same function serves a batch folder (``spark.read.text``) and a stream
(``spark.readStream.text``), and the raw line stays available as the
synthetic key: the log has no request id.  Malformed lines are kept with a
null ``entry`` and ``corrupt = true`` instead of failing the job.

What the log cannot give back (request id, requested model, downgrade and
beta columns, sampling parameters, thinking, retries, TTFT, message id,
response tool names, error text; and for streams the stop reason) stays null
or at the table default in the rebuilt rows.  Passthrough calls are in the
log only and are left out of the rebuild.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gatemeter.functions.models import ModelPolicy
from gatemeter.operators.telemetry import build_telemetry

USAGE_SCHEMA = T.StructType([
    T.StructField("input_tokens", T.LongType()),
    T.StructField("output_tokens", T.LongType()),
    T.StructField("cache_read_input_tokens", T.LongType()),
    T.StructField("cache_creation_input_tokens", T.LongType()),
    T.StructField("cache_creation", T.StructType([
        T.StructField("ephemeral_5m_input_tokens", T.LongType()),
        T.StructField("ephemeral_1h_input_tokens", T.LongType()),
    ])),
    T.StructField("server_tool_use", T.StructType([
        T.StructField("web_search_requests", T.LongType()),
    ])),
])

# Union of every line shape the gateway writes.
LOG_SCHEMA = T.StructType([
    T.StructField("ts", T.DoubleType()),
    T.StructField("path", T.StringType()),
    T.StructField("request", T.StructType([
        T.StructField("model", T.StringType()),
        T.StructField("stream", T.BooleanType()),
        T.StructField("max_tokens", T.LongType()),
        T.StructField("n_messages", T.LongType()),
        T.StructField("user_id", T.StringType()),
        T.StructField("tools", T.ArrayType(T.StringType())),
        T.StructField("last_user_message", T.StringType()),
        T.StructField("passthrough", T.StringType()),
        T.StructField("translated", T.BooleanType()),
    ])),
    T.StructField("response", T.StructType([
        T.StructField("status", T.LongType()),
        T.StructField("stream", T.BooleanType()),
        T.StructField("translated", T.BooleanType()),
        T.StructField("tavily", T.BooleanType()),
        T.StructField("usage", USAGE_SCHEMA),
        T.StructField("stop_reason", T.StringType()),
        T.StructField("req_bytes", T.LongType()),
        T.StructField("resp_bytes", T.LongType()),
        T.StructField("text_preview", T.StringType()),
        T.StructField("search_depth", T.StringType()),
        T.StructField("results", T.LongType()),
        T.StructField("query", T.StringType()),
        T.StructField("cost_usd", T.DoubleType()),
        T.StructField("spend_today_usd", T.DoubleType()),
        T.StructField("upstream", T.StringType()),
    ])),
    T.StructField("elapsed_ms", T.LongType()),
])


def parse_log_lines(lines: DataFrame, col: str = "value") -> DataFrame:
    """SRC-1: ``(line, corrupt, entry)`` from a column of JSON lines.

    A line is corrupt when it is not a JSON object; its ``entry`` is null.
    """
    v = F.col(col)
    ok = F.try_parse_json(v).isNotNull() & F.ltrim(v).startswith("{")
    # Parsed inside a generator: a later filter on the parsed fields cannot be
    # pushed below it, so Catalyst does not copy the parse into the filter
    # and every line is parsed exactly once.
    row = F.struct(v.alias("line"), (~ok).alias("corrupt"),
                   F.when(ok, F.from_json(v, LOG_SCHEMA)).alias("entry"))
    return lines.select(F.inline(F.array(row)))


def read_request_log(spark: SparkSession, path: str) -> DataFrame:
    """SRC-1 over a folder of ``*.jsonl``/``*.json`` files (batch)."""
    return parse_log_lines(spark.read.text(path))


def read_request_log_stream(spark: SparkSession, path: str,
                            max_files_per_trigger: int | None = None) -> DataFrame:
    """SRC-1 as a file stream; the same parse as the batch reader."""
    r = spark.readStream.format("text")
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", str(max_files_per_trigger))
    return parse_log_lines(r.load(path))


def write_request_log(entries: DataFrame, path: str, col: str = "line") -> None:
    """SNK-3: append JSON lines (one text column) to the log folder."""
    entries.select(F.col(col).alias("value")).write.mode("append").text(path)


def end_micros(entry: Column) -> Column:
    """Call end as epoch microseconds (the line's float seconds, rounded)."""
    return F.round(entry["ts"] * F.lit(1_000_000)).cast("long")


def log_to_calls(parsed: DataFrame) -> DataFrame:
    """Log entries -> call records (the contract of :func:`build_telemetry`).

    ``ts`` is the call *start*: end time minus ``elapsed_ms``.  The request id
    is ``sha2(line, 256)``, stable across re-reads of the same line.
    """
    e = F.col("entry")
    req, resp = e["request"], e["response"]
    usage = resp["usage"]
    route = (F.when(F.coalesce(resp["tavily"], F.lit(False)), F.lit("tavily"))
             .when(F.coalesce(resp["translated"], F.lit(False)), F.lit("openai"))
             .otherwise(F.lit("native")))
    stream = F.coalesce(req["stream"], resp["stream"], F.lit(False))
    start = F.timestamp_micros(end_micros(e) - F.coalesce(e["elapsed_ms"], F.lit(0)) * 1000)
    return (parsed.where(~F.col("corrupt") & req["passthrough"].isNull())
            .select(
                F.sha2(F.col("line"), 256).alias("request_id"),
                start.alias("ts"),
                F.timestamp_micros(end_micros(e)).alias("ts_end"),
                req["user_id"].alias("user_id_raw"),
                # the log holds the upstream name; the client's name is not in it
                F.lit(None).cast("string").alias("requested_model"),
                req["model"].alias("upstream_model"),
                route.alias("route"),
                F.lit(None).cast("string").alias("beta_requested"),
                usage["input_tokens"].alias("input_tokens"),
                usage["output_tokens"].alias("output_tokens"),
                usage["cache_read_input_tokens"].alias("cache_read_input_tokens"),
                usage["cache_creation_input_tokens"].alias("cache_creation_input_tokens"),
                usage["cache_creation"]["ephemeral_5m_input_tokens"].alias("cache_creation_5m"),
                usage["cache_creation"]["ephemeral_1h_input_tokens"].alias("cache_creation_1h"),
                usage["server_tool_use"]["web_search_requests"].alias("web_search_requests"),
                stream.alias("stream"),
                resp["status"].alias("status"),
                e["elapsed_ms"].alias("elapsed_ms"),
                F.lit(None).cast("int").alias("ttft_ms"),
                F.when(~stream, resp["stop_reason"]).alias("stop_reason"),
                # a stream's line does not say whether it ended
                F.when(~stream, resp["status"] == 200).alias("completed"),
                resp["req_bytes"].alias("req_bytes"),
                resp["resp_bytes"].alias("resp_bytes"),
                resp["search_depth"].alias("search_depth"),
                req["n_messages"].alias("n_messages"),
                req["max_tokens"].alias("max_tokens"),
                req["tools"].alias("tool_names"),
            ))


def rebuild_telemetry(parsed: DataFrame, policy: ModelPolicy | None = None) -> DataFrame:
    """SNK-4: the telemetry table rebuilt from parsed log lines.

    A narrow projection with the price lookup: no shuffle.  The model in the
    log is already the upstream name and is taken as it is.
    """
    return build_telemetry(log_to_calls(parsed), policy)
