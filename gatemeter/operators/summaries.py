"""Console and log summaries of calls (P-9, P-24, P-26, P-27, P-28, P-30, P-31).

All per-row projections over parsed bodies or the telemetry table.  Message
content (previews, last user message) appears only when ``log_content`` is
set: the gateway's content-privacy switch (P-26).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatemeter import fixed
from gatemeter.functions.requests import is_responses_body
from gatemeter.functions.text import cut, fmt_size, preview, token_estimate
from gatemeter.operators.bodies import parse_bodies

_V = "_v"


def _get(path: str, t: str = "string") -> Column:
    return F.try_variant_get(F.col(_V), path, t)


def last_user_text(messages: Column) -> Column:
    """W-5 inside one body: the last ``user`` message's text (string content,
    or its text blocks joined by a space); ``''`` when there is none."""
    users = F.filter(messages, lambda m: F.coalesce(
        F.try_variant_get(m, "$.role", "string") == "user", F.lit(False)))
    last = F.try_element_at(users, F.lit(-1))
    content = F.try_variant_get(last, "$.content", "variant")
    blocks = F.try_variant_get(content, "$", "array<variant>")
    texts = F.transform(
        F.filter(blocks, lambda b: F.coalesce(F.try_variant_get(b, "$.type", "string") == "text",
                                              F.lit(False))),
        lambda b: F.coalesce(F.try_variant_get(b, "$.text", "string"), F.lit("")))
    as_text = F.when(blocks.isNotNull(), F.array_join(texts, " ")).otherwise(
        F.when(F.schema_of_variant(content) == "STRING", F.try_variant_get(content, "$", "string")))
    return F.coalesce(as_text, F.lit(""))


def request_summaries(bodies: DataFrame, key: str = "request_id", body_col: str = "body",
                      log_content: bool = False) -> DataFrame:
    """P-31 + P-27 + P-28 + P-24 for every accepted body.

    ``summary``: ``<model> (<n> msgs[ [stream]])`` plus the quoted preview of
    the last user message when ``log_content``; ``log_entry``: the log-safe
    request struct (model, stream, max_tokens, n_messages, user_id, tools,
    last_user_message cut at 500 when ``log_content``); ``is_responses`` /
    ``n_input`` for Responses-API bodies; ``est_tokens`` of the last user text.
    """
    p = parse_bodies(bodies.select(key, body_col), body_col).where(F.col("reject_reason").isNull())
    msgs = F.coalesce(_get("$.messages", "array<variant>"), F.array().cast("array<variant>"))
    p = p.select(key, _V, msgs.alias("_m"), last_user_text(msgs).alias("_last"),
                 F.array_contains(F.json_object_keys(body_col), "input").alias("_has_input"))
    model = F.coalesce(_get("$.model"), F.lit("?"))
    stream = F.coalesce(_get("$.stream", "boolean"), F.lit(False))
    n_msgs = F.size("_m")
    summary = F.concat(model, F.lit(" ("), n_msgs.cast("string"), F.lit(" msgs"),
                       F.when(stream, F.lit(" [stream]")).otherwise(F.lit("")), F.lit(")"))
    if log_content:
        summary = F.concat(summary, F.lit(' "'), preview(F.col("_last")), F.lit('"'))
    user_id = _get("$.metadata.user_id")
    tools = F.transform(_get("$.tools", "array<variant>"),
                        lambda t: F.coalesce(F.try_variant_get(t, "$.name", "string"), F.lit("")))
    entry = F.struct(
        F.coalesce(_get("$.model"), F.lit("")).alias("model"), stream.alias("stream"),
        _get("$.max_tokens", "bigint").alias("max_tokens"), n_msgs.alias("n_messages"),
        F.when(F.coalesce(user_id, F.lit("")) != "", user_id).alias("user_id"),
        F.when(F.size(tools) > 0, tools).alias("tools"),
        (F.when(F.size(F.filter("_m", lambda m: F.try_variant_get(m, "$.role", "string") == "user")) > 0,
                cut(F.col("_last"), fixed.LOG_TEXT_CHARS)) if log_content
         else F.lit(None).cast("string")).alias("last_user_message"))
    inp_kind = F.schema_of_variant(_get("$.input", "variant"))
    is_responses = is_responses_body(n_msgs, F.col("_has_input"))
    n_input = (F.when(inp_kind.startswith("ARRAY"), F.size(_get("$.input", "array<variant>")))
               .when(inp_kind == "STRING", F.lit(1)).otherwise(F.lit(0)))
    return p.select(key, summary.alias("summary"), entry.alias("log_entry"),
                    is_responses.alias("is_responses"), F.when(is_responses, n_input).alias("n_input"),
                    token_estimate(F.col("_last")).alias("est_tokens"))


def quoted_start(text: Column) -> Column:
    """P-26: the start of a response's text as the console shows it, always with dots."""
    start = F.replace(F.substring(F.coalesce(text, F.lit("")), 1, fixed.PREVIEW_CHARS), F.lit("\n"), F.lit(" "))
    return F.concat(F.lit(' "'), start, F.lit('..."'))


def response_summary(status: Column, streamed: Column, input_tokens: Column, output_tokens: Column,
                     cache_read: Column, stop_reason: Column, error_text: Column,
                     text: Column | None = None, has_body: Column | None = None) -> Column:
    """P-30: ``HTTP <status>: <message[:100]>`` for errors, ``OK [streamed]``
    for streams, else ``OK in=.. out=..[, cached=..] stop=..``; ``HTTP 200`` when
    a response that is no stream has no body that could be read (``has_body``).

    ``text`` (the stream's text, or the first text block's) is passed only where
    content may be logged (P-26): its start then follows.
    """
    end = F.lit("") if text is None else quoted_start(text)
    readable = F.lit(True) if has_body is None else F.coalesce(has_body, F.lit(False))
    ok = F.concat(F.lit("OK in="), F.coalesce(input_tokens, F.lit(0)).cast("string"),
                  F.lit(" out="), F.coalesce(output_tokens, F.lit(0)).cast("string"),
                  F.when(F.coalesce(cache_read, F.lit(0)) != 0,
                         F.concat(F.lit(", cached="), cache_read.cast("string"))).otherwise(F.lit("")),
                  F.lit(" stop="), F.coalesce(stop_reason, F.lit("?")))
    return (F.when(status != 200, F.concat(F.lit("HTTP "), status.cast("string"), F.lit(": "),
                                           F.coalesce(F.substring(error_text, 1, 100), F.lit(""))))
            .when(streamed, F.concat(F.lit("OK [streamed]"), end))
            .when(~readable, F.concat(F.lit("HTTP "), status.cast("string")))
            .otherwise(F.concat(ok, end)))


def call_lines(telemetry: DataFrame) -> DataFrame:
    """P-30 + P-9 over the telemetry table: ``(request_id, ts, summary,
    req_size, resp_size)``."""
    t = telemetry
    return t.select(
        "request_id", "ts",
        response_summary(F.col("status"), F.col("stream"), F.col("input_tokens"),
                         F.col("output_tokens"), F.col("cache_read_tokens"), F.col("stop_reason"),
                         F.col("error_message")).alias("summary"),
        fmt_size(F.col("req_bytes")).alias("req_size"),
        fmt_size(F.col("resp_bytes")).alias("resp_size"))
