"""Telemetry facts of every kind of landed response, and the fact rows of all routes (A-17, A-20, U-2).

Each reader gives the same columns (:data:`FACT_COLUMNS`) per key: a native
response body, a native event stream, a translated chat response, a search
answer.  :func:`unite` stacks them by name; :func:`fact_rows` joins them to the
call records on the key and prices the rows.  Readers are projections that
parse each payload once; the join is the only shuffle.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gatemeter.functions.models import ModelPolicy
from gatemeter.operators import convert, search, sse
from gatemeter.operators.telemetry import build_telemetry

FACT_COLUMNS: tuple[str, ...] = (
    "input_tokens", "output_tokens", "cache_read_input_tokens", "cache_creation_input_tokens", "cache_creation_5m",
    "cache_creation_1h", "web_search_requests", "stop_reason", "response_message_id", "response_tool_names",
    "error_message", "completed",
)


@F.pandas_udf(T.StringType())
def python_json(js: pd.Series) -> pd.Series:
    """JSON text as Python writes it by default, keys in their order."""
    import json

    return js.map(lambda s: None if s is None else json.dumps(json.loads(s)))


def _facts(df: DataFrame, key: str) -> DataFrame:
    none = F.lit(None)
    kinds = {"stop_reason": "string", "response_message_id": "string", "response_tool_names": "array<string>",
             "error_message": "string", "completed": "boolean"}
    return df.select(key, *[(F.col(c) if c in df.columns else none).cast(kinds.get(c, "bigint")).alias(c)
                            for c in FACT_COLUMNS])


def message_response_facts(responses: DataFrame, key: str = "request_id", body_col: str = "body") -> DataFrame:
    """A-17: usage, stop reason, id, tool names and error of whole message responses.

    A body that is not a JSON object, or null, gives a row of nulls.
    """
    body = F.col(body_col)
    parsed = F.struct(F.col(key), F.try_parse_json(F.when(F.ltrim(body).startswith("{"), body)).alias("_v"),
                      F.get_json_object(body, "$.error").alias("_error"))
    d = responses.select(F.inline(F.array(parsed)))

    def g(path: str, t: str = "string") -> Column:
        return F.try_variant_get(F.col("_v"), path, t)

    tools = F.filter(F.coalesce(g("$.content", "array<variant>"), F.array().cast("array<variant>")),
                     lambda b: F.coalesce(F.try_variant_get(b, "$.type", "string") == "tool_use", F.lit(False)))
    return _facts(d.select(
        key,
        *[g(f"$.usage.{k}", "bigint").alias(k) for k in sse.USAGE_KEYS],
        g("$.usage.cache_creation.ephemeral_5m_input_tokens", "bigint").alias("cache_creation_5m"),
        g("$.usage.cache_creation.ephemeral_1h_input_tokens", "bigint").alias("cache_creation_1h"),
        g("$.usage.server_tool_use.web_search_requests", "bigint").alias("web_search_requests"),
        g("$.stop_reason").alias("stop_reason"), g("$.id").alias("response_message_id"),
        F.transform(tools, lambda b: F.coalesce(F.try_variant_get(b, "$.name", "string"), F.lit("")))
        .alias("response_tool_names"),
        python_json(F.col("_error")).alias("error_message"), F.col("_v").isNotNull().alias("completed")), key)


def stream_response_facts(streams: DataFrame, key: str = "request_id", raw_col: str = "raw") -> DataFrame:
    """A-11..A-16 of captured event streams as fact columns."""
    f = sse.facts_from_raw(streams, [key], raw_col)
    return _facts(f.withColumnRenamed("message_id", "response_message_id")
                  .withColumnRenamed("tool_names", "response_tool_names"), key)


def translated_response_facts(responses: DataFrame, key: str = "request_id", body_col: str = "body") -> DataFrame:
    """Chat responses after their conversion (C-2); the chat usage has no cache fields."""
    m = convert.from_chat_response(responses, key, body_col)
    tools = F.filter("content", lambda b: b["type"] == "tool_use")
    return _facts(m.select(key, "input_tokens", "output_tokens", "stop_reason",
                           F.col("message_id").alias("response_message_id"), F.lit(True).alias("completed"),
                           F.transform(tools, lambda b: F.coalesce(b["name"], F.lit(""))).alias("response_tool_names")),
                  key)


def search_response_facts(rendered: DataFrame, key: str = "request_id") -> DataFrame:
    """Usage of rendered search answers (P-24)."""
    u = search.search_usage(F.col("markdown"), F.col("n_results"))
    return _facts(rendered.select(
        key, u["input_tokens"].alias("input_tokens"), u["output_tokens"].alias("output_tokens"),
        u["server_tool_use"]["web_search_requests"].alias("web_search_requests"),
        F.lit("end_turn").alias("stop_reason"), F.lit(True).alias("completed"), F.concat(F.lit("msg_search_"), F.col("search_id").cast("string"))
        .alias("response_message_id")), key)


def unite(*facts: DataFrame) -> DataFrame:
    """U-2: the facts of all routes as one table."""
    return reduce(lambda a, b: a.unionByName(b), facts)


def fact_rows(calls: DataFrame, facts: DataFrame, policy: ModelPolicy | None = None,
              key: str = "request_id") -> DataFrame:
    """A-20: one telemetry row per call, its response's facts folded in.

    A call without a response (it failed before one) keeps nulls, and so zeros
    in the counts.  An error text counts for failed calls only, usage, stop
    reason, id and tools for successful ones only.  A stream is complete when it
    ended, any other call when it succeeded.
    """
    own = [c for c in calls.columns if c not in FACT_COLUMNS]
    ok = F.col("status") == 200
    j = calls.select(*own).join(facts, key, "left")
    ended = F.coalesce("completed", F.lit(False))
    completed = F.when(F.coalesce(F.col("stream"), F.lit(False)), ended).otherwise(ok & ended).alias("completed")
    folded = [F.when(~ok, F.col(c)).alias(c) if c == "error_message" else F.when(ok, F.col(c)).alias(c)
              for c in FACT_COLUMNS if c not in ("response_tool_names", "completed")]
    tools = F.coalesce(F.when(ok, F.col("response_tool_names")), F.array().cast("array<string>"))
    return build_telemetry(j.select(*own, *folded, completed, tools.alias("response_tool_names")), policy)
