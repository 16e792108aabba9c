"""Request-body jobs: parse, reject, features, allowlist, search detection.

(SRC-5, SRC-8, P-5..P-8, P-11, P-12, P-20, P-21, P-27, P-28.)

Each body is parsed once into VARIANT; every feature is a path lookup into
that value.  Bodies over the size limit are never parsed.  The only Python
in here is the JSON-size helper of P-8, an Arrow-batched pandas UDF that
runs only on rows whose ``system`` is a list or an object, and the
``cache_control`` normaliser of P-6 (recursive, no built-in equivalent),
likewise only on bodies that contain ``cache_control``.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gatemeter import fixed
from gatemeter.functions.models import ModelPolicy, map_model_name
from gatemeter.functions.requests import is_responses_body, search_only, unknown_fields
from gatemeter.functions.text import pystrip

_V = "_v"


def _get(path: str, t: str = "string", v: str = _V) -> Column:
    return F.try_variant_get(F.col(v), path, t)


def parse_bodies(bodies: DataFrame, body_col: str = "body",
                 max_bytes: int = fixed.MAX_BODY_BYTES) -> DataFrame:
    """SRC-5 + SRC-8: adds ``_v`` (the parsed body) and ``reject_reason``
    (``too_large`` / ``invalid_json`` / null).  Oversized bodies are never parsed."""
    b = F.col(body_col)
    size = F.octet_length(b)
    too_large = size > max_bytes
    looks_obj = F.ltrim(b).startswith("{")
    v = F.try_parse_json(F.when(~too_large & looks_obj, b))
    reason = (F.when(b.isNull(), F.lit("missing"))
              .when(too_large, F.lit("too_large"))
              .when(v.isNull(), F.lit("invalid_json")))
    # built inside a generator so a filter on ``reject_reason`` is not pushed
    # below it with a second copy of the parse: each body is parsed once
    row = F.struct(*[F.col(c) for c in bodies.columns], v.alias(_V), size.alias("req_bytes"),
                   reason.alias("reject_reason"))
    return bodies.select(F.inline(F.array(row)))


def body_rejects(bodies: DataFrame, key: str = "request_id", body_col: str = "body",
                 max_bytes: int = fixed.MAX_BODY_BYTES) -> DataFrame:
    """Bodies the gateway would refuse (HTTP 400 / 413): ``(key, req_bytes, reason)``."""
    p = parse_bodies(bodies.select(key, body_col), body_col, max_bytes)
    return p.where(F.col("reject_reason").isNotNull()).select(key, "req_bytes", "reject_reason")


@F.pandas_udf(T.LongType())
def python_json_size(js: pd.Series) -> pd.Series:
    """P-8 for non-string content: UTF-8 length of Python's default
    ``json.dumps`` of the value (``", "``/``": "`` separators, ASCII escapes)."""
    return js.map(lambda s: None if s is None else len(json.dumps(json.loads(s)).encode()))


def structured_text(value: Column, text: Column) -> Column:
    """``text``, the JSON text of ``value``, where that is a list or an object with something in it."""
    as_list = F.try_variant_get(value, "$", "array<variant>")
    as_obj = F.try_variant_get(value, "$", "map<string,variant>")
    return F.when((as_list.isNotNull() & (F.size(as_list) > 0)) | (as_obj.isNotNull() & (F.size(as_obj) > 0)), text)


def plain_size(value: Column) -> Column:
    """P-8 for all but :func:`structured_text`: bytes of a string; 0 when the value is missing, empty or no string."""
    as_list = F.try_variant_get(value, "$", "array<variant>")
    as_obj = F.try_variant_get(value, "$", "map<string,variant>")
    as_str = F.try_variant_get(value, "$", "string")
    return (F.when(as_list.isNotNull() | as_obj.isNotNull(), F.lit(0).cast("long"))
            .when(as_str.isNotNull() & (as_str != ""), F.octet_length(as_str).cast("long"))
            .otherwise(F.lit(0).cast("long")))


def body_features(bodies: DataFrame, key: str = "request_id", body_col: str = "body") -> DataFrame:
    """P-11, P-12, P-20, P-28 and the request-log summary (P-27) of every
    accepted body: one row per body, all features from one parse."""
    p = parse_bodies(bodies.select(key, body_col), body_col).where(F.col("reject_reason").isNull())
    # stage the arrays used several times in their own projection
    p = p.select(key, _V, "req_bytes",
                 F.get_json_object(body_col, "$.system").alias("_sys_text"),
                 F.array_contains(F.json_object_keys(body_col), "input").alias("_has_input"),
                 _get("$.messages", "array<variant>").alias("_msgs"),
                 _get("$.tools", "array<variant>").alias("_tools"),
                 _get("$.system", "variant").alias("_sys"))
    tools = F.coalesce(F.col("_tools"), F.array().cast("array<variant>"))
    tool_objs = F.filter(tools, lambda t: F.try_variant_get(t, "$", "map<string,variant>").isNotNull())
    tool_types = F.transform(tools, lambda t: F.try_variant_get(t, "$.type", "string"))
    # the features are finished before the Python helper is asked: the rows that wait for its
    # answer, up to a batch at a time, hold no bodies
    features = F.struct(
        F.col(key),
        _get("$.model").alias("model"),
        F.coalesce(F.size(F.col("_msgs")), F.lit(0)).cast("int").alias("n_messages"),
        structured_text(F.col("_sys"), F.col("_sys_text")).alias("_structured"),
        plain_size(F.col("_sys")).alias("_plain"),
        F.size(tools).cast("int").alias("tool_count"),
        F.transform(tool_objs, lambda t: F.coalesce(F.try_variant_get(t, "$.name", "string"),
                                                   F.lit(""))).alias("tool_names"),
        _get("$.max_tokens", "int").alias("max_tokens"),
        _get("$.temperature", "double").alias("temperature"),
        _get("$.top_p", "double").alias("top_p"),
        _get("$.top_k", "int").alias("top_k"),
        F.coalesce(_get("$.thinking.type") == "enabled", F.lit(False)).alias("thinking_enabled"),
        _get("$.thinking.budget_tokens", "int").alias("thinking_budget"),
        F.coalesce(_get("$.stream", "boolean"), F.lit(False)).alias("stream"),
        _get("$.metadata.user_id").alias("user_id"),
        search_only(tool_types).alias("search_only"),
        is_responses_body(F.size("_msgs"), F.col("_has_input")).alias("is_responses_body"),
        F.col("req_bytes").cast("int").alias("req_bytes"),
    )
    f = p.select(F.inline(F.array(features)))
    # P-8: the value's own JSON text is measured, where numbers keep the spelling that the parsed value has lost
    system_bytes = F.coalesce(python_json_size(F.col("_structured")), F.col("_plain")).cast("int")
    return f.select(*[system_bytes.alias("system_bytes") if c == "_structured" else F.col(c)
                      for c in f.columns if c != "_plain"])


def unknown_body_fields(bodies: DataFrame, key: str = "request_id", body_col: str = "body") -> DataFrame:
    """P-5: top-level fields the allowlist drops, in body order (accepted bodies only)."""
    p = parse_bodies(bodies.select(key, body_col), body_col).where(F.col("reject_reason").isNull())
    return p.select(key, unknown_fields(F.json_object_keys(F.col(body_col))).alias("unknown_fields"))


def search_query(bodies: DataFrame, key: str = "request_id", body_col: str = "body") -> DataFrame:
    """P-21: the query of a search-only call: its last message's content
    (string, or text blocks joined by a space), stripped."""
    p = parse_bodies(bodies.select(key, body_col), body_col).where(F.col("reject_reason").isNull())
    # an empty or missing message list gives an empty query, not an error
    last = F.try_element_at(_get("$.messages", "array<variant>"), F.lit(-1))
    p = p.select(key, last.alias("_last"),
                 F.transform(_get("$.tools", "array<variant>"),
                             lambda t: F.try_variant_get(t, "$.type", "string")).alias("_types"))
    content = F.try_variant_get(F.col("_last"), "$.content", "variant")
    blocks = F.try_variant_get(content, "$", "array<variant>")
    texts = F.transform(
        F.filter(blocks, lambda b: F.coalesce(F.try_variant_get(b, "$.type", "string") == "text",
                                              F.lit(False))),
        lambda b: F.coalesce(F.try_variant_get(b, "$.text", "string"), F.lit("")))
    as_text = (F.when(blocks.isNotNull(), F.array_join(texts, " "))
               .otherwise(F.try_variant_get(content, "$", "string")))
    q = F.coalesce(pystrip(as_text), F.lit(""))
    return p.where(search_only(F.coalesce(F.col("_types"), F.array().cast("array<string>")))) \
            .select(key, q.alias("search_query"))


# --- P-6 / P-7: payload normalisation -------------------------------------------

def _reduced(value):
    """P-6: every ``cache_control`` object reduced to its ``type``, at any depth."""
    if isinstance(value, dict):
        return {k: ({"type": v["type"]} if "type" in v else v) if k == "cache_control" and isinstance(v, dict) else _reduced(v)
                for k, v in value.items()}
    return [_reduced(v) for v in value] if isinstance(value, list) else value


SENT = T.StructType([T.StructField("body", T.StringType()), T.StructField("modified", T.BooleanType())])


@F.pandas_udf(SENT)
def forwarded_body(js: pd.Series, model: pd.Series) -> pd.DataFrame:
    """P-7: the body as it is sent on, or null where nothing had to change.

    Key order is the client's; a rewritten body has the gateway's serialisation.
    """
    allowed = set(fixed.ALLOWED_BODY_FIELDS)

    def one(text: str | None, name: str | None) -> tuple[str | None, bool]:
        if text is None:
            return None, False
        body = json.loads(text)
        sent = {k: v for k, v in body.items() if k in allowed}
        if name is not None and name != body.get("model", ""):
            sent["model"] = name
        sent = _reduced(sent)
        return (json.dumps(sent), True) if sent != body else (None, False)

    rows = [one(t, m) for t, m in zip(js, model)]
    return pd.DataFrame(rows, columns=["body", "modified"]).astype({"body": object, "modified": bool})


def normalise_bodies(bodies: DataFrame, policy: ModelPolicy | None = None,
                     key: str = "request_id", body_col: str = "body") -> DataFrame:
    """P-7: the forwarded body of each accepted request.

    ``(key, original_model, model, body, modified)``: the model name mapped
    (P-1), fields outside the allowlist dropped (P-5), and ``cache_control``
    extras removed (P-6).  Unmodified bodies are passed through byte for byte.
    Only bodies that may change reach the Python rewriter: another model name,
    an unknown field, or the text ``cache_control``.
    """
    policy = policy or ModelPolicy()
    p = parse_bodies(bodies.select(key, body_col), body_col).where(F.col("reject_reason").isNull())
    original = F.coalesce(_get("$.model"), F.lit(""))
    p = p.select(F.inline(F.array(F.struct(
        F.col(key), F.col(body_col).alias("_body"), original.alias("original_model"),
        map_model_name(original, policy).alias("model"),
        F.size(unknown_fields(F.json_object_keys(F.col(body_col)))).alias("_unknown")))))
    may_change = ((F.col("model") != F.col("original_model")) | (F.col("_unknown") > 0)
                  | F.col("_body").contains("cache_control"))
    # Spark evaluates a Python UDF for every row, even inside a CASE branch: the others pass it a null
    sent = forwarded_body(F.when(may_change, F.col("_body")), F.col("model"))
    return (p.withColumn("_sent", sent)
            .select(key, "original_model", "model", F.coalesce(F.col("_sent.body"), F.col("_body")).alias("body"),
                    F.col("_sent.modified").alias("modified")))
