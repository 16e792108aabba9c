"""Chat-format conversion as table jobs (C-1, C-2).

The gateway converts one payload at a time.  Here a conversion is a per-row
projection over a column of landed payloads: the JSON text is parsed once
into VARIANT and rebuilt with higher-order functions (``transform``,
``filter``, ``flatten``) on the JVM, so a conversion never shuffles and never
leaves the executor that read the row.  A row is one payload, bounded by the
10 MiB body cap (SRC-8), never by the table.

Rebuilt JSON is the gateway's: keys in the client's order, its serialiser's
spacing, escapes and number spellings (:mod:`gatemeter.functions.pyjson`).
Bodies over the size limit are never parsed (SRC-8).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gatemeter import fixed
from gatemeter.functions.models import ModelPolicy, map_model_name
from gatemeter.functions.pyjson import json_list, json_object, json_text, python_json, python_json_lists
from gatemeter.functions.requests import chat_stop_reason

TOOL_CALL = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("type", T.StringType()),
    T.StructField("function", T.StructType([
        T.StructField("name", T.StringType()),
        T.StructField("arguments", T.StringType()),
    ])),
])
CHAT_MESSAGE = T.StructType([
    T.StructField("role", T.StringType()),
    T.StructField("content", T.StringType()),
    T.StructField("tool_call_id", T.StringType()),
    T.StructField("tool_calls", T.ArrayType(TOOL_CALL)),
])


def _no_messages() -> Column:
    return F.array().cast(T.ArrayType(CHAT_MESSAGE))


def _null_s() -> Column:
    return F.lit(None).cast("string")


def _get(v: Column, path: str, t: str = "string") -> Column:
    return F.try_variant_get(v, path, t)


def _keys(key) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def _parsed(df: DataFrame, keys: list[str], body_col: str, max_bytes: int = fixed.MAX_BODY_BYTES) -> DataFrame:
    """``(*keys, _body, _v)`` for rows whose payload is valid JSON and within the
    size limit.  The parse sits inside a generator so the validity filter is not
    pushed below it with a second copy of the parse: each payload is parsed once."""
    body = F.when(F.octet_length(body_col) <= max_bytes, F.col(body_col))
    row = F.struct(*[F.col(k) for k in keys], body.alias("_body"), F.try_parse_json(body).alias("_v"))
    return df.select(F.inline(F.array(row))).where(F.col("_v").isNotNull())


def _staged(df: DataFrame) -> DataFrame:
    """The same rows behind a projection that later ones are not merged into."""
    return df.select(F.inline(F.array(F.struct(*df.columns))))


# string-typed fields keep the raw JSON text of what stands there
RAW_REQUEST = "struct<messages:array<struct<content:string>>,tools:array<struct<input_schema:string>>>"
RAW_BLOCKS = "array<struct<type:string,input:string>>"


def tool_arguments(body: Column) -> Column:
    """Per message the raw ``input`` of its ``tool_use`` blocks, in order, as Python writes it."""
    raw = F.from_json(F.when(body.contains('"tool_use"'), body), RAW_REQUEST)["messages"]
    return python_json_lists(F.transform(raw, lambda m: F.transform(
        F.filter(F.from_json(m["content"], RAW_BLOCKS), lambda b: b["type"] == "tool_use"), lambda b: b["input"])), body)


def _kind(v: Column) -> Column:
    """JSON type of a variant: STRING, ARRAY<..>, OBJECT<..>, BIGINT, NULL..."""
    return F.schema_of_variant(v)


def _blocks_of_type(blocks: Column, kind: str) -> Column:
    return F.filter(blocks, lambda b: F.coalesce(_get(b, "$.type") == kind, F.lit(False)))


def _text_of_blocks(blocks: Column, sep: str) -> Column:
    """Text blocks' ``text`` joined by ``sep`` (``[]`` joins to ``''``)."""
    return F.array_join(F.transform(_blocks_of_type(blocks, "text"),
                                    lambda b: F.coalesce(_get(b, "$.text"), F.lit(""))), sep)


def _msg(role: Column, content: Column, tool_call_id: Column | None = None,
         tool_calls: Column | None = None) -> Column:
    return F.struct(role.alias("role"), content.alias("content"),
                    (tool_call_id if tool_call_id is not None else _null_s()).alias("tool_call_id"),
                    (tool_calls if tool_calls is not None
                     else F.lit(None).cast(T.ArrayType(TOOL_CALL))).alias("tool_calls"))


def chat_messages_of(message: Column, arguments: Column) -> Column:
    """One client message (VARIANT) -> ``array<CHAT_MESSAGE>`` (0..n entries);
    ``arguments`` are those of its ``tool_use`` blocks (:func:`tool_arguments`).

    * string content: the message as is;
    * block list: text blocks joined by a newline; ``tool_use`` blocks become
      ``tool_calls`` of the assistant message; ``tool_result`` blocks become
      ``tool`` messages placed *before* the user's own text; other block types
      are dropped; a message with no text yields nothing, except that an
      assistant message is always kept (it may carry only tool calls);
    * any other content: nothing.
    """
    role = _get(message, "$.role")
    content = _get(message, "$.content", "variant")
    blocks = _get(content, "$", "array<variant>")
    texts = F.transform(_blocks_of_type(blocks, "text"),
                        lambda b: F.coalesce(_get(b, "$.text"), F.lit("")))
    has_text = F.size(texts) > 0
    joined = F.array_join(texts, "\n")
    calls = F.transform(_blocks_of_type(blocks, "tool_use"), lambda b, i: F.struct(
        _get(b, "$.id").alias("id"), F.lit("function").alias("type"),
        F.struct(_get(b, "$.name").alias("name"), F.get(arguments, i).alias("arguments")).alias("function")))

    def result_text(b: Column) -> Column:
        rc = _get(b, "$.content", "variant")
        rc_blocks = _get(rc, "$", "array<variant>")
        return (F.when(rc.isNull(), F.lit(""))
                .when(rc_blocks.isNotNull(), _text_of_blocks(rc_blocks, "\n"))
                .otherwise(_get(rc, "$", "string")))

    results = F.transform(_blocks_of_type(blocks, "tool_result"), lambda b: _msg(
        F.lit("tool"), result_text(b), _get(b, "$.tool_use_id")))
    text_msg = F.when(has_text, F.array(_msg(role, joined))).otherwise(_no_messages())
    from_blocks = (
        F.when(role == "assistant", F.array(_msg(
            F.lit("assistant"), F.when(has_text, joined),
            None, F.when(F.size(calls) > 0, calls))))
        .when(role == "user", F.concat(results, text_msg))
        .otherwise(text_msg))
    return (F.when(_kind(content) == "STRING", F.array(_msg(role, _get(content, "$"))))
            .when(blocks.isNotNull(), from_blocks)
            .otherwise(_no_messages()))


def system_messages_of(system: Column) -> Column:
    """``system`` (string or text blocks) -> zero or one chat ``system`` message."""
    s_str = F.when(_kind(system) == "STRING", _get(system, "$"))
    s_blocks = _get(system, "$", "array<variant>")
    s_text = F.coalesce(s_str, F.when(s_blocks.isNotNull(), _text_of_blocks(s_blocks, "\n")))
    return F.when(s_text.isNotNull() & (s_text != ""),
                  F.array(_msg(F.lit("system"), s_text))).otherwise(_no_messages())


def chat_tools_of(tools: Column) -> Column:
    """Client tools -> function tools (description ``''`` and parameters ``{}``
    when absent)."""
    return F.transform(tools, lambda t: F.struct(
        F.lit("function").alias("type"),
        F.struct(_get(t, "$.name").alias("name"),
                 F.coalesce(_get(t, "$.description"), F.lit("")).alias("description"),
                 F.coalesce(_get(t, "$.input_schema", "variant"),
                            F.parse_json(F.lit("{}"))).alias("parameters")).alias("function")))


def _truthy_bool(v: Column) -> Column:
    """Python truthiness of a JSON scalar used as a flag."""
    k = _kind(v)
    return (F.when(k == "BOOLEAN", _get(v, "$", "boolean"))
            .when(k.isin("BIGINT", "INT", "SMALLINT", "TINYINT", "DOUBLE", "FLOAT")
                  | k.startswith("DECIMAL"), _get(v, "$", "double") != 0)
            .when(k == "STRING", _get(v, "$") != "")
            .when(k.startswith("ARRAY"), F.size(_get(v, "$", "array<variant>")) > 0)
            .otherwise(F.lit(False)))


def to_chat_request(bodies: DataFrame, key: str | list[str] = "request_id", body_col: str = "body",
                    policy: ModelPolicy | None = None, max_bytes: int = fixed.MAX_BODY_BYTES) -> DataFrame:
    """C-1: message-API request bodies -> chat-completions request bodies.

    Returns ``(key, model, chat_messages, chat_body)``.  ``chat_messages`` is
    the converted message list (system first); ``chat_body`` its JSON with
    ``max_tokens`` (default 4096), ``temperature``/``top_p`` when set,
    ``stop`` from non-empty ``stop_sequences``, ``stream`` plus usage
    reporting when streaming, and function tools.  ``top_k``, ``tool_choice``,
    ``thinking`` and ``metadata`` are not carried.  Bodies that are not
    valid JSON produce no row (they belong to the reject table).
    """
    v = F.col("_v")
    keys = _keys(key)
    # the arguments come from Python workers and are read inside lambdas: both sides are staged
    p = _staged(_parsed(bodies, keys, body_col, max_bytes).withColumn("_args", tool_arguments(F.col("_body"))))
    msgs = F.coalesce(_get(v, "$.messages", "array<variant>"),
                      F.array().cast("array<variant>"))
    chat = F.concat(system_messages_of(_get(v, "$.system", "variant")),
                    F.flatten(F.transform(msgs, lambda m, i: chat_messages_of(m, F.get(F.col("_args"), i)))))
    model = map_model_name(_get(v, "$.model"), policy)
    max_tokens = F.when(_kind(_get(v, "$.max_tokens", "variant")).isNull(),
                        F.lit(fixed.DEFAULT_MAX_TOKENS)).otherwise(_get(v, "$.max_tokens", "bigint"))
    stop = _get(v, "$.stop_sequences", "variant")
    stream = _truthy_bool(_get(v, "$.stream", "variant"))
    tools = _get(v, "$.tools", "array<variant>")
    out = p.select(*keys, "_body", "_v", model.alias("model"), chat.alias("chat_messages"),
                   max_tokens.alias("max_tokens"),
                   _get(v, "$.temperature", "double").alias("temperature"),
                   _get(v, "$.top_p", "double").alias("top_p"),
                   F.when(_truthy_bool(stop), stop).alias("stop"),
                   F.when(stream, F.lit(True)).alias("stream"),
                   F.when(stream, F.struct(F.lit(True).alias("include_usage"))).alias("stream_options"),
                   F.when(F.size(tools) > 0, chat_tools_of(tools)).alias("tools"))
    out = _staged(out)

    # the body is composed of raw texts: schemas and numbers stay as the client wrote them
    def set_field(path: str) -> Column:
        text = F.get_json_object(F.col("_body"), path)
        return F.when(text.isNotNull() & _get(F.col("_v"), path, "double").isNotNull(), text)

    raw_tools = F.from_json(F.when(F.size("tools") > 0, F.col("_body")), RAW_REQUEST)["tools"]
    tool = lambda t, i: json_object(type=F.lit('"function"'), function=json_object(
        name=json_text(t["function"]["name"]), description=json_text(t["function"]["description"]),
        parameters=F.coalesce(F.get(raw_tools, i)["input_schema"], F.lit("{}"))))
    content = lambda m: F.when(m["content"].isNotNull(), json_text(m["content"]))
    message = lambda m: F.when(m["role"] == "tool", json_object(
        role=json_text(m["role"]), tool_call_id=json_text(m["tool_call_id"]), content=content(m))).otherwise(json_object(
            role=json_text(m["role"]), content=content(m),
            tool_calls=F.when(m["tool_calls"].isNotNull(), F.to_json(m["tool_calls"]))))
    body = json_object(
        model=json_text(F.col("model")), messages=json_list(F.transform("chat_messages", message)),
        max_tokens=F.coalesce(set_field("$.max_tokens"), json_text(F.col("max_tokens"))),
        temperature=set_field("$.temperature"), top_p=set_field("$.top_p"),
        stop=F.when(F.col("stop").isNotNull(), F.to_json("stop")), stream=F.when(F.col("stream"), F.lit("true")),
        stream_options=F.when(F.col("stream"), F.lit('{"include_usage":true}')),
        tools=F.when(F.size("tools") > 0, json_list(F.transform("tools", tool))))
    return out.select(*keys, "model", "chat_messages", "tools", "max_tokens", "temperature",
                      "top_p", "stream", python_json(body).alias("chat_body"))


MESSAGE_BLOCK = T.StructType([
    T.StructField("type", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("id", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("input", T.VariantType()),
])


def from_chat_response(responses: DataFrame, key: str | list[str] = "request_id", body_col: str = "body",
                       model: Column | None = None) -> DataFrame:
    """C-2: chat-completions responses -> message-API responses.

    The first choice's ``content`` becomes a text block; when it is empty the
    ``reasoning`` text is used instead.  Each tool call becomes a ``tool_use``
    block whose ``input`` is the parsed ``arguments`` (null when they are not
    valid JSON, where the gateway would fail the call).  ``finish_reason`` is
    mapped to a stop reason (default ``end_turn``); usage is renamed, absent
    counts are 0; a missing id becomes ``msg_proxy``.  Returns ``(key,
    message_id, content, stop_reason, input_tokens, output_tokens, message)``
    where ``message`` is the response JSON.
    """
    v = F.col("_v")
    keys = _keys(key)
    p = _parsed(responses, keys, body_col)
    choice = _get(v, "$.choices[0]", "variant")
    m = _get(choice, "$.message", "variant")
    content_t = _get(m, "$.content")
    reasoning_t = _get(m, "$.reasoning")
    text = (F.when(F.coalesce(content_t, F.lit("")) != "", content_t)
            .when(F.coalesce(reasoning_t, F.lit("")) != "", reasoning_t))
    null_v = F.lit(None).cast(T.VariantType())
    text_block = F.when(text.isNotNull(), F.array(F.struct(
        F.lit("text").alias("type"), text.alias("text"), _null_s().alias("id"),
        _null_s().alias("name"), null_v.alias("input")))).otherwise(
        F.array().cast(T.ArrayType(MESSAGE_BLOCK)))
    calls = F.coalesce(_get(m, "$.tool_calls", "array<variant>"), F.array().cast("array<variant>"))
    tool_blocks = F.transform(calls, lambda tc: F.struct(
        F.lit("tool_use").alias("type"), _null_s().alias("text"), _get(tc, "$.id").alias("id"),
        _get(tc, "$.function.name").alias("name"),
        F.try_parse_json(_get(tc, "$.function.arguments")).alias("input")))
    content = F.concat(text_block, tool_blocks)
    usage = _get(v, "$.usage", "variant")
    out = p.select(
        *keys,
        F.coalesce(_get(v, "$.id"), F.lit("msg_proxy")).alias("message_id"),
        (model if model is not None else _get(v, "$.model")).alias("model"),
        content.alias("content"),
        F.transform(calls, lambda tc: _get(tc, "$.function.arguments")).alias("_arguments"),
        chat_stop_reason(F.coalesce(_get(choice, "$.finish_reason"), F.lit(""))).alias("stop_reason"),
        F.coalesce(_get(usage, "$.prompt_tokens", "bigint"), F.lit(0)).alias("input_tokens"),
        F.coalesce(_get(usage, "$.completion_tokens", "bigint"), F.lit(0)).alias("output_tokens"))
    text_part = lambda b: json_object(type=F.lit('"text"'), text=json_text(b["text"]))
    tool_part = lambda b, raw: json_object(
        type=F.lit('"tool_use"'), id=json_text(b["id"]), name=json_text(b["name"]),
        input=F.when(b["input"].isNotNull(), raw).otherwise(F.lit("null")))
    first = F.size(F.filter("content", lambda b: b["type"] == "text"))
    parts = F.transform("content", lambda b, i: F.when(b["type"] == "text", text_part(b)).otherwise(
        tool_part(b, F.get(F.col("_arguments"), i - first))))
    message = json_object(
        id=json_text(F.col("message_id")), type=F.lit('"message"'), role=F.lit('"assistant"'),
        model=json_text(F.col("model")), content=json_list(parts), stop_reason=json_text(F.col("stop_reason")),
        stop_sequence=F.lit("null"), usage=json_text(F.struct("input_tokens", "output_tokens")))
    return out.select(*keys, "message_id", "content", "stop_reason", "input_tokens",
                      "output_tokens", python_json(message).alias("message"))
