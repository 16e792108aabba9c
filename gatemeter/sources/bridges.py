"""Bridges from the landed driver tables to gateway-shaped tables.

The driver provides generic tables (``events``, ``conversations``, ``pages``);
these functions turn them into the inputs the gateway produces: per-call
usage records (B1), request bodies (B2), content blocks (B3), raw SSE captures
(B4), SSE byte chunks (B5), request-log lines (B6) and transcript title lines
(B7).  Every rule is integer arithmetic on the source keys, so a SQL oracle can
restate it exactly.  All of them are narrow projections or a join whose small
side has a stated bound; none collects anything to the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatemeter import fixed

# --- FIXED VALUES: the fixture rule's model cycle (event_id % 10) -----------
REQUESTED_MODEL_CYCLE: tuple[str, ...] = (
    "claude-opus-4-6[1m]", "claude-opus-4-6-20260312", "claude-opus",
    "claude-sonnet-4-6", "claude-sonnet-4", "claude-sonnet-4-5-20250929",
    "claude-haiku-4-5", "claude-haiku", "gpt-5-mini", "foo-20260101[x]",
)
TOOL_NAME_CYCLE: tuple[str, ...] = ("Read", "Bash", "Grep")  # (conv_id + turn) % 3
# ---------------------------------------------------------------------------


def _s(c: Column) -> Column:
    return c.cast("string")


def _cycle(values, idx: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (idx + 1).cast("int"))


def day_session(user_id: Column, ts: Column) -> Column:
    return F.concat(F.lit("s"), _s(user_id), F.lit("_"), _s(F.to_date(ts)))


def usage_raw(events: DataFrame) -> DataFrame:
    """B1: one landed call record per event."""
    eid = F.col("event_id")
    uid = _s(F.col("user_id"))
    sess = day_session(F.col("user_id"), F.col("ts"))
    user_id_raw = (
        F.when(eid % 4 == 0, F.concat(F.lit('{"device_id":"d'), uid,
                                      F.lit('","account_uuid":"","session_id":"'), sess, F.lit('"}')))
        .when(eid % 4 == 1, F.concat(F.lit("user_h_account_a"), uid, F.lit("_session_"), sess))
        .when(eid % 4 == 2, F.lit("garbage"))
    )
    route = (F.when(eid % 17 == 0, F.lit("tavily"))
             .when(eid % 10 == 8, F.lit("openai")).otherwise(F.lit("native")))
    beta = (F.when(eid % 5 == 1, F.lit("context-1m-2025-08-07, tools-1"))
            .when(eid % 5 == 2, F.lit("advisor-tool-2026-03-01"))
            .when(eid % 5 != 0, F.lit("tools-1,  cache-2")))
    return events.select(
        F.concat(F.lit("req_"), _s(eid)).alias("request_id"),
        F.col("ts"),
        sess.alias("session_id"),
        user_id_raw.alias("user_id_raw"),
        _cycle(REQUESTED_MODEL_CYCLE, eid % 10).alias("requested_model"),
        route.alias("route"),
        beta.alias("beta_requested"),
        F.when(eid % 13 != 0, (eid * 7919) % 5000).alias("raw_input_tokens"),
        ((eid * 104729) % 2000).alias("raw_output_tokens"),
        F.when(eid % 3 != 0, (eid * 1299709) % 90000).alias("raw_cache_read"),
        ((eid * 15485863) % 700).alias("raw_cache_creation"),
        (eid % 4 != 0).alias("stream"),
        F.when(F.col("event_type") == "error", F.lit(429)).otherwise(F.lit(200)).alias("status"),
        (200 + (eid * 31) % 60000).alias("elapsed_ms"),
        F.when((eid % 4 != 0) & (eid % 5 != 0), 100 + (eid * 17) % 3000).alias("ttft_ms"),
    )


def calls_from_usage_raw(raw: DataFrame) -> DataFrame:
    """B1 in the call-record contract that :func:`build_telemetry` reads."""
    return raw.select(
        "request_id", "ts", "user_id_raw", "requested_model", "route", "beta_requested",
        F.col("raw_input_tokens").alias("input_tokens"),
        F.col("raw_output_tokens").alias("output_tokens"),
        F.col("raw_cache_read").alias("cache_read_input_tokens"),
        F.col("raw_cache_creation").alias("cache_creation_input_tokens"),
        "stream", "status", "elapsed_ms", "ttft_ms",
    )


def conversation_count(conversations: DataFrame) -> int:
    """``C = max(conv_id) + 1``: B2 pairs call ``n`` with conversation ``n % C``,
    so every conversation is used.  One scalar aggregate."""
    m = conversations.agg(F.max("conv_id")).collect()[0][0]
    return int(m) + 1 if m is not None else 1


def transcript_session_of(request_id: Column, n_conversations: int) -> Column:
    """B2's association: call ``req_<n>`` carries conversation ``n % C``, whose
    transcript session is ``c<conv_id>``."""
    eid = F.substring(request_id, 5, 1 << 20).cast("long")
    return F.concat(F.lit("c"), _s(eid % n_conversations))


def conversation_messages(conversations: DataFrame) -> DataFrame:
    """``(conv_id, messages)``: each conversation's turns as ``[{role, content}]``
    in turn order.  A group is one conversation."""
    return (conversations.groupBy("conv_id")
            .agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("_t"))
            .select("conv_id", F.transform("_t", lambda m: F.struct(
                m["role"].alias("role"), m["text"].alias("content"))).alias("messages")))


def request_bodies(events: DataFrame, conversations: DataFrame) -> DataFrame:
    """B2: a landed request body per call ``(request_id, ts, body)``.

    Rules on ``n = event_id``: messages of conversation ``n % C`` with
    ``C = max(conv_id) + 1`` (every conversation is used);
    ``max_tokens = 1024 * (1 + n % 8)``; system as a block list with a
    ``cache_control`` carrying an extra ``scope`` key when ``n % 9 = 0``, as a
    string when ``n % 2 = 0``, else absent; a web-search-only tool list when
    ``n % 17 = 0``, two client tools when ``n % 3 = 1``; thinking enabled
    (budget 1024) when ``n % 8 = 1``, disabled when ``n % 8 = 5``;
    temperature 0.5 when ``n % 7 = 0``; top_p 0.9 when ``n % 11 = 0``;
    top_k 40 when ``n % 13 = 0``; ``metadata.user_id`` from B1; an unknown
    field ``zz_beta`` when ``n % 6 = 0``; the body is cut in half (invalid
    JSON) when ``n % 251 = 7``.

    The conversation side grows with the table, so the join is left to the
    planner: AQE broadcasts it only when its measured size is under the
    broadcast threshold, and otherwise shuffles both sides on the key.
    """
    raw = usage_raw(events).select("request_id", "ts", "user_id_raw", "requested_model", "stream")
    eid = F.substring(F.col("request_id"), 5, 1 << 20).cast("long")
    uid_txt = F.coalesce(F.col("user_id_raw"), F.lit(""))
    msgs = conversation_messages(conversations)
    n_conv = conversation_count(conversations)
    j = (raw.withColumn("_conv", eid % n_conv).withColumn("_n", eid)
         .join(msgs, F.col("_conv") == msgs["conv_id"], "left"))
    n = F.col("_n")
    sys_list = F.concat(F.lit('[{"type": "text", "text": "sys '), _s(n % 1000),
                        F.lit('", "cache_control": {"type": "ephemeral", "scope": "turn"}}]'))
    sys_str = F.to_json(F.array(F.concat(F.lit("You are agent "), _s(n % 1000), F.lit("."))))
    system = (F.when(n % 9 == 0, F.parse_json(sys_list))
              .when(n % 2 == 0, F.try_variant_get(F.parse_json(sys_str), "$[0]", "variant")))
    tools = (F.when(n % 17 == 0, F.parse_json(F.lit(
        '[{"type": "web_search_20250305", "name": "web_search", "max_uses": 5}]')))
        .when(n % 3 == 1, F.parse_json(F.lit(
            '[{"name": "Read", "description": "read a file", "input_schema": {"type": "object"}},'
            ' {"name": "Bash", "description": "run a command", "input_schema": {"type": "object"}}]'))))
    thinking = (F.when(n % 8 == 1, F.parse_json(F.lit('{"type": "enabled", "budget_tokens": 1024}')))
                .when(n % 8 == 5, F.parse_json(F.lit('{"type": "disabled"}'))))
    body = F.to_json(F.struct(
        F.col("requested_model").alias("model"),
        F.coalesce(F.col("messages"), F.array().cast("array<struct<role:string,content:string>>"))
        .alias("messages"),
        (F.lit(1024) * (1 + n % 8)).alias("max_tokens"),
        system.alias("system"),
        tools.alias("tools"),
        thinking.alias("thinking"),
        F.when(n % 7 == 0, F.lit(0.5)).alias("temperature"),
        F.when(n % 11 == 0, F.lit(0.9)).alias("top_p"),
        F.when(n % 13 == 0, F.lit(40)).alias("top_k"),
        F.when(F.col("user_id_raw").isNotNull(), F.struct(uid_txt.alias("user_id"))).alias("metadata"),
        F.col("stream").alias("stream"),
        F.when(n % 6 == 0, F.lit("on")).alias("zz_beta"),
    ))
    cut_body = F.when(n % 251 == 7, F.substring(body, 1, F.floor(F.char_length(body) / 2).cast("int"))
                      ).otherwise(body)
    return j.select("request_id", "ts", cut_body.alias("body"))


def blocks(conversations: DataFrame) -> DataFrame:
    """B3: normalised content blocks (text, tool_use, tool_result) per turn."""
    c = conversations
    null_s = F.lit(None).cast("string")
    text_blocks = c.select(
        "conv_id", "turn", "role", F.lit(0).alias("block_idx"), F.lit("text").alias("type"),
        F.col("text"), null_s.alias("tool_id"), null_s.alias("tool_name"), null_s.alias("file_path"))
    k = (F.col("conv_id") + F.col("turn")) % 3
    uses = c.where((F.col("role") == "assistant") & (F.col("conv_id") % 2 == 0)).select(
        "conv_id", "turn", "role", F.lit(1).alias("block_idx"), F.lit("tool_use").alias("type"),
        null_s.alias("text"),
        F.concat(F.lit("tu_"), _s(F.col("conv_id")), F.lit("_"), _s(F.col("turn"))).alias("tool_id"),
        _cycle(TOOL_NAME_CYCLE, k).alias("tool_name"),
        F.when(k == 0, F.concat(F.lit("/src/f"), _s(F.col("conv_id") % 7), F.lit(".py"))).alias("file_path"))
    results = c.where((F.col("role") == "user") & (F.col("turn") > 0) & (F.col("conv_id") % 2 == 0)).select(
        "conv_id", "turn", "role", F.lit(2).alias("block_idx"), F.lit("tool_result").alias("type"),
        F.col("text"),
        F.concat(F.lit("tu_"), _s(F.col("conv_id")), F.lit("_"), _s(F.col("turn") - 1)).alias("tool_id"),
        null_s.alias("tool_name"), null_s.alias("file_path"))
    return text_blocks.unionByName(uses).unionByName(results)


def title_lines(conversations: DataFrame) -> DataFrame:
    """B7: transcript title lines ``(session_id, line_no, kind, title)``."""
    c = conversations
    sess = F.concat(F.lit("c"), _s(F.col("conv_id")))
    ai = c.where(F.col("turn") % 3 == 1).select(
        sess.alias("session_id"), (F.col("turn") * 2).alias("line_no"),
        F.lit("ai-title").alias("kind"),
        F.concat(F.lit("ai "), _s(F.col("conv_id")), F.lit("."), _s(F.col("turn"))).alias("title"))
    custom = c.where((F.col("conv_id") % 5 == 0) & (F.col("turn") >= 2)).select(
        sess.alias("session_id"), (F.col("turn") * 2 + 1).alias("line_no"),
        F.lit("custom-title").alias("kind"),
        F.when(F.col("conv_id") % 10 == 0, F.lit("  ")).otherwise(
            F.concat(F.lit(" custom "), _s(F.col("conv_id")), F.lit("."), _s(F.col("turn")), F.lit(" ")))
        .alias("title"))
    return ai.unionByName(custom)


def title_jsonl_lines(conversations: DataFrame) -> DataFrame:
    """B7 as transcript JSONL text: ``(session_id, line_no, line)`` including
    ordinary message lines, so the title reader must pre-filter and parse."""
    t = title_lines(conversations)
    title_json = F.when(
        F.col("kind") == "ai-title",
        F.to_json(F.struct(F.col("kind").alias("type"), F.col("title").alias("aiTitle"),
                           F.col("session_id").alias("sessionId"))),
    ).otherwise(
        F.to_json(F.struct(F.col("kind").alias("type"), F.col("title").alias("customTitle"),
                           F.col("session_id").alias("sessionId"))))
    titles = t.select("session_id", "line_no", title_json.alias("line"))
    msgs = conversations.select(
        F.concat(F.lit("c"), _s(F.col("conv_id"))).alias("session_id"),
        (F.col("turn") * 2).alias("line_no"),
        F.to_json(F.struct(F.col("role").alias("type"),
                           F.struct(F.col("role").alias("role"),
                                    F.col("text").alias("content")).alias("message"))).alias("line"))
    # message lines take even numbers and titles their own; shift messages to keep keys unique
    msgs = msgs.select("session_id", (F.col("line_no") * 1000 + 999).alias("line_no"), "line")
    titles = titles.select("session_id", (F.col("line_no") * 1000).alias("line_no"), "line")
    return titles.unionByName(msgs)


def _tool_name_for(conv: Column, turn: Column) -> Column:
    return _cycle(TOOL_NAME_CYCLE, (conv + turn) % 3)


MALFORMED_DATA_LINE = 'data: {"type": "content_block_delta", "index": 0, "delta": {"type": "text_d\n\n'
SSE_PIECE_CHARS = 64


def sse_raw(conversations: DataFrame) -> DataFrame:
    """B4: a captured message event stream per assistant turn ``(conv_id, turn, raw)``.

    The text is cut into 64-character ``text_delta`` events; every 13th
    delta is followed by a malformed data line; a ``tool_use`` block is added
    for even conversations; ``message_stop`` is missing when
    ``(conv_id + turn) % 11 = 0`` (a truncated stream).
    """
    from gatemeter.functions.sse import format_sse

    c = conversations.where(F.col("role") == "assistant")
    conv, turn = F.col("conv_id"), F.col("turn")
    text = F.coalesce(F.col("text"), F.lit(""))
    n = F.ceil(F.char_length(text) / SSE_PIECE_CHARS).cast("int")
    idx = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))

    def ev(name: str, payload: Column) -> Column:
        return format_sse(F.lit(name), F.to_json(payload))

    start = ev("message_start", F.struct(
        F.lit("message_start").alias("type"),
        F.struct(F.concat(F.lit("msg_"), _s(conv), F.lit("_"), _s(turn)).alias("id"),
                 F.lit("message").alias("type"), F.lit("assistant").alias("role"),
                 F.lit("claude-sonnet-4.6").alias("model"),
                 F.array().cast("array<string>").alias("content"),
                 F.struct((conv * 10 + turn).alias("input_tokens"),
                          F.lit(0).alias("output_tokens")).alias("usage")).alias("message")))
    block_start = ev("content_block_start", F.struct(
        F.lit("content_block_start").alias("type"), F.lit(0).alias("index"),
        F.struct(F.lit("text").alias("type"), F.lit("").alias("text")).alias("content_block")))
    deltas = F.array_join(F.transform(idx, lambda i: F.concat(
        ev("content_block_delta", F.struct(
            F.lit("content_block_delta").alias("type"), F.lit(0).alias("index"),
            F.struct(F.lit("text_delta").alias("type"),
                     F.substring(text, i * SSE_PIECE_CHARS + 1, F.lit(SSE_PIECE_CHARS)).alias("text")
                     ).alias("delta"))),
        F.when(i % 13 == 12, F.lit(MALFORMED_DATA_LINE)).otherwise(F.lit("")))), "")
    block_stop = ev("content_block_stop", F.struct(
        F.lit("content_block_stop").alias("type"), F.lit(0).alias("index")))
    has_tool = conv % 2 == 0
    tool = F.when(has_tool, F.concat(
        ev("content_block_start", F.struct(
            F.lit("content_block_start").alias("type"), F.lit(1).alias("index"),
            F.struct(F.lit("tool_use").alias("type"),
                     F.concat(F.lit("tu_"), _s(conv), F.lit("_"), _s(turn)).alias("id"),
                     _tool_name_for(conv, turn).alias("name")).alias("content_block"))),
        ev("content_block_stop", F.struct(
            F.lit("content_block_stop").alias("type"), F.lit(1).alias("index"))))
    ).otherwise(F.lit(""))
    delta = ev("message_delta", F.struct(
        F.lit("message_delta").alias("type"),
        F.struct(F.when(has_tool, F.lit("tool_use")).otherwise(F.lit("end_turn")).alias("stop_reason"))
        .alias("delta"),
        F.struct(F.char_length(text).alias("output_tokens"),
                 F.struct((conv % 5).alias("ephemeral_5m_input_tokens"),
                          turn.alias("ephemeral_1h_input_tokens")).alias("cache_creation"),
                 F.struct((turn % 3).alias("web_search_requests")).alias("server_tool_use")).alias("usage")))
    stop = F.when((conv + turn) % 11 != 0,
                  ev("message_stop", F.struct(F.lit("message_stop").alias("type")))).otherwise(F.lit(""))
    raw = F.concat(start, block_start, deltas, block_stop, tool, delta, stop)
    return c.select("conv_id", "turn", raw.alias("raw"))


BLOCK_BODY_MODEL = "claude-sonnet-4-6"


def block_bodies(conversations: DataFrame) -> DataFrame:
    """B3 as request bodies ``(conv_id, body)``: one message-API body per
    conversation whose messages carry block-list content (text, ``tool_use``
    with ``input`` ``{"file_path": ..}`` or ``{}``, ``tool_result``).

    One shuffle by ``conv_id``; both groupings below reuse that partitioning.
    A group is one conversation, bounded by the 10 MiB body cap.
    """
    b = blocks(conversations).repartition("conv_id")
    block = F.struct(
        F.col("type"), F.col("text"),
        F.when(F.col("type") == "tool_use", F.col("tool_id")).alias("id"),
        F.col("tool_name").alias("name"),
        F.when(F.col("type") == "tool_use", F.struct(F.col("file_path"))).alias("input"),
        F.when(F.col("type") == "tool_result", F.col("tool_id")).alias("tool_use_id"),
        F.when(F.col("type") == "tool_result", F.col("text")).alias("content"))
    block = F.when(F.col("type") == "tool_result", block.withField("text", F.lit(None).cast("string"))
                   ).otherwise(block)
    per_msg = (b.groupBy("conv_id", "turn")
               .agg(F.first("role").alias("role"),
                    F.array_sort(F.collect_list(F.struct("block_idx", block.alias("b")))).alias("_b"))
               .select("conv_id", "turn", F.struct(
                   F.col("role"), F.transform("_b", lambda x: x["b"]).alias("content")).alias("m")))
    per_conv = (per_msg.groupBy("conv_id")
                .agg(F.array_sort(F.collect_list(F.struct("turn", "m"))).alias("_m")))
    body = F.to_json(F.struct(F.lit(BLOCK_BODY_MODEL).alias("model"),
                              F.transform("_m", lambda x: x["m"]).alias("messages"),
                              F.lit(2048).alias("max_tokens")))
    return per_conv.select("conv_id", body.alias("body"))


def ordered_tool_bodies(conversations: DataFrame) -> DataFrame:
    """Request bodies ``(conv_id, turn, body)`` of assistant turns with two tool calls whose inputs must stay as they are:
    keys out of order, a key of ``conv_id``, nested values, numbers with a spelling, and the turn's text."""
    c = conversations.where(F.col("role") == "assistant")
    text = F.to_json(F.struct(F.coalesce("text", F.lit("")).alias("t")))
    text = F.substr(text, F.lit(6), F.char_length(text) - 6)
    first = F.concat(F.lit('{"z":'), _s(F.col("turn")), F.lit(',"a":{"k'), _s(F.col("conv_id") % 10),
                     F.lit('":[1.50,2e3,null,true],"b":{}},"text":'), text, F.lit("}"))
    use = lambda i, name, value: F.concat(F.lit('{"type":"tool_use","id":"u' + i + '","name":"' + name + '","input":'), value,
                                          F.lit("}"))
    body = F.concat(F.lit('{"model":"gpt-5-mini","messages":[{"role":"user","content":"go"},{"role":"assistant","content":['
                          '{"type":"text","text":"calling"},'), use("1", "Edit", first), F.lit(","),
                    use("2", "Bash", F.lit('{"cmd":"ls","args":[]}')), F.lit("]}]}"))
    return c.select("conv_id", "turn", body.alias("body"))


def transcript_files(conversations: DataFrame) -> DataFrame:
    """B7 as transcript lines of projects ``(project, session_id, line_no, value)``: project ``p1`` holds every session;
    ``p0`` holds those with ``conv_id % 4 = 0``, without a title, and those with ``conv_id % 4 = 1``, under another."""
    own = title_jsonl_lines(conversations).select(F.lit("p1").alias("project"), "session_id", "line_no",
                                                  F.col("line").alias("value"))
    ids = conversations.select("conv_id").distinct()
    title = F.when(F.col("conv_id") % 4 == 1, F.concat(F.lit("other "), _s(F.col("conv_id")))).otherwise(F.lit(" "))
    copies = ids.where(F.col("conv_id") % 4 < 2).select(
        F.lit("p0").alias("project"), F.concat(F.lit("c"), _s(F.col("conv_id"))).alias("session_id"),
        F.lit(0).cast("long").alias("line_no"),
        F.to_json(F.struct(F.lit("ai-title").alias("type"), title.alias("aiTitle"))).alias("value"))
    return own.withColumn("line_no", F.col("line_no").cast("long")).unionByName(copies)


# --- FIXED VALUES: chat finish reasons cycled by turn % 5 --------------------
FINISH_REASON_CYCLE: tuple = ("stop", "length", "tool_calls", "content_filter", None)
# ---------------------------------------------------------------------------


def chat_responses(conversations: DataFrame) -> DataFrame:
    """Chat-completions responses ``(conv_id, turn, body)`` for assistant turns.

    Rules on ``(c, t) = (conv_id, turn)``: text in ``content``, except when
    ``(c + t) % 5 = 0`` where content is ``""`` and the text is in
    ``reasoning``; one tool call (id ``call_<c>_<t>``, B3's tool name, file
    arguments for Read) when ``c % 2 = 0``; ``finish_reason`` cycles
    stop/length/tool_calls/content_filter/absent by ``t % 5``; usage
    ``prompt_tokens = c*10+t``, ``completion_tokens = length(text)``,
    absent when ``t % 7 = 3``; no ``id`` when ``t % 6 = 5``.
    """
    c = conversations.where(F.col("role") == "assistant")
    conv, turn = F.col("conv_id"), F.col("turn")
    text = F.coalesce(F.col("text"), F.lit(""))
    in_reasoning = (conv + turn) % 5 == 0
    k = (conv + turn) % 3
    args = F.when(k == 0, F.to_json(F.struct(
        F.concat(F.lit("/src/f"), _s(conv % 7), F.lit(".py")).alias("file_path")))).otherwise(F.lit("{}"))
    call = F.struct(F.concat(F.lit("call_"), _s(conv), F.lit("_"), _s(turn)).alias("id"),
                    F.lit("function").alias("type"),
                    F.struct(_tool_name_for(conv, turn).alias("name"),
                             args.alias("arguments")).alias("function"))
    finish = F.element_at(F.array(*[F.lit(x).cast("string") for x in FINISH_REASON_CYCLE]),
                          (turn % 5 + 1).cast("int"))
    body = F.to_json(F.struct(
        F.when(turn % 6 != 5, F.concat(F.lit("chatcmpl-"), _s(conv), F.lit("-"), _s(turn))).alias("id"),
        F.lit("chat.completion").alias("object"),
        F.lit("gpt-5-mini").alias("model"),
        F.array(F.struct(
            F.lit(0).alias("index"),
            F.struct(F.lit("assistant").alias("role"),
                     F.when(in_reasoning, F.lit("")).otherwise(text).alias("content"),
                     F.when(in_reasoning, text).alias("reasoning"),
                     F.when(conv % 2 == 0, F.array(call)).alias("tool_calls")).alias("message"),
            finish.alias("finish_reason"))).alias("choices"),
        F.when(turn % 7 != 3, F.struct((conv * 10 + turn).alias("prompt_tokens"),
                                       F.char_length(text).alias("completion_tokens"))).alias("usage")))
    return c.select("conv_id", "turn", body.alias("body"))


def message_responses(conversations: DataFrame) -> DataFrame:
    """Message-API responses ``(conv_id, turn, body, status)`` for assistant turns.

    Text block, then a tool call for even conversations; usage with a 5m/1h
    split and web searches; status 529 with an error body when ``turn % 8 = 7``.
    """
    c = conversations.where(F.col("role") == "assistant")
    conv, turn = F.col("conv_id"), F.col("turn")
    text = F.coalesce(F.col("text"), F.lit(""))
    null_s = F.lit(None).cast("string")
    block = F.struct(F.lit("text").alias("type"), text.alias("text"), null_s.alias("id"), null_s.alias("name"))
    call = F.struct(F.lit("tool_use").alias("type"), null_s.alias("text"),
                    F.concat(F.lit("tu_"), _s(conv), F.lit("_"), _s(turn)).alias("id"),
                    _tool_name_for(conv, turn).alias("name"))
    usage = F.struct((conv * 10 + turn).alias("input_tokens"), F.char_length(text).alias("output_tokens"),
                     F.struct((conv % 5).alias("ephemeral_5m_input_tokens"), turn.alias("ephemeral_1h_input_tokens"))
                     .alias("cache_creation"),
                     F.struct((turn % 3).alias("web_search_requests")).alias("server_tool_use"))
    ok = F.to_json(F.struct(
        F.concat(F.lit("msg_"), _s(conv), F.lit("_"), _s(turn)).alias("id"), F.lit("message").alias("type"),
        F.lit("assistant").alias("role"),
        F.when(conv % 2 == 0, F.array(block, call)).otherwise(F.array(block)).alias("content"),
        F.when(conv % 2 == 0, "tool_use").otherwise("end_turn").alias("stop_reason"), usage.alias("usage")))
    failed = F.concat(F.lit('{"type":"error","error":{"type":"overloaded_error","message":"busy '), _s(conv), F.lit('"}}'))
    down = turn % 8 == 7
    return c.select("conv_id", "turn", F.when(down, failed).otherwise(ok).alias("body"),
                    F.when(down, 529).otherwise(200).alias("status"))


# --- FIXED VALUES: stop reasons of non-streamed log lines, cycled by n % 3 ---
LOG_STOP_CYCLE: tuple[str, ...] = ("end_turn", "tool_use", "max_tokens")
# ---------------------------------------------------------------------------


def request_log_lines(events: DataFrame) -> DataFrame:
    """B6: the JSONL request log written from B1, one line per call ``(value)``.

    Rules on ``n = event_id``: ``ts`` is the call end (event time plus
    ``elapsed_ms``) as float epoch seconds; ``request`` carries the upstream
    model (search calls: the client's name), stream, ``max_tokens = 1024 *
    (1 + n % 8)``, ``n_messages = 1 + n % 5``, the raw user id and tool names
    (``web_search`` for search calls, ``Read, Bash`` when ``n % 3 = 1``);
    ``req_bytes = 500 + n * 13 % 20000``, ``resp_bytes = 100 + n * 29 % 50000``.
    Native and translated lines carry the usage (null counts absent) and, when
    not streamed, a stop reason cycled by ``n % 3``; search lines carry depth
    (basic when ``n`` is even), result count ``n % 6``, query and cost.  A
    passthrough line replaces the call when ``n % 19 = 0``; the line is cut in
    half (malformed) when ``n % 97 = 5``.
    """
    from gatemeter.functions.models import map_model_name

    raw = usage_raw(events)
    n = F.substring(F.col("request_id"), 5, 1 << 20).cast("long")
    route = F.col("route")
    is_search = route == "tavily"
    end_s = (F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1_000_000.0)
             + F.col("elapsed_ms") / F.lit(1000.0))
    model = F.when(is_search, F.col("requested_model")).otherwise(map_model_name(F.col("requested_model")))
    tools = (F.when(n % 17 == 0, F.array(F.lit("web_search")))
             .when(n % 3 == 1, F.array(F.lit("Read"), F.lit("Bash"))))
    req_bytes = 500 + (n * 13) % 20000
    resp_bytes = 100 + (n * 29) % 50000
    request = F.struct(model.alias("model"), F.col("stream").alias("stream"),
                       (F.lit(1024) * (1 + n % 8)).alias("max_tokens"),
                       (1 + n % 5).alias("n_messages"),
                       F.col("user_id_raw").alias("user_id"), tools.alias("tools"))
    usage = F.struct(F.col("raw_input_tokens").alias("input_tokens"),
                     F.col("raw_output_tokens").alias("output_tokens"),
                     F.col("raw_cache_read").alias("cache_read_input_tokens"),
                     F.col("raw_cache_creation").alias("cache_creation_input_tokens"))
    depth = F.when(n % 2 == 0, F.lit("basic")).otherwise(F.lit("advanced"))
    # one struct for every shape: fields that do not apply are null, and
    # to_json leaves null fields out
    response = F.struct(
        F.col("status").alias("status"), F.col("stream").alias("stream"),
        F.when(route == "openai", F.lit(True)).alias("translated"),
        F.when(is_search, F.lit(True)).alias("tavily"),
        F.when(~is_search, usage).alias("usage"),
        F.when(~is_search & ~F.col("stream"), _cycle(LOG_STOP_CYCLE, n % 3)).alias("stop_reason"),
        F.when(is_search, depth).alias("search_depth"),
        F.when(is_search, n % 6).alias("results"),
        F.when(is_search, F.concat(F.lit("q "), _s(n))).alias("query"),
        req_bytes.alias("req_bytes"), resp_bytes.alias("resp_bytes"),
        F.when(is_search, F.when(n % 2 == 0, F.lit(0.005)).otherwise(F.lit(0.008))).alias("cost_usd"))
    line = F.to_json(F.struct(
        end_s.alias("ts"), F.lit("/v1/messages").alias("path"), request.alias("request"),
        response.alias("response"), F.col("elapsed_ms").alias("elapsed_ms")))
    passthrough = F.to_json(F.struct(
        end_s.alias("ts"), F.lit("/v1/chat/completions").alias("path"),
        F.struct(F.col("requested_model").alias("model"), F.col("stream").alias("stream"),
                 (1 + n % 5).alias("n_messages"), F.lit("chat").alias("passthrough")).alias("request"),
        F.struct(F.col("status").alias("status"), F.col("stream").alias("stream"),
                 req_bytes.alias("req_bytes"), resp_bytes.alias("resp_bytes")).alias("response"),
        F.col("elapsed_ms").alias("elapsed_ms")))
    full = F.when(n % 19 == 0, passthrough).otherwise(line)
    cut = F.when(n % 97 == 5, F.substring(full, 1, F.floor(F.char_length(full) / 2).cast("int"))
                 ).otherwise(full)
    return raw.select(cut.alias("value"))


SSE_CHUNK_BYTES = 7
STREAM_EPOCH_S = 1704067200  # 2024-01-01T00:00:00Z


def sse_chunks(conversations: DataFrame, chunk_bytes: int = SSE_CHUNK_BYTES) -> DataFrame:
    """B5: B4's captures as network reads ``(conv_id, turn, seq, start_ts,
    arrival_ts, chunk)``: the UTF-8 bytes cut every ``chunk_bytes`` bytes (a
    multi-byte character may be split), read ``k`` arriving at
    ``start + 100 ms + k * 20 ms``; a call starts at
    ``2024-01-01 + conv_id hours + turn minutes``."""
    raw = sse_raw(conversations).select("conv_id", "turn", F.encode("raw", "UTF-8").alias("_b"))
    n = F.ceil(F.octet_length("_b") / F.lit(chunk_bytes)).cast("int")
    start = F.timestamp_seconds(F.lit(STREAM_EPOCH_S) + F.col("conv_id") * 3600 + F.col("turn") * 60)
    pieces = raw.select("conv_id", "turn", "_b", start.alias("start_ts"),
                        F.posexplode(F.sequence(F.lit(0), n - 1)).alias("seq", "_k"))
    return pieces.select(
        "conv_id", "turn", "seq", "start_ts",
        F.timestamp_micros(F.unix_micros("start_ts") + (F.lit(100) + F.col("seq") * 20) * 1000)
        .alias("arrival_ts"),
        F.substring("_b", F.col("seq") * chunk_bytes + 1, F.lit(chunk_bytes)).alias("chunk"))


LIVE_CHUNK_BYTES = 64


def live_reads(conversations: DataFrame, chunk_bytes: int = LIVE_CHUNK_BYTES) -> DataFrame:
    """B5 as live traffic: the same reads, ``chunk_bytes`` long, of streams that
    all start within a minute (second ``(7 conv_id + 3 turn) % 60``).  A whole
    stream ends with an empty read, 20 ms after its last; those without
    ``message_stop`` never end."""
    reads = sse_chunks(conversations, chunk_bytes)
    start = F.timestamp_seconds(F.lit(STREAM_EPOCH_S) + (7 * F.col("conv_id") + 3 * F.col("turn")) % 60)
    at = lambda seq: F.timestamp_micros(F.unix_micros(start) + (F.lit(100) + seq * 20) * 1000)
    data = reads.select("conv_id", "turn", F.col("seq").cast("long").alias("seq"), start.alias("start_ts"),
                        at(F.col("seq")).alias("arrival_ts"), "chunk")
    ends = (reads.where((F.col("conv_id") + F.col("turn")) % 11 != 0).groupBy("conv_id", "turn")
            .agg((F.max("seq") + 1).cast("long").alias("seq"))
            .select("conv_id", "turn", "seq", start.alias("start_ts"), at(F.col("seq")).alias("arrival_ts"),
                    F.lit(b"").alias("chunk")))
    return data.unionByName(ends)


PAGES_PER_SEARCH = 5


def search_responses(pages: DataFrame) -> DataFrame:
    """Search-provider responses from ``pages`` ``(search_id, query, answer, results)``.

    Rules: search ``s`` returned pages ``5s .. 5s+4`` in page order; each
    result's title is the page's ``<title>`` (absent when empty), content the
    page text with tags replaced by spaces and runs of whitespace collapsed;
    query ``search <s>``; an answer (with padding to strip) when ``s % 3 = 0``;
    when ``s % 7 = 6`` there is one more search, ``-s - 1``, without any
    result.  A group is at most 5 pages.
    """
    html = F.col("html")
    title = F.nullif(F.regexp_extract(html, "<title>(.*?)</title>", 1), F.lit(""))
    text = F.regexp_replace(F.regexp_replace(html, "<[^>]*>", " "), "[ \t\n\r]+", " ")
    sid = F.floor(F.col("page_id") / PAGES_PER_SEARCH).cast("long")
    r = (pages.select(sid.alias("search_id"), "page_id",
                      F.struct(F.col("url"), title.alias("title"), text.alias("content")).alias("r"))
         .groupBy("search_id")
         .agg(F.array_sort(F.collect_list(F.struct("page_id", "r"))).alias("_r")))
    some = F.struct(F.col("search_id"), F.transform("_r", lambda x: x["r"]).alias("results"))
    none = F.struct((-F.col("search_id") - 1).alias("search_id"), F.array().cast(
        "array<struct<url:string,title:string,content:string>>").alias("results"))
    r = r.select(F.inline(F.when(F.col("search_id") % 7 == 6, F.array(some, none)).otherwise(F.array(some))))
    return r.select("search_id",
                    F.concat(F.lit("search "), _s(F.col("search_id"))).alias("query"),
                    F.when(F.col("search_id") % 3 == 0,
                           F.concat(F.lit("  answer "), _s(F.col("search_id")), F.lit(" \n")))
                    .alias("answer"),
                    "results")


def chat_sse_raw(conversations: DataFrame) -> DataFrame:
    """A collected chat-completions stream per assistant turn ``(conv_id, turn, raw)``.

    Same rules as :func:`chat_responses`, streamed: a role chunk (with the id
    unless ``turn % 6 = 5``), the text in 64-character ``content`` deltas (in
    ``reasoning`` deltas when ``(conv_id + turn) % 5 = 0``), for even
    conversations a tool call opened in one chunk and its arguments in the
    next, a finish chunk (absent when ``turn % 5 = 4``), a usage chunk (absent
    when ``turn % 7 = 3``), ``[DONE]`` and a stray line after it.
    """
    c = conversations.where(F.col("role") == "assistant")
    conv, turn = F.col("conv_id"), F.col("turn")
    text = F.coalesce(F.col("text"), F.lit(""))
    n = F.ceil(F.char_length(text) / SSE_PIECE_CHARS).cast("int")
    idx = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    in_reasoning = (conv + turn) % 5 == 0
    cid = F.when(turn % 6 != 5, F.concat(F.lit("chatcmpl-"), _s(conv), F.lit("-"), _s(turn)))

    def data(payload: Column) -> Column:
        return F.concat(F.lit("data: "), F.to_json(payload), F.lit("\n\n"))

    def chunk(delta: Column, finish: Column | None = None) -> Column:
        return data(F.struct(cid.alias("id"), F.lit("chat.completion.chunk").alias("object"),
                             F.array(F.struct(F.lit(0).alias("index"), delta.alias("delta"),
                                              (finish if finish is not None else F.lit(None).cast("string"))
                                              .alias("finish_reason"))).alias("choices")))

    role = chunk(F.struct(F.lit("assistant").alias("role")))
    pieces = F.array_join(F.transform(idx, lambda i: F.when(
        in_reasoning, chunk(F.struct(F.substring(text, i * SSE_PIECE_CHARS + 1, F.lit(SSE_PIECE_CHARS))
                                     .alias("reasoning"))))
        .otherwise(chunk(F.struct(F.substring(text, i * SSE_PIECE_CHARS + 1, F.lit(SSE_PIECE_CHARS))
                                  .alias("content"))))), "")
    k = (conv + turn) % 3
    args = F.when(k == 0, F.to_json(F.struct(
        F.concat(F.lit("/src/f"), _s(conv % 7), F.lit(".py")).alias("file_path")))).otherwise(F.lit("{}"))
    call_id = F.concat(F.lit("call_"), _s(conv), F.lit("_"), _s(turn))
    tools = F.when(conv % 2 == 0, F.concat(
        chunk(F.struct(F.array(F.struct(F.lit(0).alias("index"), call_id.alias("id"),
                                        F.lit("function").alias("type"),
                                        F.struct(_tool_name_for(conv, turn).alias("name"),
                                                 F.lit("").alias("arguments")).alias("function")))
                       .alias("tool_calls"))),
        chunk(F.struct(F.array(F.struct(F.lit(0).alias("index"),
                                        F.struct(args.alias("arguments")).alias("function")))
                       .alias("tool_calls"))))).otherwise(F.lit(""))
    finish = F.element_at(F.array(*[F.lit(x).cast("string") for x in FINISH_REASON_CYCLE]),
                          (turn % 5 + 1).cast("int"))
    fin = F.when(finish.isNotNull(), chunk(F.struct(F.lit(None).cast("string").alias("content")), finish)
                 ).otherwise(F.lit(""))
    usage = F.when(turn % 7 != 3, data(F.struct(
        cid.alias("id"), F.array().cast("array<string>").alias("choices"),
        F.struct((conv * 10 + turn).alias("prompt_tokens"),
                 F.char_length(text).alias("completion_tokens")).alias("usage")))).otherwise(F.lit(""))
    tail = F.lit("data: [DONE]\n\ndata: {\"choices\": [{\"delta\": {\"content\": \"after done\"}}]}\n\n")
    return c.select("conv_id", "turn", F.concat(role, pieces, tools, fin, usage, tail).alias("raw"))


def responses_sse_raw(conversations: DataFrame) -> DataFrame:
    """A collected Responses-API stream per assistant turn ``(conv_id, turn, raw)``.

    Rules on ``(c, t)``: ``response.created`` and ``response.in_progress``; the
    text in 64-character ``response.output_text.delta`` events; for even
    conversations a function call (output index 1, B3's tool name) and its
    arguments; then ``response.completed`` (usage ``c*10+t`` in,
    ``length(text)`` out, absent when ``t % 7 = 3``) when ``t % 5`` is 0, 1
    or 2, ``response.incomplete`` (``max_output_tokens``) when 3 and
    ``response.failed`` when 4.  Odd turns write ``data:`` without the space.
    Every stream ends with an event that has no closing blank line, which a
    reader must still hold and never emit.
    """
    c = conversations.where(F.col("role") == "assistant")
    conv, turn = F.col("conv_id"), F.col("turn")
    text = F.coalesce(F.col("text"), F.lit(""))
    n = F.ceil(F.char_length(text) / SSE_PIECE_CHARS).cast("int")
    idx = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    sep = F.when(turn % 2 == 1, F.lit("data:")).otherwise(F.lit("data: "))

    def ev(name: str, payload: Column) -> Column:
        return F.concat(F.lit(f"event: {name}\n"), sep, F.to_json(payload), F.lit("\n\n"))

    head = F.concat(
        ev("response.created", F.struct(F.lit("response.created").alias("type"))),
        ev("response.in_progress", F.struct(F.lit("response.in_progress").alias("type"))))
    pieces = F.array_join(F.transform(idx, lambda i: ev("response.output_text.delta", F.struct(
        F.lit("response.output_text.delta").alias("type"), F.lit(0).alias("output_index"),
        F.substring(text, i * SSE_PIECE_CHARS + 1, F.lit(SSE_PIECE_CHARS)).alias("delta")))), "")
    k = (conv + turn) % 3
    args = F.when(k == 0, F.to_json(F.struct(
        F.concat(F.lit("/src/f"), _s(conv % 7), F.lit(".py")).alias("file_path")))).otherwise(F.lit("{}"))
    tool = F.when(conv % 2 == 0, F.concat(
        ev("response.output_item.added", F.struct(
            F.lit("response.output_item.added").alias("type"), F.lit(1).alias("output_index"),
            F.struct(F.lit("function_call").alias("type"),
                     F.concat(F.lit("fc_"), _s(conv), F.lit("_"), _s(turn)).alias("id"),
                     F.concat(F.lit("call_"), _s(conv), F.lit("_"), _s(turn)).alias("call_id"),
                     _tool_name_for(conv, turn).alias("name")).alias("item"))),
        ev("response.function_call_arguments.delta", F.struct(
            F.lit("response.function_call_arguments.delta").alias("type"),
            F.lit(1).alias("output_index"), args.alias("delta"))))).otherwise(F.lit(""))
    usage = F.when(turn % 7 != 3, F.struct((conv * 10 + turn).alias("input_tokens"),
                                           F.char_length(text).alias("output_tokens")))
    end = (F.when(turn % 5 <= 2, ev("response.completed", F.struct(
        F.lit("response.completed").alias("type"),
        F.struct(F.lit("completed").alias("status"), usage.alias("usage")).alias("response"))))
        .when(turn % 5 == 3, ev("response.incomplete", F.struct(
            F.lit("response.incomplete").alias("type"),
            F.struct(F.struct(F.lit("max_output_tokens").alias("reason")).alias("incomplete_details"))
            .alias("response"))))
        .otherwise(ev("response.failed", F.struct(F.lit("response.failed").alias("type")))))
    tail = F.lit('event: response.output_text.delta\ndata: {"delta": "never closed"}')
    return c.select("conv_id", "turn", F.concat(head, pieces, tool, end, tail).alias("raw"))


__all__ = ["usage_raw", "calls_from_usage_raw", "blocks", "block_bodies", "chat_responses", "title_lines", "title_jsonl_lines",
           "REQUESTED_MODEL_CYCLE", "fixed"]
