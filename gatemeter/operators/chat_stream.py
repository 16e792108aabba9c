"""C-3 / A-19: a collected chat-completions stream -> message event stream.

A collected stream is one row, so the conversion is a per-row projection (no
shuffle).  What the gateway's loop carries from chunk to chunk (has a text block
started; how many tool calls have been opened; was reasoning buffered) is read
off positions here: the first chunk with content, with reasoning, with a tool
id, the chunk of the fallback, and the sorted chunk numbers of all tool ids, in
which a binary search counts those before a chunk.  A ``transform`` turns each
chunk into its events from that, so every block index is exactly the gateway's
and the work is linear in the chunks (times the search's steps):

* the text block is index 0 and is opened by the first non-empty ``content``;
* tool block ``k`` (0-based, counted by ids) has index ``k + 1`` if text had
  started by that chunk, else ``k``; argument deltas go to the current tool;
* at ``finish_reason``: buffered ``reasoning`` becomes the text when no text
  and no tool call was seen, then every open block is closed and a
  ``message_delta`` carries the mapped stop reason and output tokens;
* usage comes from the last chunk that has one; the id from the first chunk;
* lines after ``data: [DONE]`` and malformed chunks are ignored.

Event texts are the gateway's, byte for byte: its key order, blanks, escapes and
explicit nulls.  A row is one response.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatemeter.functions.requests import chat_stream_stop_reason
from gatemeter.functions.sse import format_sse
from gatemeter.functions.pyjson import python_string
from gatemeter.functions.text import pystrip

_TC = "array<struct<id:string,name:string,arguments:string>>"


def _g(v: Column, path: str, t: str = "string") -> Column:
    return F.try_variant_get(v, path, t)


def _nonempty(s: Column) -> Column:
    return F.coalesce(s, F.lit("")) != ""


def _event(name: str, fields: str, *values: Column) -> Column:
    """An event whose data is ``{"type": <name>, <fields>}``; every ``%s`` of ``fields`` is a JSON text."""
    return format_sse(F.lit(name), F.format_string(f'{{"type": "{name}"{", " if fields else ""}{fields}}}', *values))


def _text_start() -> Column:
    return _event("content_block_start", '"index": 0, "content_block": {"type": "text", "text": ""}')


def _text_delta(text: Column) -> Column:
    return _event("content_block_delta", '"index": 0, "delta": {"type": "text_delta", "text": %s}', python_string(text))


def _int(c: Column) -> Column:
    return c.cast("string")


def chat_chunks(raw: Column) -> Column:
    """SRC-4 for chat streams: ordered parsed chunks of one collected stream,
    as ``array<struct<id, content, reasoning, tool_calls, finish, usage...>>``."""
    lines = F.transform(F.split(raw, "\n"), pystrip)
    datas = F.transform(F.filter(lines, lambda x: x.startswith("data: ")),
                        lambda x: F.substring(x, 7, 1 << 30))
    done = F.array_position(datas, "[DONE]")
    kept = F.when(done > 0, F.slice(datas, 1, (done - 1).cast("int"))).otherwise(datas)
    parsed = F.filter(F.transform(kept, lambda d: F.try_parse_json(d)), lambda v: v.isNotNull())
    return F.transform(parsed, lambda v: F.struct(
        _g(v, "$.id").alias("id"),
        _g(v, "$.choices[0].delta.content").alias("content"),
        _g(v, "$.choices[0].delta.reasoning").alias("reasoning"),
        F.coalesce(F.transform(_g(v, "$.choices[0].delta.tool_calls", "array<variant>"),
                               lambda t: F.struct(_g(t, "$.id").alias("id"),
                                                  _g(t, "$.function.name").alias("name"),
                                                  _g(t, "$.function.arguments").alias("arguments"))),
                   F.array().cast(_TC)).alias("tool_calls"),
        _g(v, "$.choices[0].finish_reason").alias("finish"),
        (F.size(F.coalesce(_g(v, "$.usage", "map<string,string>"),
                           F.create_map().cast("map<string,string>"))) > 0).alias("has_usage"),
        F.coalesce(_g(v, "$.usage.prompt_tokens", "bigint"), F.lit(0)).alias("prompt_tokens"),
        F.coalesce(_g(v, "$.usage.completion_tokens", "bigint"), F.lit(0)).alias("completion_tokens")))


def _n_ids(c: Column) -> Column:
    return F.size(F.filter(c["tool_calls"], lambda t: _nonempty(t["id"])))


def _buffers(c: Column) -> Column:
    return ~_nonempty(c["content"]) & _nonempty(c["reasoning"])


def _stage(df: DataFrame, cols: list[Column]) -> DataFrame:
    """Project ``cols`` behind a generator.  Later lambdas read the staged
    arrays as columns; without the barrier Catalyst may inline a staged
    expression into a lambda, where it would be re-evaluated per element."""
    return df.select(F.inline(F.array(F.struct(*cols))))


# a binary search's steps: arrays of up to 2^21 entries
_STEPS = [1 << k for k in range(20, -1, -1)]


def count_below(places: Column, i: Column) -> Column:
    """How many entries of the sorted array ``places`` are smaller than ``i``."""
    return F.aggregate(F.array(*[F.lit(s) for s in _STEPS]), F.lit(0), lambda low, s: F.when(
        F.get(places, low + s - 1) < i, low + s).otherwise(low))


def _first(cks: Column, test) -> Column:
    """Number of the first chunk that passes (from 0), or one beyond the last."""
    at = F.array_position(F.transform(cks, lambda c: F.coalesce(test(c), F.lit(False))), F.lit(True))
    return F.when(at > 0, at - 1).otherwise(F.size(cks)).cast("int")


def _chat_events(p: dict[str, Column]) -> Column:
    """Events of every chunk from the staged chunks and places (C-3)."""
    cks = p["cks"]
    none = F.array().cast("array<string>")

    def chunk_events(c, i):
        has_text = _nonempty(c["content"])
        fallback = i == p["fallback"]
        # text has started by this chunk's tool calls, and by its end
        text_by = i >= p["content"]
        text_by = text_by | (i > p["fallback"])
        before = count_below(p["ids"], i)
        off = F.when(text_by, 1).otherwise(0)
        opened = has_text & (i == p["content"]) & (i <= p["fallback"])
        text_ev = F.when(has_text, F.concat(
            F.when(opened, F.array(_text_start())).otherwise(none), F.array(_text_delta(c["content"])))).otherwise(none)
        tc = c["tool_calls"]

        def tool_events(t, j):
            index = _int(off + before - 1 + F.size(F.filter(F.slice(tc, 1, j + 1), lambda x: _nonempty(x["id"]))))
            begin = _event("content_block_start", '"index": %s, "content_block": {"type": "tool_use", "id": %s, "name": %s, '
                           '"input": {}}', index, python_string(t["id"]), python_string(t["name"]))
            more = _event("content_block_delta", '"index": %s, "delta": {"type": "input_json_delta", "partial_json": %s}',
                          index, python_string(t["arguments"]))
            return F.concat(F.when(_nonempty(t["id"]), F.array(begin)).otherwise(none),
                            F.when(_nonempty(t["arguments"]), F.array(more)).otherwise(none))

        tool_ev = F.when(F.size(tc) > 0, F.flatten(F.transform(tc, tool_events))).otherwise(none)
        reasoning = F.array_join(F.transform(
            F.filter(F.slice(cks, 1, i + 1), _buffers), lambda x: x["reasoning"]), "")
        n_blocks = F.when(text_by | fallback, 1).otherwise(0) + before + _n_ids(c)
        stops = F.when(n_blocks > 0, F.transform(F.sequence(F.lit(0), n_blocks - 1), lambda k: _event(
            "content_block_stop", '"index": %s', _int(k)))).otherwise(none)
        finish_ev = F.when(_nonempty(c["finish"]), F.concat(
            F.when(fallback, F.array(_text_start(), _text_delta(reasoning))).otherwise(none), stops,
            F.array(_event("message_delta", '"delta": {"stop_reason": %s, "stop_sequence": null}, "usage": {"output_tokens": %s}',
                           python_string(chat_stream_stop_reason(c["finish"])), _int(p["out"]))))).otherwise(none)
        return F.concat(text_ev, tool_ev, finish_ev)

    start = _event("message_start", '"message": {"id": %s, "type": "message", "role": "assistant", "model": %s, "content": [], '
                   '"stop_reason": null, "stop_sequence": null, "usage": {"input_tokens": %s, "output_tokens": 0}}',
                   python_string(p["id"]), python_string(p["model"]), _int(p["in"]))
    body = F.array_join(F.flatten(F.transform(cks, chunk_events)), "")
    return F.when(F.size(cks) > 0, F.concat(start, body, _event("message_stop", ""))).otherwise(F.lit(""))


def convert_chat_streams(streams: DataFrame, keys: list[str], raw_col: str = "raw",
                         model: str = "claude-sonnet-4.6") -> DataFrame:
    """C-3 for a table of collected streams: ``(*keys, events)``, the message
    event stream as SSE text (``''`` when a stream has no valid chunk).

    Four narrow stages: parse the chunks once, find the places once, the
    fallback's place from them, then emit every chunk's events.
    """
    k = [F.col(c) for c in keys]
    a = _stage(streams, [*k, chat_chunks(F.col(raw_col)).alias("_cks")])
    cks = F.col("_cks")
    last_usage = F.try_element_at(F.filter(cks, lambda c: c["has_usage"]), F.lit(-1))
    b = _stage(a, [*k, cks, _first(cks, lambda c: _nonempty(c["content"])).alias("_content"),
                   _first(cks, _buffers).alias("_reasoning"), _first(cks, lambda c: _n_ids(c) > 0).alias("_tool"),
                   F.flatten(F.transform(cks, lambda c, i: F.array_repeat(i, _n_ids(c)))).alias("_ids"),
                   F.coalesce(last_usage["prompt_tokens"], F.lit(0)).alias("_in"),
                   F.coalesce(last_usage["completion_tokens"], F.lit(0)).alias("_out"),
                   F.coalesce(F.try_element_at(cks, F.lit(1))["id"], F.lit("msg_proxy")).alias("_id")])
    # the first finish after some reasoning and before any content or tool call, itself included
    ends = F.filter(F.transform(cks, lambda c, i: F.when(
        _nonempty(c["finish"]) & (i >= F.col("_reasoning")) & (i < F.col("_content")) & (i < F.col("_tool")), i)),
        lambda i: i.isNotNull())
    names = ["content", "ids", "in", "out", "id"]
    c = _stage(b, [*k, cks, *[F.col(f"_{n}") for n in names],
                   F.coalesce(F.try_element_at(ends, F.lit(1)), F.size(cks)).alias("_fallback")])
    places = {n: F.col(f"_{n}") for n in [*names, "fallback", "cks"]} | {"model": F.lit(model)}
    return c.select(*keys, _chat_events(places).alias("events"))


# --- C-4: Responses-API stream -> chat-completions chunks ----------------------------

_DELTA = ("struct<role:string,content:string,"
          "tool_calls:array<struct<index:int,id:string,type:string,"
          "function:struct<name:string,arguments:string>>>>")


def responses_events(raw: Column) -> Column:
    """The incremental reader (T11) over one collected Responses stream:
    events cut at blank lines (a tail without one is still buffered and never
    read); per event the last ``event:`` name and the ``data:`` lines (space
    optional) joined by newlines; ``[DONE]`` and malformed data skipped; the
    type falls back to the data's ``type``.  ``array<struct<type, v>>``."""
    parts = F.split(raw, "\n\n")
    complete = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))

    def one(ev):
        lines = F.split(ev, "\n")
        names = F.transform(F.filter(lines, lambda x: x.startswith("event:")),
                            lambda x: pystrip(F.substring(x, 7, 1 << 30)))
        datas = F.transform(F.filter(lines, lambda x: x.startswith("data:")),
                            lambda x: F.ltrim(F.substring(x, 6, 1 << 30)))
        data = F.array_join(datas, "\n")
        v = F.when((F.size(datas) > 0) & (data != "[DONE]"), F.try_parse_json(data))
        name = F.try_element_at(names, F.lit(-1))
        return F.struct(F.when(F.coalesce(name, F.lit("")) != "", name)
                        .otherwise(F.coalesce(_g(v, "$.type"), F.lit(""))).alias("type"),
                        v.alias("v"))

    return F.filter(F.transform(complete, one), lambda e: e["v"].isNotNull())


def _t(e):
    return e["type"]


def _v(e):
    return e["v"]


def _key_of(e, id_path: str):
    oi = _g(_v(e), "$.output_index", "bigint")
    return F.when(oi.isNotNull(), oi.cast("string")).otherwise(F.coalesce(
        F.nullif(_g(_v(e), id_path), F.lit("")), F.lit("")))


def _is_fc_added(e):
    return (_t(e) == "response.output_item.added") & \
        F.coalesce(_g(_v(e), "$.item.type") == "function_call", F.lit(False))


def _item_key(e):
    oi = _g(_v(e), "$.output_index", "bigint")
    ident = F.coalesce(F.nullif(_g(_v(e), "$.item.id"), F.lit("")),
                       F.nullif(_g(_v(e), "$.item.call_id"), F.lit("")), F.lit(""))
    return F.when(oi.isNotNull(), oi.cast("string")).otherwise(ident)


def _is_args(e):
    return _t(e) == "response.function_call_arguments.delta"


def _allocations(evs: Column) -> Column:
    """Allocating events in order: ``array<struct<i, k, a>>``."""
    return F.filter(F.transform(evs, lambda e, i: F.struct(
        i.alias("i"),
        F.when(_is_fc_added(e), _item_key(e)).when(_is_args(e), _key_of(e, "$.item_id")).alias("k"),
        (_is_fc_added(e) | _is_args(e)).alias("a"))), lambda x: x["a"])


def responses_to_chat_chunks(evs: Column, alloc: Column, order: Column, first_role: Column,
                             chat_id: Column, created: Column, model: Column) -> Column:
    """C-4 from staged columns: parsed events, allocations, key order and the
    position of the first created/in-progress event.  Returns the
    chat-completions SSE text the gateway writes, ending with ``data: [DONE]``.

    Tool-call indices are allocated at the first sight of a key (the
    ``output_index``, else the item id): the first occurrence order of keys
    among allocating events, read off ``array_distinct`` of that sequence.
    """
    t, v = _t, _v
    key_of, is_fc_added, item_key, is_args = _key_of, _is_fc_added, _item_key, _is_args

    def chunk(delta: Column, finish: Column | None = None, usage: Column | None = None) -> Column:
        body = F.to_json(F.struct(
            chat_id.alias("id"), F.lit("chat.completion.chunk").alias("object"),
            created.alias("created"), model.alias("model"),
            F.array(F.struct(F.lit(0).alias("index"), F.parse_json(F.to_json(delta)).alias("delta"),
                             (finish if finish is not None else F.lit(None).cast("string"))
                             .alias("finish_reason"))).alias("choices")),
            {"ignoreNullFields": "false"})
        if usage is not None:
            body = F.when(usage.isNotNull(), F.concat(
                F.substring(body, 1, F.char_length(body) - 1), F.lit(',"usage":'), F.to_json(usage),
                F.lit("}"))).otherwise(body)
        return F.concat(F.lit("data: "), body, F.lit("\n\n"))

    def delta(role=None, content=None, tool=None) -> Column:
        return F.struct(
            (role if role is not None else F.lit(None).cast("string")).alias("role"),
            (content if content is not None else F.lit(None).cast("string")).alias("content"),
            (F.array(tool) if tool is not None else F.lit(None)).cast(
                "array<struct<index:int,id:string,type:string,"
                "function:struct<name:string,arguments:string>>>").alias("tool_calls"))

    def tool(idx, ident=None, typ=None, name=None, args=None) -> Column:
        n = F.lit(None).cast("string")
        return F.struct(idx.cast("int").alias("index"), (ident if ident is not None else n).alias("id"),
                        (typ if typ is not None else n).alias("type"),
                        F.struct((name if name is not None else n).alias("name"),
                                 (args if args is not None else n).alias("arguments")).alias("function"))

    def idx_of(k):
        return F.array_position(order, k) - 1

    def first_alloc_at(k, i):
        return F.try_element_at(F.filter(alloc, lambda x: x["k"] == k), F.lit(1))["i"] == i

    def one(e, i):
        none = F.lit("")
        u = _g(v(e), "$.response.usage", "variant")
        has_u = F.size(F.coalesce(_g(v(e), "$.response.usage", "map<string,string>"),
                                  F.create_map().cast("map<string,string>"))) > 0
        it, ot = (F.coalesce(_g(u, "$.input_tokens", "bigint"), F.lit(0)),
                  F.coalesce(_g(u, "$.output_tokens", "bigint"), F.lit(0)))
        usage = F.when(has_u, F.struct(it.alias("prompt_tokens"), ot.alias("completion_tokens"),
                                       F.coalesce(_g(u, "$.total_tokens", "bigint"), it + ot)
                                       .alias("total_tokens")))
        saw_tool = F.size(F.filter(alloc, lambda x: x["i"] < i)) > 0
        reason = F.coalesce(_g(v(e), "$.response.incomplete_details.reason"), F.lit(""))
        from gatemeter.functions.requests import responses_incomplete_finish
        text = F.coalesce(_g(v(e), "$.delta"), F.lit(""))
        ik = item_key(e)
        ak = key_of(e, "$.item_id")
        return (
            F.when(t(e).isin("response.created", "response.in_progress"),
                   F.when(first_role == i + 1, chunk(delta(F.lit("assistant"), F.lit("")))).otherwise(none))
            .when(t(e) == "response.output_text.delta",
                  F.when(text != "", chunk(delta(content=text))).otherwise(none))
            .when(is_fc_added(e), F.when(first_alloc_at(ik, i), chunk(delta(tool=tool(
                idx_of(ik),
                F.coalesce(F.nullif(_g(v(e), "$.item.call_id"), F.lit("")),
                           F.nullif(_g(v(e), "$.item.id"), F.lit("")), F.lit("")),
                F.lit("function"), F.coalesce(_g(v(e), "$.item.name"), F.lit("")), F.lit("")))))
                .otherwise(none))
            .when(is_args(e), F.when(text != "", chunk(delta(tool=tool(idx_of(ak), args=text))))
                  .otherwise(none))
            .when(t(e) == "response.completed", chunk(
                delta(), F.when(saw_tool, F.lit("tool_calls")).otherwise(F.lit("stop")), usage))
            .when(t(e) == "response.incomplete", chunk(delta(), responses_incomplete_finish(reason)))
            .when(t(e).isin("response.failed", "error"), chunk(delta(), F.lit("stop")))
            .otherwise(none))

    return F.concat(F.array_join(F.transform(evs, one), ""), F.lit("data: [DONE]\n\n"))


def convert_responses_streams(streams: DataFrame, keys: list[str], chat_id: Column, created: Column,
                              raw_col: str = "raw", model: str = "claude-sonnet-4.6") -> DataFrame:
    """C-4 for a table of collected Responses streams: ``(*keys, chunks)``.

    Staged like C-3: parse the events once, derive the tool-index allocation
    once, then emit every event's chunk from the staged columns.
    """
    k = [F.col(c) for c in keys]
    a = _stage(streams, [*k, chat_id.alias("_cid"), created.alias("_created"),
                         responses_events(F.col(raw_col)).alias("_evs")])
    evs = F.col("_evs")
    b = _stage(a, [*k, F.col("_cid"), F.col("_created"), evs, _allocations(evs).alias("_alloc")])
    alloc = F.col("_alloc")
    c = _stage(b, [*k, F.col("_cid"), F.col("_created"), evs, alloc,
                   F.array_distinct(F.transform(alloc, lambda x: x["k"])).alias("_order"),
                   F.array_position(F.transform(evs, lambda e: _t(e).isin(
                       "response.created", "response.in_progress")), F.lit(True)).alias("_first_role")])
    return c.select(*keys, responses_to_chat_chunks(
        evs, alloc, F.col("_order"), F.col("_first_role"), F.col("_cid"), F.col("_created"),
        F.lit(model)).alias("chunks"))
