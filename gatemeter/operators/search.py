"""Search results rendered for the client (P-22, P-23, C-5).

How many results a search returns (S-4) is a parameter of the request to the
provider; landed results are all rendered.

Input is a table of search responses ``(search_id, query, answer, results)``
where ``results`` is the provider's ordered list of
``struct(url, title, content)``.  Everything here is a per-row projection
with ``transform``/``array_join``: a row is one response, so nothing shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatemeter import fixed
from gatemeter.functions.sse import format_sse
from gatemeter.functions.text import pystrip


def result_blocks(results: Column) -> Column:
    """P-22: provider results -> ``web_search_result`` blocks (url, title,
    stripped content in ``encrypted_content``, null ``page_age``)."""
    return F.transform(F.coalesce(results, F.array().cast(results_type())), lambda r: F.struct(
        F.lit("web_search_result").alias("type"),
        F.coalesce(F.nullif(r["url"], F.lit("")), F.lit("")).alias("url"),
        F.coalesce(F.nullif(r["title"], F.lit("")), F.lit("")).alias("title"),
        pystrip(F.coalesce(r["content"], F.lit(""))).alias("encrypted_content"),
        F.lit(None).cast("string").alias("page_age")))


def results_type() -> str:
    return "array<struct<url:string,title:string,content:string>>"


def results_markdown(query: Column, answer: Column, results: Column) -> Column:
    """P-23: the Markdown summary: heading, optional answer, then numbered
    ``## i. [title](url)`` entries (by provider position) with their stripped
    content, or ``_No results._``."""
    res = F.coalesce(results, F.array().cast(results_type()))
    head = F.concat(F.lit("# Search results for: "), query, F.lit("\n"))
    ans = pystrip(answer)
    answer_part = F.when(ans.isNotNull() & (ans != ""),
                         F.array(F.concat(F.lit("**Answer:** "), ans, F.lit("\n"))))
    entries = F.flatten(F.transform(res, lambda r, i: F.concat(
        F.array(F.concat(F.lit("\n## "), (i + 1).cast("string"), F.lit(". ["),
                         F.coalesce(F.nullif(r["title"], F.lit("")), F.lit("(no title)")),
                         F.lit("]("), F.coalesce(r["url"], F.lit("")), F.lit(")\n"))),
        F.when(pystrip(F.coalesce(r["content"], F.lit(""))) != "",
               F.array(pystrip(r["content"]))).otherwise(F.array().cast("array<string>")))))
    body = F.when(F.size(res) == 0, F.array(F.lit("_No results._"))).otherwise(entries)
    parts = F.concat(F.array(head), F.coalesce(answer_part, F.array().cast("array<string>")), body)
    return F.array_join(parts, "\n")


def _ev(name: str, payload: Column) -> Column:
    return format_sse(F.lit(name), F.to_json(payload))


def search_usage(text: Column, n_results: Column) -> Column:
    """P-24: usage of a search answer: a quarter of its characters, at least one,
    and one web search when there were results."""
    return F.struct(
        F.lit(0).alias("input_tokens"),
        F.greatest(F.lit(1), F.floor(F.char_length(F.coalesce(text, F.lit(""))) / 4).cast("int")).alias("output_tokens"),
        F.struct(F.when(n_results > 0, 1).otherwise(0).alias("web_search_requests")).alias("server_tool_use"))


def search_turn_events(msg_id: Column, tool_use_id: Column, query: Column, blocks: Column,
                       text: Column, model: Column, n_results: Column,
                       chunk_chars: int = fixed.SSE_TEXT_CHUNK_CHARS) -> Column:
    """C-5: a search call replayed as a message event stream: a
    ``server_tool_use`` block with the query, a ``web_search_tool_result``
    block with the results, and the Markdown as text deltas of at most
    ``chunk_chars`` characters each.  Returns the SSE text."""
    usage = search_usage(text, n_results)
    text = F.when(F.coalesce(text, F.lit("")) == "", F.lit("_(no results)_")).otherwise(text)
    n = F.ceil(F.char_length(text) / F.lit(chunk_chars)).cast("int")
    idx = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    null_s = F.lit(None).cast("string")
    start = _ev("message_start", F.struct(
        F.lit("message_start").alias("type"),
        F.struct(msg_id.alias("id"), F.lit("message").alias("type"), F.lit("assistant").alias("role"),
                 model.alias("model"), F.array().cast("array<string>").alias("content"),
                 null_s.alias("stop_reason"), null_s.alias("stop_sequence"),
                 F.struct(F.lit(0).alias("input_tokens"), F.lit(0).alias("output_tokens"))
                 .alias("usage")).alias("message")))
    tool = F.concat(
        _ev("content_block_start", F.struct(
            F.lit("content_block_start").alias("type"), F.lit(0).alias("index"),
            F.struct(F.lit("server_tool_use").alias("type"), tool_use_id.alias("id"),
                     F.lit("web_search").alias("name"),
                     F.parse_json(F.lit("{}")).alias("input")).alias("content_block"))),
        _ev("content_block_delta", F.struct(
            F.lit("content_block_delta").alias("type"), F.lit(0).alias("index"),
            F.struct(F.lit("input_json_delta").alias("type"),
                     F.to_json(F.struct(query.alias("query"))).alias("partial_json")).alias("delta"))),
        _ev("content_block_stop", F.struct(F.lit("content_block_stop").alias("type"),
                                           F.lit(0).alias("index"))))
    result = F.concat(
        _ev("content_block_start", F.struct(
            F.lit("content_block_start").alias("type"), F.lit(1).alias("index"),
            F.struct(F.lit("web_search_tool_result").alias("type"), tool_use_id.alias("tool_use_id"),
                     blocks.alias("content")).alias("content_block"))),
        _ev("content_block_stop", F.struct(F.lit("content_block_stop").alias("type"),
                                           F.lit(1).alias("index"))))
    deltas = F.array_join(F.transform(idx, lambda i: _ev("content_block_delta", F.struct(
        F.lit("content_block_delta").alias("type"), F.lit(2).alias("index"),
        F.struct(F.lit("text_delta").alias("type"),
                 F.substring(text, i * chunk_chars + 1, F.lit(chunk_chars)).alias("text")).alias("delta")))),
        "")
    text_block = F.concat(
        _ev("content_block_start", F.struct(
            F.lit("content_block_start").alias("type"), F.lit(2).alias("index"),
            F.struct(F.lit("text").alias("type"), F.lit("").alias("text")).alias("content_block"))),
        deltas,
        _ev("content_block_stop", F.struct(F.lit("content_block_stop").alias("type"),
                                           F.lit(2).alias("index"))))
    end = F.concat(
        _ev("message_delta", F.struct(
            F.lit("message_delta").alias("type"),
            F.struct(F.lit("end_turn").alias("stop_reason"), null_s.alias("stop_sequence")).alias("delta"),
            usage.alias("usage"))),
        _ev("message_stop", F.struct(F.lit("message_stop").alias("type"))))
    return F.concat(start, tool, result, text_block, end)


def render_searches(responses: DataFrame, model: str = "claude-sonnet-4.6") -> DataFrame:
    """P-22 + P-23 + C-5 for every response: ``(search_id, query, n_results,
    blocks, markdown, sse)``."""
    r = responses.select("search_id", "query", "answer", F.col("results").alias("_res"))
    sid = F.col("search_id").cast("string")
    return r.select(
        "search_id", "query", F.size("_res").alias("n_results"),
        result_blocks(F.col("_res")).alias("blocks"),
        results_markdown(F.col("query"), F.col("answer"), F.col("_res")).alias("markdown"),
    ).withColumn("sse", search_turn_events(
        F.concat(F.lit("msg_search_"), sid), F.concat(F.lit("srvtoolu_"), sid), F.col("query"),
        F.col("blocks"), F.col("markdown"), F.lit(model), F.col("n_results")))
