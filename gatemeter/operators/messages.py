"""Message- and block-level summaries (A-6, A-7, W-5, P-25, J-6).

:func:`message_rows` and :func:`block_rows` make these tables from request bodies.

Inputs are long tables: messages ``(conv_id, turn, role, text)`` and content
blocks ``(conv_id, turn, role, block_idx, type, text, tool_id, tool_name,
file_path)``.  Group keys are conversations; an array built per conversation
is bounded by one request body (10 MiB cap, SRC-8), never by the table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatemeter import fixed
from gatemeter.functions.text import cut, preview
from gatemeter.operators.bodies import parse_bodies


def message_rows(bodies: DataFrame, key: str = "request_id", body_col: str = "body") -> DataFrame:
    """``(key, turn, role, content)`` of every message of the accepted bodies; ``content`` is its VARIANT."""
    parsed = parse_bodies(bodies.select(key, body_col), body_col).where(F.col("reject_reason").isNull())
    # a generator of its own: later filters must not be pushed below with a copy of the lookup
    found = parsed.select(key, F.posexplode(F.try_variant_get("_v", "$.messages", "array<variant>")).alias("turn", "m"))
    return found.select(F.inline(F.array(F.struct(
        F.col(key), F.col("turn").cast("long").alias("turn"), F.try_variant_get("m", "$.role", "string").alias("role"),
        F.try_variant_get("m", "$.content", "variant").alias("content")))))


def block_rows(bodies: DataFrame, key: str = "request_id", body_col: str = "body") -> DataFrame:
    """``(key, turn, role, block_idx, type, text, tool_id, tool_name, file_path)`` of every content block of the accepted
    bodies; a message whose content is a string has one text block.  ``tool_id`` is the use's id, on uses and results."""
    get = lambda path, kind="string": F.try_variant_get("b", path, kind)
    content = F.col("content")
    plain = F.schema_of_variant(content) == "STRING"
    listed = F.when(plain, F.array(content)).otherwise(F.try_variant_get(content, "$", "array<variant>"))
    found = message_rows(bodies, key, body_col).select(
        key, "turn", "role", plain.alias("_plain"), F.posexplode(listed).alias("block_idx", "b"))
    kind = F.when(F.col("_plain"), F.lit("text")).otherwise(get("$.type"))
    return found.select(F.inline(F.array(F.struct(
        F.col(key), F.col("turn"), F.col("role"), F.col("block_idx"), kind.alias("type"),
        F.when(F.col("_plain"), get("$")).otherwise(get("$.text")).alias("text"),
        F.when(kind == "tool_use", get("$.id")).when(kind == "tool_result", get("$.tool_use_id")).alias("tool_id"),
        F.when(kind == "tool_use", get("$.name")).alias("tool_name"),
        F.when(kind == "tool_use", get("$.input.file_path")).alias("file_path")))))


def message_texts(blocks: DataFrame, key: str = "request_id") -> DataFrame:
    """``(key, turn, role, text)`` from blocks: a message's text blocks in order, joined by a blank (none: empty)."""
    text = F.when(F.col("type") == "text", F.struct("block_idx", F.coalesce("text", F.lit("")).alias("t")))
    return (blocks.groupBy(key, "turn").agg(F.first("role").alias("role"), F.array_sort(F.collect_list(text)).alias("_t"))
            .select(key, "turn", "role", F.array_join(F.transform("_t", lambda x: x["t"]), " ").alias("text")))


def role_counts(messages: DataFrame, key: str = "conv_id") -> DataFrame:
    """A-6: messages per (conversation, role); a missing role counts as ``?``."""
    return (messages.groupBy(key, F.coalesce(F.col("role"), F.lit("?")).alias("role"))
            .agg(F.count(F.lit(1)).alias("n")))


def last_user_message(messages: DataFrame, key: str = "conv_id") -> DataFrame:
    """W-5 + P-25: the last user message per conversation, its log form (first
    500 characters) and its console preview (80 characters, ``...`` if cut)."""
    last = (messages.where(F.col("role") == "user")
            .groupBy(key).agg(F.max_by("text", "turn").alias("_t")))
    return last.select(key, cut(F.col("_t"), fixed.LOG_TEXT_CHARS).alias("last_user_message"),
                       preview(F.col("_t")).alias("preview"))


def tool_use_counts(blocks: DataFrame, key: str = "conv_id") -> DataFrame:
    """A-7: tool_use blocks per (conversation, tool name); missing name is ``?``."""
    return (blocks.where(F.col("type") == "tool_use")
            .groupBy(key, F.coalesce(F.col("tool_name"), F.lit("?")).alias("tool_name"))
            .agg(F.count(F.lit(1)).alias("uses")))


def tool_use_summary(blocks: DataFrame, key: str = "conv_id") -> DataFrame:
    """A-7: ``Name(count)`` pairs sorted by name, space separated, per conversation."""
    counts = tool_use_counts(blocks, key)
    return (counts.groupBy(key)
            .agg(F.array_sort(F.collect_list(F.struct("tool_name", "uses"))).alias("_c"))
            .select(key, F.array_join(F.transform(
                "_c", lambda x: F.concat(x["tool_name"], F.lit("("), x["uses"].cast("string"),
                                         F.lit(")"))), " ").alias("tool_uses")))


def read_paths(blocks: DataFrame, key: str = "conv_id") -> DataFrame:
    """A-7: file paths of ``Read`` tool uses in message order, newline separated."""
    r = blocks.where((F.col("type") == "tool_use") & (F.col("tool_name") == "Read")
                     & F.col("file_path").isNotNull() & (F.col("file_path") != ""))
    return (r.groupBy(key)
            .agg(F.array_sort(F.collect_list(F.struct("turn", "block_idx", "file_path")))
                 .alias("_p"))
            .select(key, F.array_join(F.transform("_p", lambda x: x["file_path"]), "\n")
                    .alias("read_paths")))


def tool_pairs(blocks: DataFrame, key: str = "conv_id") -> DataFrame:
    """J-6: each tool_use with its tool_result (matched on the use id), or null."""
    uses = blocks.where(F.col("type") == "tool_use").select(
        key, "tool_id", "tool_name", F.col("turn").alias("use_turn"))
    results = blocks.where(F.col("type") == "tool_result").select(
        key, "tool_id", F.col("turn").alias("result_turn"))
    return uses.join(results, [key, "tool_id"], "left")


def tool_pair_summary(blocks: DataFrame, key: str = "conv_id") -> DataFrame:
    """J-6: uses and answered uses per tool name."""
    return (tool_pairs(blocks, key).groupBy("tool_name")
            .agg(F.count(F.lit(1)).alias("uses"), F.count("result_turn").alias("results")))
