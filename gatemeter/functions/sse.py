"""Server-sent-event text <-> event rows (SRC-4, C-6)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

def format_sse(event: Column, data_json: Column) -> Column:
    """C-6: ``event: <name>\\ndata: <json>\\n\\n``."""
    return F.concat(F.lit("event: "), event, F.lit("\ndata: "), data_json, F.lit("\n\n"))


# The gateway's post-hoc extractors keep the lines that start so (with the blank).
DATA_PREFIX = "data: "


def event_struct(v: Column) -> Column:
    """The fields of one parsed event that any extraction reads.

    Usage objects stay ``map<string,string>`` so a key present with JSON null is
    kept distinct from an absent key (the merge is last-wins per key).
    """

    def g(path: str, t: str = "string") -> Column:
        return F.try_variant_get(v, path, t)

    return F.struct(
        g("$.type").alias("type"),
        g("$.index", "bigint").alias("index"),
        F.struct(g("$.message.id").alias("id"), g("$.message.model").alias("model"),
                 g("$.message.usage", "map<string,string>").alias("usage")).alias("message"),
        F.struct(g("$.delta.type").alias("type"), g("$.delta.text").alias("text"),
                 g("$.delta.partial_json").alias("partial_json"),
                 g("$.delta.stop_reason").alias("stop_reason")).alias("delta"),
        g("$.usage", "map<string,string>").alias("usage"),
        F.struct(g("$.content_block.type").alias("type"), g("$.content_block.id").alias("id"),
                 g("$.content_block.name").alias("name")).alias("content_block"),
    )


def parse_events(raw: DataFrame, keys: list[str], raw_col: str = "raw") -> DataFrame:
    """SRC-4 as rows: ``(*keys, pos, ev)`` for every valid ``data: `` line, in order.

    Malformed JSON (and ``[DONE]``) is dropped, as the gateway skips it.
    """
    lines = raw.select(*keys, F.posexplode(F.split(F.col(raw_col), "\n")).alias("pos", "line"))
    v = F.try_parse_json(F.substring(F.col("line"), len(DATA_PREFIX) + 1, 1 << 30))
    parsed = lines.where(F.col("line").startswith(DATA_PREFIX)).select(
        F.inline(F.array(F.struct(*[F.col(k) for k in keys], "pos", v.alias("_v")))))
    return parsed.where(F.col("_v").isNotNull()).select(*keys, "pos", event_struct(F.col("_v")).alias("ev"))
