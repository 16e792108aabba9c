"""Session titles from transcripts (SRC-3, A-8) and their join to calls (J-2).

A transcript is ``<projects>/<encoded-cwd>/<session-id>.jsonl``; title lines
are appended as the conversation grows.  The title of a session is the last
non-blank ``custom-title``, else the last non-blank ``ai-title``, stripped.
When the same session file exists under several projects, the first file
(by path) that has a title wins.

One pass over all transcripts replaces the gateway's per-session file glob;
the result has one row per session and is joined to the calls with an equi
join that AQE turns into a broadcast only when the measured side is small.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gatemeter.functions.text import pystrip

TITLE_LINE_SCHEMA = "type string, aiTitle string, customTitle string"


def read_transcripts(spark: SparkSession, projects_dir: str, name: str = "*.jsonl",
                     session: str = r"([^/]+)\.jsonl$") -> DataFrame:
    """SRC-3: ``(file, session_id, line_no, line)`` for every transcript below ``projects_dir``.

    Large files are split like any text file: lines stand in order by the start
    of their block, then by their place in the task that reads it, which is what
    ``line_no`` holds.  ``name`` selects the files and the first group of
    ``session``, a pattern on the path, is the session's id.
    """
    lines = (spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", name).text(projects_dir)
             .select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_block"),
                     F.monotonically_increasing_id().alias("_place"), F.col("value").alias("line")))
    return lines.select("file", F.regexp_extract("file", session, 1).alias("session_id"),
                        F.struct(F.col("_block").alias("block"), F.col("_place").alias("place")).alias("line_no"), "line")


def session_titles(lines: DataFrame, file_col: str | None = "file") -> DataFrame:
    """A-8: ``(session_id, session_name)`` from transcript lines
    ``(session_id, line_no, line[, file])``."""
    # cheap substring test first; only candidate lines are parsed
    cand = lines.where(F.col("line").contains("-title"))
    obj = F.from_json(F.col("line"), TITLE_LINE_SCHEMA)
    kind = obj["type"]
    raw = F.when(kind == "custom-title", obj["customTitle"]).when(kind == "ai-title", obj["aiTitle"])
    file_key = F.col(file_col) if file_col and file_col in lines.columns else F.lit("")
    # the parse sits inside a generator so the title filter below does not
    # get a second copy of it: each candidate line is parsed once
    t = (cand.select(F.inline(F.array(F.struct(
            F.col("session_id"), file_key.alias("_file"), F.col("line_no"), kind.alias("kind"),
            pystrip(raw).alias("title")))))
         .where(F.col("title").isNotNull() & (F.col("title") != "")))
    per_file = (t.groupBy("session_id", "_file")
                .agg(F.max_by(F.when(F.col("kind") == "custom-title", F.col("title")),
                              F.when(F.col("kind") == "custom-title", F.col("line_no"))).alias("_c"),
                     F.max_by(F.when(F.col("kind") == "ai-title", F.col("title")),
                              F.when(F.col("kind") == "ai-title", F.col("line_no"))).alias("_a"))
                .select("session_id", "_file", F.coalesce("_c", "_a").alias("title")))
    return (per_file.groupBy("session_id")
            .agg(F.min_by("title", "_file").alias("session_name")))


def attach_titles(requests: DataFrame, titles: DataFrame, key: str = "session_id") -> DataFrame:
    """J-2: fill ``session_name`` from the titles (left join on the session key)."""
    t = titles.select(F.col("session_id").alias("_tsid"), F.col("session_name").alias("_tname"))
    # rows without a session find no title: spread them instead of joining them as one key
    salt = F.concat(F.lit("\x00"), F.xxhash64(*[F.col(c) for c in requests.columns
                                               if c in ("request_id", "ts", "elapsed_ms")] or [F.lit(0)])
                    .cast("string"))
    joined = requests.join(t, F.coalesce(requests[key], salt) == t["_tsid"], "left")
    cols = [F.coalesce(F.col("session_name"), F.col("_tname")).alias("session_name")
            if c == "session_name" else F.col(c) for c in requests.columns]
    return joined.select(*cols)
