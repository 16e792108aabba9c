"""Table sinks: first-wins idempotent append (SNK-1) and additive schema
evolution (SNK-2).

Parquet has no primary key and this install has no table format with
``MERGE``, so "insert or ignore" is written as two set operations:

1. first-wins inside the batch: ``groupBy(key).agg(min_by(row, arrival))``.
   It aggregates partially before the shuffle, so a key that holds a third
   of the batch is reduced on every map task instead of landing whole in one
   reducer (a ``row_number`` window would sort all of it in one task);
2. a ``left_anti`` join against the stored keys that the batch's could equal,
   which :class:`gatemeter.sources.key_index.KeyIndex` finds without reading
   those of the whole table.  The key alone decides, whatever day a row carries,
   and null keys count as equal.

The table's files hold rows and keys, and the index is derived from them: there
is no second file to fall out of step with it after a crash.  Replaying a batch
after a failure appends nothing the first run already committed.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gatemeter.sources.key_index import KeyIndex


def first_per_key(batch: DataFrame, key: str | list[str], order: list[str]) -> DataFrame:
    """One row per key: the row with the smallest ``order`` tuple."""
    keys = [key] if isinstance(key, str) else list(key)
    others = [c for c in batch.columns if c not in keys]
    if not others:
        return batch.dropDuplicates(keys)
    row = F.struct(*[F.col(c) for c in others])
    rank = F.struct(*[F.col(c) for c in order])
    return (batch.groupBy(*keys).agg(F.min_by(row, rank).alias("_first"))
            .select(*keys, *[F.col("_first")[c].alias(c) for c in others]))


def read_if_exists(spark: SparkSession, path: str, merge_schema: bool = True) -> DataFrame | None:
    try:
        return spark.read.option("mergeSchema", str(merge_schema).lower()).parquet(path)
    except AnalysisException:
        return None


def dedupe_append(batch: DataFrame, path: str, key: str | list[str], order: list[str],
                  partition_col: str | None = None, index: KeyIndex | None = None,
                  derive: Callable[[DataFrame], DataFrame] | None = None) -> None:
    """SNK-1: append the batch's new keys to the parquet table at ``path``.

    Within the batch the first row per key by ``order`` wins; a key already
    stored keeps its stored row.  ``partition_col`` (e.g. the day) names the
    table's folders.  Every batch column, the ``order`` columns included, is
    written.  The batch is evaluated once.  ``index`` sets other limits than the
    default ones for the table's key index.  With ``derive``, which gives one row
    for each it gets, the table holds ``derive``'s rows: it is applied to new keys
    only, after the others have gone.
    """
    keys = [key] if isinstance(key, str) else list(key)
    index = index or KeyIndex(batch.sparkSession, path, T.StructType([batch.schema[k] for k in keys]))
    firsts = first_per_key(batch, keys, order).persist()
    try:
        new = firsts
        have = index.stored(firsts)
        if have is not None:
            have = have.select(*[F.col(k).alias(f"_stored_{k}") for k in keys])
            new = firsts.join(have, [F.col(k).eqNullSafe(F.col(f"_stored_{k}")) for k in keys], "left_anti")
        if derive is not None:
            new = derive(new)
        if partition_col:
            # small folders share a task and get one file a batch; a folder with much of the batch is split over several
            new.hint("rebalance", F.col(partition_col)).write.mode("append").partitionBy(partition_col).parquet(path)
        else:
            new.hint("rebalance").write.mode("append").parquet(path)
    finally:
        firsts.unpersist()
    if index.due():
        index.compact()


def missing_columns(stored: DataFrame, incoming: DataFrame) -> list[str]:
    """SNK-2 / U-1: incoming columns the stored table does not have yet."""
    have = set(stored.columns)
    return [c for c in incoming.columns if c not in have]


def append_evolving(batch: DataFrame, path: str, partition_col: str | None = None) -> list[str]:
    """SNK-2: append a batch whose schema may add columns to the stored table.

    New columns are written as they are; readers open the table with
    ``mergeSchema``, so older files read the new columns as null.  A column
    the batch lacks is filled with a typed null so every file has the
    stored columns.  Returns the columns added by this batch.
    """
    spark = batch.sparkSession
    stored = read_if_exists(spark, path)
    added: list[str] = []
    if stored is not None:
        added = missing_columns(stored, batch)
        for f in stored.schema.fields:
            if f.name not in batch.columns:
                batch = batch.withColumn(f.name, F.lit(None).cast(f.dataType))
    w = batch.write.mode("append")
    if partition_col:
        w = w.partitionBy(partition_col)
    w.parquet(path)
    return added


def new_table_path(spark: SparkSession, name: str) -> str:
    """A fresh folder for a job's output under the shared checkpoint folder."""
    from gatemeter.session import scratch_path

    return os.path.join(scratch_path(spark, "tables"), f"{name}-{uuid.uuid4().hex}")


# what the file of rows without a session is called, as Spark's writer calls a folder of null
NO_SESSION = "__HIVE_DEFAULT_PARTITION__"


def mounted_folder(spark: SparkSession, path: str) -> str | None:
    """``path`` as the operating system knows it, none in a store that only Spark reaches."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    uri = jpath.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(jpath).toUri()
    return uri.getPath() if uri.getScheme() == "file" else None


def write_transcripts(lines: DataFrame, path: str) -> dict[str, str]:
    """Write lines ``(project, session_id, line_no, value)``, a file per project and session, by ``line_no``.

    In a mounted folder the tasks write ``<path>/<project>/session_id=<id>.jsonl`` themselves: like the gateway's, a
    project is one folder however many sessions it has.  Spark's writer makes a folder for every session, moves it
    when the job commits and lists each when it is read; other stores are left to it.  A file gets its name when it is
    whole, so a task that runs again replaces it by the same lines.  (Spark's readers skip names that begin with ``_``
    or a dot, hence the key before the id.)  Returns the arguments with which ``read_transcripts`` finds the files.
    """
    spark = lines.sparkSession
    ordered = (lines.repartition("project", "session_id").sortWithinPartitions("project", "session_id", "line_no")
               .select("project", "session_id", "value"))
    top = mounted_folder(spark, path)
    if top is None:
        ordered.write.partitionBy("project", "session_id").text(path)
        return {"name": "*.txt", "session": r"/session_id=([^/]+)/"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, out, files = None, None, 0

        def end() -> None:
            if out is not None:
                out.close()
                os.replace(out.name, f"{top}/{last[0]}/session_id={last[1] or NO_SESSION}.jsonl")

        for batch in batches:
            for project, session, value in zip(*(c.to_pylist() for c in batch.columns)):
                if (project, session) != last:
                    end()
                    os.makedirs(f"{top}/{project}", exist_ok=True)
                    out = open(f"{top}/{project}/.{uuid.uuid4().hex}", "wb")
                    last, files = (project, session), files + 1
                out.write((value or "").encode() + b"\n")
        end()
        yield pa.RecordBatch.from_arrays([pa.array([files], pa.int64())], names=["files"])

    os.makedirs(top, exist_ok=True)
    ordered.mapInArrow(run, "files long").agg(F.sum("files")).collect()  # one row
    return {"session": r"/session_id=([^/]+)\.jsonl$"}
