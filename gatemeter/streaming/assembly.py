"""Incremental assembly of event streams from their network reads (ST-8), and
one fact row per call as soon as its stream ends (ST-9).

Reads ``(*keys, seq, start_ts, arrival_ts, chunk)`` arrive in micro-batches, a
stream's reads over many of them.  An empty ``chunk`` is the read that found the
connection closed: it ends its stream.  Streams that never end are closed when
event time (the latest arrival of any stream) has moved ``idle_s`` beyond their
last read.

The open-stream store holds one row per stream that has not ended: the facts of
its whole lines so far, the bytes after its last line break, the number of reads
folded and the reads that arrived before their predecessors.  A micro-batch
joins its reads to the store by stream, folds what follows without a gap, cuts
at the last line break and parses only the new lines; facts merge as a whole
stream's would (first stop reason and message id, last usage value per key).
So any split of the reads into micro-batches gives the facts of the whole
stream, work is linear in the bytes read plus the open streams, and a stream
leaves the store when it ends.

Recovery: each micro-batch reads the newest store version before its own, and
overwrites the version and the facts folder of its id; a retry repeats both.
The store belongs to the checkpoint of its query.  Duplicate reads are ignored,
and so are reads of a stream that was closed at most ``idle_s`` of event time ago:
its key stays in the store so long, without its state.  Later ones open the stream
anew; it closes again by idleness, and the fact table keeps the first row of a
call (:func:`gatemeter.sources.sinks.dedupe_append`).

State per stream is its text so far, so it is bounded by the longest response.
"""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from gatemeter.functions.usage import tokens_per_sec
from gatemeter.operators.sse import (TEXT_MARKER, event_facts, joined_bytes, merge_usage, utf8_text,
                                     with_usage_columns)
from gatemeter.sources import sinks
from gatemeter.streaming.ingest import start

READ = "struct<s:bigint,a:timestamp,c:binary>"
# columns of a store row besides the stream's keys
STATE = {
    "next_seq": "bigint", "tail": "binary", "waiting": f"array<{READ}>", "start": "timestamp", "last": "timestamp",
    "first_text": "timestamp", "n_chunks": "bigint", "resp_bytes": "bigint", "text": "string",
    "usage": "map<string,string>", "stop_reason": "string", "started": "boolean", "message_id": "string",
    "tool_names": "array<string>", "completed": "boolean",
}
READS = "seq bigint, start_ts timestamp, arrival_ts timestamp, chunk binary"
CLOCK = "clock"
STREAMS = "streams"
CLOSED = "closed"
IDLE_S = 600.0
KEEP_VERSIONS = 2


class StreamStore:
    """Versions of the open streams and of the event-time clock under one folder.

    Micro-batch ``i`` writes version ``2 i``; closing all streams after it writes ``2 i + 1``.
    """

    def __init__(self, spark: SparkSession, path: str, keys: T.StructType):
        self.spark, self.path = spark, path
        self.keys = keys.fieldNames()
        state = T.StructType.fromDDL(", ".join(f"{k} {t}" for k, t in STATE.items()))
        self.schema = T.StructType([*keys.fields, *state.fields])
        self.read_schema = T.StructType([*keys.fields, *T.StructType.fromDDL(READS).fields])
        self.closed_schema = T.StructType([*keys.fields, *T.StructType.fromDDL("until timestamp").fields])

    def _fs(self):
        root = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return root.getFileSystem(self.spark._jsc.hadoopConfiguration()), root

    def versions(self) -> list[int]:
        """Whole versions (the clock is written last), oldest first."""
        fs, root = self._fs()
        if not fs.exists(root):
            return []
        jpath = self.spark._jvm.org.apache.hadoop.fs.Path
        ids = [int(s.getPath().getName().removeprefix("v=")) for s in fs.listStatus(root)]
        return sorted(i for i in ids if fs.exists(jpath(f"{self._of(i, CLOCK)}/_SUCCESS")))

    def _of(self, version: int, what: str) -> str:
        return os.path.join(self.path, f"v={version}", what)

    def read(self, before: int) -> tuple[DataFrame, DataFrame, object]:
        """Open streams, keys closed of late and event time of the newest version before the given one."""
        older = [v for v in self.versions() if v < before]
        if not older:
            return self.spark.createDataFrame([], self.schema), self.spark.createDataFrame([], self.closed_schema), None
        at = self.spark.read.schema("clock timestamp").parquet(self._of(older[-1], CLOCK)).agg(F.max("clock")).first()[0]
        return (self.spark.read.schema(self.schema).parquet(self._of(older[-1], STREAMS)),
                self.spark.read.schema(self.closed_schema).parquet(self._of(older[-1], CLOSED)), at)

    def write(self, version: int, streams: DataFrame, closed: DataFrame, clock: object) -> None:
        streams.select(*self.keys, *STATE).write.mode("overwrite").parquet(self._of(version, STREAMS))
        closed.select(*self.keys, "until").write.mode("overwrite").parquet(self._of(version, CLOSED))
        (self.spark.range(1).select(F.lit(clock).cast("timestamp").alias("clock")).coalesce(1)
         .write.mode("overwrite").parquet(self._of(version, CLOCK)))
        fs, _ = self._fs()
        for old in [v for v in self.versions() if v <= version][:-KEEP_VERSIONS]:
            fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(os.path.join(self.path, f"v={old}")), True)

    def open_streams(self) -> DataFrame:
        return self.read(1 << 62)[0]


def _staged(df: DataFrame, *cols: Column | str) -> DataFrame:
    return df.select(F.inline(F.array(F.struct(*cols))))


def fold_reads(store: DataFrame, reads: DataFrame, keys: list[str], clock: object, idle_s: float | None) -> DataFrame:
    """Store rows after these reads, with ``ended``: the stream is closed and its last bytes are folded too.

    ``idle_s`` None closes every stream.
    """
    new = reads.groupBy(*keys).agg(
        F.collect_list(F.struct(F.col("seq").cast("long").alias("s"), F.col("arrival_ts").alias("a"),
                                F.col("chunk").alias("c"))).alias("_new"),
        F.min("start_ts").alias("_start"), F.max("arrival_ts").alias("_last"))
    other = new.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_new", "_start", "_last")
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    known = store.join(other, same, "full_outer")
    nothing = F.array().cast(f"array<{READ}>")
    named = [F.when(F.col("next_seq").isNull(), F.col(f"_k{i}")).otherwise(F.col(k)).alias(k) for i, k in enumerate(keys)]
    carried = ["text", "usage", "stop_reason", "started", "message_id", "tool_names", "completed"]
    last = F.greatest("last", "_last")
    idle = F.lit(idle_s is None)
    if idle_s is not None and clock is not None:
        idle = F.unix_micros(last) + int(idle_s * 1e6) <= F.unix_micros(F.lit(clock).cast("timestamp"))
    d = _staged(known, *named, *carried, F.coalesce("next_seq", F.lit(0)).alias("next_seq"),
                F.coalesce("tail", F.lit(b"")).alias("tail"), F.least("start", "_start").alias("start"),
                last.alias("last"), "first_text", F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"),
                F.coalesce("resp_bytes", F.lit(0)).alias("resp_bytes"), idle.alias("_idle"),
                F.array_sort(F.concat(F.coalesce("waiting", nothing), F.coalesce("_new", nothing))).alias("_reads"))
    held = [*keys, *carried, "next_seq", "tail", "start", "last", "first_text", "n_chunks", "resp_bytes", "_idle"]
    # one read per number, none that was folded before
    r = F.col("_reads")
    d = _staged(d, *held, F.filter(r, lambda x, i: (x["s"] >= F.col("next_seq"))
                                   & ~F.coalesce(F.get(r, i - 1)["s"] == x["s"], F.lit(False))).alias("_reads"))
    # sorted and distinct: the i-th follows without a gap exactly when its number is next_seq + i; a closing stream
    # takes what it has
    follows = lambda x, i: F.col("_idle") | (x["s"] == F.col("next_seq") + i)
    d = _staged(d, *held, F.filter("_reads", follows).alias("_ready"),
                F.filter("_reads", lambda x, i: ~follows(x, i)).alias("_waiting"))
    end = F.exists("_ready", lambda x: F.octet_length(x["c"]) == 0)
    d = _staged(d, *held, "_ready", "_waiting", (end | F.col("_idle")).alias("ended"),
                F.concat(F.col("tail"), joined_bytes(F.transform("_ready", lambda x: x["c"]))).alias("_bytes"))
    # one character per byte, so that places in the text are places in the bytes
    flat = F.decode("_bytes", "ISO-8859-1")
    size = F.octet_length("_bytes")
    back = F.instr(F.reverse(flat), "\n")
    cut = F.when(F.col("ended"), size).when(back > 0, size - back + 1).otherwise(F.lit(0))
    mark = F.instr(flat, TEXT_MARKER)
    d = _staged(d, *held, "_ready", "_waiting", "ended", "_bytes", cut.alias("_cut"),
                F.when(F.col("first_text").isNull() & (mark > 0), mark - 1 + len(TEXT_MARKER)).alias("_mark"))
    # the read in which the first text marker is whole; an unfinished line holds no whole one
    found = F.aggregate(
        "_ready", F.struct(F.octet_length("tail").cast("long").alias("n"), F.lit(None).cast("timestamp").alias("at")),
        lambda acc, x: F.struct((acc["n"] + F.octet_length(x["c"])).alias("n"), F.coalesce(
            acc["at"], F.when(acc["n"] + F.octet_length(x["c"]) >= F.col("_mark"), x["a"])).alias("at")))["at"]
    folded = F.size("_ready")
    state = [
        *[F.col(c).alias(f"_{c}") for c in carried],
        (F.col("next_seq") + folded).alias("next_seq"),
        F.expr("substring(_bytes, _cut + 1, octet_length(_bytes) - _cut)").alias("tail"),
        F.col("_waiting").alias("waiting"), F.col("start"), F.col("last"),
        F.coalesce("first_text", found).alias("first_text"), (F.col("n_chunks") + folded).alias("n_chunks"),
        (F.col("resp_bytes") + size - F.octet_length("tail")).alias("resp_bytes"), F.col("ended")]
    d = _staged(d, *keys, *state, utf8_text(F.expr("substring(_bytes, 1, _cut)")).alias("_raw"))
    rest = [c for c in d.columns if c not in ("_raw",)]
    d = event_facts(d, rest, "_raw")
    no_usage = F.create_map().cast("map<string,string>")
    return d.select(
        *keys, "next_seq", "tail", "waiting", "start", "last", "first_text", "n_chunks", "resp_bytes",
        F.concat(F.coalesce("_text", F.lit("")), F.col("text")).alias("text"),
        merge_usage(F.array(F.coalesce("_usage", no_usage), F.col("usage"))).alias("usage"),
        F.coalesce("_stop_reason", "stop_reason").alias("stop_reason"),
        (F.coalesce("_started", F.lit(False)) | F.col("started")).alias("started"),
        F.when(F.coalesce("_started", F.lit(False)), F.col("_message_id")).otherwise(F.col("message_id")).alias("message_id"),
        F.concat(F.coalesce("_tool_names", F.array().cast("array<string>")), F.col("tool_names")).alias("tool_names"),
        (F.coalesce("_completed", F.lit(False)) | F.col("completed")).alias("completed"), "ended")


def closed_facts(ended: DataFrame, keys: list[str]) -> DataFrame:
    """The facts of closed streams, as :func:`gatemeter.operators.sse.facts_from_chunks` gives them for whole ones."""
    since = lambda ts: F.floor((F.unix_micros(ts) - F.unix_micros("start")) / 1000).cast("long")
    d = ended.withColumn("ttft_ms", since(F.col("first_text"))).withColumn("elapsed_ms", since(F.col("last")))
    also = [*keys, "start", "n_chunks", "resp_bytes", "ttft_ms", "elapsed_ms"]
    return with_usage_columns(d, also).withColumn("output_tokens_per_sec", tokens_per_sec(
        F.coalesce(F.col("output_tokens"), F.lit(0)), F.col("elapsed_ms"), F.col("ttft_ms")))


def advance(store: StreamStore, reads: DataFrame, version: int, idle_s: float | None,
            emit: Callable[[DataFrame], None]) -> None:
    """Fold the reads into the store as ``version`` and hand the facts of closed streams to ``emit``."""
    streams, closed, clock = store.read(version)
    latest = reads.agg(F.max("arrival_ts")).first()[0]
    clock = max((c for c in (clock, latest) if c is not None), default=None)
    gone = closed.select(*[F.col(k).alias(f"_g{i}") for i, k in enumerate(store.keys)])
    reads = reads.join(gone, [F.col(k).eqNullSafe(F.col(f"_g{i}")) for i, k in enumerate(store.keys)], "left_anti")
    after = fold_reads(streams, reads, store.keys, clock, idle_s).persist()
    try:
        # the store is the commit: a crash before it repeats the batch, whose facts are then written once more
        emit(closed_facts(after.where("ended"), store.keys))
        now = F.lit(clock).cast("timestamp")
        until = F.timestamp_micros(F.unix_micros(now) + int((idle_s or 0) * 1e6))
        fresh = after.where("ended").select(*store.keys, until.alias("until"))
        store.write(version, after.where(~F.col("ended")), closed.unionByName(fresh).where(F.col("until") > now), clock)
    finally:
        after.unpersist()


def assemble_stream(reads: DataFrame, store: StreamStore, facts_path: str, checkpoint: str, idle_s: float = IDLE_S,
                    trigger: str | None = None) -> StreamingQuery:
    """ST-8: stream reads; the facts of closed streams go to ``facts_path``, one folder per micro-batch."""
    def write_batch(batch: DataFrame, batch_id: int) -> None:
        advance(store, batch, 2 * batch_id, idle_s, facts_folder(facts_path, f"batch={batch_id}"))

    return start(reads.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint), trigger)


def facts_folder(facts_path: str, name: str) -> Callable[[DataFrame], None]:
    return lambda facts: facts.write.mode("overwrite").parquet(os.path.join(facts_path, name))


def live_facts(reads: DataFrame, store: StreamStore, table_path: str, checkpoint: str,
               to_rows: Callable[[DataFrame], DataFrame], idle_s: float = IDLE_S,
               trigger: str | None = None) -> StreamingQuery:
    """ST-9: stream reads into fact rows; ``to_rows`` turns closed streams' facts into rows with
    ``request_id``, ``ts`` and ``day``."""
    def write_batch(batch: DataFrame, batch_id: int) -> None:
        advance(store, batch, 2 * batch_id, idle_s, fact_table(table_path, to_rows))

    return start(reads.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint), trigger)


def fact_table(table_path: str, to_rows: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], None]:
    """The first row of a call stays: late reads of a closed stream add none."""
    return lambda facts: sinks.dedupe_append(to_rows(facts), table_path, "request_id", ["ts"], partition_col="day")


def close_open_streams(store: StreamStore, emit: Callable[[DataFrame], None]) -> None:
    """At shutdown, while no query runs on the store: close every stream that is still open."""
    versions = store.versions()
    if versions:
        advance(store, store.spark.createDataFrame([], store.read_schema), versions[-1] | 1, None, emit)
