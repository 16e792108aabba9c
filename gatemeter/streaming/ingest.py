"""Structured Streaming ingest of call records into the telemetry table
(ST-1, ST-2, ST-3, ST-5) and the running daily search spend (ST-7).

The gateway batches rows in memory (flush every 2 s or 100 rows), inserts
them with "insert or ignore" and drops its backlog when the database stays
unavailable.  Here the same contract is a file stream:

* ST-1: ``trigger(processingTime="2 seconds")`` and ``maxFilesPerTrigger``
  bound a micro-batch; ``availableNow`` (ST-5) drains what has landed and stops;
* ST-2: every micro-batch goes through the first-wins idempotent append
  (:func:`gatemeter.sources.sinks.dedupe_append`), so a replayed batch, or a
  whole re-read after a lost checkpoint, adds no second row for a call;
* ST-3: progress lives in the checkpoint folder (under the cluster's shared
  ``spark.checkpoint.dir``); a failed batch is retried, nothing is dropped.  Records
  without a key or a time cannot be stored; they go to a reject table with the
  reason instead of failing the stream.

* ST-3: numbers beyond the table's types go to the reject table in the same pass;
  when a micro-batch still cannot be evaluated because of its data, it is halved
  until the rows that fail are alone; they go to the reject table with the error,
  all others are stored;
* ST-2 without reading the table: :func:`ingest_within_watermark` keeps the keys of
  the replay horizon in the state store and writes through the exactly-once file sink.

ST-7 is kept exact without watermark state: daily spend is read from the
ingested table, where a call stands once however often it arrived.  The spend of
the day so far, per call as it arrives, is :func:`running_spend`: totals per day,
one version per micro-batch, so a repeated micro-batch starts from the same.
"""

from __future__ import annotations

import os
import time
from collections.abc import Callable

from pyspark.errors import ArithmeticException, DateTimeException, NumberFormatException, PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gatemeter import fixed
from gatemeter.functions.models import ModelPolicy
from gatemeter.operators.spend import as_spent, running_micro
from gatemeter.operators.telemetry import build_telemetry, misfit
from gatemeter.sources import sinks


def start(writer, trigger: str | None) -> StreamingQuery:
    """Start a stream writer: ``availableNow`` (default), ``flush`` (the gateway's interval, ST-1) or an interval."""
    if trigger is None or trigger == "availableNow":
        return writer.trigger(availableNow=True).start()
    if trigger == "flush":
        trigger = f"{fixed.FLUSH_INTERVAL_S:g} seconds"
    return writer.trigger(processingTime=trigger).start()


class TitleCache:
    """ST-6: session titles, re-read when older than ``ttl_s`` (the gateway's
    300 s title cache).  ``loader`` returns ``(session_id, session_name)``.
    Each refresh writes its result as a table under ``path`` and micro-batches
    read that table, so titles are computed once per refresh, not once per
    micro-batch.  Sessions without a title simply get none (the gateway caches
    that answer too).
    """

    def __init__(self, loader: Callable[[], DataFrame], path: str, ttl_s: float = fixed.TITLE_CACHE_TTL_S):
        self.loader = loader
        self.path = path
        self.ttl_s = ttl_s
        self.refreshes = 0
        self._at: float | None = None

    def get(self) -> DataFrame:
        now = time.monotonic()
        if self._at is None or now - self._at > self.ttl_s:
            self.refreshes += 1
            self.loader().write.mode("overwrite").parquet(self._table())
            self._at = now
        return SparkSession.active().read.parquet(self._table())

    def _table(self) -> str:
        return os.path.join(self.path, f"titles-{self.refreshes}")


def ingest_calls(calls: DataFrame, table_path: str, checkpoint: str,
                 policy: ModelPolicy | None = None, order: list[str] | None = None,
                 trigger: str | None = None, titles: TitleCache | None = None,
                 title_key: Callable[[DataFrame], Column] | None = None,
                 rejects_path: str | None = None) -> StreamingQuery:
    """Stream call records (the :func:`build_telemetry` contract) into the
    telemetry table at ``table_path``, partitioned by day.

    ``order`` decides which copy of a call wins inside one micro-batch
    (default: ``ts``, then ``elapsed_ms``).  With ``titles`` (ST-6) each
    micro-batch is joined to the cached titles on ``title_key(fact)``
    (default ``session_id``); a row keeps the title it had when written.
    Records without ``request_id`` or ``ts`` are never stored; with
    ``rejects_path`` they are appended there, in a folder per micro-batch that a
    retry overwrites, with a ``reject_reason`` (ST-3), together with those whose
    numbers the table's types do not hold.  Returns the started query.
    """
    from gatemeter.operators.sessions import attach_titles

    order = order or ["ts", "elapsed_ms"]

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        reason = (F.when(F.col("request_id").isNull(), F.lit("no_request_id"))
                  .when(F.col("ts").isNull(), F.lit("no_ts")))
        if rejects_path:
            reason = F.coalesce(reason, misfit(batch))
            (batch.withColumn("reject_reason", reason).where(F.col("reject_reason").isNotNull())
             .write.mode("overwrite").parquet(os.path.join(rejects_path, f"batch={batch_id}")))
        named = titles.get() if titles is not None else None

        def derive(rows: DataFrame) -> DataFrame:
            fact = build_telemetry(rows, policy).withColumn("day", F.to_date("ts"))
            if named is None:
                return fact
            key = title_key(fact) if title_key else F.col("session_id")
            return attach_titles(fact.withColumn("_title_key", key), named, key="_title_key").drop("_title_key")

        def append(fact: DataFrame) -> None:
            sinks.dedupe_append(fact, table_path, "request_id", order, partition_col="day")

        good = batch.where(reason.isNull())
        if rejects_path:
            append_bisecting(good, derive, append, os.path.join(rejects_path, f"batch={batch_id}"))
        elif set(order) <= set(good.columns):
            # the copies that go are told by the call record itself: the wide row is derived for new calls only
            sinks.dedupe_append(good, table_path, "request_id", order, partition_col="day", derive=derive)
        else:
            append(derive(good))

    w = (calls.writeStream.foreachBatch(write_batch)
         .option("checkpointLocation", checkpoint))
    return start(w, trigger)


def is_data_error(error: Exception) -> bool:
    """Whether a row's values made the job fail (SQLSTATE class 22), not the cluster, the storage or the code."""
    if not isinstance(error, PySparkException):
        return False
    return (error.getSqlState() or "").startswith("22") or isinstance(
        error, (ArithmeticException, DateTimeException, NumberFormatException))


def bad_parts(rows: DataFrame, mark: Column, derive: Callable[[DataFrame], DataFrame],
              most_halvings: int = 40) -> list[tuple[int, int, str]]:
    """Parts of ``rows`` whose ``derive`` fails on their data: (halvings, remainder of ``mark``, error).

    A part is halved by the low bits of ``mark`` until its rows have one mark.
    """
    def fails(held: DataFrame) -> str | None:
        made = derive(held)
        try:
            made.select(F.xxhash64(*made.columns).alias("h")).agg(F.max("h")).collect()
            return None
        except Exception as error:
            if not is_data_error(error):
                raise
            return str(error).splitlines()[0][:500]

    found, waiting = [], [(0, 0)]
    while waiting:
        depth, rest = waiting.pop()
        held = rows.where(F.pmod(mark, F.lit(1 << depth)) == rest)
        reason = fails(held)
        if reason is None:
            continue
        if depth >= most_halvings or held.select(mark).distinct().limit(2).count() < 2:
            found.append((depth, rest, reason))
        else:
            waiting += [(depth + 1, rest), (depth + 1, rest + (1 << depth))]
    return found


def append_bisecting(rows: DataFrame, derive: Callable[[DataFrame], DataFrame], append: Callable[[DataFrame], None],
                     rejects_path: str) -> None:
    """ST-3: append ``derive(rows)``; where their data make it fail, halve the rows until those that fail are alone.

    They are written below ``rejects_path`` with the error as ``reject_reason``,
    in folders that a retry overwrites; the others are appended.  One bad row
    among n costs about 2 log2(n) evaluations of ever smaller parts.  Equal rows
    stay together.  Errors that are not the data's are raised.
    """
    rows = rows.persist()
    try:
        try:
            append(derive(rows))
            return
        except Exception as error:
            if not is_data_error(error):
                raise
        mark = F.xxhash64(*[c for c, kind in rows.dtypes if "map<" not in kind and "variant" not in kind])
        bad = F.lit(False)
        for i, (depth, rest, reason) in enumerate(bad_parts(rows, mark, derive)):
            here = F.pmod(mark, F.lit(1 << depth)) == rest
            bad = bad | here
            (rows.where(here).withColumn("reject_reason", F.lit(reason)).write.mode("overwrite")
             .parquet(os.path.join(rejects_path, f"bad={i}")))
        append(derive(rows.where(~bad)))
    finally:
        rows.unpersist()


def ingest_within_watermark(calls: DataFrame, table_path: str, checkpoint: str, horizon: str,
                            policy: ModelPolicy | None = None, trigger: str | None = None) -> StreamingQuery:
    """ST-2 with bounded state: a call repeated within ``horizon`` of event time is stored once.

    The state store holds the keys of the horizon; the table is never read, and
    the file sink's own log makes each micro-batch count once.  Calls later than
    the horizon are dropped by the watermark: use :func:`ingest_calls` where
    replays may be older.
    """
    once = (calls.where("request_id IS NOT NULL AND ts IS NOT NULL").withColumn("ts", F.col("ts").cast("timestamp"))
            .withWatermark("ts", horizon)
            .dropDuplicatesWithinWatermark(["request_id"]))
    fact = build_telemetry(once, policy).withColumn("day", F.to_date("ts"))
    writer = (fact.writeStream.format("parquet").outputMode("append").partitionBy("day").option("path", table_path)
              .option("checkpointLocation", checkpoint))
    return start(writer, trigger)


def running_spend(calls: DataFrame, state_path: str, out_path: str, checkpoint: str,
                  trigger: str | None = None) -> StreamingQuery:
    """ST-7 per call: every paid search with its day's spend so far, in order of (ts, request_id) within a micro-batch.

    ``calls`` are fact rows, each once.  Version ``i`` of the totals per day under
    ``state_path`` and the rows in folder ``batch=i`` of ``out_path`` are both
    written by micro-batch ``i``, which reads version ``i - 1``: a repeated
    micro-batch gives the same rows and totals.
    """
    def write_batch(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        schema = "day date, micro bigint"
        before = (spark.read.schema(schema).parquet(os.path.join(state_path, f"v={batch_id - 1}")) if batch_id
                  else spark.createDataFrame([], schema))
        paid = running_micro(batch)
        rows = (paid.join(before.withColumnRenamed("micro", "_before"), "day", "left")
                .withColumn("_run", F.col("_run") + F.coalesce("_before", F.lit(0))).persist())
        try:
            rows.select(*as_spent(), "day").write.mode("overwrite").parquet(os.path.join(out_path, f"batch={batch_id}"))
            now = rows.groupBy("day").agg(F.max("_run").alias("micro"))
            (before.unionByName(now).groupBy("day").agg(F.max("micro").alias("micro")).coalesce(1)
             .write.mode("overwrite").parquet(os.path.join(state_path, f"v={batch_id}")))
        finally:
            rows.unpersist()

    return start(calls.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint), trigger)


def daily_spend(spark: SparkSession, table_path: str) -> DataFrame:
    """ST-7: ``(day, calls, spend_usd)`` of search calls from the ingested table.

    The table holds every call once, so replays, late rows and lost checkpoints
    cannot count a call twice; partial sums are combined before the shuffle.
    """
    t = spark.read.parquet(table_path).where(F.col("route") == "tavily")
    return (t.groupBy("day")
            # exact: whole 1e-3 cents, summed as integers
            .agg(F.count(F.lit(1)).alias("calls"),
                 F.sum(F.round(F.col("tavily_cost_usd") * 100000).cast("long")).alias("_e5"))
            .select("day", "calls", (F.col("_e5") / F.lit(100000.0)).alias("spend_usd")))


def run_to_end(query: StreamingQuery, timeout_s: float | None = None) -> None:
    """Wait for an ``availableNow`` query to drain its input (ST-5)."""
    if timeout_s is None:
        query.awaitTermination()
    else:
        query.awaitTermination(timeout_s)
    if query.exception() is not None:
        raise query.exception()
