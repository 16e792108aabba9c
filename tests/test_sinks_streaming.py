"""Sinks and streaming: first-wins, replay safety, schema evolution, log round trip."""

from __future__ import annotations

import os

import pytest

from pyspark.sql import functions as F

from gatemeter.operators import sessions
from gatemeter.sources import bridges, request_log, sinks
from gatemeter.sources.tables import read_table
from gatemeter.streaming import ingest

from conftest import SF_SMALL


def test_first_per_key_keeps_earliest(spark):
    df = spark.createDataFrame([("a", 2, "late"), ("a", 1, "early"), ("b", 5, "only")],
                               "k string, arrival int, v string")
    got = {r.k: r.v for r in sinks.first_per_key(df, "k", ["arrival"]).collect()}
    assert got == {"a": "early", "b": "only"}


def test_dedupe_append_is_replay_safe(spark, tmp_dir):
    path = os.path.join(tmp_dir, "t")
    a = spark.createDataFrame([("r1", "d1", 0, "A"), ("r2", "d1", 0, "A")],
                              "request_id string, day string, copy int, batch string")
    b = spark.createDataFrame([("r2", "d1", 0, "B"), ("r3", "d2", 1, "B"), ("r3", "d2", 0, "B2")],
                              "request_id string, day string, copy int, batch string")
    for batch in (a, a, b, b):
        sinks.dedupe_append(batch, path, "request_id", ["copy"], partition_col="day")
    got = {r.request_id: r.batch for r in spark.read.parquet(path).collect()}
    assert got == {"r1": "A", "r2": "A", "r3": "B2"}


def test_key_lookup_reads_buckets_not_the_table(spark, tmp_dir):
    """The bytes a batch reads for its lookup stay flat while the table grows."""
    from pyspark.sql import types as T

    from gatemeter.sources.key_index import KeyIndex

    path = os.path.join(tmp_dir, "t")
    keys = T.StructType([T.StructField("id", T.LongType())])
    index = KeyIndex(spark, path, keys, bucket_keys=500, max_files=3)
    read = []
    for i in range(8):
        ids = spark.range(i * 2000, (i + 1) * 2000)
        if i:  # every batch repeats keys of all earlier ones, and one key twice
            ids = ids.unionByName(spark.range(0, i * 2000, 997)).unionByName(spark.range(i * 2000, i * 2000 + 1))
        batch = ids.selectExpr("id", "id AS at", f"'b{i}' AS batch", "concat('d', id % 2) AS day").coalesce(1)
        few = batch.where("id % 997 = 0")
        have = index.stored(few)
        if have is not None:
            read.append(have.count())
            want = {r.id for r in few.collect() if r.id < i * 2000}
            assert want <= {r.id for r in have.collect()}
        sinks.dedupe_append(batch, path, "id", ["at"], partition_col="day", index=index)
        assert len(index.files()) - len(index._state()[2]) >= 0 and len(index._state()[2]) < 3
    stored = spark.read.parquet(path)
    assert stored.count() == stored.select("id").distinct().count() == 16_000
    assert {r.n for r in stored.groupBy("batch").agg(F.count("*").alias("n")).collect()} == {2000}
    assert index._state()[1] >= 16 and len(index.generations()) <= 2
    # a few keys touch a few buckets of about 500 keys and the young files, however many keys are stored
    one = spark.range(5, 6).selectExpr("id")
    assert index.stored(one).count() <= 2 * 2000 + 1500
    # an index that was lost is built again from the table
    other = KeyIndex(spark, path, keys, bucket_keys=100, max_files=1)
    fs, root = other._fs()
    fs.delete(root, True)
    assert index.stored(one).where("id = 5").count() == 1 and index.due()


def test_append_evolving_adds_columns(spark, tmp_dir):
    path = os.path.join(tmp_dir, "t")
    sinks.append_evolving(spark.createDataFrame([("r1", 1)], "request_id string, a int"), path)
    added = sinks.append_evolving(
        spark.createDataFrame([("r2", 2, "x")], "request_id string, a int, b string"), path)
    assert added == ["b"]
    rows = {r.request_id: (r.a, r.b) for r in
            spark.read.option("mergeSchema", "true").parquet(path).collect()}
    assert rows == {"r1": (1, None), "r2": (2, "x")}


def test_request_log_file_round_trip(spark, tmp_dir):
    """SNK-3 then SRC-1 over files gives the same rebuilt rows as the in-memory parse."""
    lines = bridges.request_log_lines(read_table(spark, SF_SMALL, "events"))
    path = os.path.join(tmp_dir, "log")
    request_log.write_request_log(lines.select(F.col("value").alias("line")), path)
    from_files = request_log.rebuild_telemetry(request_log.read_request_log(spark, path))
    in_memory = request_log.rebuild_telemetry(request_log.parse_log_lines(lines))
    cols = ["request_id", "ts", "upstream_model", "total_tokens", "est_cost_micro_usd"]
    assert from_files.select(*cols).exceptAll(in_memory.select(*cols)).count() == 0
    assert from_files.count() == in_memory.count() > 0
    corrupt = request_log.read_request_log(spark, path).where("corrupt").count()
    assert corrupt == lines.where(~F.col("value").endswith("}")).count()


def test_stream_equals_batch(spark, tmp_dir):
    """Streaming ingest over landed files equals the batch fact table."""
    raw = bridges.calls_from_usage_raw(bridges.usage_raw(read_table(spark, SF_SMALL, "events")))
    landing = os.path.join(tmp_dir, "landing")
    raw.repartition(3).write.parquet(landing)
    table = os.path.join(tmp_dir, "table")
    stream = (spark.readStream.schema(spark.read.parquet(landing).schema)
              .option("maxFilesPerTrigger", "1").parquet(landing))
    q = ingest.ingest_calls(stream, table, os.path.join(tmp_dir, "ckpt"))
    ingest.run_to_end(q, 300)
    from gatemeter.operators.telemetry import build_telemetry

    batch = build_telemetry(raw).select("request_id", "total_tokens", "est_cost_micro_usd")
    streamed = spark.read.parquet(table).select("request_id", "total_tokens", "est_cost_micro_usd")
    assert streamed.count() == batch.count()
    assert streamed.exceptAll(batch).count() == 0


def test_a_hot_folder_is_written_by_several_tasks(spark, tmp_dir):
    import glob

    size = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(size)
    spark.conf.set(size, "64k")
    try:
        batch = spark.range(60_000).selectExpr("uuid() AS id", "id AS at", "'2026-01-01' AS day")
        sinks.dedupe_append(batch, f"{tmp_dir}/hot", "id", ["at"], partition_col="day")
    finally:
        spark.conf.set(size, before)
    assert len(glob.glob(f"{tmp_dir}/hot/day=2026-01-01/*.parquet")) > 1
    assert spark.read.parquet(f"{tmp_dir}/hot").select("id").distinct().count() == 60_000


def test_bad_rows_are_found_by_halving(spark, tmp_dir):
    """One row among ten thousand that cannot be stored is rejected alone; other errors are raised."""
    import pytest

    rows = spark.range(10_000).selectExpr("id", "CASE WHEN id = 4711 THEN 0 ELSE 1 END AS d").repartition(4)
    stored = os.path.join(tmp_dir, "stored")
    derive = lambda df: df.selectExpr("id", "id div d AS q")
    ingest.append_bisecting(rows, derive, lambda f: f.write.mode("append").parquet(stored), os.path.join(tmp_dir, "rejects"))
    bad = spark.read.option("recursiveFileLookup", "true").parquet(os.path.join(tmp_dir, "rejects")).collect()
    assert [r.id for r in bad] == [4711] and "DIVIDE_BY_ZERO" in bad[0].reject_reason
    assert spark.read.parquet(stored).count() == 9_999
    twins = spark.range(6).selectExpr("id div 3 AS id", "CASE WHEN id < 3 THEN 0 ELSE 1 END AS d")
    assert len(ingest.bad_parts(twins, F.xxhash64("id", "d"), derive)) == 1

    def broken(_):
        raise OSError("disk full")

    with pytest.raises(OSError):
        ingest.append_bisecting(rows, derive, broken, os.path.join(tmp_dir, "none"))


def test_stored_facts_join_without_exchange_and_read_one_day(spark, tmp_dir):
    from gatemeter import fixed
    from gatemeter.operators.telemetry import attach_body_features, telemetry_from_events
    from gatemeter.operators.bodies import body_features
    from gatemeter.sources import fact_store

    events = read_table(spark, SF_SMALL, "events")
    bodies = bridges.request_bodies(events, read_table(spark, SF_SMALL, "conversations"))
    path = os.path.join(tmp_dir, "facts")
    facts = fact_store.write_bucketed(telemetry_from_events(events), "facts_bucketed", path, buckets=4)
    features = fact_store.write_bucketed(body_features(bodies), "features_bucketed", os.path.join(tmp_dir, "f"), 4, day=False)
    size = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(size)
    spark.conf.set(size, "-1")
    try:
        plan = attach_body_features(facts, features)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(size, before)
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    day = str(facts.agg(F.min("day")).first()[0])
    one = fact_store.read_facts(spark, path, (day, day))
    assert "PartitionFilters: [isnotnull(day" in one._jdf.queryExecution().executedPlan().toString()
    assert one.select("day").distinct().count() == 1 and one.count() == facts.where(F.col("day") == day).count() > 0
    assert one.columns[:49] == fixed.TELEMETRY_SCHEMA.fieldNames()
    assert [f.dataType for f in one.schema.fields[:49]] == [f.dataType for f in fixed.TELEMETRY_SCHEMA.fields]


def test_running_spend_repeats_a_batch(spark, tmp_dir):
    """The totals of a version come from the one before, so a repeated micro-batch changes nothing."""
    rows = spark.sql("""SELECT concat('r', id) AS request_id, timestamp'2024-01-01 20:00:00' + make_interval(0,0,0,0,id) AS ts,
                        'tavily' AS route, 0.008D AS tavily_cost_usd FROM range(9)""").withColumn("ts", F.col("ts").cast("timestamp"))
    for i in range(3):
        rows.where(F.col("request_id").substr(2, 1).cast("int").between(3 * i, 3 * i + 2)).coalesce(1).write.mode(
            "append").parquet(f"{tmp_dir}/landing")

    def run(ckpt):
        stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", "1").parquet(f"{tmp_dir}/landing")
        ingest.run_to_end(ingest.running_spend(stream, f"{tmp_dir}/totals", f"{tmp_dir}/out", f"{tmp_dir}/{ckpt}"))
        return sorted((r.request_id, str(r.day), r.spend_today_usd) for r in spark.read.parquet(f"{tmp_dir}/out").collect())

    first = run("a")
    assert first == run("b")
    assert [x[2] for x in first] == [0.008, 0.016, 0.024, 0.032, 0.008, 0.016, 0.024, 0.032, 0.04]


def test_many_bad_numbers_are_rejected_in_one_pass(spark, tmp_dir, monkeypatch):
    """Numbers beyond the table's types need no halving, however many there are; all others are stored."""
    raw = bridges.calls_from_usage_raw(bridges.usage_raw(read_table(spark, SF_SMALL, "events").where("event_id < 400")))
    n = F.substring("request_id", 5, 20).cast("long")
    raw = raw.withColumn("output_tokens", F.when(n % 4 == 1, F.lit(1 << 40)).when(n % 4 == 2, F.lit((1 << 31) - 1))
                         .otherwise(F.lit(0))).withColumn("input_tokens", F.when(n % 8 == 2, F.lit(1)).otherwise(F.lit(0)))
    raw = raw.withColumn("cache_read_input_tokens", F.lit(0)).withColumn("cache_creation_input_tokens", F.lit(None).cast("long"))
    raw = raw.withColumn("ttft_ms", F.when(n % 8 == 3, F.lit(1 << 33)).otherwise(F.lit(5)))
    raw = raw.withColumn("stream", n % 16 == 3).withColumn("route", F.lit("native"))
    raw.write.parquet(f"{tmp_dir}/landing")
    monkeypatch.setattr(ingest, "bad_parts", lambda *a: pytest.fail("halved"))
    stream = spark.readStream.schema(raw.schema).parquet(f"{tmp_dir}/landing")
    ingest.run_to_end(ingest.ingest_calls(stream, f"{tmp_dir}/facts", f"{tmp_dir}/ckpt", rejects_path=f"{tmp_dir}/rejects"), 300)
    ids = lambda rows: {int(r.request_id[4:]) for r in rows}
    bad = spark.read.option("recursiveFileLookup", "true").parquet(f"{tmp_dir}/rejects").collect()
    wrong = {i for i in range(400) if i % 4 == 1 or i % 8 == 2 or i % 16 == 3}
    assert ids(bad) == wrong and all(r.reject_reason.startswith("bad_value") for r in bad)
    assert ids(spark.read.parquet(f"{tmp_dir}/facts").collect()) == set(range(400)) - wrong


def test_only_new_calls_are_derived(spark, tmp_dir):
    """A replayed batch derives no row, and the table holds what ``derive`` makes of the first copies."""
    seen = spark.sparkContext.accumulator(0)

    def count(v):
        seen.add(1)
        return v

    mark = F.udf(count, "long")
    derive = lambda rows: rows.withColumn("w", mark(F.col("v"))).withColumn("day", F.lit("d"))
    batch = spark.createDataFrame([("a", 2, 20), ("a", 1, 10), ("b", 1, 30), (None, 1, 40)], "k string, at int, v long")
    for _ in range(2):
        sinks.dedupe_append(batch, f"{tmp_dir}/t", "k", ["at"], partition_col="day", derive=derive)
    assert seen.value == 3
    assert {(r.k, r.w) for r in spark.read.parquet(f"{tmp_dir}/t").collect()} == {("a", 10), ("b", 30), (None, 40)}


TRANSCRIPT_LINES = [("p1", "s1", 10, '{"type": "ai-title", "aiTitle": "late é"}'), ("p1", "s1", 9, '{"type": "ai-title", "aiTitle": "early"}'),
                    ("p0", "s1", 1, '{"type": "ai-title", "aiTitle": " "}'), ("p1", None, 1, '{"type": "ai-title", "aiTitle": "none"}'),
                    ("p0", "s2", 1, '{"type": "ai-title", "aiTitle": "first"}'), ("p1", "s2", 1, '{"type": "custom-title", "customTitle": "own"}'),
                    ("p1", "s3", 1, None), ("p1", "s3", 2, "x")]
TRANSCRIPT_TITLES = {"s1": "late é", sinks.NO_SESSION: "none", "s2": "first"}


def read_titles(spark, path, found):
    return {r.session_id: r.session_name for r in sessions.session_titles(sessions.read_transcripts(spark, path, **found)).collect()}


def test_transcripts_are_written_in_one_folder_per_project(spark, tmp_dir):
    path = os.path.join(tmp_dir, "t")
    lines = spark.createDataFrame(TRANSCRIPT_LINES, "project string, session_id string, line_no long, value string")
    for _ in range(2):  # again: the same files
        assert read_titles(spark, path, sinks.write_transcripts(lines, path)) == TRANSCRIPT_TITLES
        files = sorted(os.path.relpath(os.path.join(at, f), path) for at, _, some in os.walk(path) for f in some)
        assert files == sorted(f"{p}/session_id={s}.jsonl" for p, s in {(p, s or sinks.NO_SESSION) for p, s, *_ in TRANSCRIPT_LINES})
    with open(f"{path}/p1/session_id=s1.jsonl", encoding="utf-8") as f:
        assert [line.split('"')[-2] for line in f] == ["early", "late é"]
    with open(f"{path}/p1/session_id=s3.jsonl") as f:
        assert f.read() == "\nx\n"
    empty = os.path.join(tmp_dir, "none")
    assert read_titles(spark, empty, sinks.write_transcripts(lines.limit(0), empty)) == {}
    assert read_titles(spark, f"file://{tmp_dir}/u", sinks.write_transcripts(lines, f"file://{tmp_dir}/u")) == TRANSCRIPT_TITLES


def test_transcripts_in_a_store_that_only_spark_reaches(spark, tmp_dir):
    spark._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.transcripts.link./in", f"file://{tmp_dir}")
    path = "viewfs://transcripts/in/t"
    lines = spark.createDataFrame(TRANSCRIPT_LINES, "project string, session_id string, line_no long, value string")
    assert read_titles(spark, path, sinks.write_transcripts(lines, path)) == TRANSCRIPT_TITLES


def test_transcript_query_makes_no_folder_per_session(spark):
    from gatemeter.plans.registry import QUERIES
    from gatemeter.session import scratch_path

    def folders():
        top = scratch_path(spark, "tables")
        return {at for at, _, _ in os.walk(top) if "transcripts-" in at}

    before = folders()
    assert QUERIES["transcript_titles"](spark, SF_SMALL).count()
    assert len(folders() - before) == 3  # the table's and one of each project
