"""Streams assembled from micro-batches of reads: any split gives the facts of the whole stream."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gatemeter.operators import sse
from gatemeter.sources import bridges
from gatemeter.sources.tables import read_table
from gatemeter.streaming import assembly

from conftest import SF_SMALL

KEYS = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType())])
COLS = ["conv_id", "turn", "text", "message_id", "stop_reason", "completed", "tool_names", "ttft_ms", "elapsed_ms",
        "input_tokens", "output_tokens", "cache_creation_5m", "cache_creation_1h", "web_search_requests"]
READS = "conv_id long, turn long, seq long, start_ts timestamp, arrival_ts timestamp, chunk binary"


def rows(df):
    return sorted(tuple(map(repr, r)) for r in df.select(*COLS).collect())


def run(spark, folder, batches, idle_s=1e9):
    """The facts emitted by every micro-batch, the last entry by closing, and the store."""
    store, out = assembly.StreamStore(spark, folder, KEYS), []
    for i, batch in enumerate(batches):
        assembly.advance(store, spark.createDataFrame(batch, READS), 2 * i, idle_s, lambda f: out.append(rows(f)))
    assembly.close_open_streams(store, lambda f: out.append(rows(f)))
    return out, store


@pytest.fixture(scope="module")
def reads(spark):
    conv = read_table(spark, SF_SMALL, "conversations").where("conv_id < 9")
    return [tuple(r) for r in bridges.live_reads(conv, 40).collect()]


def whole(spark, reads):
    return rows(sse.facts_from_chunks(spark.createDataFrame(reads, READS), KEYS.fieldNames()))


@pytest.mark.parametrize("seed", range(3))
def test_any_split_gives_the_facts_of_the_whole_stream(spark, tmp_dir, reads, seed):
    rng = random.Random(seed)
    n = rng.choice([2, 4])
    batches = [[] for _ in range(n)]
    for r in reads:  # any order, some reads twice
        for _ in range(rng.choice([1, 1, 1, 2])):
            batches[rng.randrange(n)].append(r)
    out, store = run(spark, f"{tmp_dir}/store", batches)
    assert sorted(x for part in out for x in part) == whole(spark, reads)
    assert store.open_streams().count() == 0


def test_finished_streams_leave_the_store(spark, tmp_dir, reads):
    first = [r for r in reads if r[2] < 3] + [r for r in reads if r[0] < 4 and r[2] >= 3]
    store, out = assembly.StreamStore(spark, f"{tmp_dir}/store", KEYS), []
    assembly.advance(store, spark.createDataFrame(first, READS), 0, 1e9, lambda f: out.extend(rows(f)))
    ended = {r[:2] for r in reads if r[0] < 4 and r[5] == b""}
    assert {(r.conv_id, r.turn) for r in store.open_streams().collect()} == {r[:2] for r in reads} - ended
    assert len(out) == len(ended) > 0
    held = store.open_streams().where(F.col("conv_id") >= 4).first()
    assert held.next_seq == 3 and bytes(held.tail).count(b"\n") == 0
    # a retry of the batch emits the same and leaves the same
    again = []
    assembly.advance(store, spark.createDataFrame(first, READS), 0, 1e9, lambda f: again.extend(rows(f)))
    assert sorted(again) == sorted(out)
    # repeated reads of closed streams are ignored
    assembly.advance(store, spark.createDataFrame(first, READS), 2, 1e9, lambda f: again.extend(rows(f)))
    assert len(again) == len(out)


def test_idle_late_and_broken_streams(spark, tmp_dir):
    import datetime as dt

    t0 = dt.datetime(2024, 1, 1)
    at = lambda s: t0 + dt.timedelta(seconds=s)
    read = lambda conv, seq, s, data: (conv, 0, seq, t0, at(s), data)
    start = b'data: {"type":"message_start","message":{"id":null,"usage":{"input_tokens":5}}}\n'
    text = 'data: {"type":"content_block_delta","delta":{"type":"text_delta","text":"né"}}'.encode()
    cut = text.index(b"\xc3") + 1  # inside the character
    batches = [
        [read(1, 0, 1, start), read(1, 1, 2, text[:cut]), read(2, 0, 1, b"data: {bad\n\xff\xfe\n"), read(3, 2, 1, b"lost")],
        [read(1, 2, 3, text[cut:]), read(4, 0, 50, b"data: 1\n")],          # 2 and 3 are idle from here on
        [read(2, 1, 55, start), read(1, 3, 56, b"\n"), read(4, 1, 56, b"")],  # late for 2
        [read(5, 0, 500, b"")],
    ]
    out, store = run(spark, f"{tmp_dir}/store", batches, idle_s=30)
    got = [[(x[0], x[2], x[5], x[9]) for x in part] for part in out]
    assert got[0] == []
    # an unfinished last line counts when its stream is closed; broken bytes and lines give nothing; gaps don't block
    assert got[1] == [("1", "'né'", "False", "5"), ("2", "''", "False", "None"), ("3", "''", "False", "None")]
    assert got[2] == [("4", "''", "False", "None")]
    assert [x[0] for x in got[3]] == ["5"] and got[4] == []
    assert store.versions() and assembly.StreamStore(spark, f"{tmp_dir}/none", KEYS).versions() == []
