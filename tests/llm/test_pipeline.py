"""The corpus pipeline: every stage against its own operator on the rows its predecessor kept."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from conftest import SF_SMALL
from gatemeter.llm import minhash, mixing, packing, quality_crf, toxicity
from gatemeter.llm.common import table
from helpers import edge_docs
from test_dedup_operators import brute_force
from test_text_operators import check_packing


def test_stages_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "toxicity", "minhash near-dedup",
                                                      "mixing sources", "best-fit packing"]


def test_stages_against_brute_force(spark):
    docs = table(spark, SF_SMALL, "documents")
    lab = table(spark, SF_SMALL, "labels")
    columns = docs.columns
    run = {n: f for n, f in corpus_pipeline.STAGES}
    one = run["quality classifier"](spark, docs, SF_SMALL)
    assert one.columns == columns
    field = quality_crf.train(docs, lab)
    rows = docs.collect()
    want = {r.doc_id for r, s in zip(rows, field.scores([r.text for r in rows])) if s >= 0.5}
    assert {r.doc_id for r in one.collect()} == want
    two = run["toxicity"](spark, one, SF_SMALL)
    machine = toxicity.train(one, lab)
    rows = one.collect()
    want = {r.doc_id for r, s in zip(rows, machine.scores([r.text for r in rows])) if s < 0.5}
    rows = two.collect()
    assert two.columns == columns and {r.doc_id for r in rows} == want
    three = run["minhash near-dedup"](spark, two, SF_SMALL)
    rows.sort(key=lambda r: r.doc_id)
    _, low = brute_force([(r.doc_id, r.text) for r in rows], 5)
    assert three.columns == columns
    assert sorted(r.doc_id for r in three.collect()) == [rows[i].doc_id for i in sorted(set(low))]
    four = run["mixing sources"](spark, three, SF_SMALL)
    assert four.columns == columns
    texts = {}
    for r in four.collect():
        texts.setdefault(r.doc_id, []).append(r.text)
    assert max(map(len, texts.values())) <= 3
    check_packing(run["best-fit packing"](spark, four, SF_SMALL).collect(), texts, packing.CAPACITY)


def test_run_equals_its_stages(spark):
    rows = corpus_pipeline.run(spark, SF_SMALL).collect()
    again = corpus_pipeline.run(spark, SF_SMALL).collect()
    key = lambda rs: Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rs)
    assert rows and key(rows) == key(again)


def test_stages_on_awkward_documents(spark):
    docs = edge_docs(spark)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, edge_docs(spark, []), SF_SMALL).count() == 0, name
        got = stage(spark, docs, SF_SMALL)
        assert got.count() >= 0
        if name != "best-fit packing":
            assert got.columns == docs.columns


def test_another_memo_gives_back_the_memory_of_the_one_before():
    """Resident size of a worker falls when its next operator drops a large memo of small texts and numbers."""
    import os
    import subprocess
    import sys

    import gatemeter

    code = """
from gatemeter.llm.common import worker_memo
def resident():
    return int(open("/proc/self/statm").read().split()[1]) * 4096 / 1e6
def make():
    kept = {}
    for i in range(60_000):
        kept[str(i)] = bytes(1500)
    return kept
before = resident()
worker_memo("a", make)
full = resident()
keep = [bytes(600) for _ in range(50)]  # at the top of the heap, so that it cannot shrink by itself
worker_memo("b", dict)
assert full - before > 60 and resident() - before < 30, (before, full, resident())
"""
    root = os.path.dirname(os.path.dirname(gatemeter.__file__))
    subprocess.run([sys.executable, "-c", code], check=True, cwd=root, timeout=60)
