"""Quality rules, token counts, packing, mixing: brute force, round trips, awkward cases."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from gatemeter.llm import mixing, packing, quality_rules, token_count
from helpers import EDGE_DOCS, doc, edge_docs

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
PIECES = ["a", "b", " ", "  ", "▁", "\n", "\t", "é", "中", "🙂", "<s>", "<unk>", "<|endoftext|>", "the", "ing", ",", ".",
          "'s", " ", " ", "\u0085", "0", "12", "word", "x" * 30, " The", "!!", "\r\n", "ñ", "ß"]


def random_text(rng):
    return "".join(rng.choice(PIECES) for _ in range(rng.randint(0, 40)))


# --- quality rules ----------------------------------------------------------------
def base_counts(text):
    ws = WORDS.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORDS.search(x)]
    windows = Counter(tuple(ws[i:i + 3]) for i in range(len(ws) - 2))
    at = {j for i in range(len(ws) - 2) if windows[tuple(ws[i:i + 3])] > 1 for j in (i, i + 1, i + 2)}
    return (len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(at))


def test_quality_rules_match_sql_and_brute_force(spark):
    docs = edge_docs(spark)
    got = quality_rules.query(docs).toPandas()
    assert len(got) == len(EDGE_DOCS)
    want = sorted((base_counts(r[1]) for r in EDGE_DOCS), key=repr)
    cols = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    assert sorted(got[cols].itertuples(index=False, name=None), key=repr) == want
    documents = docs.select("doc_id", "text").toPandas()  # noqa: F841  read by duckdb
    sql = duckdb.sql(quality_rules.ORACLE_SQL).df()
    key = lambda df: sorted(map(repr, df[sorted(df.columns)].astype(object).where(df.notna(), None)
                                .itertuples(index=False, name=None)))
    assert key(got) == key(sql)


def test_rule_order_does_not_change_verdicts(spark):
    stats = quality_rules.text_statistics(edge_docs(spark))
    a = stats.select("doc_id", quality_rules.cascade(quality_rules.RULES).alias("k")).toPandas()
    b = stats.select("doc_id", quality_rules.cascade(quality_rules.RULES[::-1]).alias("k")).toPandas()
    assert a.equals(b)
    ranked = quality_rules.order_rules(edge_docs(spark))
    assert {r.name for r, _, _ in ranked} == {r.name for r in quality_rules.RULES}
    gain = [share / cost for _, cost, share in ranked]
    assert gain == sorted(gain, reverse=True)
    assert len(quality_rules.order_rules(edge_docs(spark, []))) == len(quality_rules.RULES)
    # shares hold for rows that the base rule passes: the short exclamations never enter the cascade
    loud = [doc(i, " ".join(["Wow!"] * 10)) for i in range(6)]
    calm = [doc(10 + i, " ".join(f"word{j} number{j * i} here" for j in range(40))) for i in range(6)]
    share = {r.name: s for r, _, s in quality_rules.order_rules(edge_docs(spark, loud + calm))}
    assert share["exclamations"] == 0


def test_rules_sample_before_their_statistics(spark):
    docs = edge_docs(spark)
    drawn = docs.select("text").sample(0.5, 7)
    plan = quality_rules.text_statistics(drawn, keep=())._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Sample") > plan.rindex("Generate")


def test_quality_rules_are_native(spark):
    plan = quality_rules.query(edge_docs(spark))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# --- token counts -----------------------------------------------------------------
def test_token_counts_equal_the_library(spark):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=token_count.model_path())
    rng = random.Random(3)
    texts = [random_text(rng) for _ in range(3000)] + [r[1] or "" for r in EDGE_DOCS]
    own = token_count.counter()
    assert [own.count(t) for t in texts] == [len(x) for x in lib.encode(texts)]
    got = {(r.doc_id, r.n_bytes): r.n_tokens for r in token_count.query(edge_docs(spark)).collect()}
    for d, t, *_ in EDGE_DOCS:
        assert got[d, len((t or "").encode())] == len(lib.encode(t or ""))
    assert token_count.query(edge_docs(spark, [])).count() == 0


def test_memo_bound_keeps_counts():
    small = token_count.MergeCounter(token_count.model_path(), memo_entries=3)
    big = token_count.counter()
    rng = random.Random(5)
    for t in (random_text(rng) for _ in range(300)):
        assert small.count(t) == big.count(t)


# --- packing ----------------------------------------------------------------------
def test_encoder_equals_the_tokenizer():
    enc = packing.encoder()
    rng = random.Random(4)
    for t in [random_text(rng) for _ in range(3000)] + [r[1] or "" for r in EDGE_DOCS]:
        want = enc.whole.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(enc.ids(t), "<u4").tolist() == want, repr(t)


def one_by_one(counts, capacity):
    """Best-two-fit, bin by bin."""
    left, out = dict(counts), []
    while any(left.values()):
        used, gap = [], capacity
        for n in sorted((n for n, k in left.items() if k), reverse=True):
            while left[n] and n <= gap:
                used.append(n)
                left[n] -= 1
                gap -= n
        if gap:
            s = min(used)
            best = (s, None)
            there = sorted(n for n, k in left.items() if k)
            for a in there:
                for b in there:
                    if a <= b and (a != b or left[a] > 1) and best[0] < a + b <= gap + s:
                        best = (a + b, (a, b))
            if best[1]:
                used.remove(s)
                left[s] += 1
                for n in best[1]:
                    used.append(n)
                    left[n] -= 1
        out.append(sum(used))
    return out


@pytest.mark.parametrize("seed", range(8))
def test_patterns_equal_bin_by_bin(seed):
    rng = np.random.default_rng(seed)
    counts = np.zeros(65, dtype=np.int64)
    for n in rng.integers(1, 65, 60):
        counts[n] += int(rng.integers(1, 6))
    bins = packing.best_two_fit(counts, 64)
    packed = np.zeros(65, dtype=np.int64)
    for pattern, times in bins:
        assert sum(n * k for n, k in pattern) <= 64
        for n, k in pattern:
            packed[n] += k * times
    assert (packed == counts).all()
    assert sum(t for _, t in bins) == len(one_by_one({n: int(k) for n, k in enumerate(counts) if k}, 64))


def check_packing(rows, texts, capacity):
    enc = packing.encoder()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    for d, many in by.items():
        want = Counter()
        for t in texts[d]:
            ids = enc.whole.encode(t or "", add_special_tokens=False).ids + [0]
            first = (len(ids) - 1) % capacity + 1
            cuts = [0, *range(first, len(ids) + 1, capacity)]
            for p, (a, b) in enumerate(zip(cuts, cuts[1:])):
                want[p, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
        assert Counter((r.piece, r.start, r.length, r.ids_crc32) for r in many) == want
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= capacity
    return len(sequences)


@pytest.mark.parametrize("capacity", [16, 2048])
def test_packing_round_trip(spark, capacity):
    texts = {}
    for d, t, *_ in EDGE_DOCS:
        texts.setdefault(d, []).append(t)
    rows = packing.pack(edge_docs(spark), capacity=capacity).collect()
    check_packing(rows, texts, capacity)
    assert packing.pack(edge_docs(spark, [])).count() == 0


def test_packing_keeps_ids(spark):
    rows = packing.pack(edge_docs(spark, [doc(1, "hello world again"), doc(2, None)]), capacity=2, with_ids=True).collect()
    ids = b"".join(bytes(r.ids) for r in sorted((r for r in rows if r.doc_id == 1), key=lambda r: r.piece))
    assert ids == packing.encoder().ids("hello world again") + b"\0\0\0\0"


# --- mixing -----------------------------------------------------------------------
def test_water_fill_respects_caps_and_total():
    sizes, weights = [10, 1000, 0, 500], [5, 2, 1, 5]
    t = mixing.water_fill(sizes, weights)
    assert t[0] == 30 and t[2] == 0 and abs(sum(t) - 1510) < 1e-9
    assert abs(t[1] / t[3] - 2 / 5) < 1e-9
    assert mixing.water_fill([0, 0], [5, 2]) == [0, 0]


def test_tree_splits_quotas_exactly():
    quotas = [100, 7, 0, 45]
    leaves = [mixing.leaf_quotas(quotas, 13, s, seed=1) for s in range(13)]
    assert np.sum(leaves, axis=0).tolist() == quotas
    sizes = [int(x.sum()) for x in leaves]
    assert max(sizes) - min(sizes) <= 1
    assert (mixing.leaf_quotas(quotas, 13, 5, seed=1) == leaves[5]).all()


def test_plan_meets_targets(spark):
    got = mixing.query(edge_docs(spark)).collect()
    assert len(got) == len(EDGE_DOCS)
    assert Counter((r.doc_id, r.size) for r in got) == Counter(
        (d, len(WORDS.findall(t or ""))) for d, t, *_ in EDGE_DOCS)
    by = {}
    for r in got:
        assert 0 <= r.taken <= 3 * r.size
        by.setdefault((r.source_size, r.target), []).append(r.taken)
    for (_, target), taken in by.items():
        assert abs(sum(taken) - target) <= 0.5 + 1e-6
    assert abs(sum(t for _, t in by) - sum(len(WORDS.findall(t or "")) for _, t, *_ in EDGE_DOCS)) < 1e-6
    again = mixing.query(edge_docs(spark).repartition(5)).collect()
    assert Counter(tuple(r) for r in got) == Counter(tuple(r) for r in again)
    assert mixing.query(edge_docs(spark, [])).count() == 0


def test_draw_takes_whole_documents_as_planned(spark):
    rng = random.Random(2)
    rows = [doc(i, " ".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 40))), source=f"s{i % 4}")
            for i in range(400)]
    mixed = mixing.draw(edge_docs(spark, rows), block_words=100, shard_blocks=4)
    got = Counter(r.doc_id for r in mixed.collect())
    plans = mixing.plan_sources(edge_docs(spark, rows).select(
        "source", mixing.text_size(F.col("text")).alias("size")), block_words=100)
    size = {r[0]: len(WORDS.findall(r[1])) for r in rows}
    for p in plans:
        taken = sum(k * size[d] for d, k in got.items() if f"s{d % 4}" == p.source)
        assert abs(taken - p.target) <= 40
    assert max(got.values()) <= 3
    assert mixing.draw(edge_docs(spark, [])).count() == 0
    assert mixing.draw(edge_docs(spark)).count() > 0


def planned(rows, block_words, seed=11):
    """Words taken per document of a plain prefix of each source's permuted blocks, without tree and shards."""
    t = rows.select("doc_id", "source", mixing.text_size(F.col("text")).alias("size"))
    plans = mixing.plan_sources(t, block_words=block_words)
    blocked = mixing.with_block(t, mixing.source_table(t.sparkSession, plans), seed)
    blocks = {(b.source_index, b.block): b for b in mixing.block_table(blocked, seed).collect()}
    out, used = Counter(), Counter()
    order = F.xxhash64(F.lit(seed), "doc_id").alias("o")
    for r in sorted(blocked.select("*", order).collect(), key=lambda r: (r.o, r.doc_id)):
        b = blocks[r.source_index, r.block]
        part = min(r["size"], max(0, (b.needs or 0) - used[r.source_index, r.block]))
        used[r.source_index, r.block] += r["size"]
        out[r.doc_id] += r["size"] * (b.passes + b.whole) + part
    return out


def test_query_counts_the_words_that_draw_deals(spark, monkeypatch):
    rng = random.Random(5)
    rows = [doc(i, " \n".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 40))) + "  ", source=f"s{i % 4}")
            for i in range(400)]
    docs = edge_docs(spark, rows)
    dealt = []
    real = mixing.deal
    monkeypatch.setattr(mixing, "deal", lambda *a: dealt.append(a[1:3]) or real(*a))
    taken = {r.doc_id: r.taken for r in mixing.taken_rows(docs, block_words=100, shard_blocks=4).collect()}
    assert len(dealt) == 1 and dealt[0][1] > 1
    drawn, whole = Counter(), {r[0]: r[1] for r in rows}
    cut = 0
    for r in mixing.draw(docs, block_words=100, shard_blocks=4).collect():
        drawn[r.doc_id] += len(WORDS.findall(r.text))
        assert whole[r.doc_id].startswith(r.text)
        cut += r.text != whole[r.doc_id]
    assert cut <= 4 and {d: n for d, n in taken.items() if n} == dict(drawn)
    want = planned(docs, 100)
    assert taken == {d: want[d] for d in taken}
    assert mixing.query(docs).count() == 400 and len(dealt) == 3
