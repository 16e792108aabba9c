"""Near-duplicates of texts and embeddings against brute force, with hot groups and awkward cases."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from gatemeter.llm import common, embedding_dedup, minhash
from helpers import EDGE_DOCS, doc, edge_docs

LOWER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def shingles(text, k=4):
    ws = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    k = min(k, len(ws))
    return frozenset(tuple(ws[i:i + k]) for i in range(len(ws) - k + 1)) if ws else frozenset()


def lowest(n, links):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def brute_force(rows, k=4):
    sets = [shingles(r[1], k) for r in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] and sets[j]
             and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    return sets, lowest(len(rows), links)


def near_copies(rng, n, start, words=60):
    base = [f"w{rng.randrange(10_000)}" for _ in range(words)]
    out = []
    for i in range(n):
        own = list(base)
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 5])):
            own[rng.randrange(words)] = f"v{rng.randrange(10_000)}"
        out.append(doc(start + i, " ".join(own)))
    return out


def test_components_are_exact(spark):
    rng = random.Random(1)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 460)]
    got = {r.node: r.component for r in common.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    want = lowest(500, pairs)
    nodes = {x for p in pairs if p[0] != p[1] for x in p}
    assert got == {x: want[x] for x in nodes}
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0
    assert common.components(spark.createDataFrame([(None, 1), (2, 2)], "a long, b long")).count() == 0


def test_min_max_estimates_are_unbiased():
    rng = np.random.default_rng(0)
    errors = []
    many = minhash._odd(256, 9)
    for share in (0.2, 0.5, 0.8):
        both = rng.integers(0, 2 ** 63, 300, dtype=np.uint64)
        extra = int(300 * (1 / share - 1) / 2)
        a, b = (np.concatenate([both, rng.integers(0, 2 ** 63, extra, dtype=np.uint64)]) for _ in range(2))
        s = minhash.signatures([np.unique(a), np.unique(b)], many)
        errors.append(abs((s[0] == s[1]).mean() - 300 / (300 + 2 * extra)))
    assert max(errors) < 0.08


@pytest.mark.parametrize("block", [16, 256])
def test_groups_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(minhash, "BLOCK", block)
    rng = random.Random(block)
    rows = near_copies(rng, 120, 0) + near_copies(rng, 25, 200, 200) + near_copies(rng, 40, 300, 12)
    rows += [doc(400 + i, rows[0][1]) for i in range(60)]
    rows += [doc(500 + i, " ".join(f"u{rng.randrange(50)}" for _ in range(rng.randint(0, 9)))) for i in range(60)]
    rng.shuffle(rows)
    sets, want = brute_force(rows)
    got = {r.doc_id: r for r in minhash.query(edge_docs(spark, rows)).collect()}
    ids = [r[0] for r in rows]
    groups = {}
    for i, w in enumerate(want):
        groups.setdefault(w, []).append(ids[i])
    for i, w in enumerate(want):
        r = got[ids[i]]
        assert r.n_shingles == len(sets[i])
        assert r.component_id == min(groups[w])
        assert r.kept == (r.doc_id == r.component_id)


def test_awkward_documents(spark):
    rows = minhash.query(edge_docs(spark)).collect()
    assert len(rows) == len(EDGE_DOCS)
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    for d in (1, 2, 3):
        assert (by[d][0].n_shingles, by[d][0].component_id, by[d][0].kept) == (0, d, True)
    assert by[4][0].n_shingles == 1 and by[10][0].n_shingles == 1
    assert [r.component_id for r in by[7]] == [6, 6] and by[14][0].component_id == 6
    named, empty = sorted(by[None], key=lambda r: -r.n_shingles)
    assert (named.component_id, named.kept) == (6, False)
    assert (empty.component_id, empty.kept) == (None, True)
    assert minhash.query(edge_docs(spark, [])).count() == 0


def test_keep_one_keeps_columns_and_one_of_each_group(spark):
    docs = edge_docs(spark)
    kept = minhash.keep_one(docs, shingle=5)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(6) == 1 and 7 not in ids and 14 not in ids and {1, 2, 3, 9, 10} <= set(ids)


def test_keep_one_decides_by_row(spark):
    rng = random.Random(8)
    a, b, c, e = (" ".join(f"{x}{rng.randrange(900)}" for _ in range(60)) for x in "abce")
    near = c.rsplit(" ", 1)[0] + " other"
    rows = [(1, a), (1, b), (2, b), (None, a), (None, c), (None, c), (None, near), (3, e), (3, e), (3, e + " more"), (4, ""),
            (4, ""), (None, None), (5, None)]
    schema = "doc_id long, text string, _kept string, id string, row string, n string, of string"
    docs = spark.createDataFrame([(i, t, *["clash"] * 5) for i, t in rows], schema)
    kept = minhash.keep_one(docs, shingle=5)
    assert kept.columns == docs.columns
    got = [(r.doc_id, r.text) for r in kept.collect()]
    assert sorted(t for _, t in got if t in (a, b)) == sorted([a, b]) and (1, a) in got and (1, b) in got
    assert sum(t in (c, near) for _, t in got) == 1
    assert sum((t or "").startswith(e) for _, t in got) == 1
    assert sorted(((i, t) for i, t in got if not t), key=repr) == sorted([(4, ""), (4, ""), (None, None), (5, None)], key=repr)
    component = {(r.doc_id, r.n_shingles): r.component_id for r in minhash.query(docs).collect() if r.doc_id is None}
    assert component[(None, 57)] == 1 or component[(None, 57)] is None


# --- embeddings -------------------------------------------------------------------
def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, node string, weight string")


def row(i, v):
    return (i, None if v is None else [None if x is None else float(x) for x in v], 0, "clash", "clash")


def check_vectors(spark, data):
    got = {r.vec_id: r for r in embedding_dedup.query(vectors(spark, [row(i, v) for i, v in data])).collect()}
    x = [np.asarray(v, np.float32).astype(float) for _, v in data]
    ids = [i for i, _ in data]
    links = []
    for a in range(len(x)):
        for b in range(a):
            if len(x[a]) == len(x[b]) and x[a].any() and x[b].any():
                if x[a] @ x[b] / (np.linalg.norm(x[a]) * np.linalg.norm(x[b])) >= 0.9:
                    links.append((a, b))
    want = lowest(len(x), links)
    degree = np.zeros(len(x), int)
    for a, b in links:
        degree[a] += 1
        degree[b] += 1
    groups = {}
    for i, w in enumerate(want):
        groups.setdefault(w, []).append(ids[i])
    for i, w in enumerate(want):
        r = got[ids[i]]
        assert (r.n_links, r.component_id, r.kept) == (degree[i], min(groups[w]), ids[i] == min(groups[w]))


@pytest.mark.parametrize("block", [32, 256])
def test_vector_links_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(embedding_dedup, "BLOCK", block)
    rng = np.random.default_rng(block)
    data = [(i, rng.normal(size=32)) for i in range(150)]
    centre = rng.normal(size=32)
    data += [(1000 + i, centre + rng.normal(size=32) * rng.choice([0.1, 0.3, 0.33, 0.4])) for i in range(120)]
    data += [(2000 + i, data[3][1] * s) for i, s in enumerate((1, 1, 2, -1))]
    data += [(3000 + i, rng.normal(size=5)) for i in range(40)] + [(3100, [1.0]), (3101, [2.0]), (3102, [-1.0])]
    rng.shuffle(data)
    check_vectors(spark, [(int(i), v) for i, v in data])


def test_unusable_vectors_link_with_nothing(spark):
    nan, inf = float("nan"), float("inf")
    rows = [row(1, None), row(2, []), row(3, [0, 0]), row(4, [1, None]), row(5, [nan, 1]), row(6, [inf, 1]),
            row(7, [1, 2]), row(8, [1, 2]), row(8, [1, 2]), row(9, [1e-30, 2e-30]), row(None, [1, 2])]
    got = embedding_dedup.query(vectors(spark, rows)).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.vec_id, []).append((r.n_links, r.component_id, r.kept))
    for i in range(1, 7):
        assert by[i] == [(0, i, True)]
    assert by[7] == [(4, 7, True)] and by[8] == [(4, 7, False)] * 2 and by[9] == [(4, 7, False)]
    assert by[None] == [(4, 7, False)]
    assert embedding_dedup.query(vectors(spark, [])).count() == 0


def test_decoding_lists_every_direction_above_the_threshold():
    rng = np.random.default_rng(4)
    code = embedding_dedup.Code(parts=3, words=9, threshold=1.4, copies=2)
    both = code.tables(12)
    tables = both[0]
    x = rng.normal(size=(40, 12))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    got = [f[f < 9 ** 3] for f in code.decode(x, both)]
    assert all((f[1:] > f[:-1]).all() for f in code.decode(x, both))
    one = [x @ r.T @ w.T for r, w in tables]
    total = (one[0][:, :, None, None] + one[1][:, None, :, None] + one[2][:, None, None, :]).reshape(40, -1)
    full = code.threshold / np.sqrt(12)
    for i in range(40):
        bar = full
        while (total[i] >= bar).sum() < embedding_dedup.LEAST_FILTERS // 2:
            bar -= 0.25 / np.sqrt(12)
        assert got[i].tolist() == np.flatnonzero(total[i] >= bar).tolist()


def test_caps_are_those_of_the_sphere():
    rng = np.random.default_rng(7)
    dim = 12
    w = rng.normal(size=(400_000, dim))
    w /= np.linalg.norm(w, axis=1, keepdims=True)
    x, y = np.eye(dim)[0], 0.9 * np.eye(dim)[0] + np.sqrt(1 - 0.81) * np.eye(dim)[1]
    for bar in (0.3, 0.6):
        assert np.isclose(embedding_dedup.cap(bar, dim), (w @ x >= bar).mean(), rtol=0.05)
        assert np.isclose(embedding_dedup.both_caps(bar, 0.9, dim), ((w @ x >= bar) & (w @ y >= bar)).mean(), rtol=0.06)


@pytest.mark.parametrize("rows", [10_000, 1_000_000, 100_000_000])
def test_pairs_at_the_limit_share_a_filter_at_every_size(rows):
    """The threshold rises with the number of vectors; pairs at cosine 0.9 must meet all the same."""
    rng = np.random.default_rng(rows)
    x, z = rng.normal(size=(2, 500, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z -= (z * x).sum(1, keepdims=True) * x
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    code = embedding_dedup.Code.for_rows(rows, 64)
    tables = code.tables(64)
    met = [len(np.intersect1d(a, b)) > 0 for a, b in
           zip(code.decode(x, tables), code.decode(0.9 * x + np.sqrt(1 - 0.81) * z, tables))]
    assert np.mean(met) >= 0.995
