"""Vector codes, exact top-k search and periodic runs against brute force."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from conftest import SF_SMALL
from gatemeter.llm import cover_codes, topk_search, word_runs
from gatemeter.llm.common import table
from helpers import EDGE_DOCS, doc, edge_docs

INF, NAN = float("inf"), float("nan")
VECTORS = "vec_id long, embedding array<double>, label int, row string, v string, error string, score string, part string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, e, lab, *["clash"] * 5) for i, e, lab in rows], VECTORS)


def some_vectors(rng, n, width=16, spread=1.0):
    rows = [(i, [float(np.float32(rng.gauss(0, spread))) for _ in range(width)], rng.choice([0, 1, None])) for i in range(n)]
    copies = [(n + i, list(rows[0][1]), 7) for i in range(n // 3)]
    return rows + copies


BAD = [(9001, None, 1), (9002, [1.0, None] * 8, 1), (9003, [NAN] * 16, 1), (9004, [INF] * 16, 1)]


def whole(rows):
    return [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]


# --- vector codes ---------------------------------------------------------------------------------------------------

def plain_codes(rows, parts=8, entries=16, rounds=6):
    """The contract with Python integers and a loop over everything."""
    rows = [(i, [math.floor(4096 * x) for x in e], lab) for i, e, lab in whole(rows)]
    width = len(rows[0][1]) // parts
    cut = lambda v, p: v[p * width:(p + 1) * width]
    smallest = sorted((r for r in rows if r[0] is not None), key=lambda r: r[:2])[:entries]
    books = [[cut(r[1], p) for r in smallest] for p in range(parts)]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), j) for j, c in enumerate(book))

    for _ in range(rounds):
        for p, book in enumerate(books):
            groups = {}
            for r in rows:
                groups.setdefault(nearest(cut(r[1], p), book)[1], []).append(cut(r[1], p))
            books[p] = [[sum(c) // len(groups[j]) for c in zip(*groups[j])] if j in groups else e
                        for j, e in enumerate(book)]
    found = [[nearest(cut(r[1], p), books[p]) for p in range(parts)] for r in rows]
    errors = [sum(d for d, _ in f) for f in found]
    by_label = {}
    for r, e in zip(rows, errors):
        by_label[r[2]] = by_label.get(r[2], 0) + e
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((r[0], "".join(f"{j:02x}" for _, j in f), e, by_label[r[2]], digest)
                   for r, f, e in zip(rows, found, errors)), key=repr)


@pytest.mark.parametrize("leaf", [1, 4, 64])
def test_cover_tree_invariants(leaf):
    rng = np.random.default_rng(leaf)
    for kind in range(4):
        points = rng.integers(-900, 900, (300, 3)) if kind else rng.integers(0, 3, (300, 3))
        if kind == 2:
            points[rng.random(300) < 0.5] = points[0]
        points = cover_codes.exact(points)
        _, born = cover_codes.grow_nets(points, leaf)
        reach = cover_codes.lengths(points - points[0]).max()
        net = [0]
        for level in sorted({b[0] for b in born}):
            r = reach / 2 ** level
            fresh = [b for b in born if b[0] == level]
            for _, point, parent in fresh:
                assert parent in net
                assert np.linalg.norm((points[point] - points[parent]).astype(float)) <= 2 * r * (1 + 1e-9)
            net += [b[1] for b in fresh]
            gaps = [np.linalg.norm((points[net[i]] - points[net[j]]).astype(float)) for i in range(len(net)) for j in range(i)]
            assert min(gaps) > r * (1 - 1e-9)
        tree = cover_codes.build_tree(points, leaf)
        assert sorted(tree.order) == list(range(300))
        placed = points[tree.order]
        for i in range(len(tree.centre)):
            inside = placed[tree.begin[i]:tree.end[i]]
            assert cover_codes.lengths(inside - placed[tree.centre[i]]).max() == tree.radius[i]
            kids = range(tree.child[i], tree.child[i] + tree.children[i])
            if kids:
                assert [tree.begin[k] for k in kids][1:] == [tree.end[k] for k in kids][:-1]
                assert (tree.begin[kids[0]], tree.end[kids[-1]]) == (tree.begin[i], tree.end[i])


def test_assignment_is_exact_with_ties_and_large_numbers():
    rng = np.random.default_rng(5)
    whole_subtrees = 0
    for kind in range(30):
        scale = [1, 50, 4000, 1 << 45][kind % 4]
        points = cover_codes.exact(rng.integers(-4, 5, (257, 4)) * scale)
        if kind % 3 == 0:
            points = cover_codes.exact(points + (rng.integers(0, 2, 257) * 100 * scale)[:, None])
        tree = cover_codes.build_tree(points, 8)
        placed = points[tree.order]
        book = np.concatenate([placed[rng.integers(0, 257, 7)], placed[:2]])
        got = np.full(257, -1)
        for a, b, e in zip(*cover_codes.assign(tree, placed, book)):
            assert (got[a:b] == -1).all()
            got[a:b] = e
            whole_subtrees += b - a > 1
        gaps = cover_codes.squares(placed[:, None, :] - book[None])
        assert got.tolist() == [min(range(9), key=lambda j: (g[j], j)) for g in gaps]
    assert whole_subtrees


@pytest.mark.parametrize("chunk", [50, 4096])
def test_codes_equal_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(cover_codes, "CHUNK", chunk)
    rng = random.Random(chunk)
    rows = some_vectors(rng, 90) + BAD + [(3, [0.25] * 16, None), (None, [0.5] * 16, 1)]
    rng.shuffle(rows)
    got = cover_codes.query(vectors(spark, rows).repartition(3)).collect()
    assert sorted((tuple(r) for r in got), key=repr) == plain_codes(rows)


def test_codes_of_few_long_and_large_vectors(spark):
    rows = [(i, [float(i + j) for j in range(8)], 0) for i in range(5)]
    got = cover_codes.query(vectors(spark, rows)).collect()
    assert sorted((tuple(r) for r in got), key=repr) == plain_codes(rows)
    # a length that eight does not divide is filled with zeros; other lengths and empty vectors go
    ragged = [(1, [1.0] * 10, 0), (2, [2.0] * 10, 0), (3, [1.0] * 4, 0), (4, [], 0)]
    assert {(r.vec_id, r.error) for r in cover_codes.query(vectors(spark, ragged)).collect()} == {(1, 0), (2, 0)}
    big = [(i, [1e9 * (i % 5 + 20 * (i > 15))] * 8, 0) for i in range(20)]
    got = cover_codes.query(vectors(spark, big)).collect()
    want = {r[0]: r[1:3] for r in plain_codes(big)}
    assert {r.vec_id: r.code for r in got} == {i: c for i, (c, _) in want.items()}
    assert {r.vec_id: r.error for r in got} == {i: e if e < 1 << 63 else None for i, (_, e) in want.items()}
    assert cover_codes.query(vectors(spark, [])).count() == 0
    assert cover_codes.query(vectors(spark, BAD)).count() == 0


# --- exact search ---------------------------------------------------------------------------------------------------

def plain_search(rows, k=20):
    rows = [(i, [math.floor(64 * x) for x in e]) for i, e, _ in whole(rows)]
    out = []
    for at, (query, v) in enumerate(rows):
        if query is not None and query % 20 == 0:
            found = sorted((-sum(a * b for a, b in zip(v, w)), i is None, i or 0)
                           for j, (i, w) in enumerate(rows) if j != at)
            out += [(query, r + 1, None if null else i, -s) for r, (s, null, i) in enumerate(found[:k])]
    return sorted(out, key=repr)


@pytest.mark.parametrize("blocks", [(16, 3), (8192, 4096)])
def test_search_equals_brute_force(spark, monkeypatch, blocks):
    monkeypatch.setattr(topk_search, "CANDIDATES", blocks[0])
    monkeypatch.setattr(topk_search, "QUERIES", blocks[1])
    rng = random.Random(blocks[0])
    # few distinct scores, so that most places are ties; copies; repeated, missing and ragged rows
    rows = some_vectors(rng, 120, 4, 0.02) + BAD + [(40, [0.1, 0.0, 0.3, 0.0], 1), (40, [0.1, 0.0, 0.3, 0.0], 2),
                                                    (None, [0.1] * 4, 0), (60_000, [], 0), (61, [0.5] * 9, 0),
                                                    (80_000, [0.0] * 4, 0)]
    rng.shuffle(rows)
    got = topk_search.query(vectors(spark, rows).repartition(3)).collect()
    assert sorted((tuple(r) for r in got), key=repr) == plain_search(rows)


def test_search_of_few_empty_and_large_vectors(spark):
    few = [(0, [1.0, 2.0], 0), (1, [1.0, 2.0], 0), (20, [-1.0, 0.0], 0)]
    assert sorted(map(tuple, topk_search.query(vectors(spark, few)).collect()), key=repr) == plain_search(few)
    assert topk_search.query(vectors(spark, few[:1])).count() == 0
    assert topk_search.query(vectors(spark, [])).count() == 0
    large = [(i, [4e5 * (i - 30), 2e7 * (i % 3)], 0) for i in range(60)]
    assert sorted(map(tuple, topk_search.query(vectors(spark, large)).collect()), key=repr) == plain_search(large)
    beyond = [(0, [1e18, 1e18], 0), (1, [1e18, 1.0], 0), (2, [-1e18, 0.0], 0)]
    assert [(r.vec_id, r.score) for r in topk_search.query(vectors(spark, beyond)).orderBy("rank").collect()] == \
        [(1, topk_search.LONG_MAX), (2, -topk_search.LONG_MAX)]


def test_sparse_rows_scatter_into_dense_scores():
    rng = np.random.default_rng(2)
    a, b = (np.where(rng.random((n, 300)) < 0.03, rng.integers(-9, 10, (n, 300)), 0) for n in (70, 90))
    lists = [topk_search.posting_lists(*topk_search.sparse_rows(pa.array(x.tolist(), pa.list_(pa.int64())))) for x in (a, b)]
    assert sum(len(r) for r, _ in lists[0].values()) == (a != 0).sum()
    for exact in (True, False):
        assert (topk_search.accumulate(*lists, 70, 20, 80, exact) == a @ b[20:80].T).all()


# --- periodic runs --------------------------------------------------------------------------------------------------

def plain_runs(words):
    out = []
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            run = words[i:j + q]
            if j > i and len(run) >= max(6, 4 * q) and not any(run[r:] == run[:-r] for r in range(1, q)):
                out.append((i, len(run), q))
            i = max(i, j) + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_row(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        if h % 10 == 0:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words)
    dropped = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = None
    for r in runs:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2],
            sha("".join(f"{s},{length},{q}\n" for s, length, q in runs)),
            sha(" ".join(w for i, w in enumerate(words) if i not in dropped)))


def test_wavelet_matrix():
    rng = np.random.default_rng(1)
    values = rng.permutation(700)
    matrix = word_runs.WaveletMatrix(values, 10)
    left = rng.integers(0, 700, 300)
    right = left + 1 + (rng.random(300) * (700 - left)).astype(int)
    right = np.minimum(right, 700)
    x = rng.integers(0, 700, 300)
    k = (rng.random(300) * (right - left)).astype(int)
    assert matrix.below(left, right, x).tolist() == [(values[a:b] < v).sum() for a, b, v in zip(left, right, x)]
    assert matrix.smallest(left, right, k).tolist() == [np.sort(values[a:b])[i] for a, b, i in zip(left, right, k)]


@pytest.mark.parametrize("seed", range(4))
def test_runs_equal_brute_force(seed):
    rng = random.Random(seed)
    for _ in range(120):
        texts = []
        for _ in range(rng.randint(0, 6)):
            c = [rng.randrange(rng.choice([1, 2, 3, 8])) for _ in range(rng.randint(0, 90))]
            if c and rng.random() < 0.6:
                a, p = rng.randrange(len(c)), rng.randint(1, 20)
                c = [c[i] if i < a else c[a + (i - a) % p] for i in range(len(c))]
            if rng.random() < 0.2:
                c = c + [9] + c * 5
            texts.append(c)
        starts = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(int)
        got = [[] for _ in texts]
        for t, *r in zip(*(x.tolist() for x in word_runs.find_runs([w for t in texts for w in t], starts))):
            got[t].append(tuple(r))
        assert got == [plain_runs(t) for t in texts]


def test_runs_query_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(word_runs, "CHUNK_BYTES", 20_000)
    rows = [r for r in table(spark, SF_SMALL, "documents").select("doc_id", "text").collect() if len(r.text) < 6000]
    docs = [doc(r.doc_id, r.text) for r in rows]
    docs += [doc(1000 + i, "a b " * i + "x y z " * (i % 7)) for i in range(60)]
    docs += [doc(2000 + i, " ".join("pqr"[j % 3] for j in range(i))) for i in range(40)]
    got = word_runs.query(edge_docs(spark, docs).repartition(3)).collect()
    want = [plain_row(r[0], r[1]) for r in docs]
    assert sorted((tuple(r) for r in got), key=repr) == sorted(want, key=repr)
    assert sum(r[1] > 0 for r in want) > 50 and sum(r[1] > 0 for r in want[:len(rows)]) > 5


def test_runs_of_awkward_documents(spark):
    rows = [r for r in EDGE_DOCS if r[0] != 9]
    got = word_runs.query(edge_docs(spark, rows)).collect()
    assert sorted((tuple(r) for r in got), key=repr) == sorted((plain_row(r[0], r[1]) for r in rows), key=repr)
    assert word_runs.query(edge_docs(spark, [])).count() == 0
    (long,) = word_runs.word_runs(edge_docs(spark, [doc(9, "a b c " * 200_000 + "end")])).collect()
    assert [tuple(r) for r in long.runs] == [(0, 600_000, 3)] and long.collapsed == "a b c end"
