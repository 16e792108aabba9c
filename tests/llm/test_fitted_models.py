"""Classifiers, language-model scores and URL filter: brute force and held-out accuracy."""

from __future__ import annotations

import itertools
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF_ORACLE
from gatemeter.llm import common, lm_score, quality_crf, toxicity, url_filter
from gatemeter.llm.common import table
from helpers import EDGE_DOCS, LINE, doc, edge_docs, labels


# --- toxicity ---------------------------------------------------------------------
def slow_kernel(a, b):
    def k(s, t):
        total = 0.0
        for x in itertools.combinations(range(len(s)), 3):
            for y in itertools.combinations(range(len(t)), 3):
                if all(s[i] == t[j] for i, j in zip(x, y)) and x[2] - x[0] < toxicity.SPAN and y[2] - y[0] < toxicity.SPAN:
                    total += toxicity.DECAY ** (x[2] - x[0] + 1 + y[2] - y[0] + 1)
        return total

    return k(a, b) / (k(a, a) * k(b, b)) ** 0.5


def test_kernel_equals_its_definition():
    words = ["^idiot$", "^idxiot$", "^banana$", "^cat$", "^pathetical$"]
    got = toxicity.kernel(words, words)
    want = np.array([[slow_kernel(a, b) for b in words] for a in words])
    assert np.allclose(got, want, atol=1e-5)
    assert got[0, 1] > 0.35 > got[0, 2]


def test_folded_machine_equals_landmark_machine_and_tolerates_gaps():
    rng = random.Random(0)
    syllables = ["ta", "re", "mi", "non", "ver", "qua", "ple", "st", "or", "en"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 3)))
    texts, y = [], []
    for i in range(400):
        ws = [word() for _ in range(40)]
        if i % 4 == 0:
            ws[rng.randrange(40)] = rng.choice(["gribbler", "snozzard"])
        texts.append(" ".join(ws))
        y.append(int(i % 4 == 0))
    m = toxicity.fit(texts, np.array(y), landmarks=16, negatives=400)
    clean = " ".join(word() for _ in range(40))
    s = m.scores([clean, clean + " gribbler", clean + " grib-bler.", clean + " g r i b b l e r", clean + " GR1BBLER!", None, ""])
    assert s[0] < 0.5 and (s[1:5] >= 0.5).all() and (s[5:] < 0.5).all()


def test_whole_long_units_and_insults_across_blanks(monkeypatch):
    rng = random.Random(4)
    syllables = ["ta", "re", "mi", "non", "ver", "qua", "ple", "sto", "ora", "en"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 3)))
    # the insult stands after the first window of a harmless beginning that clean texts hold too
    start = "averyharmlessbeginningof"
    texts, y = [], []
    for i in range(400):
        ws = [word() for _ in range(40)]
        ws[3] = start + (rng.choice(["gribblers", "snozzards"]) if i % 4 == 0 else rng.choice(["meadows", "gardens"]))
        texts.append(" ".join(ws))
        y.append(int(i % 4 == 0))
    m = toxicity.fit(texts, np.array(y), landmarks=16, negatives=400)
    clean = " ".join(word() for _ in range(40))
    cases = [clean, clean + f" {start}meadows", clean + f" {start}gribblers", clean + " xyloph" + start + "snozzards",
             clean + " gr ib bl er s", clean + " gr ib. " + word() + " bl er s"]
    s = m.scores(cases)
    assert (s[[0, 1]] < 0.5).all() and (s[2:5] >= 0.5).all() and s[5] < s[4]
    # chunks and an emptied memo change nothing
    monkeypatch.setattr(toxicity, "CHUNK_CHARS", 300)
    monkeypatch.setattr(toxicity, "MEMO_CHARS", 500)
    common._MEMO.clear()
    assert np.allclose(m.scores(cases + texts), np.concatenate([s, m.scores(texts)]))
    assert toxicity.units("go to it. id io t") == ["go", "to", "it.", "id", "io", "t", "gotoit", "idiot"]


@pytest.fixture(scope="module")
def tables(spark):
    return table(spark, SF_ORACLE, "documents"), table(spark, SF_ORACLE, "labels")


def held_out(rows, label):
    r = [x for x in rows if x.held_out]
    return np.mean([x.predicted == x[label] for x in r]), len(r)


def test_toxicity_on_held_out_documents(tables):
    docs, lab = tables
    rows = toxicity.query(docs, lab).join(lab, "doc_id").collect()
    share, n = held_out(rows, "toxic")
    assert n > 50 and share >= 0.9
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)


def test_quality_on_held_out_documents(tables):
    docs, lab = tables
    rows = quality_crf.query(docs, lab).join(lab, "doc_id").collect()
    share, n = held_out(rows, "quality")
    assert n > 80 and share >= 0.97


@pytest.mark.parametrize("query", [toxicity.query, quality_crf.query])
@pytest.mark.parametrize("rows", [[], [(6, 1, 0), (7, 1, 0), (8, 1, 0)], [(6, 1, 1), (9, 0, 0), (11, None, None), (12, 0, 1)]])
def test_classifiers_on_awkward_documents(spark, query, rows):
    got = query(edge_docs(spark), labels(spark, rows)).collect()
    assert len(got) == len(EDGE_DOCS)
    assert all(0 <= r.score <= 1 and r.predicted in (0, 1) and r.held_out is not None for r in got)
    same = {r.score for r in got if r.doc_id in (6, 7)}
    assert len(same) == 1
    assert query(edge_docs(spark, []), labels(spark, rows)).count() == 0


def test_quality_field_is_fitted_on_long_documents():
    good = ["\n".join(f"the plain line {i} of text {k} runs on quietly." for i in range(90)) for k in range(20)]
    bad = ["\n".join(f"BUY!!! ### NOW!!! $$$ {k}" for _ in range(90)) for k in range(20)]
    field = quality_crf.fit(good + bad, np.array([1] * 20 + [0] * 20), rounds=20)
    assert np.abs(field.weights).sum() > 0
    assert (field.scores(good) > 0.9).all() and (field.scores(bad) < 0.1).all()


def test_chains_hold_every_line_once(monkeypatch):
    monkeypatch.setattr(quality_crf, "CELLS", 40)
    rows = [np.arange(n, dtype=float) + 1 for n in (3, 0, 90, 7, 7, 12, 1)]
    seen = {}
    for at, padded, sizes in quality_crf.chains(rows):
        assert len(at) == 1 or padded.size <= 40
        seen |= {int(j): padded[k, :sizes[k]].tolist() for k, j in enumerate(at)}
    assert seen == {j: r.tolist() for j, r in enumerate(rows) if len(r)}


def test_labelled_sample_is_taken_from_the_rows_that_are_there(spark):
    from gatemeter.llm.labelled import training_rows

    lab = labels(spark, [(i, 0, i % 2) for i in range(400)])
    docs = spark.createDataFrame([(i, "x" * (i % 3 * 10)) for i in range(300, 400)], "doc_id long, text string")
    rows = training_rows(docs, lab, "toxic", F.col("doc_id") >= 0, 8, max_chars=10)
    assert rows["label"].value_counts().to_dict() == {0: 8, 1: 8}
    assert set(rows["doc_id"]) <= {i for i in range(300, 400) if i % 3 == 1} and set(rows["text"]) == {"x" * 10}


# --- conditional random field -----------------------------------------------------
def test_marginals_equal_enumeration():
    rng = np.random.default_rng(1)
    e, trans = rng.normal(size=(3, 4)), rng.normal(size=(2, 2))
    sizes = np.array([4, 2, 1])
    p, pairs = quality_crf.forward_backward(e, sizes, trans)
    want_pairs = np.zeros((2, 2))
    for i, n in enumerate(sizes):
        weights = {}
        for path in itertools.product((0, 1), repeat=int(n)):
            weights[path] = np.exp(sum(e[i, k] * path[k] for k in range(n))
                                   + sum(trans[a, b] for a, b in zip(path, path[1:])))
        z = sum(weights.values())
        for k in range(n):
            assert np.isclose(p[i, k], sum(w for path, w in weights.items() if path[k]) / z)
        for path, w in weights.items():
            for a, b in zip(path, path[1:]):
                want_pairs[a, b] += w / z
    assert np.allclose(pairs, want_pairs)


# --- language-model scores --------------------------------------------------------
def small_network():
    rng = np.random.default_rng(0)
    return lm_score.WindowNetwork.start(rng.integers(1, 50, lm_score.CLASSES * lm_score.PER_CLASS))


def test_log_probs_equal_a_plain_loop():
    net = small_network()
    words = lm_score.Vocabulary([b"the", b"cat", b"sat"])
    texts = ["The cat sat on the mat", None, "", "one", " ".join(f"w{i}" for i in range(50))]
    ids, sizes = lm_score.encode(texts, words)
    assert sizes.tolist() == [6, 0, 0, 1, 50]
    at, _ = lm_score.places(sizes)
    got = net.token_log_probs(ids, at)
    for place, lp in zip(at, got):
        h = sum(net.sides[k][ids[place + s]] for k, s in enumerate(lm_score.SIDES)) + net.hidden
        h = np.append(np.maximum(h, 0.1 * h), 1)
        full = []
        c_scores = h @ net.to_class
        c_log = c_scores - np.log(np.exp(c_scores).sum())
        for c in range(lm_score.CLASSES):
            w = h @ net.to_word[c]
            full.append(c_log[c] + w - np.log(np.exp(w).sum()))
        full = np.concatenate(full)
        assert np.isclose(np.exp(full).sum(), 1, atol=1e-4)
        assert np.isclose(lp, full[ids[place]], atol=1e-4)


def test_training_step_follows_the_gradient():
    net = small_network()
    ids, sizes = lm_score.encode(["a b c d e f g h " * 20], lm_score.Vocabulary([b"a", b"b", b"c", b"d"]))
    at, _ = lm_score.places(sizes)
    before = net.token_log_probs(ids, at).mean()
    for _ in range(30):
        net.train(ids, at)
    assert net.token_log_probs(ids, at).mean() > before + 1.0


def test_averaged_network_beats_word_frequencies(tables):
    docs, _ = tables
    words, net = lm_score.train(docs.select("text").repartition(3), rounds=2)
    _, counts = lm_score.vocabulary(docs)
    base = lm_score.WindowNetwork.start(counts)
    base.sides[:] = 0
    base.to_class[:-1] = 0
    base.to_word[:, :-1] = 0
    texts = [r.text for r in docs.select("text").limit(60).collect()]
    ids, sizes = lm_score.encode(texts, words)
    at, _ = lm_score.places(sizes)
    assert net.token_log_probs(ids, at).mean() > base.token_log_probs(ids, at).mean()


def test_scores_of_awkward_documents(spark):
    got = lm_score.query(edge_docs(spark)).collect()
    assert len(got) == len(EDGE_DOCS)
    by = {r.doc_id: r for r in got}
    for d in (1, 2, 3):
        assert (by[d].n_tokens, by[d].log_prob, by[d].mean_log_prob) == (0, 0.0, None)
    assert by[9].n_tokens == 30_000 and by[9].log_prob < 0
    assert np.isclose(by[6].log_prob, by[7].log_prob, rtol=1e-5)
    assert lm_score.query(edge_docs(spark, [])).count() == 0


def test_unseen_words_score_below_rare_ones_and_the_tail_sums_to_one(spark):
    common = [f"c{i:04d}" for i in range(lm_score.WORDS)]
    rare = [f"r{i:04d}" for i in range(1500)]
    rows = [(i, " ".join(common)) for i in range(40)] + [(100 + i, " ".join(rare)) for i in range(30)] + [(200, "once")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    words, net = lm_score.train(docs)
    assert words.tail.table.count() == len(rare) + 1 and set(words.words) == {w.encode() for w in common}
    shares = lm_score.Shares(*zip(*[(bytes(r.word), r.n) for r in words.tail.table.collect()]), words, words.tail.whole)
    total, kinds = np.zeros(lm_score.HASHED), np.zeros(lm_score.HASHED)
    for w in [*(w.encode() for w in rare), b"once"]:
        k = lm_score.zlib.crc32(w) % lm_score.HASHED
        total[k] += np.exp(shares[w])
        kinds[k] += 1
    assert np.allclose(total + (kinds + 1) * lm_score.UNSEEN / words.tail.whole, 1)
    # a made-up word of the same hashed id
    same = next(w for i in range(10**6) if lm_score.zlib.crc32((w := f"zz{i}").encode()) % lm_score.HASHED
                == lm_score.zlib.crc32(b"r0007") % lm_score.HASHED)
    got = {r.doc_id: r for r in lm_score.score(spark.createDataFrame(
        [(1, "r0007"), (2, same), (3, "c0007"), (None, None)], "doc_id long, text string"), words, net).collect()}
    own = lm_score.encode(["r0007"], words)[0]
    assert np.isclose(got[1].log_prob, net.token_log_probs(own, np.array([2]))[0] + shares[b"r0007"], atol=1e-4)
    assert np.isclose(got[1].log_prob - got[2].log_prob, np.log(30 / lm_score.UNSEEN), atol=1e-4)
    assert (got[None].n_tokens, got[None].log_prob, got[None].mean_log_prob) == (0, 0.0, None)


def test_coded_rows_number_the_words_of_each_chunk(spark):
    words = lm_score.Vocabulary([b"the", b"fox", b"w1"])
    docs = edge_docs(spark, [*EDGE_DOCS, *[(100, "  A\x0bthe\x1ca\rW1 \x85 W2 w2\x00 ", *EDGE_DOCS[0][2:])] * 2]).repartition(3)
    rows = lm_score.coded(docs, words, "text", ["doc_id", "text"]).collect()
    assert len(rows) == len(EDGE_DOCS) + 2
    chunks = {}
    for r in rows:
        chunks.setdefault(r.chunk, []).append(r)
    assert len(chunks) == 3
    for some in chunks.values():
        listed = []
        for r in some:
            assert r.base == len(listed)
            listed += map(bytes, r.fresh)
        assert len(set(listed)) == len(listed)
        for r in some:
            want = (r.row.text or "").encode()
            want = bytes(c + 32 if 65 <= c <= 90 else c for c in want).split()
            assert np.frombuffer(r.ids, "<u2").tolist() == words.ids(want).tolist()
            assert [listed[k] for k in np.frombuffer(r.tail, "<u4")] == [w for w in want if w not in words]


def test_scoring_reads_coded_rows_not_texts(spark):
    plan = lm_score.query(edge_docs(spark))._jdf.queryExecution().executedPlan().toString()
    assert "text" not in plan and plan.count("InArrow") == 1


def test_training_does_not_depend_on_the_split(tables):
    docs = tables[0].select("doc_id", "text").limit(300).persist()
    _, one = lm_score.train(docs.repartition(2), rounds=2, replica_tokens=20_000)
    _, two = lm_score.train(docs.repartition(7, "doc_id"), rounds=2, replica_tokens=20_000)
    assert np.allclose(one.flat(), two.flat(), atol=1e-5)


# --- URL filter -------------------------------------------------------------------
URLS = ["http://A.Example.NET/en/1", "https://x.net/y", "http://net/", "http://net", "https://example.com/de/x?y#z",
        "https://sub.example.com/de", "ftp://q.org/fr/a", "http://org/fr/", "http://xorg/fr/", "nohost", None, "",
        "://", "http://?q", "http://h#f/x", "http://h/p?/de/", "http://casino.example.org/en/9", "http://É.example.net/en/",
        "http://a.example.netx/en/1", "https://b.example.com/en/12", "https://b.example.com/en/12"]


def pages(spark, urls):
    return spark.createDataFrame([(i, u, "<p>", "clash", "clash") for i, u in enumerate(urls)],
                                 "page_id long, url string, html string, host string, s string")


def test_url_filter_matches_sql(spark):
    p = pages(spark, URLS)
    got = url_filter.query(p).toPandas()
    pages_df = p.select("page_id", "url").toPandas()
    con = duckdb.connect()
    con.register("pages", pages_df)
    want = con.execute(url_filter.ORACLE_SQL).df()
    key = lambda df: sorted(map(repr, df[sorted(df.columns)].astype(object).where(df.notna(), None)
                                .itertuples(index=False, name=None)))
    assert key(got) == key(want)
    by = got.set_index("page_id")
    assert by.loc[0, ["host", "path", "rule", "verdict"]].tolist() == ["a.example.net", "/en/1", "example.net/en/", "allow"]
    assert by.loc[1, "rule"] == "net/" and by.loc[2, "rule"] == "net/" and by.loc[3, "rule"] is None
    assert by.loc[4, ["path", "rule", "verdict"]].tolist() == ["/de/x", "example.com/de/", "block"]
    assert by.loc[8, "rule"] is None and by.loc[9, ["host", "path"]].tolist() == ["", ""]


def test_url_model_is_a_distribution(spark):
    rows = [(a + b + c, (i * 7) % 5, (i * 3) % 4) for i, (a, b, c) in enumerate(itertools.product("ab^", "ab", "ab$"))]
    counts = spark.createDataFrame(rows, "g string, a long, b long")
    assert url_filter.model(counts).count() == len(rows)


def test_url_filter_without_training_urls(spark):
    got = {r.page_id: r.verdict for r in url_filter.query(pages(spark, ["http://a.io/x", None])).collect()}
    assert got == {0: "allow", 1: "allow"}
    assert url_filter.query(pages(spark, [])).count() == 0
    import re

    plan = url_filter.query(pages(spark, URLS))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
