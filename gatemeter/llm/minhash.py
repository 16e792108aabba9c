"""Near-duplicate documents by min-max hashing, confirmed on full shingle sets.

Signature: every permutation of the shingle hashes gives two components, its
smallest and its largest value, so half the hash evaluations of plain MinHash
give the same number of unbiased estimates.  Bands of ``ROWS`` components
become bucket keys.

1. Texts with equal shingle sets are one class (digest of the sorted set);
   everything after that is between classes.
2. Star step: in each bucket every class is compared with one pivot, so a
   bucket of n classes gives n - 1 pairs.  Pairs whose signatures agree too
   little are dropped, the others are confirmed on their full sets, and
   confirmed links form components.
3. Only buckets that still hold more than one component go on: their classes
   are dealt into blocks and every pair of blocks is compared in one task,
   with the full sets at hand.  A pair is looked at in the first band it shares,
   only while its ends lie in different components, so the output is a spanning
   set of confirmed links, never the pairs of a group.  No bucket is capped.

With 24 bands of 4 a pair at similarity 0.8 shares no bucket with probability
3e-6.  Signatures drop a pair only when they agree 4.5 deviations below 0.8.

Edge cases: null, empty and blank texts have no shingle and link with nothing;
a text of fewer words than a shingle is one shingle; repeated rows are one
class; a row without doc_id takes its class's component (null when no row of
the component has an id), and is kept only in that last case; texts that only
occur without an id link like others; very long texts are read whole; an empty table
gives an empty result; extra columns are ignored by :func:`groups` and kept by
:func:`keep_one`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatemeter.llm.common import components, discard, worker_memo, written

SHINGLE = 4
PERCENT = 80
BANDS, ROWS = 24, 4
PERMUTATIONS = BANDS * ROWS // 2
BLOCK = 256
MEMO_ENTRIES = 200_000
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
BATCH_SHINGLES = 1_000_000


def _odd(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 2 ** 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


MULTIPLIERS = _odd(PERMUTATIONS, 42)
BASE = _odd(1, 7)[0]


class _Words(dict):
    def __missing__(self, w: bytes) -> int:
        import xxhash

        if len(self) >= MEMO_ENTRIES:
            self.clear()
        self[w] = h = xxhash.xxh3_64_intdigest(w)
        return h


def shingle_set(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of one text."""
    if not text:
        return np.zeros(0, np.uint64)
    words = text.encode("utf-8", "surrogatepass").translate(LOWER).split()  # splits at 0x20, 0x09-0x0D only
    if not words:
        return np.zeros(0, np.uint64)
    w = np.array(list(map(worker_memo("minhash", _Words).__getitem__, words)), dtype=np.uint64)
    k = min(shingle, len(w))
    h = w[:len(w) - k + 1].copy()
    for i in range(1, k):
        h = h * BASE + w[i:len(w) - k + 1 + i]
    h += np.uint64(k)
    for shift, mult in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        h ^= h >> np.uint64(shift)
        h *= np.uint64(mult)
    h ^= h >> np.uint64(33)
    return np.unique(h)


def signatures(sets: list[np.ndarray], multipliers: np.ndarray = MULTIPLIERS) -> np.ndarray:
    """(texts, 2 * permutations) components: the smallest and the largest value of each permutation."""
    out = np.zeros((len(sets), 2 * len(multipliers)), np.int32)
    sizes = np.array([len(s) for s in sets])
    at = np.flatnonzero(sizes)
    if len(at):
        flat = np.concatenate([sets[i] for i in at])
        starts = np.concatenate([[0], np.cumsum(sizes[at])[:-1]])
        for p, m in enumerate(multipliers):
            y = flat * m
            out[at, 2 * p] = (np.minimum.reduceat(y, starts) >> np.uint64(32)).astype(np.uint32).view(np.int32)
            out[at, 2 * p + 1] = (np.maximum.reduceat(y, starts) >> np.uint64(32)).astype(np.uint32).view(np.int32)
    return out


def sketch_rows(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles, digest and signature of every row (digest and signature null without words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column("doc_id"), batch.column("text").to_pylist()
            start, held, total = 0, [], 0
            for i, t in enumerate(texts):
                held.append(shingle_set(t, shingle))
                total += len(held[-1])
                if total >= BATCH_SHINGLES or i + 1 == len(texts):
                    some = [len(s) > 0 for s in held]
                    sig = signatures(held)
                    yield pa.RecordBatch.from_arrays([
                        ids.slice(start, len(held)),
                        pa.array([len(s) for s in held], pa.int64()),
                        pa.array([_digest(s) if k else None
                                  for s, k in zip(held, some)], pa.string()),
                        pa.array([r if k else None for r, k in zip(sig, some)], pa.list_(pa.int32())),
                    ], names=["doc_id", "n_shingles", "digest", "sketch"])
                    start, held, total = i + 1, [], 0

    return docs.select("doc_id", "text").mapInArrow(
        run, "doc_id long, n_shingles long, digest string, sketch array<int>")


def set_rows(texts: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(node, digest, text) -> (node, hashes); rows whose text has another digest are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, sets = [], []
            for node, digest, t in zip(batch.column("node").to_pylist(), batch.column("digest").to_pylist(),
                                       batch.column("text").to_pylist()):
                s = shingle_set(t, shingle)
                if _digest(s) == digest:
                    nodes.append(node)
                    sets.append(s.view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(sets, pa.list_(pa.int64()))],
                                             names=["node", "hashes"])

    return texts.select("node", "digest", "text").mapInArrow(run, "node long, hashes array<bigint>")


def nameless_sets(texts: DataFrame, near: DataFrame, shingle: int) -> DataFrame:
    """(node, hashes) of the classes ``near`` (node, digest) whose texts only occur without an id."""
    found = texts.select("text", digest_column(F.col("text"), shingle).alias("digest"))
    return set_rows(found.join(near.select("node", "digest"), "digest"), shingle)


def digest_column(text: Column, shingle: int) -> Column:
    """Digest of a text's shingle set, as in :func:`sketch_rows`."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        sets = (shingle_set(t, shingle) for t in texts)
        return pd.Series([_digest(s) if len(s) else None for s in sets], dtype=object)

    return run(text)


def _digest(hashes: np.ndarray) -> str:
    return hashlib.blake2b(hashes, digest_size=16).hexdigest()


def band_keys(sketch: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)),
                       lambda b: F.struct(b.cast("byte").alias("band"),
                                          F.xxhash64(b, F.slice(sketch, b * ROWS + 1, ROWS)).alias("key")))


def least_agreement(percent: int = PERCENT, deviations: float = 4.5) -> int:
    n, p = BANDS * ROWS, percent / 100
    return int(n * p - deviations * (n * p * (1 - p)) ** 0.5)


def similar_size(a: Column, b: Column, percent: int) -> Column:
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def star_links(members: DataFrame, classes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Confirmed links between every class and two pivots of each of its buckets, in an id and in a hash order."""
    pivots = members.groupBy("band", "key").agg(
        F.min("node").alias("p"), F.min(F.struct(F.xxhash64("node").alias("o"), F.col("node"))).alias("q"))
    pairs = (members.join(pivots, ["band", "key"])
             .select("node", F.explode(F.array("p", "q.node")).alias("pivot"))
             .where("node != pivot").distinct())
    own = classes.select("node", F.col("n_shingles").alias("n"), F.col("sketch").alias("s"))
    other = classes.select(F.col("node").alias("pivot"), F.col("n_shingles").alias("pn"), F.col("sketch").alias("ps"))
    agree = F.size(F.filter(F.zip_with("s", "ps", lambda x, y: x == y), lambda x: x))
    likely = (pairs.join(own, "node").join(other, "pivot")
              .where(similar_size(F.col("n"), F.col("pn"), percent) & (agree >= least_agreement(percent)))
              .select("node", "pivot"))
    a = sets.select("node", F.col("hashes").alias("a"))
    b = sets.select(F.col("node").alias("pivot"), F.col("hashes").alias("b"))
    both = F.size(F.array_intersect("a", "b"))
    return (likely.join(a, "node").join(b, "pivot")
            .where(100 * both >= percent * (F.size("a") + F.size("b") - both))
            .select(F.col("node").alias("a"), F.col("pivot").alias("b")))


def block_links(split: DataFrame, percent: int) -> DataFrame:
    """Confirmed links across components inside buckets, as pairs of components.

    ``split``: band, key, node, component, block, blocks, sketch, hashes.  Every
    pair of blocks of a bucket is one group of at most two blocks.
    """
    n = F.col("blocks")
    pairs = F.transform(F.sequence(F.lit(0), n - 1),
                        lambda j: F.struct(F.least(j, F.col("block")).alias("i"), F.greatest(j, F.col("block")).alias("j")))
    dealt = split.select("band", "key", "node", "component", "block", "sketch", "hashes",
                         F.inline(pairs).alias("i", "j"))
    least = least_agreement(percent)

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        band, _, i, j = (k.as_py() for k in key)
        table = table.sort_by("node")
        node = table.column("node").to_numpy()
        block = table.column("block").to_numpy()
        sketch = np.stack(table.column("sketch").to_numpy())
        hashes = [np.asarray(h, dtype=np.int64) for h in table.column("hashes").to_numpy()]
        size = np.array([len(h) for h in hashes])
        comp = table.column("component").to_numpy().copy()
        out_a, out_b = [], []
        for x in range(len(node) - 1):
            rest = np.arange(x + 1, len(node))
            if i != j:
                rest = rest[block[rest] != block[x]]
            rest = rest[comp[rest] != comp[x]]
            rest = rest[np.minimum(size[rest], size[x]) * 100 >= np.maximum(size[rest], size[x]) * percent]
            if not len(rest):
                continue
            same = sketch[rest] == sketch[x]
            rest, same = rest[same.sum(1) >= least], same[same.sum(1) >= least]
            if not len(rest):
                continue
            first = same.reshape(len(rest), BANDS, ROWS).all(2).argmax(1)
            for y in rest[first == band]:
                if comp[y] == comp[x]:
                    continue
                both = len(np.intersect1d(hashes[x], hashes[y], assume_unique=True))
                if 100 * both >= percent * (size[x] + size[y] - both):
                    out_a.append(comp[x])
                    out_b.append(comp[y])
                    comp[comp == comp[y]] = comp[x]
        return pa.table({"a": pa.array(out_a, pa.int64()), "b": pa.array(out_b, pa.int64())})

    return dealt.groupBy("band", "key", "i", "j").applyInArrow(run, "a long, b long")


def linked(docs: DataFrame, percent: int, shingle: int) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, n_shingles, digest) of ``docs`` (doc_id, text), and classes (digest, rep: smallest id, component)."""
    sketched = written(sketch_rows(docs, shingle))
    classes = written(sketched.where("digest IS NOT NULL").groupBy("digest")
                      .agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n_shingles"),
                           F.first("sketch").alias("sketch"))
                      .withColumn("node", F.monotonically_increasing_id()))
    rows = written(sketched.drop("sketch"))
    discard(sketched)
    keyed = classes.select("node", F.inline(band_keys(F.col("sketch"))))
    counts = keyed.groupBy("band", "key").agg(F.count("*").alias("m")).where("m > 1")
    members = written(keyed.join(counts, ["band", "key"]).select("band", "key", "node", "m"))
    near = members.select("node").distinct().join(classes.select("node", "digest", "rep"), "node")
    sets = written(set_rows(docs.join(near.where("rep IS NOT NULL"), F.col("doc_id") == F.col("rep")), shingle)
                   .unionByName(nameless_sets(docs.where("doc_id IS NULL"), near.where("rep IS NULL"), shingle))
                   .dropDuplicates(["node"]))
    comp = written(components(written(star_links(members, classes, sets, percent))))
    known = members.join(comp, "node", "left").withColumn("component", F.coalesce("component", "node"))
    # buckets of two have been compared whole by the star step
    mixed = (known.groupBy("band", "key").agg(F.count("*").alias("m"), F.min("component").alias("lo"),
                                              F.max("component").alias("hi"))
             .where("m > 2 AND lo < hi").select("band", "key", F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks")))
    split = (known.drop("m").join(mixed, ["band", "key"])
             .withColumn("block", F.pmod(F.xxhash64("node", "band"), F.col("blocks")).cast("int"))
             .join(classes.select("node", "sketch"), "node").join(sets, "node"))
    more = written(block_links(split, percent))
    discard(members)
    discard(sets)
    # links across components join these; the smallest node of a component stands for it
    joined = components(more).select(F.col("node").alias("component"), F.col("component").alias("lower"))
    named = (classes.select("digest", "rep", "node").join(comp, "node", "left")
             .withColumn("component", F.coalesce("component", "node")).join(joined, "component", "left")
             .select("digest", "rep", F.coalesce("lower", "component").alias("component")))
    return rows, named


def groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT,
           shingle: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row."""
    rows, named = linked(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), percent, shingle)
    lowest = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    by_digest = named.join(lowest, "component").select("digest", "component_id")
    out = rows.join(by_digest, "digest", "left")
    cid = F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", cid.alias("component_id"),
                      F.coalesce(F.col("doc_id") == cid, cid.isNull()).alias("kept"))


def keep_one(docs: DataFrame, percent: int = PERCENT, shingle: int = SHINGLE) -> DataFrame:
    """``docs`` with one row of each group: the smallest doc_id (null last), then the smallest digest.

    Rows without words are groups of their own.  Rows decide, not ids: another
    text under the kept id goes or stays with its own group.
    """
    d = docs.select("doc_id", "text")
    rows, named = linked(d, percent, shingle)
    first = (named.groupBy("component").agg(F.min(F.struct(F.col("rep").isNull().alias("none"), "rep", "digest")).alias("f"))
             .select("f.rep", "f.digest"))
    copies = (rows.alias("r").join(first.alias("f"), (F.col("r.digest") == F.col("f.digest"))
                                   & F.col("r.doc_id").eqNullSafe(F.col("f.rep")))
              .groupBy("r.doc_id", "r.digest").agg(F.count("*").alias("n")))
    chosen = written(copies.select(F.col("doc_id").alias("id"), F.col("digest").alias("of"), "n"))
    marked = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("id"),
                         digest_column(F.col("text"), shingle).alias("of"))
    met = (marked.alias("m").join(chosen.alias("c"), F.col("m.id").eqNullSafe(F.col("c.id"))
                                  & (F.col("m.of") == F.col("c.of")), "left").select("m.*", "n"))
    one = met.where("n = 1 OR of IS NULL").select("row")
    # rows of one id and one shingle set, in a group of which they are the first
    if not chosen.where("n > 1").isEmpty():
        one = one.unionByName(met.where("n > 1").dropDuplicates(["id", "of"]).select("row"))
    return one.select("row.*")


def query(docs: DataFrame) -> DataFrame:
    return groups(docs)
