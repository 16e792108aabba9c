"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Each source's documents fall by a seeded hash into blocks of about
``block_words`` words.  A source's target is whole passes over it plus a rest;
the rest is drawn from a fresh seeded permutation of its blocks, so every
source has an exact quota of blocks.  A binary tree over the output shards
splits the vector of quotas: each node gives its left half a multivariate
hypergeometric draw, until each shard holds its own quota of every source.
Shards then take disjoint ranges of the permuted blocks and shuffle locally.

Per source (the entries of a weight table) there is one row on the driver:
name, words, documents, blocks.  Everything about documents and blocks stays
in DataFrames; a leaf of the tree walks its own path in a task, with node
seeds, so no task or driver holds the whole tree.

Edge cases: a null source is a source of its own, last in order; null and
empty texts have size 0 and are never taken; rows of one doc_id are mixed one
by one; a corpus without words takes nothing; an empty table gives an empty
result; extra columns are kept by :func:`draw` and ignored by :func:`taken_rows`,
which counts what :func:`draw` deals.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gatemeter.llm.common import SPACE_CLASS, WORD_RE, discard, written

WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
BLOCK_WORDS = 50_000
BLOCK_DOCS = 2_000
SHARD_BLOCKS = 64


def text_size(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_RE)), F.lit(0)).cast("long")


def water_fill(sizes: Sequence[int], weights: Sequence[float], repeats: int = MAX_REPEATS) -> list[float]:
    """Targets by weight that share the sum of sizes; what lies above ``repeats`` sizes is reshared."""
    total = float(sum(sizes))
    caps = [float(repeats * s) for s in sizes]
    out = [0.0] * len(sizes)
    free = [i for i, s in enumerate(sizes) if s > 0]
    while free:
        share = total / sum(weights[i] for i in free)
        over = [i for i in free if weights[i] * share > caps[i]]
        if not over:
            for i in free:
                out[i] = weights[i] * share
            break
        for i in over:
            out[i] = caps[i]
            total -= caps[i]
        free = [i for i in free if i not in set(over)]
    return out


@dataclass(frozen=True)
class SourcePlan:
    """One source: its order, name, words, target words and number of blocks."""

    index: int
    source: str | None
    size: int
    target: float
    blocks: int

    @property
    def passes(self) -> int:
        return int(self.target // self.size) if self.size else 0

    @property
    def rest(self) -> int:
        return round(self.target - self.passes * self.size) if self.size else 0


def plan_sources(sized: DataFrame, weights: Sequence[float] = WEIGHTS, repeats: int = MAX_REPEATS,
                 block_words: int = BLOCK_WORDS) -> list[SourcePlan]:
    """The weight table: sources by code point, null last, weights repeating."""
    rows = sized.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("docs")).collect()
    rows.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    sizes = [int(r["size"]) for r in rows]
    targets = water_fill(sizes, [weights[i % len(weights)] for i in range(len(rows))], repeats)
    return [SourcePlan(i, r["source"], s, t, max(1, s // block_words, r["docs"] // BLOCK_DOCS))
            for i, (r, s, t) in enumerate(zip(rows, sizes, targets))]


def source_table(spark, plans: Sequence[SourcePlan]) -> DataFrame:
    return spark.createDataFrame(
        [(p.index, p.source, p.size, p.target, p.blocks, p.passes, p.rest) for p in plans],
        "source_index int, _source string, source_size long, target double, n_blocks long, passes int, rest long")


def with_block(docs: DataFrame, sources: DataFrame, seed: int) -> DataFrame:
    """Adds the source's plan and each row's block."""
    return (docs.join(sources, docs["source"].eqNullSafe(sources["_source"]))
            .withColumn("block", F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id")), F.col("n_blocks"))).drop("_source"))


def block_table(blocked: DataFrame, seed: int) -> DataFrame:
    """One row per block: passes, whether the rest takes it whole, or the words of it that the rest still needs."""
    b = (blocked.groupBy("source_index", "block")
         .agg(F.sum("size").alias("words"), F.first("passes").alias("passes"), F.first("rest").alias("rest"))
         .where("words > 0"))
    order = F.xxhash64(F.lit(seed), F.lit("rest"), "source_index", "block")
    w = Window.partitionBy("source_index").orderBy(order, "block").rowsBetween(Window.unboundedPreceding, -1)
    b = b.withColumn("before", F.coalesce(F.sum("words").over(w), F.lit(0)))
    return b.select("source_index", "block", "words", "passes",
                    (F.col("before") + F.col("words") <= F.col("rest")).alias("whole"),
                    F.when((F.col("before") < F.col("rest")) & (F.col("before") + F.col("words") > F.col("rest")),
                           F.col("rest") - F.col("before")).alias("needs"))


def leaf_quotas(quotas: Sequence[int], shards: int, shard: int, seed: int) -> np.ndarray:
    """Blocks of every source that one shard receives: the walk from the root to its leaf.

    Each node splits its counts by a multivariate hypergeometric draw seeded by
    the node, so all leaves agree on the nodes they share and the leaves' quotas
    sum exactly to ``quotas``.
    """
    counts = np.array(quotas, dtype=np.int64)
    total = int(counts.sum())
    lo, hi = 0, shards
    edge = lambda i: total * i // shards  # noqa: E731  leaves differ by one block at most
    while hi - lo > 1:
        mid = (lo + hi) // 2
        rng = np.random.default_rng([seed, lo, hi])
        left = rng.multivariate_hypergeometric(counts, edge(mid) - edge(lo), method="marginals")
        if shard < mid:
            counts, hi = left, mid
        else:
            counts, lo = counts - left, mid
    return counts


def deal(draws: DataFrame, quotas: Sequence[int], shards: int, seed: int) -> DataFrame:
    """Adds ``shard`` to the drawn blocks (source_index, rank): disjoint ranges of each source's permutation."""
    spark = draws.sparkSession
    quotas = [int(q) for q in quotas]

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for ids in batches:
            for shard in ids["id"]:
                n = leaf_quotas(quotas, shards, int(shard), seed)
                yield pd.DataFrame({"shard": np.int64(shard), "source_index": np.arange(len(n), dtype=np.int32), "n": n})

    leaves = spark.range(shards).mapInPandas(walk, "shard long, source_index int, n long").where("n > 0")
    w = Window.partitionBy("source_index").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    ranges = leaves.withColumn("first", F.coalesce(F.sum("n").over(w), F.lit(0)))
    places = ranges.select("source_index", "shard",
                           F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1)).alias("rank"))
    return draws.join(places, ["source_index", "rank"])


def deal_corpus(sized: DataFrame, weights: Sequence[float] = WEIGHTS, repeats: int = MAX_REPEATS,
                block_words: int = BLOCK_WORDS, shard_blocks: int = SHARD_BLOCKS,
                seed: int = 11) -> tuple[DataFrame, DataFrame, int]:
    """(source table, dealt blocks, number of shards) of a written table of doc_id, source, size.

    A dealt block has its ``shards``, one per whole copy, and for the one block
    per source that the rest cuts through ``last``, the shard of the cut copy,
    and ``needs``, the words it takes.
    """
    plans = plan_sources(sized, weights, repeats, block_words)
    sources = source_table(sized.sparkSession, plans)
    blocks = written(block_table(with_block(sized, sources, seed), seed))
    # every drawn block once per pass, ranked in that pass's permutation
    passes = F.col("passes") + F.when(F.col("whole") | F.col("needs").isNotNull(), 1).otherwise(0)
    drawn = (blocks.withColumn("copies", passes).where("copies > 0")
             .select("source_index", "block", "passes", "needs",
                     F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")))
    order = Window.partitionBy("source_index").orderBy("copy", F.xxhash64(F.lit(seed), "copy", "source_index", "block"),
                                                       "block")
    drawn = drawn.withColumn("rank", (F.row_number().over(order) - 1).cast("long"))
    per_source = {r["source_index"]: r["n"] for r in
                  drawn.groupBy("source_index").agg(F.count("*").alias("n")).collect()}  # a row per source
    quotas = [per_source.get(p.index, 0) for p in plans]
    shards = max(1, -(-sum(quotas) // shard_blocks))
    cut = F.col("needs").isNotNull() & (F.col("copy") > F.col("passes"))
    dealt = written(deal(drawn, quotas, shards, seed).groupBy("source_index", "block").agg(
        F.collect_list(F.when(~cut, F.col("shard"))).alias("shards"),
        F.max(F.when(cut, F.col("shard"))).alias("last"), F.max(F.when(cut, F.col("needs"))).alias("needs")))
    discard(blocks)
    return sources, dealt, shards


def cut_rows(rows: DataFrame, *ties: Column | str) -> DataFrame:
    """Rows of cut blocks with ``part``, the words that the cut copy takes of each."""
    w = (Window.partitionBy("source_index", "block").orderBy("order", "doc_id", "size", *ties)
         .rowsBetween(Window.unboundedPreceding, -1))
    before = F.coalesce(F.sum("size").over(w), F.lit(0))
    return rows.withColumn("part", F.least(F.col("size"), F.greatest(F.col("needs") - before, F.lit(0))))


def sizes(docs: DataFrame) -> DataFrame:
    return written(docs.select("doc_id", "source", text_size(F.col("text")).alias("size")))


def taken_rows(docs: DataFrame, weights: Sequence[float] = WEIGHTS, repeats: int = MAX_REPEATS,
               block_words: int = BLOCK_WORDS, shard_blocks: int = SHARD_BLOCKS, seed: int = 11) -> DataFrame:
    """doc_id, size, source_size, target, taken of every row: the words of it that :func:`draw` deals to all shards."""
    sized = sizes(docs)
    sources, dealt, _ = deal_corpus(sized, weights, repeats, block_words, shard_blocks, seed)
    rows = (with_block(sized, sources, seed).join(dealt, ["source_index", "block"], "left")
            .withColumn("whole", F.col("size") * F.coalesce(F.size("shards"), F.lit(0))))
    parts = ["doc_id", "size", "source_size", "target"]
    whole = rows.where("last IS NULL").select(*parts, F.col("whole").cast("long").alias("taken"))
    cut = cut_rows(rows.where("last IS NOT NULL").withColumn("order", F.xxhash64(F.lit(seed), "doc_id")))
    return whole.unionByName(cut.select(*parts, (F.col("whole") + F.col("part")).cast("long").alias("taken")))


def first_words(text: Column, n: Column) -> Column:
    """A text up to the end of its n-th word."""
    ends = F.split(text, f"(?<={WORD_RE[:-1]})(?=[{SPACE_CLASS}])")
    return F.array_join(F.slice(ends, F.lit(1), n.cast("int")), "")


def draw(docs: DataFrame, weights: Sequence[float] = WEIGHTS, repeats: int = MAX_REPEATS,
         block_words: int = BLOCK_WORDS, shard_blocks: int = SHARD_BLOCKS, seed: int = 11) -> DataFrame:
    """The mixed corpus itself: every row as often as it is drawn, all columns kept, plus ``_shard``.

    The last document of a source's rest ends at the word that meets the
    source's target (its other columns stay as they are); all others are whole.
    """
    sources, dealt, shards = deal_corpus(sizes(docs), weights, repeats, block_words, shard_blocks, seed)
    d = docs.select(F.struct(*docs.columns).alias("_row"), "doc_id", "source")
    d = (with_block(d, sources.select("source_index", "_source", "n_blocks"), seed)
         .join(dealt, ["source_index", "block"]).withColumn("size", text_size(F.col("_row.text")))
         # a source's block with words may hold empty texts too: they are never taken
         .where("size > 0"))
    whole = d.select("_row", F.explode("shards").alias("_shard"))
    cut = (cut_rows(d.where("last IS NOT NULL").withColumn("order", F.xxhash64(F.lit(seed), "doc_id")),
                    F.xxhash64("_row.text")).where("part > 0"))
    text = F.when(F.col("part") < F.col("size"), first_words(F.col("_row.text"), F.col("part"))).otherwise(F.col("_row.text"))
    cut = cut.select(F.struct(*[text.alias(c) if c == "text" else F.col("_row")[c].alias(c) for c in docs.columns])
                     .alias("_row"), F.col("last").alias("_shard"))
    local = F.xxhash64(F.lit(seed), F.lit("local"), "_shard", "_row.doc_id")
    return (whole.unionByName(cut).repartition(shards, "_shard").sortWithinPartitions("_shard", local)
            .select("_row.*", "_shard"))


def query(docs: DataFrame) -> DataFrame:
    return taken_rows(docs.select("doc_id", "source", "text"))
