"""Exact top-k search by exhaustive term-at-a-time accumulation.

A vector is a sparse row: its non-zero components are terms with integer
weights.  Candidates are dealt into blocks and turned into posting lists (per
term the candidates that have it, and their weights); queries are dealt into
blocks as well, and every pair of blocks is one group.  In a group the query
rows go through their terms one after the other and scatter query weight times
posting weight into a dense array of scores, one row per candidate.  Selection
by partition then leaves the k best of the block for every query, and a merge
over the blocks the k best of all.

Blocks hold at most about ``CANDIDATES`` and ``QUERIES`` rows, whatever the ids
or the vectors, so a group's memory is bounded and no key is hot.  A query meets
every candidate once; nothing but k rows per query and block leaves a group.

Scores are exact: 64-bit integers where sums fit, Python integers beyond, cut to
the range of a long at the end.

Edge cases: rows whose vector is null or holds a null or non-finite component
take no part; empty and zero vectors score 0 with all; a component that one of
two vectors lacks counts as 0; components beyond the range of a long count as
its end; rows of one id are rows of their own, each leaves out only itself; rows
without an id are candidates, after all ids in ties, and never queries; an empty
table gives an empty result; extra columns are ignored and may have any names.
"""

from __future__ import annotations

from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gatemeter.llm.common import integer_vectors, written

SCALE = 64
TOP = 20
EVERY = 20
CANDIDATES = 8192
QUERIES = 4096
# queries that share one dense array of scores
STRIP = 64
# beyond so many pairs of blocks a task takes several, one after the other
MOST_TASKS = 20_000
LONG_MAX = (1 << 63) - 1

BEST = pa.schema([(name, pa.int64()) for name in ("row", "query_id", "vec_id", "score")])
Postings = dict[int, tuple[np.ndarray, np.ndarray]]


def sparse_rows(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, term, weight) of the non-zero components, by term, then row."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(column)), sizes)
    term = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    weight = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    row, term, weight = (x[weight != 0] for x in (row, term, weight))
    order = np.argsort(term, kind="stable")
    return row[order], term[order], weight[order]


def posting_lists(row: np.ndarray, term: np.ndarray, weight: np.ndarray) -> Postings:
    terms, first = np.unique(term, return_index=True)
    ends = np.append(first[1:], len(term))
    return {int(t): (row[a:b], weight[a:b]) for t, a, b in zip(terms, first, ends)}


def fits_long(candidates: Postings, queries: Postings) -> tuple[bool, int]:
    """Whether every partial score fits 62 bits, and a bound on scores."""
    top = [max((int(np.abs(w.astype(float)).max()) for _, w in p.values()), default=0) for p in (candidates, queries)]
    bound = top[0] * top[1] * len(candidates.keys() & queries.keys())
    return bound < 1 << 62, bound


def accumulate(candidates: Postings, queries: Postings, n: int, first: int, last: int, exact: bool) -> np.ndarray:
    """Scores of n candidates (rows) with queries first..last (columns), term after term."""
    scores = np.zeros((n, last - first), dtype=np.int64 if exact else object)
    for term, (who, weight) in queries.items():
        if term not in candidates:
            continue
        a, b = np.searchsorted(who, (first, last))
        if a == b:
            continue
        rows, posted = candidates[term]
        if not exact:
            posted, weight = posted.astype(object), weight.astype(object)
        columns = who[a:b] - first
        if 2 * (b - a) < last - first:
            scores[rows[:, None], columns] += posted[:, None] * weight[a:b]
        else:
            dense = np.zeros(last - first, dtype=scores.dtype)
            dense[columns] = weight[a:b]
            if len(rows) == n:
                scores += posted[:, None] * dense
            else:
                scores[rows] += posted[:, None] * dense
    return scores


def select(scores: np.ndarray, own: np.ndarray, k: int, bound: int) -> tuple[np.ndarray, np.ndarray]:
    """(column, row) of the k best rows of every column, ties to the earlier row; ``own`` is a column's row or -1."""
    n, m = scores.shape
    if scores.dtype == object:
        scores = np.clip(scores, -LONG_MAX, LONG_MAX).astype(np.int64)
    if bound < LONG_MAX // (2 * n + 2):
        # score and row in one number: all differ, so a partition settles ties
        key = (scores * n + (n - 1 - np.arange(n))[:, None]).T.copy()
        has = np.flatnonzero(own >= 0)
        key[has, own[has]] = -LONG_MAX
        k = min(k, n)
        best = np.argpartition(key, n - k, axis=1)[:, n - k:] if k < n else np.tile(np.arange(n), (m, 1))
        column, row = np.repeat(np.arange(m), best.shape[1]), best.ravel()
        keep = row != own[column]
        return column[keep], row[keep]
    ranked = [np.lexsort((np.arange(n), -scores[:, j])) for j in range(m)]
    ranked = [r[r != o][:k] for r, o in zip(ranked, own)]
    return np.repeat(np.arange(m), [len(r) for r in ranked]), np.concatenate(ranked)


def best_of_blocks(candidates: pa.Table, queries: pa.Table, k: int) -> pa.Table:
    """The k best candidates of one block for every query of another."""
    # the side without a row of this group comes without columns
    if not candidates.num_rows or not queries.num_rows:
        return BEST.empty_table()
    # ties go to the smaller id, so candidates stand in the order of their ids (null last)
    candidates = candidates.sort_by([("vec_id", "ascending"), ("row", "ascending")]).combine_chunks()
    queries = queries.combine_chunks()
    n, m = candidates.num_rows, queries.num_rows
    found = []
    rows, asked = candidates["row"].to_numpy(), queries["asker"].to_numpy()
    order = np.argsort(rows)
    at = np.minimum(np.searchsorted(rows, asked, sorter=order), n - 1)
    own = np.where(rows[order[at]] == asked, order[at], -1)
    posted = posting_lists(*sparse_rows(_one(candidates["v"])))
    wanted = posting_lists(*sparse_rows(_one(queries["wanted"])))
    exact, bound = fits_long(posted, wanted)
    for first in range(0, m, STRIP):
        last = min(m, first + STRIP)
        scores = accumulate(posted, wanted, n, first, last, exact)
        column, row = select(scores, own[first:last], k, bound)
        found.append((column + first, row, scores[row, column]))
    query, row, score = (np.concatenate(x) for x in zip(*found))
    score = np.clip(score, -LONG_MAX, LONG_MAX).astype(np.int64)
    return pa.table({"row": queries["asker"].take(pa.array(query)), "query_id": queries["query_id"].take(pa.array(query)),
                     "vec_id": candidates["vec_id"].take(pa.array(row)), "score": pa.array(score)}, schema=BEST)


def _one(column: pa.ChunkedArray) -> pa.ListArray:
    return column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)


def search(vectors: DataFrame, asks: Column, k: int = TOP, scale: int = SCALE) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for every row where ``asks`` its k best other rows.

    ``asks`` is a condition on ``vec_id``.
    """
    # row numbers must not change when a task is run again
    rows = written(integer_vectors(vectors.select("vec_id", "embedding"), scale)
                   .select(F.monotonically_increasing_id().alias("row"), "vec_id", F.coalesce(asks, F.lit(False)).alias("asks"), "v"))
    n, m = rows.agg(F.count("*"), F.count_if("asks")).first()
    wide, high = max(1, ceil(n / CANDIDATES)), max(1, ceil(m / QUERIES))
    tasks = min(MOST_TASKS, wide * high)

    def block(count: int, salt: int) -> Column:
        return F.pmod(F.xxhash64("row", F.lit(salt)), F.lit(count))

    def every(count: int) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(count - 1).cast("long")))

    posted = rows.select("row", "vec_id", "v", block(wide, 1).alias("c"), every(high).alias("q"))
    # new names: both sides come from one table, and a cogroup prunes columns that it takes for the other side's
    asked = rows.where("asks").select(F.col("row").alias("asker"), F.col("vec_id").alias("query_id"),
                                      F.col("v").alias("wanted"), every(wide).alias("c"), block(high, 2).alias("q"))
    best = (posted.repartition(tasks, "c", "q").groupBy("c", "q")
            .cogroup(asked.repartition(tasks, "c", "q").groupBy("c", "q"))
            .applyInArrow(lambda left, right: best_of_blocks(left, right, k),
                          "row long, query_id long, vec_id long, score long"))
    order = Window.partitionBy("row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return (best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def query(vectors: DataFrame) -> DataFrame:
    return search(vectors, F.col("vec_id") % EVERY == 0)


ORACLE_SQL = f"""
WITH kept AS (
  SELECT vec_id, row_number() OVER () AS r, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.r, q.vec_id AS query_id, c.vec_id,
         list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM kept q JOIN kept c ON q.r != c.r WHERE q.vec_id % {EVERY} = 0
)
SELECT query_id, rank, vec_id, score FROM (
  SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id NULLS LAST)::INTEGER AS rank
  FROM scored
) WHERE rank <= {TOP}
"""
