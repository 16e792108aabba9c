"""Embedding near-duplicates by spherical-cap filters from structured random product codes.

A filter is a direction; a vector belongs to every filter whose direction it
exceeds by the threshold (its spherical caps).  Directions are the products of
a random code: after a fixed random rotation the coordinates are split into
parts, every part has its own few code words, and a direction is one word per
part.  The words are scored once per part, and a branch-and-bound sum lists all
directions above the threshold without visiting the others.

Vectors meet where they share a filter, and every met pair is verified by its
cosine in double precision.  The threshold rises with the number of vectors so
that a filter holds about ``FILTER_ROWS`` unrelated ones, and the number of
directions is set so that two vectors at the wanted cosine share ``SHARED`` on
average; both use the exact caps of the sphere in the vectors' dimension, whose
tails are thinner than a normal distribution's.

A filter with many vectors (a large group of near copies) is dealt into blocks;
each pair of blocks is one group, multiplied as matrices.  A linked pair is
counted only in the smallest filter it shares, so groups return one count per
vector and a spanning set of links, never the pairs themselves.

Edge cases: null, empty and zero vectors, and those with a null or non-finite
component, link with nothing; vectors of different lengths never link; equal
vectors are one class and all linked; rows of one vec_id are vectors of their
own; an empty table gives an empty result; extra columns (labels too) are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import sqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatemeter.llm.common import components, written

COSINE = 0.9
FILTER_ROWS = 64
SHARED = 16.0
LEAST_FILTERS = 24
COPIES = 8
LARGEST_CAP = 0.006
LEAST_DIM = 8
BLOCK = 256
SEED = 20


POINTS = 4001


def _integral(y: np.ndarray, x: np.ndarray) -> float:
    return float(((y[1:] + y[:-1]) / 2 * np.diff(x)).sum())


def _angles(bar: float) -> np.ndarray:
    return np.linspace(0.0, np.arccos(np.clip(bar, -1.0, 1.0)), POINTS)


def cap(bar: float, dim: int) -> float:
    """Share of the unit sphere in ``dim`` dimensions that lies in a cap: P(<x, w> >= bar) for a random direction w."""
    whole = np.linspace(0.0, np.pi, POINTS)
    angles = _angles(bar)
    return _integral(np.sin(angles) ** (dim - 2), angles) / _integral(np.sin(whole) ** (dim - 2), whole)


def both_caps(bar: float, cosine: float, dim: int) -> float:
    """P(<x, w> >= bar and <y, w> >= bar) for unit vectors x and y at this cosine."""
    whole = np.linspace(0.0, np.pi, POINTS)
    angles = _angles(bar)
    # given <x, w>, the rest of w is a random direction in one dimension less
    needed = (bar - cosine * np.cos(angles)) / (sqrt(1 - cosine * cosine) * np.maximum(np.sin(angles), 1e-12))
    bars = np.linspace(-1.0, 1.0, 801)
    caps = np.array([cap(b, dim - 1) for b in bars])
    other = np.interp(needed, bars, caps)
    return _integral(np.sin(angles) ** (dim - 2) * other, angles) / _integral(np.sin(whole) ** (dim - 2), whole)


@dataclass(frozen=True)
class Code:
    """Parts, words per part and threshold (in standard deviations of a random direction) of ``copies`` codes.

    The directions of one product code depend on each other: a pair whose
    difference lies in few parts shares many or none.  Codes over independent
    rotations don't.
    """

    parts: int
    words: int
    threshold: float
    copies: int = 1
    seed: int = SEED

    @classmethod
    def for_rows(cls, n: int, dim: int, cosine: float = COSINE, shared: float = SHARED) -> "Code":
        """For n vectors of ``dim`` components (few components: as for ``LEAST_DIM``)."""
        dim = max(dim, LEAST_DIM)
        share = min(FILTER_ROWS / max(n, 1), LARGEST_CAP)
        lo, hi = 0.0, 1.0
        while hi - lo > 1e-9:
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if cap(mid, dim) > share else (lo, mid)
        wanted = shared / COPIES / both_caps(hi, cosine, dim)
        parts = 2
        while wanted ** (1 / parts) > 400:
            parts += 1
        return cls(parts, int(wanted ** (1 / parts)) + 1, hi * sqrt(dim), COPIES)

    def tables(self, dim: int) -> list[list[tuple[np.ndarray, np.ndarray]]]:
        """Per code and part: the rotated coordinates' rows, and the code words, of one vector length."""
        return [self._table(dim, copy) for copy in range(self.copies)]

    def _table(self, dim: int, copy: int) -> list[tuple[np.ndarray, np.ndarray]]:
        rng = np.random.default_rng([self.seed, dim, copy])
        rotation = np.linalg.qr(rng.normal(size=(dim, dim)))[0]
        parts = min(self.parts, dim)
        words = int(round(self.words ** (self.parts / parts)))
        out = []
        for rows in np.array_split(np.arange(dim), parts):
            w = rng.normal(size=(words, len(rows)))
            w /= np.linalg.norm(w, axis=1, keepdims=True)
            # together the words of all parts make a unit direction
            out.append((rotation[rows], w * sqrt(len(rows) / dim)))
        return out

    def decode(self, unit: np.ndarray, tables: list[list[tuple[np.ndarray, np.ndarray]]]) -> list[np.ndarray]:
        """For each unit vector all filter numbers above the threshold, ascending.

        A vector with fewer than its share of ``LEAST_FILTERS`` in a code lowers its own threshold there.
        """
        found, first = [], 0
        for table in tables:
            found.append([first + f for f in self._decode(unit, table)])
            first += table[0][1].shape[0] ** len(table)
        return [np.concatenate(f) for f in zip(*found)]

    def _decode(self, unit: np.ndarray, tables: list[tuple[np.ndarray, np.ndarray]]) -> list[np.ndarray]:
        dim = unit.shape[1]
        scores = [unit @ r.T @ w.T for r, w in tables]
        words = scores[0].shape[1]
        most = words ** len(tables)
        best = [s.max(1) for s in scores]
        out = []
        for i in range(len(unit)):
            bar = self.threshold / sqrt(dim)
            while True:
                total, number = np.zeros(1), np.zeros(1, dtype=np.int64)
                rest = sum(b[i] for b in best)
                for s, b in zip(scores, best):
                    rest -= b[i]
                    one = np.flatnonzero(s[i] + total.max() + rest >= bar)
                    total = (total[:, None] + s[i][one][None, :]).ravel()
                    number = (number[:, None] * words + one[None, :]).ravel()
                    keep = total + rest >= bar
                    total, number = total[keep], number[keep]
                    if not len(number):
                        break
                if len(number) >= min(-(-LEAST_FILTERS // self.copies), most):
                    break
                bar -= 0.25 / sqrt(dim)
            out.append(np.sort(number))
        return out


def usable(v: Column) -> Column:
    """Non-empty, no null, all finite, not all zero."""
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.isNotNull() & (F.size(v) > 0) & ~bad & F.exists(v, lambda x: x != 0)


def filter_rows(classes: DataFrame, code: Code) -> DataFrame:
    """(node, weight, vector) -> one row per vector and filter, with all filters of the vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, list] = {}
        for whole in batches:
            for start in range(0, whole.num_rows, 512):
                batch = whole.slice(start, 512)
                vectors = [np.asarray(v, dtype=np.float64) for v in batch.column("vector").to_numpy(zero_copy_only=False)]
                filters: list[np.ndarray] = [np.zeros(0, np.int64)] * len(vectors)
                for dim in {len(v) for v in vectors}:
                    at = [i for i, v in enumerate(vectors) if len(v) == dim]
                    if dim not in known:
                        known[dim] = code.tables(dim)
                    x = np.stack([vectors[i] for i in at])
                    x = x / np.abs(x).max(1, keepdims=True)
                    x /= np.linalg.norm(x, axis=1, keepdims=True)
                    for i, f in zip(at, code.decode(x, known[dim])):
                        filters[i] = f
                yield pa.RecordBatch.from_arrays(
                    [batch.column("node"), batch.column("weight"), batch.column("vector"),
                     pa.array(filters, pa.list_(pa.int64()))], names=["node", "weight", "vector", "filters"])

    kind = classes.schema["vector"].dataType.simpleString()
    return classes.select("node", "weight", "vector").mapInArrow(
        run, f"node long, weight long, vector {kind}, filters array<bigint>")


def linked(dealt: DataFrame, cosine: float) -> DataFrame:
    """(node, links, root) from groups (dim, filter, i, j) of at most two blocks."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        _, filter_, i, j = (k.as_py() for k in key)
        table = table.sort_by("node")
        node, weight = table.column("node").to_numpy(), table.column("weight").to_numpy()
        block = table.column("block").to_numpy()
        x = np.stack([np.asarray(v, dtype=np.float64) for v in table.column("vector").to_numpy()])
        x = x / np.abs(x).max(1, keepdims=True)
        x /= np.sqrt((x * x).sum(1))[:, None]
        near = x @ x.T >= cosine
        np.fill_diagonal(near, False)
        if i != j:
            near &= block[:, None] != block[None, :]
        rows = np.flatnonzero(near.any(1))
        empty = pa.table({"node": pa.array([], pa.int64()), "links": pa.array([], pa.int64()),
                          "root": pa.array([], pa.int64())})
        if not len(rows):
            return empty
        near, node, weight = near[np.ix_(rows, rows)], node[rows], weight[rows]
        lists = table.column("filters").take(pa.array(rows)).to_pylist()
        smaller = sorted({f for fs in lists for f in fs if f < filter_})
        count = near
        if smaller:
            place = {f: k for k, f in enumerate(smaller)}
            member = np.zeros((len(rows), len(smaller)), np.float32)
            for r, fs in enumerate(lists):
                member[r, [place[f] for f in fs if f < filter_]] = 1
            count = near & (member @ member.T == 0)
        root = np.arange(len(rows))
        while True:
            nxt = np.minimum(root, np.where(near, root[None, :], len(rows)).min(1))
            nxt = nxt[nxt]
            if (nxt == root).all():
                break
            root = nxt
        return pa.table({"node": pa.array(node, pa.int64()), "links": pa.array(count @ weight, pa.int64()),
                         "root": pa.array(node[root], pa.int64())})

    return dealt.groupBy("dim", "filter", "i", "j").applyInArrow(run, "node long, links long, root long")


def groups(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding",
           cosine: float = COSINE) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row."""
    v = vectors.select(F.col(vec_id).alias("vec_id"), F.col(embedding).alias("vector"))
    v = v.withColumn("ok", F.coalesce(usable(F.col("vector")), F.lit(False)))
    classes = written(v.where("ok").groupBy("vector").agg(F.count("*").alias("weight"), F.min("vec_id").alias("rep"))
                      .withColumn("node", F.monotonically_increasing_id()))
    n, dim = classes.agg(F.count("*"), F.mode(F.size("vector"))).first()
    code = Code.for_rows(n, dim or 1, cosine)
    found = written(filter_rows(classes, code))
    hot = (found.select(F.size("vector").alias("dim"), F.explode("filters").alias("filter"))
           .groupBy("dim", "filter").agg(F.count("*").alias("m")).where(F.col("m") > BLOCK)
           .select("dim", "filter", F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks")))
    rows = (found.select(F.size("vector").alias("dim"), "node", "weight", "vector", "filters",
                         F.explode("filters").alias("filter"))
            .join(hot, ["dim", "filter"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
            .withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")))
    dealt = rows.select("dim", "filter", "node", "weight", "vector", "filters", "block", F.inline(F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1),
        lambda j: F.struct(F.least(j, F.col("block")).alias("i"), F.greatest(j, F.col("block")).alias("j")))))
    met = written(linked(dealt, cosine))
    counts = met.groupBy("node").agg(F.sum("links").alias("links"))
    comp = components(met, "node", "root")
    named = (classes.select("node", "vector", "weight", "rep").join(counts, "node", "left")
             .join(comp, "node", "left").withColumn("component", F.coalesce("component", "node")))
    lowest = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    by_vector = named.join(lowest, "component").select(
        F.col("vector").alias("_vector"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("links"),
        "component_id")
    out = v.join(by_vector, F.col("ok") & (F.col("vector") == F.col("_vector")), "left")
    cid = F.when(F.col("ok"), F.col("component_id")).otherwise(F.col("vec_id"))
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), cid.alias("component_id"),
                      F.coalesce(F.col("vec_id") == cid, cid.isNull()).alias("kept"))


def query(vectors: DataFrame) -> DataFrame:
    return groups(vectors)
