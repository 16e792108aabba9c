"""Vector codes by product quantisation; Lloyd's assignment runs over cover trees.

Vectors become integers (``floor(4096 x)``) and are cut into equal parts, each
with a codebook of its own.  Rows are taken in chunks where they lie, without a
shuffle, and every part of a chunk gets a cover tree, built once: level i is a
net of points more than r_i = r_0 / 2^i apart, every point of a finer net hangs
from one of the coarser net within r_{i-1}, and a point with its descendants is
one consecutive range of the tree's order.  Cumulative sums over that order give
the sum of any subtree as one difference.

A round walks the tree from its root.  By the triangle inequality an entry
farther from a node's centre than the nearest entry by more than twice the
node's radius can be nearest to no point below; a subtree with a single entry
left is assigned whole, only the others descend with the entries they still
have.  Points of a leaf that stays ambiguous are compared exactly in integers,
ties to the lower index.  Tasks return counts and sums per entry, so a round
moves parts x entries x components numbers per task, whatever the rows.

Arithmetic is exact: integers as long as squares fit, Python integers beyond.

Edge cases: rows whose vector is null, empty or holds a null or non-finite
component are dropped, and so are vectors of another length than that of the
smallest kept id; components beyond the range of a long count as its end; a
length that the parts don't divide is filled with zeros; rows of one id are
rows of their own (codebooks start with ties in the order of their vectors),
null ids are coded but start no entry; fewer rows than entries give fewer
entries; an empty table gives an empty result; an error beyond the range of a
long is null; extra columns are ignored and may have any names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gatemeter.llm.common import discard, integer_vectors, written

SCALE = 4096
PARTS = 8
ENTRIES = 16
ROUNDS = 6
CHUNK = 4096
LEAF = 64
LONG_MAX = (1 << 63) - 1

Codebooks = list[np.ndarray]  # per part: entries x components


def exact(values: np.ndarray) -> np.ndarray:
    """64-bit integers where their squares fit, Python integers where not."""
    top = max(int(values.max(initial=0)), -int(values.min(initial=0)))
    fits = 4 * top * top * values.shape[-1] <= LONG_MAX and top * CHUNK <= LONG_MAX
    return values.astype(np.int64 if fits else object)


def squares(difference: np.ndarray) -> np.ndarray:
    """Exact squared lengths along the last axis."""
    return (difference * difference).sum(axis=-1)


def lengths(difference: np.ndarray) -> np.ndarray:
    return np.sqrt(squares(difference).astype(float))


@dataclass
class CoverTree:
    """Nodes breadth first, children of a node side by side; points in tree order.

    ``order`` gives the row of every place, ``centre`` the place of a node's
    point, [``begin``, ``end``) its range, ``radius`` the greatest distance from
    the centre to a point of the range, ``child``/``children`` its first child
    and their number (0: leaf).
    """

    order: np.ndarray
    centre: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    radius: np.ndarray
    child: np.ndarray
    children: np.ndarray

    FIELDS = ("order", "centre", "begin", "end", "radius", "child", "children")


def grow_nets(points: np.ndarray, leaf: int = LEAF) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """Nested nets, coarse to fine: the centre of every point, and (level, new centre, its parent) in order.

    A centre with at most ``leaf`` points is a leaf from then on: it still takes points that it covers, and is refined
    no further.
    """
    n = len(points)
    owner = np.zeros(n, dtype=np.int64)
    distance = lengths(points - points[0])
    centres = [0]
    born: list[tuple[int, int, int]] = []
    reach = float(distance.max(initial=0.0))
    level = 0
    refined = np.ones(n, dtype=bool)
    while True:
        reach /= 2
        level += 1
        refined[centres] &= np.bincount(owner, minlength=n)[centres] > leaf
        far = np.flatnonzero((distance > 0) & refined[owner])
        if not len(far):
            return owner, born
        far = far[distance[far] > reach]
        # a point that another centre of this level covers moves there, so the net stays apart
        for at in range(0, len(far) if len(centres) > 1 else 0, 512):
            rows = far[at:at + 512]
            gap = _distances(points, rows, np.array(centres))
            near = gap.argmin(axis=1)
            gap = gap[np.arange(len(rows)), near]
            take = gap <= reach
            owner[rows[take]] = np.array(centres)[near[take]]
            distance[rows[take]] = gap[take]
        far = far[distance[far] > reach]
        while len(far):
            fresh = int(far[0])
            born.append((level, fresh, int(owner[fresh])))
            centres.append(fresh)
            gap = lengths(points[far] - points[fresh])
            take = gap <= reach
            owner[far[take]] = fresh
            distance[far[take]] = gap[take]
            far = far[~take]


def _distances(points: np.ndarray, rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    a, b = points[rows], points[centres]
    if points.dtype == object:
        return np.stack([lengths(a - c) for c in b], axis=1)
    # decides only which net a point joins; radii are measured afterwards
    a, b = a.astype(float), b.astype(float)
    return np.sqrt(np.maximum((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)[None, :], 0))


def build_tree(points: np.ndarray, leaf: int = LEAF) -> CoverTree:
    n = len(points)
    owner, born = grow_nets(points, leaf)
    by_owner = np.argsort(owner, kind="stable")
    own_end = np.cumsum(np.bincount(owner, minlength=n))
    # the children of a centre, one list per level in which it got some
    levels: dict[int, list[tuple[int, list[int]]]] = {}
    for level, fresh, parent in born:
        mine = levels.setdefault(parent, [])
        if not mine or mine[-1][0] != level:
            mine.append((level, []))
        mine[-1][1].append(fresh)
    # depth first: (centre, how many of its levels lie above, number of its node)
    order = np.empty(n, dtype=np.int64)
    filled = 0
    nodes: list[list[int]] = []      # centre, begin, end, parent node
    stack = [(0, 0, -1, False)]
    while stack:
        point, above, at, done = stack.pop()
        if done:
            nodes[at][2] = filled
            continue
        number = len(nodes)
        nodes.append([point, filled, 0, at])
        stack.append((point, above, number, True))
        mine = levels.get(point, [])
        if above == len(mine):
            own = by_owner[own_end[point - 1] if point else 0:own_end[point]]
            order[filled:filled + len(own)] = own
            filled += len(own)
            continue
        for child in reversed(mine[above][1]):
            stack.append((child, 0, number, False))
        stack.append((point, above + 1, number, False))
    table = np.array(nodes, dtype=np.int64)
    # breadth first, so that the children of a node stand side by side
    depth = np.zeros(len(table), dtype=np.int64)
    for i in range(1, len(table)):
        depth[i] = depth[table[i, 3]] + 1
    rank = np.empty(len(table), dtype=np.int64)
    parent_rank = np.full(len(table), -1)
    sorted_nodes, at = [], 0
    for d in range(int(depth.max(initial=0)) + 1):
        here = np.flatnonzero(depth == d)
        above = np.where(table[here, 3] >= 0, rank[table[here, 3]], -1)
        here = here[np.argsort(above, kind="stable")]
        rank[here] = np.arange(at, at + len(here))
        parent_rank[rank[here]] = np.where(table[here, 3] >= 0, rank[table[here, 3]], -1)
        sorted_nodes.append(here)
        at += len(here)
    table = table[np.concatenate(sorted_nodes)]
    children = np.bincount(parent_rank[1:], minlength=len(table))
    child = np.concatenate([[1], 1 + np.cumsum(children)[:-1]])
    place = np.empty(n, dtype=np.int64)
    place[order] = np.arange(n)
    tree = CoverTree(order, place[table[:, 0]], table[:, 1], table[:, 2], np.zeros(len(table)), child, children)
    placed = points[order]
    # every depth covers disjoint ranges: one pass over the points per depth
    at = 0
    for here in sorted_nodes:
        ids = np.arange(at, at + len(here))
        at += len(here)
        sizes = tree.end[ids] - tree.begin[ids]
        rows = np.repeat(tree.begin[ids] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        gap = lengths(placed[rows] - placed[np.repeat(tree.centre[ids], sizes)])
        tree.radius[ids] = np.maximum.reduceat(gap, np.cumsum(sizes) - sizes)
    return tree


def assign(tree: CoverTree, points: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges (begin, end, entry) that cover all places of the tree: whole subtrees, or points of ambiguous leaves."""
    # an entry equal to one before it never wins
    first = [j for j in range(len(book)) if not any((book[j] == book[i]).all() for i in range(j))]
    node = np.zeros(len(first), dtype=np.int64)
    entry = np.array(first, dtype=np.int64)
    begins, ends, entries = [], [], []
    while len(node):
        gap = lengths(points[tree.centre[node]] - book[entry])
        radius = tree.radius[node]
        head = np.flatnonzero(np.append(True, node[1:] != node[:-1]))
        sizes = np.diff(np.append(head, len(node)))
        nearest = np.repeat(np.minimum.reduceat(gap, head), sizes)
        # distances are rounded; the slack keeps every entry that might tie
        keep = gap - nearest <= 2 * radius + 1e-9 * (gap + nearest + radius) + 1e-9
        node, entry = node[keep], entry[keep]
        head = np.flatnonzero(np.append(True, node[1:] != node[:-1]))
        sizes = np.diff(np.append(head, len(node)))
        single = head[sizes == 1]
        begins.append(tree.begin[node[single]])
        ends.append(tree.end[node[single]])
        entries.append(entry[single])
        several = np.repeat(sizes > 1, sizes)
        node, entry = node[several], entry[several]
        leaf = tree.children[node] == 0
        if leaf.any():
            place, choice = _spread(node[leaf], entry[leaf], tree.begin, tree.end - tree.begin)
            error = squares(points[place] - book[choice])
            head = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
            sizes = np.diff(np.append(head, len(place)))
            best = np.flatnonzero(error == np.repeat(np.minimum.reduceat(error, head), sizes))
            _, at = np.unique(place[best], return_index=True)
            begins.append(place[best[at]])
            ends.append(place[best[at]] + 1)
            entries.append(choice[best[at]])
        node, entry = _spread(node[~leaf], entry[~leaf], tree.child, tree.children)
    return tuple(np.concatenate(x) for x in (begins, ends, entries))


def _spread(node: np.ndarray, entry: np.ndarray, first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every (node, entry) for each of ``count`` followers from ``first``, ordered by follower, then entry."""
    if not len(node):
        return node, entry
    head = np.flatnonzero(np.append(True, node[1:] != node[:-1]))
    options = np.diff(np.append(head, len(node)))
    one = node[head]
    followers = count[one]
    # follower t of a node takes all of the node's entries in turn
    total = np.repeat(options, followers)
    start = np.repeat(head, followers)
    who = np.repeat(first[one] - (np.cumsum(followers) - followers), followers) + np.arange(followers.sum())
    inner = np.arange(total.sum()) - np.repeat(np.cumsum(total) - total, total)
    return np.repeat(who, total), entry[np.repeat(start, total) + inner]


# --- tables: one row per chunk -------------------------------------------------------------------------------------

_TREE_TYPES = dict.fromkeys(CoverTree.FIELDS, np.int32) | {"radius": np.float64}
TREES = T.StructType([
    T.StructField("ids", T.ArrayType(T.LongType())), T.StructField("rows", T.ArrayType(T.LongType())),
    T.StructField("points", T.ArrayType(T.BinaryType())), T.StructField("kind", T.StringType()),
    *[T.StructField(f, T.ArrayType(T.BinaryType())) for f in CoverTree.FIELDS]])


def _smallest_type(values: np.ndarray) -> type:
    top = max(int(values.max(initial=0)), -int(values.min(initial=0)) - 1)
    return np.int16 if top < 1 << 15 else np.int32 if top < 1 << 31 else np.int64


def _matrix(column: pa.Array, parts: int) -> np.ndarray:
    """Rows of equal length as a matrix, filled with zeros to a multiple of ``parts``."""
    values = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)
    return np.pad(values, ((0, 0), (0, -values.shape[1] % parts)))


def _tree_rows(ids: np.ndarray, rows: np.ndarray, values: np.ndarray, parts: int) -> pa.RecordBatch:
    kind = _smallest_type(values)
    points, trees = [], []
    for part in np.split(values, parts, axis=1):
        tree = build_tree(exact(part))
        points.append(part[tree.order].astype(kind).tobytes())
        trees.append(tree)
    fields = {f: [getattr(t, f).astype(_TREE_TYPES[f]).tobytes() for t in trees] for f in CoverTree.FIELDS}
    blobs = pa.list_(pa.binary())
    return pa.RecordBatch.from_arrays(
        [pa.array([ids], pa.list_(pa.int64())), pa.array([rows], pa.list_(pa.int64())), pa.array([points], blobs),
         pa.array([np.dtype(kind).name]), *[pa.array([fields[f]], blobs) for f in CoverTree.FIELDS]],
        names=TREES.fieldNames())


def plant_trees(vectors: DataFrame, parts: int = PARTS) -> DataFrame:
    """Cover trees of every chunk of ``vectors`` (row, vec_id, v: integers of one length)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        count = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for batch in pa.Table.from_batches(held).combine_chunks().to_batches():
                yield _tree_rows(batch.column("vec_id").to_pylist(), batch.column("row").to_numpy(),
                                 _matrix(batch.column("v"), parts), parts)

        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                piece = batch.slice(at, CHUNK)
                if count and count + piece.num_rows > CHUNK:
                    yield from flush()
                    held, count = [], 0
                held.append(piece)
                count += piece.num_rows
        if count:
            yield from flush()

    return vectors.select("row", "vec_id", "v").mapInArrow(run, TREES)


def _read_trees(batch: pa.RecordBatch) -> Iterator[tuple[list, np.ndarray, list[tuple[CoverTree, np.ndarray]]]]:
    """(ids, rows, [(tree, points in tree order) per part]) of every chunk of a batch."""
    for i in range(batch.num_rows):
        get = lambda name: batch.column(name)[i].as_py()  # noqa: E731, B023
        rows = np.array(get("rows"), dtype=np.int64)
        blobs = {f: get(f) for f in CoverTree.FIELDS}
        parts = []
        for p, raw in enumerate(get("points")):
            fields = {f: np.frombuffer(blobs[f][p], dtype=_TREE_TYPES[f]) for f in CoverTree.FIELDS}
            tree = CoverTree(**{f: v if f == "radius" else v.astype(np.int64) for f, v in fields.items()})
            points = np.frombuffer(raw, dtype=get("kind")).reshape(len(rows), -1)
            parts.append((tree, exact(points)))
        yield get("ids"), rows, parts


def _matching(points: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    book = exact(book)
    return (points.astype(object), book.astype(object)) if object in (points.dtype, book.dtype) else (points, book)


def entry_sums(trees: DataFrame, books: Codebooks) -> DataFrame:
    """One assignment round: part, entry, component, size, total (summed over all rows)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = [np.zeros(len(b), dtype=object) for b in books]
        totals = [np.zeros(b.shape, dtype=object) for b in books]
        for batch in batches:
            for _, _, parts in _read_trees(batch):
                for p, (tree, points) in enumerate(parts):
                    begin, end, entry = assign(tree, *_matching(points, books[p]))
                    running = np.vstack([np.zeros_like(points[:1]), np.cumsum(points, axis=0)])
                    sums = running[end] - running[begin]
                    for e in np.unique(entry):
                        mine = entry == e
                        sizes[p][e] += int((end - begin)[mine].sum())
                        totals[p][e] += sums[mine].sum(axis=0)
        found = [(p, e, c, int(sizes[p][e]), str(int(totals[p][e][c]))) for p, b in enumerate(books)
                 for e in range(len(b)) if sizes[p][e] for c in range(b.shape[1])]
        if found:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(x)) for x in zip(*found)], names=["part", "entry", "component", "size", "total"])

    part_sums = trees.mapInArrow(run, "part long, entry long, component long, size long, total string")
    return part_sums.groupBy("part", "entry", "component").agg(
        F.sum("size").alias("size"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))


def train(trees: DataFrame, books: Codebooks, rounds: int = ROUNDS) -> Codebooks:
    """Lloyd rounds: entries move to the floor of their parts' mean, unused ones stay."""
    for _ in range(rounds):
        books = [b.copy() for b in books]
        # parts x entries x components rows
        for r in entry_sums(trees, books).collect():
            books[r.part][r.entry, r.component] = int(r.total) // r.size
    return books


def encode(trees: DataFrame, books: Codebooks) -> DataFrame:
    """row, vec_id, codes (entry per part) and error (null beyond a long) of every vector."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, rows, parts in _read_trees(batch):
                codes = np.zeros((len(rows), len(parts)), dtype=np.int32)
                error = np.zeros(len(rows), dtype=object)
                for p, (tree, points) in enumerate(parts):
                    points, book = _matching(points, books[p])
                    begin, end, entry = assign(tree, points, book)
                    sizes = end - begin
                    place = np.repeat(begin - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
                    chosen = np.repeat(entry, sizes)
                    codes[tree.order[place], p] = chosen
                    error[tree.order[place]] += squares(points[place] - book[chosen]).astype(object)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rows), pa.array(ids, pa.int64()),
                     pa.ListArray.from_arrays(np.arange(len(rows) + 1, dtype=np.int32) * len(parts), codes.ravel()),
                     pa.array([int(e) if e <= LONG_MAX else None for e in error], pa.int64())],
                    names=["row", "vec_id", "codes", "error"])

    return trees.mapInArrow(run, "row long, vec_id long, codes array<int>, error long")


def first_codebooks(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES) -> Codebooks:
    """The parts of the ``entries`` smallest ids."""
    rows = vectors.where("vec_id is not null").orderBy("vec_id", "v").limit(entries).select("v").collect()
    if not rows:
        return []
    width = len(rows[0].v)
    start = np.array([r.v for r in rows if len(r.v) == width], dtype=np.int64).astype(object)
    start = np.pad(start, ((0, 0), (0, -width % parts)))
    return np.split(start, parts, axis=1)


def digest(books: Codebooks) -> str:
    return hashlib.sha256(",".join(str(int(x)) for b in books for x in b.ravel()).encode()).hexdigest()


@dataclass
class Compressed:
    """``codes`` (row, vec_id, codes, error), the final codebooks, and the rows with their ``row`` number."""

    codes: DataFrame
    books: Codebooks
    rows: DataFrame


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS,
             scale: int = SCALE, keep: tuple[str, ...] = ()) -> Compressed:
    """Train codebooks over all rows and code every row."""
    valid = integer_vectors(vectors.select("vec_id", "embedding", *keep).where(F.size("embedding") > 0), scale)
    books = first_codebooks(valid, parts, entries)
    width = sum(b.shape[1] for b in books)
    # row numbers must not change when a task is run again
    rows = written(valid.where(F.size("v").between(width - parts + 1, width) if books else F.lit(False))
                   .select(F.monotonically_increasing_id().alias("row"), "vec_id", *keep, "v"))
    trees = written(plant_trees(rows, parts))
    books = train(trees, books, rounds)
    return Compressed(encode(trees, books), books, rows)


def query(vectors: DataFrame) -> DataFrame:
    done = compress(vectors, keep=("label",))
    coded = written(done.codes.join(done.rows.select("row", "label"), "row"))
    discard(done.rows)
    of_label = coded.groupBy("label").agg(F.try_sum("error").alias("label_error")).withColumnRenamed("label", "of")
    code = F.concat_ws("", F.transform("codes", lambda c: F.lpad(F.lower(F.hex(c)), 2, "0")))
    return (coded.join(of_label, F.col("label").eqNullSafe(F.col("of")), "left")
            .select("vec_id", code.alias("code"), "error", "label_error",
                    F.lit(digest(done.books)).alias("codebooks_sha256")))


def _oracle() -> str:
    """The contract's codes in SQL, one block of CTEs per round."""
    sql = f"""
WITH kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), parts AS (
  SELECT vec_id, label, p, v[p * len(v) // {PARTS} + 1 : (p + 1) * len(v) // {PARTS}] AS x
  FROM kept, (SELECT unnest(range({PARTS})) AS p)
), b0 AS (
  SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, x AS c FROM parts
  WHERE vec_id IN (SELECT vec_id FROM kept ORDER BY vec_id LIMIT {ENTRIES})
)"""
    for i in range(ROUNDS + 1):
        sql += f""", d{i} AS (
  SELECT vec_id, label, p, x, min({{'d': list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT,
         'e': e}}) AS best
  FROM parts JOIN b{i} USING (p) GROUP BY vec_id, label, p, x
)"""
        if i < ROUNDS:
            sql += f""", s{i} AS (
  SELECT p, e, i, sum(y) AS s, count(*) AS n
  FROM (SELECT p, best.e AS e, unnest(x) AS y, unnest(range(len(x))) AS i FROM d{i}) GROUP BY p, e, i
), m{i} AS (
  SELECT p, e, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS c FROM s{i} GROUP BY p, e
), b{i + 1} AS (
  SELECT p, e, coalesce(m{i}.c, b{i}.c) AS c FROM b{i} LEFT JOIN m{i} USING (p, e)
)"""
    return sql + f""", coded AS (
  SELECT vec_id, label, string_agg(lpad(lower(to_hex(best.e)), 2, '0'), '' ORDER BY p) AS code,
         sum(best.d)::BIGINT AS error
  FROM d{ROUNDS} GROUP BY vec_id, label
)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
  (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) FROM b{ROUNDS}) AS codebooks_sha256
FROM coded"""


ORACLE_SQL = _oracle()
