"""Periodic runs of words by internal pattern matching.

A run is a maximal stretch of words with smallest period q and at least
``max(6, 4 q)`` words.  Such a stretch holds, for the power 2^k with
q <= 2^k < 2 q, a whole aligned (dyadic) block of 2^k words, and the nearest
other occurrence of that block within 2^k words lies exactly q away.  So every
aligned block asks for its next and its last occurrence in the neighbouring
windows; occurrences there form a progression whose difference is the candidate
period.

The occurrences come from the suffix array: prefix doubling sorts the suffixes
by their first 2^k words, so the suffixes that start with a block are one
interval of the array.  A wavelet matrix over the array's positions answers
range successor and predecessor inside that interval.  Candidates of one period
that overlap by a period are merged, stretched word by word to both sides, and
kept when they are long enough.

Texts are handled in chunks of ``CHUNK_BYTES``; a longer text is a chunk of its
own, worked on whole.  A chunk of n words needs O(n) memory: the wavelet matrix
keeps packed bits.

Edge cases: null, empty and blank texts have no words, no run and an empty
collapsed text; repeated rows (and rows of one id) are judged one by one; null
ids stay; very long texts are read whole; an empty table gives an empty result;
other columns than the key and the text are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHUNK_BYTES = 1 << 20
LEAST_LENGTH = 6
LEAST_EXPONENT = 4

# (key, number of words) -> the word that stands at every place, or None for the text as it is
Rewrite = Callable[[int | None, int], np.ndarray | None]


class WaveletMatrix:
    """Rank and selection by value over intervals of an array of integers from 0 to 2^bits - 1."""

    def __init__(self, values: np.ndarray, bits: int) -> None:
        self.bits = list(range(bits - 1, -1, -1))
        self.words, self.before, self.zeros = [], [], []
        n = len(values)
        for bit in self.bits:
            one = (values >> bit & 1).astype(bool)
            packed = np.zeros(n // 64 + 1, dtype=np.uint64)
            raw = np.packbits(one, bitorder="little")
            packed.view(np.uint8)[:len(raw)] = raw
            before = np.zeros(len(packed), dtype=np.int64)
            np.cumsum(np.bitwise_count(packed[:-1]), out=before[1:])
            self.words.append(packed)
            self.before.append(before)
            self.zeros.append(n - int(one.sum()))
            values = np.concatenate([values[~one], values[one]])

    def _ones(self, level: int, i: np.ndarray) -> np.ndarray:
        """Set bits before place i."""
        at = i >> 6
        low = self.words[level][at] & ((np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1))
        return self.before[level][at] + np.bitwise_count(low)

    def below(self, left: np.ndarray, right: np.ndarray, value: np.ndarray) -> np.ndarray:
        """How many entries of [left, right) are smaller than value."""
        found = np.zeros(len(left), dtype=np.int64)
        for level, bit in enumerate(self.bits):
            l1, r1 = self._ones(level, left), self._ones(level, right)
            one = (value >> bit & 1).astype(bool)
            found += np.where(one, (right - r1) - (left - l1), 0)
            left = np.where(one, self.zeros[level] + l1, left - l1)
            right = np.where(one, self.zeros[level] + r1, right - r1)
        return found

    def smallest(self, left: np.ndarray, right: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The k-th smallest entry (from 0) of [left, right)."""
        out = np.zeros(len(left), dtype=np.int64)
        for level, bit in enumerate(self.bits):
            l1, r1 = self._ones(level, left), self._ones(level, right)
            zeros = (right - r1) - (left - l1)
            one = k >= zeros
            out |= one.astype(np.int64) << bit
            k = np.where(one, k - zeros, k)
            left = np.where(one, self.zeros[level] + l1, left - l1)
            right = np.where(one, self.zeros[level] + r1, right - r1)
        return out


def block_intervals(codes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, list[tuple]]:
    """Suffix array (text after text) and the aligned blocks that occur more than once.

    ``codes`` are the words of all texts one after the other, ``starts`` their
    first places with the end of all as last entry.  Every block is (level,
    places, first slot, slots).  Suffixes are sorted by as many words as a block
    that matters can have: below half of their text.
    """
    n = len(codes)
    sizes = np.diff(starts)
    text = np.repeat(np.arange(len(sizes)), sizes)
    local = np.arange(n) - starts[text]
    room = sizes[text] - local
    key = text * (int(codes.max(initial=0)) + 1) + codes
    order = np.argsort(key)
    array = order
    open_slots = np.arange(n)
    rank = np.zeros(n, dtype=np.int64)
    blocks = []
    level = 0
    sorted_key = key[order]
    while len(open_slots):
        head = np.ones(len(open_slots), dtype=bool)
        head[1:] = sorted_key[1:] != sorted_key[:-1]
        first = np.flatnonzero(head)
        members = np.diff(np.append(first, len(open_slots)))
        slot = np.repeat(open_slots[first], members)
        many = np.repeat(members, members)
        place = array[open_slots]
        rank[place] = slot
        width = 1 << level
        # a run of this level is longer than two blocks
        long_enough = sizes[text[place]] > 2 * width
        pick = (many > 1) & long_enough
        wanted = pick & (local[place] % width == 0) & (room[place] >= width)
        if wanted.any():
            blocks.append((level, place[wanted], slot[wanted], many[wanted]))
        open_slots, place = open_slots[pick], place[pick]
        follow = np.where(room[place] > width, rank[np.minimum(place + width, n - 1)] + 1, 0)
        key = rank[place] * (n + 1) + follow
        order = np.argsort(key)
        array[open_slots] = place[order]
        sorted_key = key[order]
        level += 1
    return array, blocks


def candidates(codes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stretches (first place, end, period) between neighbouring occurrences of aligned blocks."""
    array, blocks = block_intervals(codes, starts)
    found = []
    if blocks:
        sizes = np.diff(starts)
        first_place = np.repeat(starts[:-1], sizes)
        matrix = WaveletMatrix(array - first_place[array], max(1, int(sizes.max() - 1).bit_length()))
        width = np.concatenate([np.full(len(p), 1 << level) for level, p, _, _ in blocks])
        place, left, many = (np.concatenate([b[i] for b in blocks]) for i in (1, 2, 3))
        base = first_place[place]
        at = matrix.below(left, left + many, place - base)
        for step in (1, -1):
            has = np.flatnonzero((at + step >= 0) & (at + step < many))
            other = base[has] + matrix.smallest(left[has], left[has] + many[has], at[has] + step)
            period = np.abs(other - place[has])
            near = period <= width[has]
            low = np.minimum(other, place[has])[near]
            found.append((low, low + (period + width[has])[near], period[near]))
    if not found:
        return (np.zeros(0, dtype=np.int64),) * 3
    return tuple(np.concatenate(x) for x in zip(*found))


def merged(low: np.ndarray, end: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stretches of one period that share a whole period become one."""
    order = np.lexsort((low, period))
    low, end, period = low[order], end[order], period[order]
    fresh = np.ones(len(low), dtype=bool)
    fresh[1:] = period[1:] != period[:-1]
    group = np.cumsum(fresh)
    offset = group * (int(end.max(initial=0)) + 1)
    reach = np.maximum.accumulate(end + offset) - offset
    fresh[1:] |= low[1:] + period[1:] > reach[:-1]
    first = np.flatnonzero(fresh)
    return low[first], (np.maximum.reduceat(end, first) if len(first) else end), period[first]


def stretch(codes: np.ndarray, x: np.ndarray, y: np.ndarray, room: np.ndarray, step: int) -> np.ndarray:
    """For how many i from 0, below room, codes[x + step i] equals codes[y + step i]."""
    out = np.zeros(len(x), dtype=np.int64)
    live = np.flatnonzero(room > 0)
    width = 4
    while len(live):
        i = out[live, None] + np.arange(width)
        inside = i < room[live, None]
        i = np.where(inside, i, 0) * step
        same = inside & (codes[x[live, None] + i] == codes[y[live, None] + i])
        whole = same.all(axis=1)
        out[live] += np.where(whole, width, same.argmin(axis=1))
        live = live[whole]
        width = max(4, min(4 * width, (1 << 20) // max(1, len(live))))
    return out


def find_runs(codes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, start in the text, length, period) of all runs, ordered by text, start and period."""
    codes, starts = np.asarray(codes, dtype=np.int64), np.asarray(starts, dtype=np.int64)
    low, end, period = merged(*candidates(codes, starts))
    text = np.searchsorted(starts, low, side="right") - 1
    low = low - stretch(codes, low - 1, low - 1 + period, low - starts[text], -1)
    end = end + stretch(codes, end, end - period, starts[text + 1] - end, 1)
    keep = end - low >= np.maximum(LEAST_LENGTH, LEAST_EXPONENT * period)
    rows = np.unique(np.column_stack([low, period, end, text])[keep], axis=0)
    low, period, end, text = rows.T
    return text, low - starts[text], end - low, period


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The text without the words that repeat a run's first period, joined by one blank."""
    if not runs:
        return b" ".join(words)
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    return b" ".join([words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0)])


def _chunks(sizes: np.ndarray) -> Iterator[np.ndarray]:
    """Rows of similar size, together at most ``CHUNK_BYTES`` or one row."""
    order = np.argsort(sizes, kind="stable")
    begin, total = 0, 0
    for i, row in enumerate(order):
        if i > begin and total + sizes[row] > CHUNK_BYTES:
            yield order[begin:i]
            begin, total = i, 0
        total += sizes[row]
    if begin < len(order):
        yield order[begin:]


def analyse(keys: list, texts: list[bytes | None], rewrite: Rewrite | None = None) -> tuple[list, list[bytes]]:
    """Runs (start, length, period) and collapsed text of every text of one chunk."""
    # bytes.split cuts at the six ASCII white-space characters and nothing else
    words = [(t or b"").split() for t in texts]
    sizes = np.array([len(w) for w in words], dtype=np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    flat = pa.array([w for ws in words for w in ws], type=pa.binary())
    codes = flat.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    for i, key in enumerate(keys):
        places = rewrite(key, len(words[i])) if rewrite and words[i] else None
        if places is not None:
            codes[starts[i]:starts[i + 1]] = codes[starts[i]:starts[i + 1]][places]
            words[i] = [words[i][j] for j in places]
    runs: list[list[tuple[int, int, int]]] = [[] for _ in keys]
    for text, *run in zip(*(x.tolist() for x in find_runs(codes, starts))):
        runs[text].append(tuple(run))
    return runs, [collapse(w, r) for w, r in zip(words, runs)]


RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
RUNS_TYPE = "array<struct<start:bigint,length:bigint,period:bigint>>"


def word_runs(docs: DataFrame, key: str = "doc_id", text: str = "text", rewrite: Rewrite | None = None) -> DataFrame:
    """Per row: the key, ``runs`` by start and period, and ``collapsed``, the text without repeated periods.

    ``rewrite`` may rearrange the words of a text first; it must depend on its
    arguments only.
    """
    key_type = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1).cast(pa.binary())
            sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
            for rows in _chunks(sizes):
                ids = keys.take(pa.array(rows))
                runs, collapsed = analyse(ids.to_pylist(), texts.take(pa.array(rows)).to_pylist(), rewrite)
                flat = [r for rs in runs for r in rs]
                spans = pa.StructArray.from_arrays(
                    [pa.array([r[i] for r in flat], type=pa.int64()) for i in range(3)], fields=list(RUN))
                ends = np.concatenate([[0], np.cumsum([len(rs) for rs in runs])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.ListArray.from_arrays(pa.array(ends), spans),
                     pa.array(collapsed, type=pa.binary()).cast(pa.string())], names=[key, "runs", "collapsed"])

    return docs.select(key, text).mapInArrow(run, f"{key} {key_type}, runs {RUNS_TYPE}, collapsed string")


def strongest(runs: Column) -> Column:
    """The run of greatest length / period; ties go to the first by start, then period."""
    none = F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>")
    return F.aggregate(runs, none, lambda best, r: F.when(
        best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best))


def periodic_tail(doc_id: int | None, n: int) -> np.ndarray | None:
    """The contract's rearrangement: one document in ten gets a periodic tail, chosen by the crc32 of its id."""
    if doc_id is None or n == 0:
        return None
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    i = np.arange(n)
    return np.where(i < a, i, a + (i - a) % p)


def query(docs: DataFrame) -> DataFrame:
    found = word_runs(docs, rewrite=periodic_tail)
    best = strongest(F.col("runs"))
    listed = F.concat_ws("", F.transform("runs", lambda r: F.concat(
        F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))))
    return (found.withColumn("best", best)
            .select("doc_id", F.size("runs").cast("long").alias("n_runs"),
                    F.col("best.start").alias("start"), F.col("best.length").alias("length"),
                    F.col("best.period").alias("period"),
                    F.expr("1000 * best.length div best.period").alias("exponent_milli"),
                    F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256")))
