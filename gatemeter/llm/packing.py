"""Best-two-fit packing of tokenised documents into fixed-length sequences.

1. Every text is tokenised once, per row, in the workers (:func:`tokenised`);
   only lengths and checksums of the pieces are kept and written.
2. Lengths are whole numbers from 1 to the capacity, so the whole packing
   problem is a histogram of at most ``capacity`` counts.  That histogram (its
   size never depends on the input) is packed by :func:`best_two_fit`: a bin
   is filled greedily, largest first; then its smallest document gives way to
   the two unpacked ones that fill the expanded gap best.  A bin's pattern is
   repeated while its lengths last, so the work is bounded by the number of
   distinct lengths too.
3. Each piece takes its place by its rank among the pieces of its length.
   Ranks are salted counts plus a row number inside (length, salt): a length
   held by a third of all pieces is spread over all salts.

Edge cases: a null or empty text is the end mark alone (length 1); repeated
rows are packed one by one; texts of any length are cut only when longer than
the capacity, with the short piece first; an empty table packs into nothing;
extra columns are ignored.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gatemeter.llm.common import staged, worker_memo, written

CAPACITY = 2048
TOKENIZER = "byte_bpe_50k.json"
RANKS = "byte_bpe_50k.tiktoken"
END_ID = 0
MEMO_ENTRIES = 200_000


class _CutHere(Exception):
    """The text has blanks that do not start a word."""


class _Pieces(dict):
    """Blank-separated piece -> its ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, lead: str, encode, entries: int) -> None:
        super().__init__()
        self.lead, self.encode, self.entries = lead, encode, entries
        self.line: bytes = encode("\n")
        self.bare: _Pieces = self
        self.marks = {c: encode(c) for c in ".,;:!?"}

    def __missing__(self, p: str) -> bytes:
        if not p or p[0].isspace():
            raise _CutHere
        lines = p.split("\n")
        if p[-1] in self.marks and p[:-1].isalpha():
            ids = self[p[:-1]] + self.marks[p[-1]]
        elif len(lines) > 1 and all(x and not any(map(str.isspace, x)) for x in lines):
            # line breaks between words stand alone
            ids = self[lines[0]]
            for x in lines[1:]:
                ids += self.line + self.bare[x]
        else:
            ids = self.encode(self.lead + p)
        if len(self) >= self.entries:
            self.clear()
        if len(p) <= 64:
            self[p] = ids
        return ids


class Encoder:
    """Ids of whole texts, equal to the tokenizer file's, with a memo per blank-separated piece.

    The tokenizer's own split always starts a new unit at a blank that stands
    before a non-blank, so pieces cut there are independent.
    """

    def __init__(self, tokenizer: str | None = None, ranks: str | None = None, entries: int = MEMO_ENTRIES) -> None:
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(tokenizer or public_tokenizers.path(TOKENIZER))
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        with open(ranks or public_tokenizers.path(RANKS), "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        pieces = tiktoken.Encoding("pieces", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table,
                                   special_tokens={})

        def encode(p: str) -> bytes:
            if p.isascii() or max(p) < "ɐ":
                return np.array(pieces.encode_ordinary(p), dtype="<u4").tobytes()
            return self.full(p)

        self.words = _Pieces(" ", encode, entries)
        self.words.bare = self.first = _Pieces("", encode, entries // 8)
        self.first.bare = self.first
        self.cut = re.compile(r" (?=\S)")

    def full(self, text: str) -> bytes:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def ids(self, text: str | None) -> bytes:
        if not text:
            return b""
        if any(s in text for s in self.special):
            return self.full(text)
        head, *rest = text.split(" ")
        try:
            return self.first[head] + b"".join(map(self.words.__getitem__, rest))
        except _CutHere:
            head, *rest = self.cut.split(text)
            encode = self.words.encode
            return encode(head) + b"".join(
                [encode(" " + p) if any(c.isspace() for c in p) else self.words[p] for p in rest])


def encoder(tokenizer: str | None = None, ranks: str | None = None) -> Encoder:
    """One encoder per Python worker."""
    return worker_memo(("packing", tokenizer, ranks), lambda: Encoder(tokenizer, ranks))


def tokenised(text: Column, capacity: int = CAPACITY, tokenizer: str | None = None, ranks: str | None = None,
              with_ids: bool = False) -> Column:
    """struct(n, crcs[, ids]): ids of the whole text with the end mark, and a checksum per piece."""
    end = np.array([END_ID], dtype="<u4").tobytes()

    @F.pandas_udf("n long, crcs array<long>" + ", ids array<binary>" * with_ids)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        enc = encoder(tokenizer, ranks)
        step = 4 * capacity
        for texts in batches:
            sizes, sums, parts = [], [], []
            for t in texts.array:
                buf = enc.ids(t) + end
                first = (len(buf) - 1) % step + 1
                cuts = [0, *range(first, len(buf) + 1, step)]
                pieces = [buf[a:b] for a, b in zip(cuts, cuts[1:])]
                sizes.append(len(buf) // 4)
                sums.append([zlib.crc32(p) for p in pieces])
                if with_ids:
                    parts.append(pieces)
            out = {"n": np.array(sizes, dtype="int64"), "crcs": sums}
            yield pd.DataFrame(out | {"ids": parts} if with_ids else out)

    return run(text)


def best_two_fit(counts: np.ndarray, capacity: int = CAPACITY) -> list[tuple[list[tuple[int, int]], int]]:
    """Patterns [(length, how many), ... longest first] and how many bins have each.

    ``counts[n]`` documents have length n.  Equal to packing bin by bin: while
    the lengths a bin used are still there, the next bin is the same.
    """
    left = np.array(counts, dtype=np.int64)
    left[0] = 0
    bins: list[tuple[list[tuple[int, int]], int]] = []
    lengths = np.flatnonzero(left)
    while len(lengths):
        used: dict[int, int] = {}
        gap, top = capacity, len(lengths)
        while gap and (top := int(np.searchsorted(lengths[:top], gap, "right"))):
            n = int(lengths[top - 1])
            take = int(min(left[n], gap // n))
            used[n] = take
            gap -= take * n
            top -= 1
        if gap:
            small = min(used)
            room = gap + small
            free = left[lengths].copy()
            free[np.searchsorted(lengths, list(used))] -= list(used.values())
            there = lengths[free > 0]
            a = there[there <= room // 2]
            if len(a):
                at = np.searchsorted(there, room - a, "right") - 1
                twice = np.isin(a, lengths[free > 1])
                at = np.where((there[at] == a) & ~twice, at - 1, at)
                both = np.where(at >= 0, a + there[np.maximum(at, 0)], 0)
                best = int(np.argmax(both))
                if both[best] > small:
                    used[small] -= 1
                    for n in (int(a[best]), int(there[at[best]])):
                        used[n] = used.get(n, 0) + 1
        pattern = sorted(((n, k) for n, k in used.items() if k), reverse=True)
        times = int(min(left[n] // k for n, k in pattern))
        for n, k in pattern:
            left[n] -= k * times
        bins.append((pattern, times))
        lengths = lengths[left[lengths] > 0]
    return bins


def slots(bins: list[tuple[list[tuple[int, int]], int]], capacity: int = CAPACITY) -> dict[int, np.ndarray]:
    """For each length the rows (first rank, copies in a bin, first sequence, offset of the first copy)."""
    out: dict[int, list[tuple[int, int, int, int]]] = {}
    ranks = np.zeros(capacity + 1, dtype=np.int64)
    sequence = 0
    for pattern, times in bins:
        offset = 0
        for n, k in pattern:
            out.setdefault(n, []).append((int(ranks[n]), k, sequence, offset))
            ranks[n] += k * times
            offset += n * k
        sequence += times
    return {n: np.array(rows, dtype=np.int64) for n, rows in out.items()}


def ranked(pieces: DataFrame, salts: int) -> DataFrame:
    """``rank``: 0, 1, ... among the rows of each length, without bringing a length into one task."""
    p = pieces.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece", "_metadata.row_index"), F.lit(salts)))
    p = p.withColumn("_order", F.col("_metadata.row_index"))
    counts = p.groupBy("length", "_salt").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("length", "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("length", "_salt").orderBy("doc_id", "piece", "ids_crc32", "_order")
    return (p.withColumn("_k", F.row_number().over(inside))
            .join(starts, ["length", "_salt"])
            .withColumn("rank", F.col("_start") + F.col("_k") - 1)
            .drop("_salt", "_order", "_k", "_start"))


def pack(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY,
         tokenizer: str | None = None, ranks: str | None = None, with_ids: bool = False) -> DataFrame:
    """One row per piece with its sequence and its place there (and its ids, if asked for)."""
    spark = docs.sparkSession
    d = staged(docs, F.col(doc_id).alias("doc_id"),
               tokenised(F.col(text), capacity, tokenizer, ranks, with_ids).alias("t"))
    n, k = F.col("t.n"), F.size("t.crcs")
    first = n - capacity * (k - 1)
    exploded = d.select("doc_id", n.alias("n"), k.alias("k"), first.alias("first"), "t",
                        F.posexplode("t.crcs").alias("piece", "ids_crc32"))
    pieces = written(exploded.select(
        "doc_id", F.col("piece").cast("int").alias("piece"),
        F.when(F.col("piece") == 0, F.lit(0)).otherwise(F.col("first") + capacity * (F.col("piece") - 1))
        .cast("long").alias("start"),
        F.when(F.col("piece") == 0, F.col("first")).otherwise(F.lit(capacity)).cast("long").alias("length"),
        F.col("ids_crc32").cast("long").alias("ids_crc32"),
        *([F.get("t.ids", F.col("piece")).alias("ids")] if with_ids else [])))
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect():  # at most `capacity` rows
        counts[r["length"]] = r["n"]
    places = spark.sparkContext.broadcast(slots(best_two_fit(counts, capacity), capacity))

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        n, r = length.to_numpy(), rank.to_numpy()
        seq, off = np.zeros(len(n), dtype=np.int64), np.zeros(len(n), dtype=np.int64)
        for one in np.unique(n):
            at = np.flatnonzero(n == one)
            rows = places.value[int(one)]
            row = rows[np.searchsorted(rows[:, 0], r[at], "right") - 1]
            inside = r[at] - row[:, 0]
            seq[at] = row[:, 2] + inside // row[:, 1]
            off[at] = row[:, 3] + inside % row[:, 1] * one
        return pd.DataFrame({"sequence_id": seq, "offset": off})

    salts = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    out = ranked(pieces, salts).withColumn("_p", place("length", "rank"))
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", F.col("_p.sequence_id").alias("sequence_id"),
                      F.col("_p.offset").alias("offset"), *(["ids"] if with_ids else []))


def query(docs: DataFrame) -> DataFrame:
    return pack(docs.select("doc_id", "text"))
