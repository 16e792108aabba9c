"""Token counts by heap-and-linked-list byte-pair merging.

The vocabulary is a sentencepiece BPE model with byte fallback.  A text becomes
a chain of symbols (one per character, blanks written as U+2581, one blank put
before a non-empty text).  A heap holds every adjacent pair that is itself a
piece, keyed by rank and position; the lowest rank is popped, the pair merged
in the linked list, and the two new neighbour pairs pushed.  The count is the
number of initial symbols minus the merges (a symbol outside the vocabulary
counts as its UTF-8 bytes): no ids are made.

A merge can never bridge two characters that are adjacent in no piece, so a
text is cut there and at blanks, and the count of each distinct segment is kept
in a bounded per-worker memo.  The cuts are exact, not an approximation.

Edge cases: null and empty texts have 0 bytes and 0 tokens; repeated rows are
counted one by one; very long texts without blanks cost O(n log n); an empty
table gives an empty result; control-symbol strings inside texts are ordinary
text; a line break falls back to its byte.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MODEL_NAME = "piece_bpe_32k.model"
TOKEN_LIMIT = 4096
BLANK = "▁"
MEMO_ENTRIES = 700_000


def model_path(name: str = MODEL_NAME) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class MergeCounter:
    """Counts tokens of one vocabulary."""

    def __init__(self, path: str, memo_entries: int = MEMO_ENTRIES) -> None:
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        spec = proto.normalizer_spec
        if (spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.escape_whitespaces
                or proto.trainer_spec.treat_whitespace_as_suffix or proto.trainer_spec.model_type != 2):
            raise ValueError("this counter needs a BPE model without text normalisation")
        self.dummy_prefix = spec.add_dummy_prefix
        normal = [p for p in proto.pieces if p.type == 1]
        if any(p.type == 4 for p in proto.pieces):
            raise ValueError("user-defined symbols are not supported")
        self.rank = {p.piece: int(-p.score) for p in normal}
        if any(p.score != int(p.score) for p in normal):
            raise ValueError("ranks must be whole numbers")
        self.inside = {p.piece[i:i + 2] for p in normal for i in range(len(p.piece) - 1)}
        self.blank_inside = any(BLANK in p.piece.lstrip(BLANK) for p in normal)
        self.memo_entries = memo_entries
        self.words: dict[str, int] = {}
        self.segments: dict[str, int] = {}

    def merge(self, symbols: str) -> int:
        """Tokens of one segment."""
        n = len(symbols)
        get = self.rank.get
        part: list[str | None] = list(symbols)
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        # one integer per entry: rank first, then the place of the left symbol
        heap = [r * n + i for i in range(n - 1) if (r := get(symbols[i:i + 2])) is not None]
        heapify(heap)
        merges = 0
        while heap:
            r, i = divmod(heappop(heap), n)
            left, j = part[i], after[i]
            if left is None or j >= n or get(both := left + part[j]) != r:
                continue  # one side has been merged meanwhile; equal rank and place mean the same entry
            merges += 1
            part[i], part[j] = both, None
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (r := get(both + part[k])) is not None:
                    heappush(heap, r * n + i)
            h = before[i]
            if h >= 0 and (r := get(part[h] + both)) is not None:
                heappush(heap, r * n + h)
        count = n - merges
        for p in part:
            if p is not None and len(p) == 1 and get(p) is None:
                count += len(p.encode("utf-8")) - 1
        return count

    def segment(self, symbols: str) -> int:
        """Tokens of a run of characters, cut where no piece joins two neighbours."""
        inside, memo, total, start = self.inside, self.segments, 0, 0
        for i in range(1, len(symbols) + 1):
            if i == len(symbols) or symbols[i - 1:i + 1] not in inside:
                cut = symbols[start:i]
                start = i
                got = memo.get(cut)
                if got is None:
                    got = self.merge(cut)
                    if len(memo) >= self.memo_entries:
                        memo.clear()
                    if len(cut) <= 64:
                        memo[cut] = got
                total += got
        return total

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if BLANK in text or "  " in text or self.blank_inside or not self.dummy_prefix or text[0] == " " \
                or text[-1] == " ":
            # runs of blanks may merge with each other: cut before a blank run only
            symbols = text.replace(" ", BLANK)
            if self.dummy_prefix:
                symbols = BLANK + symbols
            return self.segment(symbols)
        memo, total = self.words, 0
        for w in text.split(" "):
            got = memo.get(w)
            if got is None:
                got = self.segment(BLANK + w)
                if len(memo) >= self.memo_entries:
                    memo.clear()
                if len(w) <= 64:
                    memo[w] = got
            total += got
        return total


_COUNTERS: dict[str, MergeCounter] = {}


def counter(path: str | None = None) -> MergeCounter:
    """One counter, and so one memo, per Python worker and vocabulary."""
    path = path or model_path()
    if path not in _COUNTERS:
        _COUNTERS[path] = MergeCounter(path)
    return _COUNTERS[path]


def token_count(text: Column, path: str | None = None) -> Column:
    """Column of token counts; ``path`` must be readable on every worker."""

    @F.pandas_udf("long")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        count = counter(path).count
        for s in batches:
            yield pd.Series([count(t) for t in s.array], dtype="int64")

    return run(text)


def count_tokens(docs: DataFrame, text: str = "text", limit: int = TOKEN_LIMIT, path: str | None = None) -> DataFrame:
    """``docs`` with n_bytes, n_tokens and over_limit, replacing columns of these names."""
    out = docs.withColumn("n_tokens", token_count(F.col(text), path))
    return (out.withColumn("n_bytes", F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long"))
            .withColumn("over_limit", F.col("n_tokens") > limit))


def query(docs: DataFrame) -> DataFrame:
    return count_tokens(docs.select("doc_id", "text")).select("doc_id", "n_bytes", "n_tokens", "over_limit")
