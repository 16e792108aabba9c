"""Document scores by masked pseudo-likelihood of a bidirectional window network.

Every token is hidden in turn and predicted from the two tokens on either side;
the sum of the log-probabilities is the document's pseudo-log-likelihood.

Tokens are lower-cased (A-Z) words: the most frequent words of the corpus have
an id of their own, all others share hashed ids.  The network adds one embedding
per neighbouring place, applies a rectifier and predicts the id in two steps,
its class and its place in the class, so a prediction costs two small softmaxes.
A word of a hashed id is predicted in a third step, by its share of the id's
tokens in the corpus.  That table holds every word and grows with the corpus; a
word it lacks counts ``UNSEEN`` times, and each id is assumed to have one unseen
word more than it has seen ones.

Corpus work (all documents, growing with them):
1. word counts, pre-aggregated in the workers, then by word, kept as a table;
2. coding: every text is cut into words once more and stored as ids, two bytes a
   token.  Rows come in chunks of bounded size; the words without an id of their
   own are numbered per chunk, and a row holds the numbers of its tokens and the
   words that it is the first of its chunk to have.  Training and scoring read
   these rows, not the texts;
3. training in rounds: rows are dealt by a hash of their columns to the replicas
   of a round, about ``REPLICA_TOKENS`` tokens each however the input is split.
   Every replica trains from the round's start and returns its parameters
   weighted by its tokens; a grouped sum averages them for the next round.  All
   rows are trained on once.  Only word and parameter tables of fixed size reach
   the driver.
Scoring looks the words of each chunk up once by a join, which gives back their
numbers and counts to meet the chunk's rows in a cogroup.  The rows are stored by
buckets of chunks, so they don't move.

Edge cases: null, empty and blank texts have 0 tokens, log_prob 0 and a null
mean; a text of one word is predicted from the edges alone; repeated rows score
alike; very long texts are read whole (a chunk of their own); an empty table
gives an empty result; extra columns are kept by :func:`score`.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, IntegerType, LongType, StructField, StructType

from gatemeter.llm.common import discard, written
from gatemeter.session import checkpoint_dir

CLASSES = 32
PER_CLASS = 32
HASHED = 255
WORDS = CLASSES * PER_CLASS - HASHED - 1  # the last id is the edge of a text
EDGE = CLASSES * PER_CLASS - 1
WIDTH = 16
SIDES = (-2, -1, 1, 2)
BATCH = 8192
RATE = 0.05
ROUNDS = 4
REPLICA_TOKENS = 500_000
UNSEEN = 0.5
CHUNK_ROWS = 4096
CHUNK_BYTES = 16 << 20
TRAIN_TOKENS = 200_000
# buckets of the rows to score: about so many tokens each
BUCKET_TOKENS = 2_000_000
MOST_BUCKETS = 20_000
# logits beyond this say nothing more in single precision
LIMIT = 30.0


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Tokens of each text, all of them in a row as places in the list of the distinct ones, and that list (in order)."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts.fill_null("")))
    flat, ends = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
    whole = pc.binary_length(flat).to_numpy() > 0  # blanks at the ends of a text cut off empty words
    if not whole.all():
        flat, ends = flat.filter(pa.array(whole)), np.concatenate([[0], np.cumsum(whole)])[ends]
    coded = flat.dictionary_encode()
    return np.diff(ends), coded.indices.to_numpy(), coded.dictionary.cast(pa.binary())


@dataclass
class Tail:
    """All words of the hashed ids (word, n), what their counts are divided by per hashed id, and the corpus's tokens."""

    table: DataFrame
    whole: np.ndarray
    tokens: int


class Vocabulary(dict):
    """word -> id of the words with an id of their own; all others are hashed.  Workers get no ``tail``."""

    def __init__(self, words: list[bytes], tail: Tail | None = None) -> None:
        super().__init__({w: i for i, w in enumerate(words)})
        self.words, self.tail = words, tail

    def __missing__(self, w: bytes) -> int:
        return WORDS + zlib.crc32(w) % HASHED

    def ids(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.int64, count=len(words))

    def __reduce__(self):
        return Vocabulary, (self.words,)


class Shares(dict):
    """word -> log of its share of its hashed id, from words and their counts; 0 for words with an id of their own.

    What :func:`log_probs` takes a chunk's words from, one word at a time.
    """

    def __init__(self, words: list[bytes], counts: np.ndarray, vocabulary: Vocabulary, whole: np.ndarray) -> None:
        at = np.array([zlib.crc32(w) % HASHED for w in words], dtype=np.int64)
        super().__init__(zip(words, np.log(counts / whole[at]).tolist()))
        self.update(dict.fromkeys(vocabulary.words, 0.0))
        self.unseen = np.log(UNSEEN / whole)

    def __missing__(self, w: bytes) -> float:
        return float(self.unseen[zlib.crc32(w) % HASHED])


def between_edges(ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Ids of texts in a row, with two edges between texts and around all."""
    out = np.full(len(ids) + 2 * len(sizes) + 2, EDGE, dtype=np.int64)
    out[places(sizes)[0]] = ids
    return out


def encode(texts: list[str | None], vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """All ids in a row, two edges between texts and around all, and the tokens of each text."""
    sizes, codes, distinct = tokens(pa.array(texts, pa.string()))
    return between_edges(vocabulary.ids(distinct.to_pylist())[codes], sizes), sizes


@dataclass
class WindowNetwork:
    """Parameters: per side embeddings, hidden bias, class and in-class outputs."""

    sides: np.ndarray   # (4, ids, width)
    hidden: np.ndarray  # (width,)
    to_class: np.ndarray  # (width + 1, classes), last row the bias
    to_word: np.ndarray   # (classes, width + 1, per class)
    slopes: dict = field(default_factory=dict)

    @classmethod
    def start(cls, counts: np.ndarray, seed: int = 3) -> "WindowNetwork":
        """Small random weights; the biases are the corpus's log-frequencies."""
        rng = np.random.default_rng(seed)
        n = CLASSES * PER_CLASS
        c = (counts + 0.5).reshape(CLASSES, PER_CLASS)
        to_class = rng.normal(0, 0.1, (WIDTH + 1, CLASSES))
        to_class[-1] = np.log(c.sum(1) / c.sum())
        to_word = rng.normal(0, 0.1, (CLASSES, WIDTH + 1, PER_CLASS))
        to_word[:, -1] = np.log(c / c.sum(1, keepdims=True))
        return cls(rng.normal(0, 0.3, (len(SIDES), n, WIDTH)).astype(np.float32),
                   np.full(WIDTH, 0.1, np.float32), to_class.astype(np.float32), to_word.astype(np.float32))

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in (self.sides, self.hidden, self.to_class, self.to_word)])

    @classmethod
    def of_flat(cls, v: np.ndarray) -> "WindowNetwork":
        n = CLASSES * PER_CLASS
        shapes = [(len(SIDES), n, WIDTH), (WIDTH,), (WIDTH + 1, CLASSES), (CLASSES, WIDTH + 1, PER_CLASS)]
        out, i = [], 0
        for s in shapes:
            k = int(np.prod(s))
            out.append(v[i:i + k].reshape(s).astype(np.float32))
            i += k
        return cls(*out)

    def states(self, ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        z = self.sides[0].take(ids[at + SIDES[0]], axis=0)
        for k in range(1, len(SIDES)):
            z += self.sides[k].take(ids[at + SIDES[k]], axis=0)
        z += self.hidden
        h = np.empty((len(at), WIDTH + 1), np.float32)
        np.maximum(z, 0.1 * z, out=h[:, :-1])
        h[:, -1] = 1
        return z, h

    @staticmethod
    def _exp(x: np.ndarray) -> np.ndarray:
        """Numerators of the rows' softmax, in place."""
        np.clip(x, -LIMIT, LIMIT, out=x)
        return np.exp(x, out=x)

    def _in_class(self, h: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numerators and denominators within the class, of rows in order of it: class ``c`` up to ``ends[c + 1]``."""
        x, whole = np.empty((len(h), PER_CLASS), np.float32), np.empty(len(h), np.float32)
        some = [(c, slice(ends[c], ends[c + 1])) for c in range(CLASSES) if ends[c] < ends[c + 1]]
        for c, k in some:
            np.matmul(h[k], self.to_word[c], out=x[k])
        self._exp(x)
        ones = np.ones(PER_CLASS, np.float32)
        for _, k in some:
            np.matmul(x[k], ones, out=whole[k])
        return x, whole

    def token_log_probs(self, ids: np.ndarray, at: np.ndarray) -> np.ndarray:
        """log P(token | its neighbours) at the given places."""
        out = np.empty(len(at), np.float32)
        for i in range(0, len(at), BATCH):
            some = at[i:i + BATCH]
            _, h = self.states(ids, some)
            target = ids[some]
            group = target // PER_CLASS
            rows = np.arange(len(some))
            x = self._exp(h @ self.to_class)
            lp = np.log(x[rows, group] / (x @ np.ones(CLASSES, np.float32)))
            order = np.argsort(group.astype(np.uint8), kind="stable")
            x, whole = self._in_class(h.take(order, axis=0), np.searchsorted(group[order], np.arange(CLASSES + 1)))
            lp[order] += np.log(x[rows, target[order] % PER_CLASS] / whole)
            out[i:i + BATCH] = lp
        return out

    def _step(self, name: str, value: np.ndarray, grad: np.ndarray, rate: float) -> None:
        """Adagrad."""
        if name not in self.slopes:
            self.slopes[name] = np.full(value.shape, 1e-4, np.float32)
        self.slopes[name] += grad * grad
        value -= rate * grad / np.sqrt(self.slopes[name])

    def train(self, ids: np.ndarray, at: np.ndarray, rate: float = RATE) -> None:
        """One pass of gradient steps over the given places."""
        for i in range(0, len(at), BATCH):
            some = at[i:i + BATCH]
            z, h = self.states(ids, some)
            target = ids[some]
            group = target // PER_CLASS
            rows = np.arange(len(some))
            g = self._exp(h @ self.to_class)
            g /= (g @ np.ones(CLASSES, np.float32))[:, None]
            g[rows, group] -= 1
            dh = g @ self.to_class[:-1].T
            d_class = h.T @ g
            d_word = np.zeros_like(self.to_word)
            order = np.argsort(group.astype(np.uint8), kind="stable")
            ends = np.searchsorted(group[order], np.arange(CLASSES + 1))
            sorted_h = h.take(order, axis=0)
            p, whole = self._in_class(sorted_h, ends)
            p /= whole[:, None]
            p[rows, target[order] % PER_CLASS] -= 1
            back = np.empty_like(dh)
            for c in range(CLASSES):
                k = slice(ends[c], ends[c + 1])
                if ends[c] < ends[c + 1]:
                    d_word[c] = sorted_h[k].T @ p[k]
                    np.matmul(p[k], self.to_word[c][:-1].T, out=back[k])
            dh[order] += back
            dh *= np.where(z < 0, np.float32(0.1), np.float32(1))
            n = np.float32(1.0 / len(some))
            for s, shift in enumerate(SIDES):
                near = ids[some + shift]
                by = np.argsort(near.astype(np.uint16), kind="stable")
                sorted_ids = near[by]
                first = np.flatnonzero(np.concatenate([[True], sorted_ids[1:] != sorted_ids[:-1]]))
                grad = np.zeros_like(self.sides[s])
                grad[sorted_ids[first]] = np.add.reduceat(dh.take(by, axis=0), first, axis=0) * n
                self._step(f"side{s}", self.sides[s], grad, rate)
            self._step("hidden", self.hidden, dh.sum(0) * n, rate)
            self._step("class", self.to_class, d_class * n, rate)
            self._step("word", self.to_word, d_word * n, rate)


def places(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of all tokens in the encoded row, and the first token of each text among them."""
    starts = 2 + np.concatenate([[0], np.cumsum(sizes + 2)[:-1]]).astype(np.int64) if len(sizes) else np.zeros(0, np.int64)
    first = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64) if len(sizes) else starts
    at = np.repeat(starts - first, sizes) + np.arange(int(sizes.sum()))
    return at, first


def pieces(batch: pa.RecordBatch, text: str) -> Iterator[pa.RecordBatch]:
    """Neighbouring rows of together at most ``CHUNK_ROWS`` and ``CHUNK_BYTES`` of text, or one row."""
    ends = np.cumsum(pc.binary_length(batch.column(text)).fill_null(0).to_numpy().astype(np.int64))
    at = 0
    while at < len(ends):
        most = CHUNK_BYTES + (ends[at - 1] if at else 0)
        end = max(at + 1, min(at + CHUNK_ROWS, int(np.searchsorted(ends, most, side="right"))))
        yield batch.slice(at, end - at)
        at = end


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(word, n) over all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in pieces(batch, text):
                _, codes, distinct = tokens(some.column(text))
                yield pa.RecordBatch.from_arrays([distinct, pa.array(np.bincount(codes, minlength=len(distinct)), pa.int64())],
                                                 names=["word", "n"])

    return (docs.select(text).mapInArrow(run, "word binary, n long")
            .groupBy("word").agg(F.sum("n").alias("n")))


def vocabulary(docs: DataFrame, text: str = "text") -> tuple[Vocabulary, np.ndarray]:
    """The most frequent words (ties by bytes) with the table of all others, and the corpus counts of every id."""
    spark = docs.sparkSession
    counts = written(word_counts(docs, text))
    top = counts.orderBy(F.desc("n"), "word").limit(WORDS).collect()  # at most WORDS rows
    words = [bytes(r["word"]) for r in top]
    known = spark.createDataFrame([(w,) for w in words], "word binary")
    rest = (counts.join(F.broadcast(known), "word", "left_anti")
            .withColumn("bucket", (F.crc32("word") % HASHED).cast("int")))
    seen, kinds = np.zeros(HASHED), np.zeros(HASHED)
    for r in rest.groupBy("bucket").agg(F.sum("n").alias("n"), F.count("*").alias("kinds")).collect():  # HASHED rows
        seen[r["bucket"]], kinds[r["bucket"]] = r["n"], r["kinds"]
    whole = seen + UNSEEN * (kinds + 1)
    table = written(rest.select("word", "n"))
    discard(counts)
    ids = np.zeros(CLASSES * PER_CLASS)
    ids[:len(top)] = [r["n"] for r in top]
    ids[WORDS:EDGE] = seen
    return Vocabulary(words, Tail(table, whole, int(ids.sum()))), ids


def by_replica(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """The texts (ids) of one replica after another from rows (replica, ids) in order of replicas."""
    held: list[np.ndarray] = []
    last = None
    for batch in batches:
        for replica, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if replica != last and held:
                yield held
                held = []
            last = replica
            held.append(np.frombuffer(ids, dtype="<u2"))
    if held:
        yield held


def in_steps(texts: list[np.ndarray]) -> Iterator[list[np.ndarray]]:
    """Neighbouring texts of together about ``TRAIN_TOKENS`` tokens."""
    held, total = [], 0
    for ids in texts:
        held.append(ids)
        total += len(ids)
        if total >= TRAIN_TOKENS:
            yield held
            held, total = [], 0
    if held:
        yield held


def binaries(sizes: np.ndarray, data: np.ndarray) -> pa.Array:
    """Binary values of ``sizes`` elements of ``data`` each."""
    ends = np.concatenate([[0], np.cumsum(sizes)]) * data.itemsize
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data.tobytes())])


def elements(column: pa.ChunkedArray, dtype: str) -> tuple[np.ndarray, np.ndarray]:
    """What :func:`binaries` was made of: the elements of each value, and all of them in a row."""
    whole = pa.concat_arrays(column.cast(pa.binary()).chunks)
    _, ends, data = whole.buffers()
    ends = np.frombuffer(ends, np.int32)[whole.offset:whole.offset + len(whole) + 1]
    kind = np.dtype(dtype)
    some = np.frombuffer(data, np.uint8)[ends[0]:ends[-1]] if data is not None else np.zeros(0, np.uint8)
    return np.diff(ends) // kind.itemsize, some.view(kind)


def coded(docs: DataFrame, words: Vocabulary, text: str, columns: Sequence[str]) -> DataFrame:
    """``docs`` as (chunk, mark, row, ids, tail, base, fresh): ``row`` has ``columns``, ``ids`` the ids of the text's tokens.

    ``tail`` has the numbers of the tokens without an id of their own among such words of the chunk; ``fresh`` are those
    words whose first token in the chunk stands in this row, numbered from ``base``.
    """
    known = words.words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_words = pa.array(known, pa.binary())
        chunk = TaskContext.get().partitionId() << 32
        for batch in batches:
            for some in pieces(batch, "text"):
                sizes, codes, distinct = tokens(some.column("text"))
                own = pc.index_in(distinct, value_set=own_words)
                rest = distinct.filter(own.is_null())
                is_rest = own.is_null().to_numpy(zero_copy_only=False)
                ids = own.fill_null(0).to_numpy().astype("<u2")
                ids[is_rest] = [WORDS + zlib.crc32(w) % HASHED for w in rest.to_pylist()]
                number = np.cumsum(is_rest) - 1
                in_rest = is_rest[codes]
                ends = np.cumsum(sizes)
                before = np.concatenate([[0], np.cumsum(in_rest)])
                # words are listed by their first token: the highest place so far tells how many a row has reached
                reached = np.concatenate([[-1], np.maximum.accumulate(codes)])[np.concatenate([[0], ends])] if len(codes) else \
                    np.full(len(sizes) + 1, -1)
                fresh = np.concatenate([[0], number + 1])[reached + 1].astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(sizes), chunk)), some.column("mark"), some.column("row"), binaries(sizes, ids[codes]),
                     binaries(np.diff(before[np.concatenate([[0], ends])]), number[codes[in_rest]].astype("<u4")),
                     pa.array(fresh[:-1]), pa.ListArray.from_arrays(pa.array(fresh), rest)],
                    names=["chunk", "mark", "row", "ids", "tail", "base", "fresh"])
                chunk += 1

    mark = F.xxhash64(*[c for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind])
    rows = docs.select(F.col(text).alias("text"), mark.alias("mark"),
                       F.struct(*(columns or [F.lit(True).alias("row")])).alias("row"))
    return rows.mapInArrow(run, StructType([
        StructField("chunk", LongType()), StructField("mark", LongType()), rows.schema["row"],
        StructField("ids", BinaryType()), StructField("tail", BinaryType()), StructField("base", IntegerType()),
        StructField("fresh", ArrayType(BinaryType()))]))


def train(docs: DataFrame, text: str = "text", rounds: int = ROUNDS,
          replica_tokens: int = REPLICA_TOKENS) -> tuple[Vocabulary, WindowNetwork]:
    """Replicas of ``replica_tokens`` tokens, averaged by their tokens after each round."""
    words, counts = vocabulary(docs, text)
    rows = written(coded(docs, words, text, []).select("mark", "ids"))
    net = fit(rows, words, counts, rounds, replica_tokens)
    discard(rows)
    return words, net


def fit(rows: DataFrame, words: Vocabulary, counts: np.ndarray, rounds: int = ROUNDS,
        replica_tokens: int = REPLICA_TOKENS) -> WindowNetwork:
    """The network of stored coded rows, of which ``mark`` and ``ids`` are read."""
    net = WindowNetwork.start(counts)
    replicas = max(1, -(-words.tail.tokens // (rounds * replica_tokens)))
    dealt = (rows.select("mark", "ids").withColumn("slot", F.pmod("mark", F.lit(rounds * replicas)))
             .select("mark", "ids", (F.col("slot") % rounds).alias("round"),
                     F.floor(F.col("slot") / rounds).alias("replica")))
    for round_ in range(rounds):
        begin = rows.sparkSession.sparkContext.broadcast(net.flat())  # about 0.3 MB

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            flat = begin.value
            total, tokens = np.zeros(len(flat)), 0
            for texts in by_replica(batches):
                own, n = WindowNetwork.of_flat(flat), 0
                for some in in_steps(texts):
                    sizes = np.array([len(ids) for ids in some], dtype=np.int64)
                    own.train(between_edges(np.concatenate(some), sizes), places(sizes)[0])
                    n += int(sizes.sum())
                total += own.flat().astype(np.float64) * n
                tokens += n
            if tokens:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(len(total)), pa.int32()), pa.array(total),
                     pa.array(np.full(len(total), tokens), pa.int64())], names=["i", "v", "n"])

        sums = (dealt.where(F.col("round") == round_).select("replica", "mark", "ids")
                .repartition("replica").sortWithinPartitions("replica", "mark", "ids").select("replica", "ids")
                .mapInArrow(run, "i int, v double, n long").groupBy("i")
                .agg((F.sum("v") / F.sum("n")).alias("v")).toPandas())  # one row per parameter
        if len(sums):
            flat = np.zeros(len(sums))
            flat[sums["i"].to_numpy()] = sums["v"].to_numpy()
            net = WindowNetwork.of_flat(flat)
    return net


def log_probs(rows: pa.Table, found: pa.Table, net: WindowNetwork, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and sum of log-probabilities of every coded text of a chunk, with the counts found of its words."""
    sizes, ids = elements(rows.column("ids"), "<u2")
    _, tail = elements(rows.column("tail"), "<u4")
    at, first = places(sizes)
    lp = net.token_log_probs(between_edges(ids, sizes), at).astype(np.float64)
    if len(tail):
        in_tail = (ids >= WORDS) & (ids < EDGE)
        n, id_of = np.full(int(tail.max()) + 1, UNSEEN), np.zeros(int(tail.max()) + 1, np.int64)
        n[found.column("place").to_numpy()] = found.column("n").to_numpy()
        id_of[tail] = ids[in_tail] - WORDS
        lp[in_tail] += np.log(n / whole[id_of])[tail]
    return sizes, np.where(sizes > 0, np.add.reduceat(np.append(lp, 0.0), np.minimum(first, len(at))), 0.0)


def by_bucket(rows: DataFrame, key: str, buckets: int) -> DataFrame:
    """A table in the shared folder, in hash buckets of ``key``: joins on it leave the rows where they are."""
    spark = rows.sparkSession
    name = f"gatemeter_{uuid.uuid4().hex}"
    (rows.write.format("parquet").option("compression", "zstd").option("path", f"{checkpoint_dir(spark).rstrip('/')}/{name}")
     .bucketBy(buckets, key).sortBy(key).saveAsTable(name))
    return spark.table(name)


def score(docs: DataFrame, words: Vocabulary, net: WindowNetwork, text: str = "text") -> DataFrame:
    """``docs`` with n_tokens, log_prob and mean_log_prob, replacing columns of these names."""
    d = docs.drop("n_tokens", "log_prob", "mean_log_prob")
    return scored(stored(d, words, text, d.columns), words, net)


def stored(docs: DataFrame, words: Vocabulary, text: str, columns: Sequence[str]) -> DataFrame:
    """Coded rows in buckets of chunks."""
    buckets = max(1, min(MOST_BUCKETS, -(-words.tail.tokens // BUCKET_TOKENS)))
    return by_bucket(coded(docs, words, text, columns), "chunk", buckets)


def scored(rows: DataFrame, words: Vocabulary, net: WindowNetwork) -> DataFrame:
    """The columns of each coded row with n_tokens, log_prob and mean_log_prob."""
    looked_up = (rows.select("chunk", "base", F.posexplode("fresh").alias("at", "word"))
                 .select(F.col("chunk").alias("of"), (F.col("base") + F.col("at")).alias("place"), "word")
                 .join(words.tail.table, "word").select("of", "place", "n"))
    begin = rows.sparkSession.sparkContext.broadcast((net.flat(), words.tail.whole))

    def run(some: pa.Table, found: pa.Table) -> pa.Table:
        flat, whole = begin.value
        row = some.column("row").combine_chunks()
        n, lp = log_probs(some, found, WindowNetwork.of_flat(flat), whole)
        mean = pa.array(lp / np.maximum(n, 1), pa.float64(), mask=n == 0)
        return pa.Table.from_arrays([*row.flatten(), pa.array(n, pa.int64()), pa.array(lp, pa.float64()), mean],
                                    names=[*(f.name for f in row.type), "n_tokens", "log_prob", "mean_log_prob"])

    schema = StructType([*rows.schema["row"].dataType.fields, StructField("n_tokens", LongType()),
                         StructField("log_prob", DoubleType()), StructField("mean_log_prob", DoubleType())])
    return (rows.select("chunk", "row", "ids", "tail").groupBy("chunk").cogroup(looked_up.groupBy("of"))
            .applyInArrow(run, schema))


def query(docs: DataFrame) -> DataFrame:
    d = docs.select("doc_id", "text")
    words, counts = vocabulary(d)
    rows = stored(d, words, "text", ["doc_id"])
    return scored(rows, words, fit(rows, words, counts))
