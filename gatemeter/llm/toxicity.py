"""Toxicity by a subsequence string-kernel support vector machine with Nystroem landmarks.

The kernel of two strings sums, over every triple of characters they share in
order, ``decay`` to the power of the spans the triple takes in each: gaps,
inserted characters and endings cost a factor, they do not hide a word.  It is
normalised to 1 for equal strings.

A text is read as units: blank-separated words, lower-cased, usual digit
spellings folded, punctuation dropped, a mark put at either end, runs of single
letters, and of words of at most two letters, joined across their blanks within
a sentence; longer ones are read in overlapping windows, all of them.

Fitting (numpy, on a bounded sample of labelled documents): sentences of toxic
documents are represented by their witnesses, the units with the word starts
most specific to toxic documents; sentences of clean documents are negatives,
and the clean units that score highest are added for another fit.  A long
witness counts with all its windows at first, then with its best one; a clean
unit always counts with all.  Units are
mapped by the Nystroem method onto landmarks, a squared-hinge linear machine is
fitted there, and because kernel and machine are linear in triples, the fitted
machine folds into one weight per triple.  A text is described by its largest
unit margins and by how many are positive; a logistic curve over these, fitted
on documents that its machine has not seen, gives the score.

Edge cases: null, empty and blank texts, and texts of units under three letters,
score as no unit at all (near 0); very long texts are read whole, in chunks with
their neighbours of at most about ``CHUNK_CHARS`` characters; repeated rows score
alike; labels of one class only, and no labels, give a constant score; an empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatemeter.llm.common import worker_memo
from gatemeter.llm.labelled import fold, logistic, training_rows

PER_CLASS = 1500
DECAY = 0.6
SPAN = 8  # a triple is looked for in so many neighbouring letters
WINDOW = 20
STEP = 10
SYMBOLS = 64
START, END = "^", "$"
FLOOR = -3.0
MEMO_CHARS = 1_500_000
CHUNK_CHARS = 1_000_000
ENDS = tuple(".!?;:")
SHORT_WORDS = re.compile(r"(?<!\S)\S{1,3}(?!\S)(?:\s+\S{1,3}(?!\S))+")
SPELLED = str.maketrans("013457@$!", "oieastasi")
AROUND = "!?.,;:'\"()[]{}<>|*%&#-_…"
CODES = {c: i + 2 for i, c in enumerate("abcdefghijklmnopqrstuvwxyz")} | {START: 0, END: 1}


def _code(c: int) -> int:
    return CODES.get(chr(c), 28 + c % (SYMBOLS - 28))


ASCII_CODES = np.array([_code(c) for c in range(128)], dtype=np.int32)


def symbols(strings: list[str]) -> np.ndarray:
    """The symbols of strings of one length, a row each."""
    c = np.frombuffer("".join(strings).encode("utf-32-le", "surrogatepass"), dtype="<u4").reshape(len(strings), -1)
    return np.where(c < 128, ASCII_CODES[np.minimum(c, 127)], 28 + c % (SYMBOLS - 28)).astype(np.int32)


def unit(word: str) -> str:
    """The letters of one word as they are compared; '' when it has none."""
    w = word.lower().strip(AROUND)
    return w if w.isalpha() else "".join(filter(str.isalnum, w.rstrip("$@").translate(SPELLED)))


def units(text: str | None) -> list[str]:
    """Words of a text; runs of single letters, and of words of one or two, are joined into one more each."""
    if not text:
        return []
    return text.split() + [u for run in SHORT_WORDS.finditer(text) for u in joined(run.group().split())]


def joined(words: list[str]) -> list[str]:
    """What a run of short words spells: its single letters, and its pieces of one or two letters within a sentence."""
    out, letters, pieces = [], [], []

    def close(run: list[str], least: int) -> None:
        if len(run) >= 2 and len(u := "".join(run)) >= least:
            out.append(u)
        run.clear()

    def close_pieces() -> None:
        # single letters alone are the other kind of run
        if any(len(x) > 1 for x in pieces):
            close(pieces, 4)
        pieces.clear()

    for w in words:
        short = unit(w)
        if len(w) <= 2 and len(short) == 1:
            letters.append(short)
        else:
            close(letters, 3)
        if 1 <= len(short) <= 2:
            pieces.append(short)
        if not 1 <= len(short) <= 2 or w.endswith(ENDS):
            close_pieces()
    close(letters, 3)
    close_pieces()
    return out


def windows(u: str) -> list[str]:
    """What is compared for one unit: it with its marks, or overlapping parts of a long one."""
    if len(u) < 3:
        return []
    m = START + u + END
    return [m] if len(m) <= WINDOW else [m[i:i + WINDOW] for i in range(0, len(m) - STEP, STEP)]


_TRIPLES: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def triples(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Index triples of a string of n letters, within ``SPAN``, and their decays."""
    if n not in _TRIPLES:
        t = np.array([x for x in combinations(range(n), 3) if x[2] - x[0] < SPAN], dtype=np.int64).reshape(-1, 3)
        _TRIPLES[n] = t, (DECAY ** (t[:, 2] - t[:, 0] + 1)).astype(np.float32)
    return _TRIPLES[n]


def by_length(strings: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(places in the list, triple codes, normalised decays) for the strings of each length."""
    lengths = np.array([len(s) for s in strings])
    for n in np.unique(lengths[lengths >= 3]):
        at = np.flatnonzero(lengths == n)
        t, decay = triples(int(n))
        for some in np.array_split(at, -(-len(at) * len(decay) // 300_000)):
            c = symbols([strings[i] for i in some])
            codes = (c[:, t[:, 0]] * SYMBOLS + c[:, t[:, 1]]) * SYMBOLS + c[:, t[:, 2]]
            # norm: equal triples of one string add up before they are squared
            order = np.argsort(codes, axis=1, kind="stable")
            runs = np.take_along_axis(codes, order, 1)
            new = np.ones(runs.shape, bool)
            new[:, 1:] = runs[:, 1:] != runs[:, :-1]
            sums = np.add.reduceat(decay[order].ravel(), np.flatnonzero(new.ravel()))
            row_starts = np.concatenate([[0], np.cumsum(new.sum(1))[:-1]])
            yield some, codes, decay / np.sqrt(np.add.reduceat(sums * sums, row_starts))[:, None]


def kernel(a: list[str], b: list[str]) -> np.ndarray:
    """Normalised subsequence kernel of two lists of strings."""
    parts = list(by_length(b))
    if not a or not parts:
        return np.zeros((len(a), len(b)))
    seen = np.unique(np.concatenate([codes.ravel() for _, codes, _ in parts]))
    table = np.zeros((len(seen) + 1, len(b)), np.float32)
    for at, codes, values in parts:
        np.add.at(table, (np.searchsorted(seen, codes), at[:, None]), values)
    out = np.zeros((len(a), len(b)), np.float32)
    for at, codes, values in by_length(a):
        place = np.searchsorted(seen, codes)
        place[seen[np.minimum(place, len(seen) - 1)] != codes] = len(seen)
        total = np.zeros((len(at), len(b)), np.float32)
        for k in range(codes.shape[1]):
            total += values[:, k, None] * table[place[:, k]]
        out[at] = total
    return out.astype(float)


class Memo(dict):
    """Margins of words seen, emptied before their letters pass ``MEMO_CHARS``."""

    chars = 0

    def lacking(self, words: set[str]) -> list[str]:
        """Those of the words without an entry; all of them when the memo had to be emptied."""
        new = list(words.difference(self))
        if self.chars + sum(map(len, new)) > MEMO_CHARS:
            self.clear()
            self.chars = 0
            new = list(words)
        self.chars += sum(map(len, new))
        return new


def _memo(machine: "Machine") -> Memo:
    """One memo per worker, for the machine it serves."""
    mark = hashlib.blake2b(machine.weights.tobytes() + np.float64(machine.offset).tobytes()).digest()
    return worker_memo(("toxicity", mark), Memo)


def chunks(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of together about ``CHUNK_CHARS`` characters."""
    begin = total = 0
    for i, t in enumerate(texts):
        total += len(t or "")
        if total >= CHUNK_CHARS:
            yield begin, i + 1
            begin, total = i + 1, 0
    if begin < len(texts):
        yield begin, len(texts)


@dataclass
class Machine:
    """Weight per triple and offset; curve over a text's features."""

    weights: np.ndarray
    offset: float
    curve: np.ndarray | None = None
    level: float = -6.0

    def margins(self, strings: list[str]) -> np.ndarray:
        out = np.full(len(strings), FLOOR)
        for at, codes, values in by_length(strings):
            out[at] = np.maximum((self.weights[codes] * values).sum(1) + self.offset, FLOOR)
        return out

    def best_margins(self, words: list[str]) -> list[float]:
        """The largest margin of each word's windows."""
        parts = [windows(unit(w)) for w in words]
        got = self.margins([p for ps in parts for p in ps])
        sizes = np.array([len(ps) for ps in parts], dtype=np.int64)
        best = np.full(len(parts), FLOOR)
        some = sizes > 0
        if some.any():
            best[some] = np.maximum.reduceat(got, (np.cumsum(sizes) - sizes)[some])
        return best.tolist()

    def features(self, texts: list[str | None]) -> np.ndarray:
        """Per text: the largest, second and third margin of its distinct units, positive ones, and their share."""
        memo = _memo(self)
        out = np.empty((len(texts), 5))
        for begin, end in chunks(texts):
            split = [set(units(t)) for t in texts[begin:end]]
            new = memo.lacking(set().union(*split))
            memo.update(zip(new, self.best_margins(new)))
            for k, ws in enumerate(split, begin):
                m = np.array([FLOOR] * 3 + list(map(memo.__getitem__, ws)))
                top = np.partition(m, len(m) - 3)[-3:]
                top.sort()
                hits = float((m > 0).sum())
                out[k] = (*top[::-1], np.log1p(hits), np.log1p(100 * hits / (len(ws) + 20)))
        return out

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if self.curve is None:
            return np.full(len(texts), 1 / (1 + np.exp(-self.level)))
        x = self.features(texts) @ self.curve[:-1] + self.curve[-1]
        return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def squared_hinge(x: np.ndarray, y: np.ndarray, weight: np.ndarray, c: float = 20.0) -> np.ndarray:
    """Linear machine (last entry: offset) by Newton steps on the primal."""
    z = np.column_stack([x, np.ones(len(x))])
    b = np.zeros(z.shape[1])
    keep = np.ones(len(b))
    keep[-1] = 1e-3
    for _ in range(40):
        on = y * (z @ b) < 1
        zo, wo = z[on], weight[on]
        grad = keep * b - 2 * c * (zo * (wo * (y[on] - zo @ b))[:, None]).sum(0)
        hess = np.diag(keep) + 2 * c * (zo * wo[:, None]).T @ zo
        step = np.linalg.solve(hess, grad)
        b = b - step
        if abs(step).max() < 1e-8:
            break
    return b


def starts(u: str) -> set[str]:
    """Word starts of four to eight letters, and the whole word."""
    return {u[:k] for k in range(4, 9) if len(u) > k} | {u + END}


def witnesses(sets: list[set[str]], labels: np.ndarray) -> Counter:
    """Units of toxic documents whose word starts speak for toxicity, with their documents.

    A start weighs its toxic documents times its log rate ratio, so that starts
    of many documents stand out from chance ones; a unit counts where it has at
    least half of the weight of its document's best.
    """
    of = {u: starts(u) for s in sets for u in s}
    seen = [Counter(), Counter()]
    for s, y in zip(sets, labels):
        seen[int(y)].update(set().union(*(of[u] for u in s)) if s else ())
    n0, n1 = max(1, int((labels == 0).sum())), max(1, int((labels == 1).sum()))
    ratio = {p: np.log((k + 0.5) / (n1 + 1) * (n0 + 1) / (seen[0].get(p, 0) + 0.5)) for p, k in seen[1].items()}
    weight = {p: seen[1][p] * r if r > 1.4 else 0.0 for p, r in ratio.items()}
    out: Counter = Counter()
    for s, y in zip(sets, labels):
        if y == 1 and s:
            own = {u: max(weight[p] for p in of[u]) for u in s}
            best = max(own.values())
            out.update(u for u, w in own.items() if w >= max(best / 2, 8.0))
    return out


def fit_machine(sets: list[set[str]], labels: np.ndarray, landmarks: int, negatives: int, seed: int) -> Machine | None:
    found = witnesses(sets, labels)
    common = Counter(u for s, y in zip(sets, labels) if y == 0 for u in s if u not in found)
    clean = [u for u, _ in sorted(common.items(), key=lambda x: (-x[1], x[0]))]
    if not found or not clean:
        return None
    witness = [u for u, _ in found.most_common(2000)]
    rng = np.random.default_rng(seed)
    # half the negatives are the most frequent clean units, half any
    negative = clean[:negatives // 2]
    rest = [clean[i] for i in rng.permutation(len(clean)) if i >= len(negative)]
    negative += rest[:negatives // 2]
    some = clean[:negatives // 2] + rest[:40_000]
    chosen = negative[:landmarks // 2] + negative[-(landmarks // 2):]
    positive = {u: windows(u) for u in witness}
    machine = None
    for _ in range(2):
        if machine is not None:
            # every witness by its best window, and the clean units that score highest
            for u, ps in positive.items():
                positive[u] = [ps[int(np.argmax(machine.margins(ps)))]]
            hard = np.array(machine.best_margins(some))
            worst = [some[i] for i in np.argsort(-hard, kind="stable")[:600]]
            negative = list(dict.fromkeys(negative + worst))
            chosen = list(dict.fromkeys(chosen + worst[:landmarks // 2]))
        marks = [p for u in witness[:landmarks] for p in positive[u]] + [p for u in chosen for p in windows(u)]
        marks = list(dict.fromkeys(marks))
        good_parts = [(p, found[u] / len(ps)) for u, ps in positive.items() for p in ps]
        bad_parts = [(p, common[u]) for u in negative for p in windows(u)]
        values, vectors = np.linalg.eigh(kernel(marks, marks))
        good = values > 1e-6
        root = vectors[:, good] / np.sqrt(values[good])
        x = kernel([p for p, _ in good_parts + bad_parts], marks) @ root
        y = np.array([1.0] * len(good_parts) + [-1.0] * len(bad_parts))
        share, held = (np.sqrt([float(n) for _, n in parts]) for parts in (good_parts, bad_parts))
        b = squared_hinge(x, y, np.concatenate([share / share.sum(), held / held.sum()]) * len(y) / 2)
        folded = np.zeros(SYMBOLS ** 3)
        alpha = root @ b[:-1]
        for at, codes, decays in by_length(marks):
            np.add.at(folded, codes, alpha[at, None] * decays)
        machine = Machine(folded.astype(np.float32), float(b[-1]))
    return machine


def fit(texts: list[str], labels: np.ndarray, landmarks: int = 64, negatives: int = 3000, seed: int = 5) -> Machine:
    """The machine from whole documents and their labels (1: toxic)."""
    labels = np.asarray(labels)
    constant = Machine(np.zeros(SYMBOLS ** 3, np.float32), 0.0,
                       level=6.0 if len(labels) and labels.min() == 1 else -6.0)
    if not (labels == 1).any() or not (labels == 0).any():
        return constant
    sets = [{u for w in units(t) if len(u := unit(w)) >= 3} for t in texts]
    part = np.random.default_rng(seed).permutation(len(texts)) % 2
    x = np.zeros((len(texts), 5))
    for k in (0, 1):
        half = fit_machine([s for s, p in zip(sets, part) if p != k], labels[part != k], landmarks, negatives, seed)
        if half is None:
            return constant
        x[part == k] = half.features([t for t, p in zip(texts, part) if p == k])
    machine = fit_machine(sets, labels, landmarks, negatives, seed)
    machine.curve = logistic(x, labels, positive=0.25)
    return machine


def toxicity(text: Column, machine: Machine) -> Column:
    """Score column (0 to 1)."""

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series(machine.scores(s.tolist()), dtype="float64")

    return run(text)


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Machine:
    """Fitted on at most ``per_class`` documents of each class outside the held-out fifth."""
    rows = training_rows(docs, labels, "toxic", fold(F.col("doc_id"), 5) != 0, per_class)
    return fit(rows["text"].tolist(), rows["label"].to_numpy())


def score(docs: DataFrame, machine: Machine) -> DataFrame:
    return docs.withColumn("score", toxicity(F.col("text"), machine))


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    machine = train(docs, labels)
    out = score(docs.select("doc_id", "text"), machine)
    return out.select("doc_id", F.coalesce(fold(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"), "score",
                      F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
