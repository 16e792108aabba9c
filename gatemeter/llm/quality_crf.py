"""Document quality from a linear-chain conditional random field over lines.

Every line of a text is labelled good or bad.  A line's features are its own
counts (repetition, capitals, symbols, exclamation marks, digits, word length,
punctuation, equal to the line before) and those of the lines next to it;
transition weights tie neighbouring labels.  Forward-backward gives each line's
marginal; their mean weighted by line length, calibrated by a logistic curve,
is the document's score.

Fitting (numpy, on a bounded sample of labelled documents): lines start with
their document's label; lines of bad documents that look clearly good to a
first line-wise fit are relabelled; then transitions and emissions are fitted
together by the gradient of the conditional likelihood.

Edge cases: null, empty and blank texts have no line and quality 0 before
calibration; repeated rows score alike; a text without line breaks is one line,
however long; labels of one class only give a constant score; extra columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatemeter.llm.common import SPACES, split_words, worker_memo
from gatemeter.llm.labelled import fold, logistic_1d, training_rows

PER_CLASS = 1500
CELLS = 1 << 18  # lines of a padded group of chains, unless one chain alone has more
FOLDS, HELD_OUT = 3, 1
UPPER = bytes([*range(65, 91), *range(192, 223)])
LOWER = bytes([*range(97, 123), *range(223, 256)])
SYMBOLS = b"#*$%&|<>"
DIGITS = b"0123456789"
OWN, NEAR = 12, 6


def line_counts(line: str, before: str | None) -> tuple[float, ...]:
    """Features of one line; the first ``NEAR`` are also shown to its neighbours."""
    ws = split_words(line)
    n = len(ws)
    b = line.encode("latin-1", "replace")
    size = len(b)
    up, low = size - len(b.translate(None, UPPER)), size - len(b.translate(None, LOWER))
    symbols, digits = size - len(b.translate(None, SYMBOLS)), size - len(b.translate(None, DIGITS))
    return (sum(map(eq, ws, ws[1:])) / n, up / (up + low + 5), min(symbols / n, 2.0), min(b.count(b"!") / n, 2.0),
            digits / size, float(line == before),
            1 - len(set(ws)) / n, np.log1p(n), min(size / n / 10, 3.0), float(max(map(len, ws)) > 30),
            float(b[-1:] in b".!?:;"), float("http" in line or "@" in line))


def document_lines(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(features with neighbours, lengths) of the lines that hold a word."""
    lines = [x for x in text.split("\n") if x.strip(SPACES)] if text else []
    if not lines:
        return np.zeros((0, OWN + 2 * NEAR)), np.zeros(0)
    own = np.array([line_counts(x, y) for x, y in zip(lines, [None, *lines])])
    near = np.zeros((len(lines) + 2, NEAR))
    near[1:-1] = own[:, :NEAR]
    return np.hstack([own, near[:-2], near[2:]]), np.array([len(x) for x in lines], dtype=float)


def chains(emissions: list[np.ndarray], width: int = 256) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Groups of chains of like length, padded: (places, emissions, lengths)."""
    sizes = np.array([len(e) for e in emissions])
    order = np.argsort(sizes, kind="stable")
    order = order[sizes[order] > 0]
    i = 0
    while i < len(order):
        n = min(width, len(order) - i)
        while n > 1 and n * sizes[order[i + n - 1]] > CELLS:
            n = (n + 1) // 2
        at = order[i:i + n]
        i += n
        padded = np.zeros((len(at), int(sizes[at].max())))
        for k, j in enumerate(at):
            padded[k, :sizes[j]] = emissions[j]
        yield at, padded, sizes[at]


def forward_backward(e: np.ndarray, sizes: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals P(good) (chains, lines) and expected transition counts (2, 2).

    ``e`` is the score of good against bad; messages are normalised per step.
    """
    n, width = e.shape
    e = np.clip(e, -40, 40)
    emit = np.stack([1 / (1 + np.exp(e)), 1 / (1 + np.exp(-e))], 2)
    t = np.exp(trans)
    inside = np.arange(width)[None, :] < sizes[:, None]
    fore, back = np.zeros((n, width, 2)), np.ones((n, width, 2))
    fore[:, 0] = emit[:, 0]
    for i in range(1, width):
        m = (fore[:, i - 1] @ t) * emit[:, i]
        fore[:, i] = m / m.sum(1, keepdims=True)
    for i in range(width - 2, -1, -1):
        m = (back[:, i + 1] * emit[:, i + 1]) @ t.T
        m /= m.sum(1, keepdims=True)
        back[:, i] = np.where(inside[:, i + 1, None], m, 1.0)
    p = fore * back
    p /= p.sum(2, keepdims=True)
    pair = fore[:, :-1, :, None] * t * (back[:, 1:] * emit[:, 1:])[:, :, None, :]
    pair /= np.maximum(pair.sum((2, 3), keepdims=True), 1e-300)
    return p[:, :, 1], (pair * inside[:, 1:, None, None]).sum((0, 1))


@dataclass
class LineField:
    """Emission weights over standardised features, transitions, calibration."""

    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    trans: np.ndarray
    slope: float = 1.0
    level: float = 0.0

    def emissions(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) / self.spread @ self.weights[:-1] + self.weights[-1]

    def marginals(self, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
        """P(good) and length of every line with a word, per text."""
        rows = [document_lines(t) for t in texts]
        e = [self.emissions(x) for x, _ in rows]
        good: list[np.ndarray] = [np.zeros(0)] * len(rows)
        for at, padded, sizes in chains(e):
            p, _ = forward_backward(padded, sizes, self.trans)
            for k, j in enumerate(at):
                good[j] = p[k, :sizes[k]]
        return [(g, size) for g, (_, size) in zip(good, rows)]

    def quality(self, texts: list[str | None]) -> np.ndarray:
        return np.array([float(g @ size / size.sum()) if len(g) else 0.0 for g, size in self.marginals(texts)])

    def scores(self, texts: list[str | None]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.quality(texts) + self.level, -30, 30)))


def _logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    z = np.column_stack([x, np.ones(len(x))])
    b = np.zeros(z.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
        step = np.linalg.solve((z * (w * p * (1 - p))[:, None]).T @ z + ridge * np.eye(len(b)),
                               z.T @ (w * (p - y)) + ridge * b)
        b -= step
        if abs(step).max() < 1e-7:
            break
    return b


def fit(texts: list[str], labels: np.ndarray, rounds: int = 150) -> LineField:
    """The field from whole documents and their labels (1: good)."""
    labels = np.asarray(labels)
    d = OWN + 2 * NEAR
    rows = [document_lines(t) for t in texts]
    use = [i for i, (x, _) in enumerate(rows) if len(x)]
    if not use or labels[use].min() == labels[use].max():
        return LineField(np.zeros(d), np.ones(d), np.zeros(d + 1), np.zeros((2, 2)),
                         *logistic_1d(np.zeros(len(labels)), labels))
    x = np.vstack([rows[i][0] for i in use])
    owner = np.repeat(use, [len(rows[i][0]) for i in use])
    mean, spread = x.mean(0), x.std(0)
    spread[spread < 1e-6] = 1.0
    z = (x - mean) / spread
    y = labels[owner].astype(float)
    # every class of documents weighs the same, however many lines it has
    w = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
    b = _logistic(z, y, w)
    p = 1 / (1 + np.exp(-np.clip(np.column_stack([z, np.ones(len(z))]) @ b, -30, 30)))
    relabelled = (y == 0) & (p > 0.8)
    worst = pd.Series(p).groupby(owner).transform("min").to_numpy()
    y = np.where(relabelled & (p > worst), 1.0, y)
    w = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
    field = LineField(mean, spread, _logistic(z, y, w), np.zeros((2, 2)))
    starts = np.searchsorted(owner, use)
    place = {i: (s, s + len(rows[i][0])) for i, s in zip(use, starts)}
    seen = np.zeros((2, 2))
    for a, c in place.values():
        k = y[a:c].astype(int)
        np.add.at(seen, (k[:-1], k[1:]), 1)
    groups = list(chains([z[a:c, 0] for a, c in place.values()]))
    spans = list(place.values())
    fast, slow, t_fast, t_slow = np.zeros(d + 1), np.zeros(d + 1), np.zeros((2, 2)), np.zeros((2, 2))
    for step in range(1, rounds + 1):
        e = z @ field.weights[:-1] + field.weights[-1]
        marginal, expected = np.zeros(len(z)), np.zeros((2, 2))
        for at, padded, sizes in groups:
            full = np.zeros_like(padded)
            for k, j in enumerate(at):
                a, c = spans[j]
                full[k, :c - a] = e[a:c]
            g, pairs = forward_backward(full, sizes, field.trans)
            expected += pairs
            for k, j in enumerate(at):
                a, c = spans[j]
                marginal[a:c] = g[k, :c - a]
        grad = np.append(z.T @ (w * (y - marginal)), (w * (y - marginal)).sum()) - 1e-3 * field.weights
        t_grad = (seen - expected) / max(1.0, seen.sum()) - 1e-3 * field.trans
        fast, slow = 0.9 * fast + 0.1 * grad, 0.99 * slow + 0.01 * grad ** 2
        t_fast, t_slow = 0.9 * t_fast + 0.1 * t_grad, 0.99 * t_slow + 0.01 * t_grad ** 2
        a, c = 1 - 0.9 ** step, 1 - 0.99 ** step
        field.weights = field.weights + 0.05 * (fast / a) / (np.sqrt(slow / c) + 1e-8)
        field.trans = np.clip(field.trans + 0.05 * (t_fast / a) / (np.sqrt(t_slow / c) + 1e-8), -4, 4)
    field.slope, field.level = logistic_1d(field.quality(list(texts)), labels)
    return field


def quality(text: Column, field: LineField) -> Column:
    """Score column (0 to 1)."""

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        worker_memo("quality_crf", dict)  # none of its own: drops the one of a stage before
        for s in batches:
            yield pd.Series(field.scores(s.tolist()), dtype="float64")

    return run(text)


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> LineField:
    """Fitted on at most ``per_class`` documents of each class outside the held-out third."""
    rows = training_rows(docs, labels, "quality", fold(F.col("doc_id"), FOLDS) != HELD_OUT, per_class)
    return fit(rows["text"].tolist(), rows["label"].to_numpy())


def score(docs: DataFrame, field: LineField) -> DataFrame:
    return docs.withColumn("score", quality(F.col("text"), field))


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    out = score(docs.select("doc_id", "text"), train(docs, labels))
    return out.select("doc_id", F.coalesce(fold(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"),
                      "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
