"""Bounded samples of labelled documents for fitting classifiers."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatemeter.llm.common import discard, written

MAX_TRAIN_CHARS = 60_000


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id's decimal text modulo ``folds`` (null ids: null)."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def training_rows(docs: DataFrame, labels: DataFrame, label: str, train: Column, per_class: int,
                  max_chars: int = MAX_TRAIN_CHARS) -> pd.DataFrame:
    """At most ``per_class`` labelled texts of each class: columns text, label.

    A fixed pseudo-random choice by id over the rows that ``train`` (a condition
    on ``doc_id``) allows and that ``docs`` holds.  Texts above ``max_chars`` are left out of the fit so
    that the sample's size is bounded; they are scored like any other.  Rows of
    an id with two labels count with the larger one; null labels are ignored.
    """
    ids = (labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & train)
           .groupBy("doc_id").agg(F.max(label).alias("label")))
    texts = docs.select("doc_id", "text").where(F.length("text").between(1, max_chars))
    there = written(texts.select("doc_id").join(ids, "doc_id").distinct())
    picked = None
    for value in (0, 1):
        one = (there.where(F.col("label") == value)
               .orderBy(F.xxhash64(F.lit(label), "doc_id"), "doc_id").limit(per_class))
        picked = one if picked is None else picked.unionByName(one)
    # at most 2 * per_class ids of 16 bytes
    rows = (texts.join(F.broadcast(picked), "doc_id").groupBy("doc_id", "label").agg(F.max("text").alias("text")))
    out = rows.select("doc_id", "text", "label").toPandas()
    discard(there)
    return out.sort_values("doc_id", kind="stable").reset_index(drop=True)


def logistic(x, y, ridge: float = 1e-3, rounds: int = 60, positive: float = 0.5):
    """Weights and offset (last) of P(y=1) = sigmoid(x w + offset); class 1 has ``positive`` of all weight."""
    import numpy as np

    x, y = np.asarray(x, dtype=float), np.asarray(y, dtype=float)
    mid, spread = x.mean(0), x.std(0)
    spread[spread < 1e-9] = 1.0
    z = np.column_stack([(x - mid) / spread, np.ones(len(x))])
    w = np.where(y == 1, positive / max(1.0, y.sum()), (1 - positive) / max(1.0, len(y) - y.sum()))
    keep = np.full(z.shape[1], ridge)
    keep[-1] = 1e-6
    b = np.zeros(z.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
        step = np.linalg.solve((z * (w * p * (1 - p))[:, None]).T @ z + np.diag(keep), z.T @ (w * (p - y)) + keep * b)
        b -= np.clip(step, -3, 3)
        if abs(step).max() < 1e-9:
            break
    out = b.copy()
    out[:-1] /= spread
    out[-1] -= out[:-1] @ mid
    return out


def logistic_1d(x, y, ridge: float = 1e-2, rounds: int = 60) -> tuple[float, float]:
    """Slope and offset of P(y=1) = sigmoid(slope * x + offset), classes weighted equally."""
    import numpy as np

    x, y = np.asarray(x, dtype=float), np.asarray(y, dtype=float)
    if len(x) == 0 or y.min() == y.max():
        return 0.0, (6.0 if len(y) and y.min() == 1 else -6.0)
    mid, spread = x.mean(), x.std() or 1.0
    z = np.column_stack([(x - mid) / spread, np.ones_like(x)])
    w = np.where(y == 1, 0.5 / y.sum(), 0.5 / (len(y) - y.sum()))
    b = np.zeros(2)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
        grad = z.T @ (w * (p - y)) + ridge * np.array([b[0], 0.0])
        hess = (z * (w * p * (1 - p))[:, None]).T @ z + np.diag([ridge, 1e-6])
        step = np.linalg.solve(hess, grad)
        b -= np.clip(step, -3, 3)
        if abs(step).max() < 1e-9:
            break
    return float(b[0] / spread), float(b[1] - b[0] * mid / spread)
