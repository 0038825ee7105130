"""Toxicity by a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

A text is the set of its n-grams of 4 to 7 characters, in lower case with white space as one space, hashed into a fixed
number of features.  Over the labelled sample each feature has the ratio of its smoothed share in toxic documents to that
in others; its logarithm scales the feature.  Features whose shares differ by less than sampling error are left out, so a
long text is not scored by the sum of many accidental ones.  A logistic regression with an L2 penalty on top of the
scaled features gives the score.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.encoding import portions
from graphloom.llm.labelled import code_points, fitted, fold, mixed, scored, sigmoid
from graphloom.llm.shared import free_name

SPACE = re.compile(r"\s+")


@dataclass(frozen=True)
class Settings:
    orders: tuple[int, ...] = (4, 5, 6, 7)
    bits: int = 20
    smoothing: float = 1.0
    least_z: float = 4.5  # standard errors between the two shares
    penalty: float = 1.0
    rounds: int = 250
    sample_rows: int = 4_000
    sample_chars: int = 14_000_000


SETTINGS = Settings()


def features(texts: list[str | None], s: Settings = SETTINGS, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(text number, feature), each pair once; only features that are ``wanted``."""
    clean = [" " + SPACE.sub(" ", t or "").strip().lower() + " " for t in texts]
    codes, ends = code_points(clean)
    of = np.repeat(np.arange(len(clean)), np.diff(ends))
    pairs = []
    h = codes.copy()
    for n in range(2, max(s.orders) + 1):
        h = h[: len(codes) - n + 1] * np.uint64(1_000_003) + codes[n - 1 :]
        if n not in s.orders or not len(h):
            continue
        f = mixed(h + np.uint64(n), s.bits)
        inside = of[: len(h)] == of[n - 1 :]
        at = np.nonzero(inside if wanted is None else inside & wanted[f])[0]
        pairs.append(np.unique(of[at] << s.bits | f[at]))
    found = np.unique(np.concatenate(pairs)) if pairs else np.empty(0, np.int64)
    return found >> s.bits, found & (1 << s.bits) - 1


@dataclass
class Model:
    ids: np.ndarray  # the features kept, in order
    weights: np.ndarray  # of each, the log-count ratio times what was learned
    bias: float
    settings: Settings

    def __post_init__(self):
        self.wanted = np.zeros(1 << self.settings.bits, bool)
        self.wanted[self.ids] = True

    def __reduce__(self):
        return Model, (self.ids, self.weights, self.bias, self.settings)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        text, feature = features(texts, self.settings, self.wanted)
        return sigmoid(self.bias + np.bincount(text, self.weights[np.searchsorted(self.ids, feature)] if len(feature) else [], len(texts)))


def train(texts: list[str | None], toxic: np.ndarray, s: Settings = SETTINGS) -> Model:
    """Without both labels in the sample the model gives the labels' share (or 0) to every text."""
    size = 1 << s.bits
    n_toxic, n = float(toxic.sum()), len(texts)
    if not 0 < n_toxic < n:
        share = (n_toxic + 1e-3) / (n + 1)
        return Model(np.empty(0, np.int64), np.empty(0), float(np.log(share / (1 - share))), s)
    present = np.zeros((2, size))
    for i, j in portions(texts, 500_000):
        text, feature = features(texts[i:j], s)
        hit = toxic[i:j][text] > 0
        present[1] += np.bincount(feature[hit], minlength=size)
        present[0] += np.bincount(feature[~hit], minlength=size)
    share = (present + s.smoothing) / (np.array([[n - n_toxic], [n_toxic]]) + 2 * s.smoothing)
    ratio = np.log(share[1] / share[0])
    both = present.sum(axis=0) / n
    error = np.sqrt(np.maximum(both * (1 - both), 1e-12) * (1 / n_toxic + 1 / (n - n_toxic)))
    kept = np.abs(present[1] / n_toxic - present[0] / (n - n_toxic)) > s.least_z * error
    kept &= present.sum(axis=0) > 0
    rows, columns = [], []
    for i, j in portions(texts, 500_000):
        text, feature = features(texts[i:j], s, kept)
        rows.append(text + i)
        columns.append(feature)
    row, column = np.concatenate(rows), np.concatenate(columns)
    x = ratio[column]
    bias = float(np.log(n_toxic / (n - n_toxic)))
    ids, place = np.unique(column, return_inverse=True)
    w = np.zeros(len(ids))
    # Gradient steps of Adam over the whole sample: few features are left and their number is bounded.
    m, v, mb, vb = np.zeros(len(ids)), np.zeros(len(ids)), 0.0, 0.0
    for t in range(1, s.rounds + 1):
        p = sigmoid(bias + np.bincount(row, w[place] * x, n))
        g = np.bincount(place, (p - toxic)[row] * x, len(ids)) + s.penalty * w
        gb = float((p - toxic).sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        rate = 0.05 / (1 - 0.9**t) * np.sqrt(1 - 0.999**t)
        w, bias = w - rate * m / (np.sqrt(v) + 1e-9), bias - rate * mb / (vb**0.5 + 1e-9)
    return Model(ids, w * ratio[ids], bias, s)


def fit(docs: DataFrame, labels: DataFrame, s: Settings = SETTINGS, label: str = "toxic") -> Model:
    return fitted(docs, labels, label, s.sample_rows, s.sample_chars, lambda texts, toxic: train(texts, toxic, s))


def score_documents(docs: DataFrame, model: Model, text_col: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with a new column (double, 0 to 1); only the text is an input.

    A null text is scored as an empty one.  Every whole text is scored, in portions of bounded size.
    """
    return scored(docs, model.scores, text_col, name)


def toxicity_scores(docs: DataFrame, labels: DataFrame, s: Settings = SETTINGS, threshold: float = 0.5) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for every row of ``docs``.

    Repeated ids are scored row by row; a null id has a null ``held_out``; empty tables give no rows; without usable
    labels every score is the same (see ``train``); other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = score_documents(rows, fit(docs, labels, s))
    return out.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame, s: Settings = SETTINGS, threshold: float = 0.5) -> DataFrame:
    """The documents with a score below the threshold, with all their columns, whatever their names.

    Null and empty texts are scored like any other, rows that repeat an id row by row, a very long text in whole; rows with
    a null id are scored too, and an empty table gives none.
    """
    name = free_name(docs, "score")
    return score_documents(docs, fit(docs, labels, s), name=name).where(F.col(name) < threshold).drop(name)
