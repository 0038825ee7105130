"""Quality by attention-based multiple-instance learning over passages.

A document is a bag of passages, the windows of ``PASSAGE`` characters that cover its whole text; labels are known for
documents only.  A passage is described by the frequencies of pairs of character classes, by how many of its words are
distinct and how long they are, and encoded by one layer, h = tanh(E x).  Gated attention, a = softmax(w (tanh(V h) *
sigmoid(U h))), weighs the passages of a document against each other, and a logistic layer scores the weighted sum of
their codes.  All weights are learned together from document labels by Adam.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.labelled import code_points, fitted, fold, scored, sigmoid
from graphloom.llm.shared import free_name

PASSAGE = 400
CLASSES = 12
WIDTH = CLASSES * CLASSES + 5


@dataclass(frozen=True)
class Settings:
    codes: int = 24
    attention: int = 16
    epochs: int = 40
    batch: int = 64
    rate: float = 0.004
    decay: float = 1e-4
    seed: int = 7
    sample_rows: int = 6_000
    sample_chars: int = 20_000_000


SETTINGS = Settings()


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """The class of every code point, from its Unicode category; frequent marks have classes of their own."""
    own = {" ": 3, "\n": 4, ".": 5, ",": 6, "!": 7}
    kinds = {"Ll": 0, "Lu": 1, "Nd": 2, "Zs": 3, "Cc": 4, "Po": 8, "Sm": 9, "Sc": 9, "So": 9, "Sk": 9}
    out = np.full(0x110000, 11, np.int64)
    for c in range(0x3000):  # beyond, letters without case and everything else are one class
        kind = unicodedata.category(chr(c))
        out[c] = own.get(chr(c), kinds.get(kind, 10 if kind[0] == "P" else 11))
    return out


def passages(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The description of every passage, and how many each text has; an empty text has one empty passage."""
    cut = [[t[k : k + PASSAGE] for k in range(0, len(t), PASSAGE)] if t else [""] for t in texts]
    flat = [p for own in cut for p in own]
    codes, ends = code_points(flat)
    kind = classes()[codes.astype(np.int64)]
    size = np.diff(ends)
    of = np.repeat(np.arange(len(flat)), size)
    pair = kind[:-1] * CLASSES + kind[1:] if len(kind) else kind
    inside = of[:-1] == of[1:]
    counts = np.bincount((of[:-1] * CLASSES**2 + pair)[inside] if len(kind) else [], minlength=len(flat) * CLASSES**2).reshape(len(flat), -1).astype(float)
    words = [p.split() for p in flat]
    n = np.array([len(w) for w in words], float)
    distinct = np.array([len(set(w)) for w in words], float)
    letters = np.array([len(set(p)) for p in flat], float)
    rest = np.stack([distinct / np.maximum(n, 1), n / np.maximum(size, 1), np.log1p(size), letters / np.maximum(size, 1), (n > 0).astype(float)], axis=1)
    return np.hstack([counts / np.maximum(size, 1)[:, None], rest]), np.array([len(own) for own in cut])


@dataclass
class Model:
    mean: np.ndarray
    spread: np.ndarray
    weights: dict[str, np.ndarray]

    def forward(self, x: np.ndarray, sizes: np.ndarray) -> dict[str, np.ndarray]:
        p, starts = self.weights, np.append(0, np.cumsum(sizes)[:-1])
        h = np.tanh(x @ p["E"] + p["e"])
        t, g = np.tanh(h @ p["V"]), sigmoid(h @ p["U"])
        raw = (t * g) @ p["w"]
        a = np.exp(raw - np.repeat(np.maximum.reduceat(raw, starts), sizes))
        a /= np.repeat(np.add.reduceat(a, starts), sizes)
        z = np.add.reduceat(a[:, None] * h, starts, axis=0)
        return {"h": h, "t": t, "g": g, "a": a, "z": z, "y": sigmoid(z @ p["c"] + p["d"]), "starts": starts}

    def normal(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.spread, -6, 6)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if not texts:
            return np.empty(0)
        x, sizes = passages(texts)
        return self.forward(self.normal(x), sizes)["y"]


def _gradients(model: Model, x: np.ndarray, sizes: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    p, f = model.weights, model.forward(x, sizes)
    each = np.repeat(np.arange(len(sizes)), sizes)
    dlogit = (f["y"] - y) / len(y)
    dz = dlogit[:, None] * p["c"]
    da = (dz[each] * f["h"]).sum(axis=1)
    draw = f["a"] * (da - np.add.reduceat(f["a"] * da, f["starts"])[each])
    dtg = draw[:, None] * p["w"]
    dt, dg = dtg * f["g"] * (1 - f["t"] ** 2), dtg * f["t"] * f["g"] * (1 - f["g"])
    dh = (f["a"][:, None] * dz[each] + dt @ p["V"].T + dg @ p["U"].T) * (1 - f["h"] ** 2)
    return {"E": x.T @ dh, "e": dh.sum(axis=0), "V": f["h"].T @ dt, "U": f["h"].T @ dg, "w": (f["t"] * f["g"]).T @ draw, "c": f["z"].T @ dlogit, "d": np.array(dlogit.sum())}


def train(texts: list[str], good: np.ndarray, s: Settings = SETTINGS) -> Model:
    """The same sample gives the same model.  An empty sample gives scores of one half."""
    r = np.random.default_rng(s.seed)
    shape = {"E": (WIDTH, s.codes), "e": (s.codes,), "V": (s.codes, s.attention), "U": (s.codes, s.attention), "w": (s.attention,), "c": (s.codes,), "d": ()}
    weights = {k: r.normal(0, n[0] ** -0.5, n) if len(n) > 1 else np.zeros(n) for k, n in shape.items()}
    weights["w"], weights["c"] = r.normal(0, 0.1, s.attention), r.normal(0, 0.1, s.codes)
    if not texts:
        return Model(np.zeros(WIDTH), np.ones(WIDTH), weights | {"c": np.zeros(s.codes)})
    made = [passages(texts[k : k + 200]) for k in range(0, len(texts), 200)]
    x, sizes = np.vstack([m[0] for m in made]), np.concatenate([m[1] for m in made])
    model = Model(x.mean(axis=0), x.std(axis=0) + 1e-3, weights)
    x = model.normal(x)
    starts = np.append(0, np.cumsum(sizes))
    first = {k: np.zeros_like(v) for k, v in weights.items()}
    second = {k: np.zeros_like(v) for k, v in weights.items()}
    step = 0
    for epoch in range(s.epochs):
        order = r.permutation(len(texts))
        rate = s.rate * (1 - epoch / s.epochs)
        for k in range(0, len(order), s.batch):
            of = order[k : k + s.batch]
            rows = np.concatenate([np.arange(starts[i], starts[i + 1]) for i in of])
            step += 1
            for name, g in _gradients(model, x[rows], sizes[of], good[of]).items():
                first[name] = 0.9 * first[name] + 0.1 * g
                second[name] = 0.999 * second[name] + 0.001 * g * g
                move = first[name] / (1 - 0.9**step) / (np.sqrt(second[name] / (1 - 0.999**step)) + 1e-8)
                weights[name] = weights[name] - rate * (move + s.decay * weights[name])
    return model


def fit(docs: DataFrame, labels: DataFrame, s: Settings = SETTINGS, label: str = "quality") -> Model:
    return fitted(docs, labels, label, s.sample_rows, s.sample_chars, lambda texts, good: train(texts, good, s))


def quality_scores(docs: DataFrame, labels: DataFrame, s: Settings = SETTINGS, threshold: float = 0.3) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for every row of ``docs``; only the text is an input of a score.

    A null text is scored as an empty one.  Repeated ids are scored row by row; a null id has a null ``held_out``; empty
    tables give no rows; other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = scored(rows, fit(docs, labels, s).scores, "text")
    return out.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, s: Settings = SETTINGS, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """The documents that reach the threshold, with all their columns, whatever their names.

    Null and empty texts are scored like any other, rows that repeat an id row by row, a very long text in whole; rows with
    a null id are scored too, and an empty table gives none.
    """
    name = free_name(docs, "score")
    return scored(docs, fit(docs, labels, s).scores, text_col, name).where(F.col(name) >= threshold).drop(name)
