"""What the two classifiers share: the bounded training sample, hashing of text, logistic regression."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.encoding import portions
from graphloom.llm.shared import lean, slices

FOLDS = 5


def fold(doc_id: Column, folds: int = FOLDS) -> Column:
    """crc32 of the id as text, modulo the number of folds; fold 0 is held out."""
    return F.crc32(doc_id.cast("string")) % folds


def fitted(docs: DataFrame, labels: DataFrame, label: str, rows: int, chars: int, train: Callable[[list[str], np.ndarray], Any], id_col: str = "doc_id", text_col: str = "text") -> Any:
    """``train(texts, labels)`` over at most ``rows`` labelled documents outside fold 0 and about ``chars`` characters in all.

    The sample is the first rows in the order of a hash of the id, so it is the same however the tables are stored.  Ids
    whose label rows disagree, null labels and labels other than 0 and 1 are left out; texts are taken whole.  Its bounds
    fit one task, where the model is trained; the driver receives the model alone, and a lost task is run again.
    """
    agreed = labels.where(f"{label} in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("__id")).agg(F.min(label).alias("__label"), F.max(label).alias("__other")).where("__label = __other").where(fold(F.col("__id")) != 0)
    key = F.col(id_col).cast("long").alias("__id")
    chosen = agreed.join(docs.select(key), "__id", "left_semi").orderBy(F.xxhash64("__id"), "__id").limit(rows)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("__text")
    # At most ``rows`` ids are broadcast, so no text is shuffled but those of the sample.
    first = docs.select(key, text).join(F.broadcast(chosen), "__id").orderBy(F.xxhash64("__id"), "__id", "__text").limit(rows).select("__text", F.col("__label").cast("double").alias("y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, known, held = [], [], 0
        for b in batches:
            for text, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if held <= chars:
                    texts.append(text)
                    known.append(y)
                    held += len(text)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(train(texts, np.array(known)))], pa.binary())], ["model"])

    made = first.coalesce(1).mapInArrow(lean(run), "model binary").collect()
    return pickle.loads(made[0]["model"]) if made else train([], np.empty(0))


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All characters of some texts as numbers, and where each text begins (one more entry for the end)."""
    ends = np.cumsum([0] + [len(t) for t in texts])
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64), ends


def mixed(h: np.ndarray, bits: int) -> np.ndarray:
    """The upper bits of a multiplicative hash."""
    h = h * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    return (h * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - bits)).astype(np.int64)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def scored(docs: DataFrame, scores: Callable[[list[str | None]], np.ndarray], text_col: str, name: str = "score") -> DataFrame:
    """``docs`` and a new column of scores, computed from whole texts in portions of bounded size."""
    place, schema = docs.columns.index(text_col), docs.withColumn(name, F.lit(0.0)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, place):
            texts = b.column(place).to_pylist()
            found = [scores(texts[i:j]) for i, j in portions(texts, 500_000)]
            values = np.concatenate(found) if found else np.empty(0)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(values, pa.float64())], [*b.schema.names, name])

    return docs.mapInArrow(lean(run), schema)
