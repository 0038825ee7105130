"""Vectors as ``array<double>`` columns, and the default embedder: feature hashing of words."""

from __future__ import annotations

from hashlib import md5

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

DIMENSIONS = 64


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column, epsilon: float = 1e-10) -> Column:
    """Divided by its length plus epsilon: a zero vector stays zero."""
    return F.transform(a, lambda x: x.cast("double") / (norm(a) + epsilon))


#: About so many bytes of texts are cut into words at a time.
PART = 16 << 20


def _hit(texts: pa.Array) -> np.ndarray:
    """How often each text hits each bucket: a word's is the end of its MD5's first four bytes, made once for equal words."""
    words = pc.utf8_split_whitespace(texts)  # with empty words where a text begins or ends with white space
    sizes = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False)
    coded = words.flatten().dictionary_encode()
    buckets = np.array([md5(w.encode(), usedforsecurity=False).digest()[3] % DIMENSIONS if w else -1 for w in coded.dictionary.to_pylist()], np.int64)
    at = buckets[coded.indices.to_numpy()] if len(coded) else np.zeros(0, np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    return np.bincount((row * DIMENSIONS + at)[at >= 0], minlength=len(sizes) * DIMENSIONS).reshape(-1, DIMENSIONS).astype(float)


@F.arrow_udf(ArrayType(DoubleType()))
def _counted(texts: pa.Array) -> pa.Array:
    past, at, out = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)), 0, []
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(past, (past[at - 1] if at else 0) + PART, side="right")))
        counts = _hit(texts.slice(at, to - at))
        out.append((counts / (np.sqrt((counts**2).sum(axis=1, keepdims=True)) + 1e-10)).ravel())
        at = to
    values = pa.array(np.concatenate(out) if out else np.zeros(0))
    return pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * DIMENSIONS), values)


def embed(text: Column) -> Column:
    """How often each bucket is hit by the words of a text, in lower case; unit length, or zero for a text without words."""
    return _counted(F.lower(text))


def usable(a: Column) -> Column:
    """Whether a vector has a length: neither zero nor without a number."""
    return F.element_at(F.transform(F.array(norm(a)), lambda n: (n > 0) & ~F.isnan(n)), 1)


def unit_of(a: Column) -> Column:
    """Unit length, computed once per array."""
    return F.element_at(F.transform(F.array(a), lambda v: F.element_at(F.transform(F.array(norm(v)), lambda n: F.transform(v, lambda x: x / (n + F.lit(1e-10)))), 1)), 1)
