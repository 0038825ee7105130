"""Vectors of texts against their definition."""

from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from graphloom.functions import text as T
from graphloom.functions import vectors


def test_words_are_those_of_tokens_at_every_white_space(spark, monkeypatch):
    monkeypatch.setattr(vectors, "PART", 64)
    odd = [None, "", " ", "a", " A  b\n", "İstanbul ΣΑΣ ß", "x" * 200, "Ann met Bob. Ann left " * 9]
    odd += [f"p{chr(c)}q {chr(c)}" for c in (*range(1, 0x300), 0x1680, 0x180E, *range(0x2000, 0x2070), 0x3000, 0xFEFF, 0x1F600)]
    df = spark.createDataFrame(list(enumerate(odd)), "id int, text string")
    for r in df.select("id", T.tokens(F.lower("text")).alias("w"), vectors.embed(F.col("text")).alias("v")).collect():
        counts = np.zeros(vectors.DIMENSIONS)
        for w in r["w"] or []:
            counts[int(md5(w.encode()).hexdigest()[:8], 16) % vectors.DIMENSIONS] += 1
        assert r["v"] == (counts / (np.sqrt((counts**2).sum()) + 1e-10)).tolist(), odd[r["id"]]


def test_equal_words_are_hashed_once(monkeypatch):
    """Of a text of 30,000 words, three; every word was hashed by itself before."""
    hashed = []
    monkeypatch.setattr(vectors, "md5", lambda *a, **b: hashed.append(a) or md5(*a, **b))
    assert vectors._hit(pa.array(["a b c " * 10_000, None, ""])).sum(axis=1).tolist() == [30_000, 0, 0] and len(hashed) == 3
