"""Near copies by SimHash and the likeness of shingle sets: of every group one document stays.

Two texts are near copies if the Jaccard likeness of their sets of 5-word shingles is 0.8 or more.  Candidates are texts
that SimHash links, by fingerprints of those shingles at two or fewer differing bits, as ``simhash`` finds and links them.
Near copies differ in up to about 11 bits, and covering masks for these would take 2^12 - 1 tables, so further candidates
come from MinHash: 48 bands of 8 minima, so a pair of likeness s meets in no band with probability (1 - s^8)^48, 1.5e-4 at
0.8.  Documents linked by either form a candidate group.  The texts of a group stream through one task in the
order of their ids, and a text stays unless one that stayed before it is its near copy by exact comparison.  So no two
texts that stay in a group are near copies, and everything that goes has a near copy that stays.

A task holds the sets of the texts that stay, not of the copies, and compares a text only with those that share one of
its first shingles: of two sets of likeness s, sorted alike, the first n - ceil(s n) + 1 elements of each have one in common.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.components import components
from graphloom.llm.shared import cut, free_name, lean, slices
from graphloom.llm.simhash import _LOWER, fingerprint, near_links

BANDS, ROWS = 48, 8
_RANDOM = np.random.default_rng(42)
FACTORS = _RANDOM.integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
SHIFTS = _RANDOM.integers(0, 1 << 63, BANDS * ROWS, np.uint64)


def normal_words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()


def shingle_set(words: list[bytes], size: int = 5) -> np.ndarray:
    """The sorted distinct hashes of the shingles; fewer words than a shingle has are one shingle, no words one of nothing."""
    shingles = set(map(b" ".join, zip(*(words[k:] for k in range(size))))) if len(words) >= size else {b" ".join(words)}
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, shingles), np.uint64, len(shingles)))


def bands(hashes: np.ndarray) -> list[int]:
    """A key for each band."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(hashes), 512):
        least = np.minimum(least, (hashes[None, k : k + 512] * FACTORS[:, None] + SHIFTS[:, None]).min(axis=1))
    return [xxhash.xxh64_intdigest(least[t * ROWS : (t + 1) * ROWS].tobytes(), t) for t in range(BANDS)]


class Kept:
    """The sets of the texts that stay, found again by their first elements."""

    def __init__(self, similarity: float) -> None:
        self.similarity, self.sets, self.by = similarity, [], {}

    def like(self, a: np.ndarray, b: np.ndarray) -> bool:
        shared = len(np.intersect1d(a, b, assume_unique=True))
        return shared >= self.similarity * (len(a) + len(b) - shared) - 1e-9

    def holds(self, hashes: np.ndarray) -> bool:
        """Whether a near copy stayed; if not, this one stays."""
        n = len(hashes)
        first = hashes[: n - math.ceil(self.similarity * n - 1e-9) + 1].tolist()
        for i in sorted({i for h in first for i in self.by.get(h, ())}):
            if self.like(hashes, self.sets[i]):
                return True
        for h in first:
            self.by.setdefault(h, []).append(len(self.sets))
        self.sets.append(hashes)
        return False


def _marks(docs: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """``(doc_id, text_hash, node, fp, bands)``; texts of the same words are one node, fp is their SimHash fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 2):
            nodes, prints, keys = [], [], []
            for text in b.column(2).to_pylist():
                words = normal_words(text)
                nodes.append(xxhash.xxh64_intdigest(b" ".join(words)))
                prints.append(fingerprint(text, size))
                keys.append(bands(shingle_set(words, size)))
            node, fp = (pa.array(np.array(x, np.uint64).view(np.int64)) for x in (nodes, prints))
            flat = pa.array(np.array(keys, np.uint64).reshape(-1).view(np.int64))
            lists = pa.ListArray.from_arrays(pa.array(range(0, len(nodes) * BANDS + 1, BANDS), pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), node, fp, lists], ["doc_id", "text_hash", "node", "fp", "bands"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).cast("string")).where("doc_id is not null")
    return rows.mapInArrow(lean(run), "doc_id long, text_hash long, node long, fp long, bands array<long>")


def candidates(marks: DataFrame) -> DataFrame:
    """``marks (node, fp, bands)`` -> links ``(a, b)`` between nodes that SimHash links or that have a band in common."""
    prints = marks.select("node", "fp").distinct()
    reps = cut(prints.groupBy("fp").agg(F.min("node").alias("rep")))
    equal = prints.join(reps, "fp").select(F.col("rep").alias("a"), F.col("node").alias("b"))
    keys = marks.select("node", F.explode("bands").alias("key"))
    met = keys.groupBy("key").agg(F.min("node").alias("a"), F.max("node").alias("z")).where("a <> z").select("key", "a")
    banded = keys.join(cut(met), "key").select("a", F.col("node").alias("b"))
    return near_links(reps).unionByName(equal).unionByName(banded).where("a <> b").distinct()


def _gone(groups: DataFrame, size: int, similarity: float) -> DataFrame:
    """``groups (component, doc_id, node, text)`` -> the nodes that have a near copy that stays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, last, kept = None, None, Kept(similarity)
        for b in slices(batches, 3):
            out = []
            for component, node, text in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist()):
                if component != at:
                    at, last, kept = component, None, Kept(similarity)
                if node == last:  # a repeated row
                    continue
                last = node
                if kept.holds(shingle_set(normal_words(text), size)):
                    out.append(node)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.int64())], ["node"])

    return groups.repartition("component").sortWithinPartitions("component", "doc_id", "node").mapInArrow(lean(run), "node long")


def survivors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, similarity: float = 0.8) -> DataFrame:
    """``(doc_id, text_hash, n)`` of the documents that stay; text_hash is Spark's xxhash64 of the text, n the rows that have both."""
    marks = cut(_marks(docs, id_col, text_col, size))
    nodes = marks.groupBy("node").agg(F.min(F.struct("doc_id", "text_hash")).alias("first"))
    found = components(candidates(marks))
    alike = nodes.join(found, "node").select("component", "node", "first")
    own = (F.col("first.doc_id") == F.col("id")) & (F.col("first.text_hash") == F.col("hash"))
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("hash"), F.col(text_col).cast("string").alias("text"))
    groups = texts.join(alike, own).select("component", F.col("first.doc_id").alias("doc_id"), "node", "text")
    stay = nodes.join(cut(_gone(groups, size, similarity)), "node", "left_anti").select("first.*")
    return stay.join(marks.groupBy("doc_id", "text_hash").agg(F.count("*").alias("n")), ["doc_id", "text_hash"])


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, similarity: float = 0.8) -> DataFrame:
    """The documents that have no near copy among those that stay, with all their columns; the smallest id of a group stays.

    Texts that differ only in case and white space are copies, texts without words are copies of each other, and a text
    of fewer words than a shingle has is one shingle.  Rows with a null id stay.  A repeated id with different texts is
    a document for each text; of rows that repeat an id and a text one stays.
    """
    of, hashed, n, row = (free_name(docs, c) for c in ("kept", "hash", "n", "row"))
    kept = cut(survivors(docs, id_col, text_col, size, similarity).select(F.col("doc_id").alias(of), F.col("text_hash").alias(hashed), F.col("n").alias(n)))
    own, text_hash = F.col(id_col).cast("long"), F.xxhash64(text_col)
    same = (own == F.col(of)) & (text_hash == F.col(hashed))
    single = docs.join(kept.where(F.col(n) == 1), same, "left").where(F.col(of).isNotNull() | own.isNull())
    order = Window.partitionBy(of, hashed).orderBy(F.xxhash64(*docs.columns))
    again = docs.join(kept.where(F.col(n) > 1), same).withColumn(row, F.row_number().over(order)).where(F.col(row) == 1)
    return single.select(*docs.columns).unionByName(again.select(*docs.columns))
