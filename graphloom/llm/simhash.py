"""Near-duplicates by SimHash fingerprints and covering locality-sensitive hashing.

A fingerprint is the bitwise majority over the XXH64 hashes of a text's 3-word shingles.  Fingerprints within the
radius r = 2 are found without any chance of a miss: every bit position i carries a nonzero vector p(i) of r + 1 bits,
and table v (a nonzero vector of r + 1 bits) keeps the positions with an odd inner product <p(i), v>.  At most r
vectors p(i) of differing positions cannot span r + 1 dimensions, so some v is orthogonal to all of them: in table v
both fingerprints have the same key.

Equal fingerprints count once.  A bucket of more than ``split_above`` fingerprints is dealt again by a second covering
family over the bits its table leaves free; as that leaves at most 12 bits free, no bucket then holds more than 4,096
fingerprints whatever the data.  Inside a bucket, blocks of fingerprints are compared and only the links of a spanning
forest leave it, so the links of one text grow with the number of tables and not with the size of its group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.components import components
from graphloom.llm.shared import cut, free_name

RADIUS = 2
SEED = 42


def covering_masks(positions: list[int], radius: int = RADIUS) -> list[int]:
    """Masks over the given bit positions; any pair differing in at most ``radius`` of them agrees under one."""
    top = 1 << (radius + 1)
    vector = {p: 1 + k % (top - 1) for k, p in enumerate(positions)}
    return [sum(1 << p for p in positions if (vector[p] & v).bit_count() & 1) for v in range(1, top)]


TABLES = covering_masks(list(range(64)))
#: For each table, the masks that deal its buckets again: its own bits and a covering family over the others.
SECOND = [[m | extra for extra in covering_masks([p for p in range(64) if not m >> p & 1])] for m in TABLES]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprint(text: str | None, size: int = 3, seed: int = SEED) -> int:
    """Bit b is 1 if it is set in over half of the hashes; no word gives 0."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return 0
    if len(words) < size:
        shingles = [b" ".join(words)]
    else:
        shingles = list(map(b" ".join, zip(*(words[k:] for k in range(size)))))
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for k in range(0, len(shingles), 16384):
        part = shingles[k : k + 16384]
        h = np.fromiter((digest(s, seed) for s in part), np.uint64, len(part))
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(shingles), bitorder="little").view("<u8")[0])


_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, fp long)``; a null or empty text has the fingerprint 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t) for t in b.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp, pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def forest(values: np.ndarray, radius: int = RADIUS) -> list[tuple[int, int]]:
    """Index pairs that span the groups of ``values`` linked within the radius: each value is compared once with those
    that no group has reached yet, so time is at most quadratic in a bucket's bounded size and memory linear."""
    out = []
    left = np.arange(len(values))
    while len(left) > 1:
        reached, left = [int(left[0])], left[1:]
        while reached and len(left):
            i = reached.pop()
            near = np.bitwise_count(values[left] ^ values[i]) <= radius
            found = left[near].tolist()
            out += [(i, j) for j in found]
            reached += found
            left = left[~near] if found else left
    return out


def _keys(reps: DataFrame, masks: list[int], tag: str) -> DataFrame:
    return reps.select("*", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(_signed(m))) for m in masks])).alias(tag, f"{tag}_key"))


def near_links(reps: DataFrame, split_above: int = 2048) -> DataFrame:
    """``reps (fp, rep)``, one row per fingerprint -> links ``(a, b)`` between reps that have the same components as all
    pairs of fingerprints within the radius."""
    first = _keys(reps, TABLES, "t")
    many = first.groupBy("t", "t_key").count().where("count > 1")
    held = first.join(many, ["t", "t_key"])
    small = held.where(F.col("count") <= split_above).select("t", F.lit(-1).alias("u"), F.col("t_key").alias("key"), "fp", "rep")
    second = F.array(*[F.array(*[F.lit(_signed(m)) for m in ms]) for ms in SECOND])
    large = (
        held.where(F.col("count") > split_above)
        .select("t", "fp", "rep", F.posexplode(F.element_at(second, F.col("t") + 1)).alias("u", "m"))
        .select("t", "u", F.col("fp").bitwiseAND(F.col("m")).alias("key"), "fp", "rep")
    )
    buckets = small.unionByName(large).groupBy("t", "u", "key").agg(F.collect_list(F.struct("rep", "fp")).alias("members")).where(F.size("members") > 1).select("members")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists, out = b.column(0), []
            flat = lists.flatten()
            rep, fp = flat.field("rep").to_numpy(), flat.field("fp").to_numpy().view(np.uint64)
            at = 0
            for n in lists.value_lengths().to_pylist():
                r = rep[at : at + n]
                out += [(r[i], r[j]) for i, j in forest(fp[at : at + n])]
                at += n
            pairs = np.array(out, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    return buckets.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` for every row of ``docs``.

    component_id is the smallest id reachable by links of at most two differing bits, the row's own included.
    Null texts, empty texts and texts without words have the fingerprint of sixteen zeros and are linked like any
    other; a repeated id gives a row for each of its rows; a null id has a null component and links nothing.  Empty
    tables give no rows; other columns are ignored.
    """
    marks = cut(fingerprints(docs, id_col, text_col))
    reps = cut(marks.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("rep")))
    # A repeated id with different texts is one node: its fingerprints are linked through it.
    ids = marks.where("doc_id is not null").groupBy("doc_id").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi"), F.count("*").alias("n"))
    torn = marks.join(ids.where("lo <> hi").select("doc_id", "lo"), "doc_id")
    own = reps.withColumnRenamed("rep", "a")
    torn = torn.join(own, "fp").select("lo", "a").join(reps.select(F.col("fp").alias("lo"), F.col("rep").alias("b")), "lo").select("a", "b")
    found = components(near_links(reps).unionByName(torn))
    of = reps.join(found, reps.rep == found.node, "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    joined = marks.join(of, "fp", "left")
    return joined.select(
        "doc_id",
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"),
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents whose id is that of their component: one of each group stays, with all its columns.

    Rows with a null id stay.
    """
    name = free_name(docs, "kept")
    kept = near_duplicates(docs, id_col, text_col).where("doc_id = component_id").select(F.col("doc_id").alias(name)).distinct()
    own = F.col(id_col).cast("long")
    return docs.join(kept, own == F.col(name), "left").where(F.col(name).isNotNull() | own.isNull()).drop(name)
