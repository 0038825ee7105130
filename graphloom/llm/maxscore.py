"""Exact top-k search over integer vectors with MaxScore on sharded inverted lists.

A vector is a bag of terms: component d with value x is the term (d, sign of x) with the impact |x|.  A query holds the
same terms; where its sign agrees with a vector's, the product is positive, where it doesn't, negative.  A shard is an
inverted index over a bounded number of vectors, with the greatest impact of every term.  Vectors are dense, so the lists of
a component's two terms are kept as one column, and lists are traversed for a block of queries at once by a matrix product.

For a query, an agreeing term has the score bound |q| x greatest impact, an opposed one 0.  A query comes with a threshold t,
its k-th score in a first shard, known before all others are searched.  Its terms are sorted by bound; the longest tail
whose bounds sum to less than ``slack`` x t is non-essential: a vector that scores less than t minus that sum in the other,
essential, lists cannot reach t (with slack 1, a vector in none of them).  Essential lists are traversed; then the other
terms are probed for the vectors still in the running, dearest first, and after some of them those go whose score plus the
bounds still to come is below t.  What is left has its exact score.  The k best of every shard are merged at the end.

A block of queries goes to every shard; no join pairs single rows.  A task reads a shard once, builds its index, and then
meets up to ``together`` blocks of queries, so its work is bounded whatever the number of queries.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.shared import cut

NONE = -(2**63)  # the threshold of a query that has none
LISTS = ("ids", "flat", "least", "hit_query", "hit_vec", "hit_score")
FOUND = "block int, width int, " + ", ".join(f"{c} array<long>" for c in LISTS)


def quantized(vector: Column, factor: int = 256) -> Column:
    """floor(factor * x) of every component; null if the vector is null or a component is null or not finite."""
    ok = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(ok, F.transform(vector, lambda x: F.floor(x.cast("double") * factor).cast("long")))


class Shard:
    """The lists of some vectors, a column for each component."""

    def __init__(self, ids: np.ndarray, values: np.ndarray):
        self.ids, self.values = ids, values
        self.agreeing = np.stack([np.maximum(x, 0).max(axis=0, initial=0) for x in (values, -values)])  # greatest impacts

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int, least: np.ndarray, slack: float = 0.5) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
        """For each query the k best (scores, ids) of those that reach its threshold, and the thresholds after them."""
        bound = np.where(queries > 0, queries * self.agreeing[0], -queries * self.agreeing[1])
        order = np.argsort(-bound, axis=1, kind="stable")
        ahead = np.cumsum(np.take_along_axis(bound, order, 1)[:, ::-1], axis=1)[:, ::-1]  # of each term and those after it
        ahead = np.concatenate([ahead, np.zeros((len(queries), 1), np.int64)], 1)
        essential = np.where(least > 0, (ahead[:, :-1] >= (slack * np.maximum(least, 0))[:, None]).sum(axis=1), queries.shape[1])
        mask = np.zeros(queries.shape, bool)
        np.put_along_axis(mask, order, np.arange(queries.shape[1]) < essential[:, None], 1)
        # Doubles hold these sums exactly, and multiply much faster; beyond them integers do.
        exact = np.abs(queries).max(initial=0).astype(float) * np.abs(self.values).max(initial=0) * max(1, queries.shape[1]) < 2**53
        kind = np.float64 if exact else np.int64
        scores = (queries * mask).astype(kind) @ self.values.astype(kind).T
        out, after = [], least.copy()
        for i, score in enumerate(scores):
            t, done = int(least[i]), int(essential[i])
            if t == NONE and len(score) > k + 1:  # its own id may be one of them
                t = int(np.partition(score, len(score) - k - 1)[len(score) - k - 1])
            held = np.nonzero(score >= t - int(ahead[i, done]))[0] if t != NONE else np.arange(len(score))
            score = score[held].astype(np.int64)
            while done < queries.shape[1] and len(held):
                part = order[i, done : done + 8]
                done += len(part)
                score = score + self.values[np.ix_(held, part)] @ queries[i, part]
                keep = score >= t - int(ahead[i, done])
                held, score = held[keep], score[keep]
            ids = self.ids[held]
            other = ids != query_ids[i]
            score, ids = score[other], ids[other]
            top = np.lexsort((ids, -score))[:k]
            out.append((score[top], ids[top]))
            if len(top) == k:
                after[i] = max(after[i], score[top[-1]])
        return out, after


def _blocks(vectors: DataFrame, n: int, name: str) -> DataFrame:
    """``(<name>, width, ids, flat)``: rows of the vectors of one length, dealt to ``n`` blocks by a hash."""
    dealt = vectors.groupBy(F.pmod(F.xxhash64("vec_id", "v"), F.lit(n)).cast("int").alias(name), F.size("v").alias("width"))
    rows = dealt.agg(F.collect_list(F.struct("vec_id", "v")).alias("r"))
    return rows.select(name, "width", F.col("r.vec_id").alias("ids"), F.flatten("r.v").alias("flat"))


def _search(asked: DataFrame, shards: DataFrame, k: int, parts: int, again: bool) -> DataFrame:
    """``asked (shard, part, block, width, ids, flat, least)`` against ``shards (shard, width, ids, flat)`` -> FOUND; the
    blocks of queries, with their thresholds, only if they are needed ``again``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, index = None, None
        thresholds: dict[tuple[int, int], np.ndarray] = {}  # of the blocks that this task met
        for b in batches:
            col = {name: b.column(i) for i, name in enumerate(b.schema.names)}
            for row in range(b.num_rows):
                shard, width, part, block = (col[c][row].as_py() for c in ("shard", "width", "part", "block"))
                ids, flat = (col[c][row].values.to_numpy(zero_copy_only=False) for c in ("ids", "flat"))
                if block < 0:
                    at, index = (shard, width, part), Shard(ids, flat.reshape(len(ids), width))
                    continue
                least = thresholds.get((block, width))
                if least is None:
                    least = col["least"][row].values.to_numpy(zero_copy_only=False)
                hits: list[tuple[np.ndarray, np.ndarray]] = [(np.empty(0, np.int64),) * 2] * len(ids)
                if at == (shard, width, part):
                    hits, least = index.search(ids, flat.reshape(len(ids), width), k, least)
                    thresholds[block, width] = least
                lists = [ids, flat, least] if again else [np.empty(0, np.int64)] * 3
                lists += [np.repeat(ids, [len(s) for s, _ in hits]), np.concatenate([i for _, i in hits]), np.concatenate([s for s, _ in hits])]
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([width], pa.int32()), *(pa.array([x], pa.list_(pa.int64())) for x in lists)], ["block", "width", *LISTS])

    columns = ["shard", "width", "part", "block", "ids", "flat", "least"]
    index = shards.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).withColumns({"block": F.lit(-1), "least": F.array().cast("array<long>")})
    both = index.select(columns).unionByName(asked.select(columns))
    return both.repartition("shard", "width", "part").sortWithinPartitions("shard", "width", "part", "block").mapInArrow(run, FOUND)


def top_k(queries: DataFrame, vectors: DataFrame, k: int = 5, shard: int = 4096, block: int = 1024, together: int = 64) -> DataFrame:
    """``queries`` and ``vectors (vec_id long, v array<long>)`` -> ``(query_id, rank, vec_id, score)``.

    Scores are integer inner products; ties go to the smaller id; a query's own id is no candidate for it.  Rows with a
    null id or vector take no part, and vectors of another length than the query's are no candidates.  A repeated id
    with a repeated vector counts once.  A query without candidates gives no rows, nor does an empty table.  Other columns
    are ignored.
    """
    whole = "vec_id is not null and v is not null"
    asked = cut(queries.where(whole).select("vec_id", "v").distinct())
    held = cut(vectors.where(whole).select("vec_id", "v").distinct())
    n, m = (max(1, -(-rows.count() // size)) for rows, size in ((held, shard), (asked, block)))
    parts = -(-m // together)
    part = F.pmod(F.col("block"), F.lit(parts)).cast("int").alias("part")
    shards = _blocks(held, n, "shard")
    blocks = _blocks(asked, m, "block").withColumns({"shard": F.lit(0), "least": F.transform("ids", lambda _: F.lit(NONE))})
    found = first = cut(_search(blocks.select("*", part), shards.where("shard = 0"), k, parts, True))
    if n > 1:
        rest = first.select("block", "width", "ids", "flat", "least", part, F.explode(F.sequence(F.lit(1), F.lit(n - 1))).alias("shard"))
        found = first.unionByName(_search(rest, shards.where("shard > 0"), k, parts, False))
    hits = found.select(F.explode(F.arrays_zip("hit_query", "hit_vec", "hit_score")).alias("h")).select(F.col("h.hit_query").alias("query_id"), F.col("h.hit_vec").alias("vec_id"), F.col("h.hit_score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
