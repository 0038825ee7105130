"""Rounds over a graph whose nodes are numbered: links stay where they are, in blocks, and a round moves one array.

Names become numbers in their own order, so the least number is the least name.  All links of a node are in one block, a row
of arrays.  A round is one job without a shuffle: every block gets the array of all labels (4 bytes a node, which the driver
passes on as it is) and gives those of its own nodes.  Links never pass the driver."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.storage import cut

#: At most about so many links are a block; fewer than the least are not parted further.
BLOCK, LEAST = 1 << 21, 1 << 16
ROW = "nodes binary, ends binary, dst binary, w binary"


def _sums(key: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys in order, and the sum of each."""
    order = np.argsort(key)
    key = key[order]
    first = _firsts(key)
    return key[first], np.add.reduceat(w[order], first) if len(first) else w[:0]


def _firsts(a: np.ndarray) -> np.ndarray:
    """Where a run of equal values begins."""
    return np.flatnonzero(np.append(True, a[1:] != a[:-1])) if len(a) else np.zeros(0, np.int64)


def _built(n: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Links ``(src, dst, w)`` of a partition as a block, those of a pair added up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            src, dst, w = (np.concatenate([b.column(k).to_numpy(zero_copy_only=False) for b in held]) for k in range(3))
            key, w = _sums(src.astype(np.int64) * n + dst, w)
            src, dst = key // n, (key % n).astype(np.int32)
            first = _firsts(src)
            ends = np.append(first[1:], len(src)).astype(np.int64)
            arrays = src[first].astype(np.int32), ends, dst, w if (w != 1).any() else w[:0]
            yield pa.RecordBatch.from_arrays([pa.array([a.tobytes()], pa.binary()) for a in arrays], ["nodes", "ends", "dst", "w"])

    return run


class Block:
    """Nodes, the places of their links' first ends among them, the other ends, and weights."""

    def __init__(self, batch: pa.RecordBatch, i: int):
        part = [np.frombuffer(batch.column(k)[i].as_buffer(), kind) for k, kind in enumerate((np.int32, np.int64, np.int32, np.int64))]
        self.nodes, ends, self.dst, w = part
        self.row = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
        self.w = w if len(w) else np.ones(len(self.dst), np.int64)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield Block(batch, i)


def _mixed(seeds: np.ndarray, k: int) -> np.ndarray:
    """XXH64 of an int with other hashes as seeds: Spark's ``xxhash64(node, k)``."""
    p1, p2, p3, p5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5))
    h = seeds + p5 + np.uint64(4) ^ np.uint64((k * int(p1)) % (1 << 64))
    h = (h << np.uint64(23) | h >> np.uint64(41)) * p2 + p3
    h = (h ^ h >> np.uint64(33)) * p2
    h = (h ^ h >> np.uint64(29)) * p3
    return h ^ h >> np.uint64(32)


class Numbered:
    """Links ``(src, dst)``, each in both directions, once and without loops; ``g`` is the group that a link is inside."""

    def __init__(self, links: DataFrame):
        self.spark = links.sparkSession
        grouped = "g" in links.columns
        links = cut(links)
        own = links.select(F.col("src").alias("node"), *(["g"] if grouped else [])).distinct()
        dealt = cut(own.repartitionByRange("node").sortWithinPartitions("node").withColumn("at", F.monotonically_increasing_id()))
        sizes = dict(tuple(r) for r in dealt.groupBy(F.shiftright("at", 33).alias("part")).count().collect())
        self.n = sum(sizes.values())
        if self.n >= 1 << 31:
            raise ValueError("more nodes than 32 bits number")
        before, self.group = 0, np.zeros(self.n, np.int32)
        if not self.n:
            return
        offsets = []
        for part in sorted(sizes):
            offsets += [F.lit(part), F.lit(before)]
            before += sizes[part]
        at = F.element_at(F.create_map(*offsets), F.shiftright("at", 33)) + F.col("at").bitwiseAND((1 << 33) - 1)
        self.names = cut(dealt.select(at.cast("int").alias("id"), "node", F.xxhash64("node").alias("seed"), *(["g"] if grouped else [])))
        if grouped:
            least = self.names.groupBy("g").agg(F.min("id").alias("group"))
            self._spread(self.group, self.names.join(least, "g").select("id", "group"))
        self.seeds = np.zeros(self.n, np.int64)
        self._spread(self.seeds, self.names.select("id", "seed"))
        count = links.count()
        self.parts = max(min(self.spark.sparkContext.defaultParallelism, -(-count // LEAST)), -(-count // BLOCK))
        a, b = self.names.select(F.col("id").alias("a"), F.col("node").alias("src")), self.names.select(F.col("id").alias("b"), F.col("node").alias("dst"))
        self.links = self._dealt(links.select("src", "dst").join(a, "src").join(b, "dst").select("a", "b", F.lit(1).cast("long").alias("w")))

    @staticmethod
    def _spread(to: np.ndarray, rows: DataFrame) -> None:
        """Values of nodes, in the places of these."""
        t = rows.toArrow()
        to[t.column(0).to_numpy()] = t.column(1).to_numpy()

    def _dealt(self, links: DataFrame) -> DataFrame:
        return cut(links.toDF("src", "dst", "w").repartition(self.parts, "src").mapInArrow(_built(self.n), ROW).coalesce(self.parts))

    def _each(self, blocks: DataFrame, value: Callable[[Block, dict], tuple[np.ndarray, float]], **state: np.ndarray) -> tuple[np.ndarray, float]:
        """What every block says of its nodes, in an array of all nodes, and the sum of its figures."""
        held = self.spark.sparkContext.broadcast(state)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for block in _blocks(batches):
                own, figure = value(block, held.value)
                yield pa.RecordBatch.from_arrays([pa.array([block.nodes.tobytes()], pa.binary()), pa.array([own.astype(np.int64).tobytes()], pa.binary()), pa.array([float(figure)])], ["nodes", "own", "figure"])

        rows = blocks.mapInArrow(run, "nodes binary, own binary, figure double").collect()
        held.destroy()
        out, figure = np.arange(self.n, dtype=np.int64), 0.0
        for r in rows:
            out[np.frombuffer(r["nodes"], np.int32)] = np.frombuffer(r["own"], np.int64)
        return out, sum(sorted(r["figure"] for r in rows))

    def named(self, labels: np.ndarray) -> DataFrame:
        """``(node, label)`` of an array of labels, which are numbers of nodes."""
        held = self.spark.sparkContext.broadcast(labels.astype(np.int32))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield pa.RecordBatch.from_arrays([b.column(1), pa.array(held.value[b.column(0).to_numpy()])], ["node", "id"])

        of = self.names.select("id", F.col("node").alias("label"))
        out = cut(self.names.select("id", "node").mapInArrow(run, "node string, id int").join(of, "id").select("node", "label"))
        held.destroy()
        return out

    # Communities.

    def _degrees(self) -> np.ndarray:
        return self._each(self.links, lambda block, _: (np.bincount(block.row, block.w, len(block.nodes)), 0.0))[0]

    def _modularity(self, blocks: DataFrame, labels: np.ndarray, degree: np.ndarray, total: np.ndarray) -> float:
        """The sum over groups of their modularity."""

        def inside(block: Block, s: dict) -> tuple[np.ndarray, float]:
            same = s["labels"][block.nodes][block.row] == s["labels"][block.dst]
            return block.nodes, (block.w * same / s["total"][block.nodes][block.row]).sum()

        volume = np.bincount(labels, degree, self.n)
        # A label's group is that of its node.
        return self._each(blocks, inside, labels=labels, total=total)[1] - float(((volume / total) ** 2).sum())

    def _moved(self, blocks: DataFrame, labels: np.ndarray, held, half: int) -> tuple[np.ndarray, int]:
        """One round of local moving: of half of the nodes, each goes to the neighbouring community with the greatest gain in
        modularity, if that is more than its own; and how many nodes of either half would.  Gains are whole numbers: times
        the weight of all links of the group."""
        n = self.n

        def moves(block: Block, s: dict) -> tuple[np.ndarray, float]:
            labels, (degree, total, seeds) = s["labels"].astype(np.int64), held.value
            volume = np.bincount(labels, degree, n).astype(np.int64)
            nodes, own = block.nodes, labels[block.nodes]
            other = nodes[block.row] != block.dst
            # A node's own community counts even without a link into it.
            keys = np.concatenate([block.row[other] * n + labels[block.dst[other]], np.arange(len(nodes)) * n + own])
            key, k = _sums(keys, np.concatenate([block.w[other], np.zeros(len(nodes), np.int64)]))
            row, label = key // n, key % n
            stays, d = label == own[row], degree[nodes][row]
            gain = k * total[nodes][row] - d * (volume[label] - np.where(stays, d, 0))
            first = _firsts(row)
            most = np.maximum.reduceat(gain, first)
            choice = np.minimum.reduceat(np.where(gain == most[row], label, n), first)
            better = most > gain[stays]
            turn = (_mixed(seeds[nodes], half // 2) & np.uint64(1)).astype(np.int64) == half % 2
            return np.where(better & turn, choice, own), better.sum()

        new, wants = self._each(blocks, moves, labels=labels.astype(np.int32))
        return new, int(wants)

    def _merged(self, blocks: DataFrame, named: np.ndarray) -> DataFrame:
        """Communities as nodes: links between them added up, first within a block."""
        held, n = self.spark.sparkContext.broadcast(named), self.n

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for block in _blocks(batches):
                key, w = _sums(held.value[block.nodes][block.row] * n + held.value[block.dst], block.w)
                yield pa.RecordBatch.from_arrays([pa.array((key // n).astype(np.int32)), pa.array((key % n).astype(np.int32)), pa.array(w)], ["src", "dst", "w"])

        out = self._dealt(blocks.mapInArrow(run, "src int, dst int, w long"))
        held.destroy()
        return out

    def _connected(self, found: np.ndarray) -> np.ndarray:
        """The parts of each community that links inside it connect, named by their least node."""

        def near(block: Block, s: dict) -> tuple[np.ndarray, float]:
            part, found = s["part"], s["found"]
            same = np.where(found[block.nodes][block.row] == found[block.dst], part[block.dst], part[block.nodes][block.row])
            return np.minimum(part[block.nodes], np.minimum.reduceat(same, _firsts(block.row))), 0.0

        part = np.arange(self.n, dtype=np.int64)
        while True:
            new = self._each(self.links, near, part=part, found=found)[0]
            # The least label around, and then that label's own, until none has another: paths halve.
            while ((over := new[new]) != new).any():
                new = over
            if (new == part).all():
                return part
            part = new

    def partition(self, settled: float) -> np.ndarray:
        """See ``graph.partition``."""
        context = self.spark.sparkContext
        blocks, degree = self.links, self._degrees()
        total = np.bincount(self.group, degree, self.n).astype(np.int64)[self.group]
        found, q = None, None
        while True:
            labels = np.arange(self.n, dtype=np.int64)
            start = self._modularity(blocks, labels, degree, total) if q is None else q
            best, half, idle, fewest = labels, 0, 0, None
            enough = settled * np.count_nonzero(degree)
            held = context.broadcast((degree, total, self.seeds.view(np.uint64)))
            while idle < 3:
                labels, wants = self._moved(blocks, labels, held, half)
                half, idle = half + 1, idle + 1
                if fewest is None or wants < fewest:
                    best, fewest, idle = labels, wants, 0
                if wants <= enough:
                    break
            held.destroy()
            q = self._modularity(blocks, best, degree, total)
            if found is not None and q <= start + 1e-6:
                break
            named = np.full(self.n, self.n, np.int64)
            alive = np.flatnonzero(degree)
            np.minimum.at(named, best[alive], alive)
            named = np.where(degree > 0, named[best], np.arange(self.n))
            found = named if found is None else named[found]
            if q <= start + 1e-6:
                break
            blocks = self._merged(blocks, named)
            degree = np.bincount(named, degree, self.n).astype(np.int64)
        return self._connected(found)

    # Labels of propagation.

    def propagated(self, bound: int) -> np.ndarray:
        """See ``graph.label_propagation``."""
        n = self.n

        def votes(block: Block, s: dict) -> tuple[np.ndarray, float]:
            key, k = _sums(block.row * n + s["labels"][block.dst], block.w)
            row, label = key // n, key % n
            first = _firsts(row)
            most = np.maximum.reduceat(k, first)
            return np.minimum.reduceat(np.where(k == most[row], label, n), first), 0.0

        labels, older = np.arange(n, dtype=np.int64), None
        for _ in range(bound):
            new = self._each(self.links, votes, labels=labels.astype(np.int32))[0]
            if any(old is not None and (new == old).all() for old in (labels, older)):
                return np.minimum(new, labels)
            labels, older = new, labels
        raise RuntimeError(f"labels did not settle in {bound} rounds")
