"""Packing of documents into sequences by linear grouping, configurations of few sizes, and best fit.

What decides a packing is how many pieces there are of each length, and lengths run from 1 to the capacity: the histogram
has a bounded number of rows whatever the corpus, so it is packed exactly on the driver and the plan, which says which
ranks of which length go where, is bounded too.

1.  Pieces longer than a share ``large`` of the capacity are sorted by falling length and grouped into ``groups`` groups of equal
    cardinality; each counts as long as the longest of its group.
2.  The linear program over configurations (multisets of group sizes that fit a sequence) is solved by column generation;
    its solution is rounded down.
3.  The configurations' places are filled with actual pieces of their groups, whose true lengths leave more room.
4.  What rounding left over and all small pieces go, by falling length, each into the fullest sequence that holds it.

Which pieces count as large decides how well that goes: grouping wins where most pieces take a third of a sequence or so,
and loses a little where small ones can fill any room.  So the histogram is packed with each of several bounds, the last
of which leaves every piece to best fit, and the plan with the fewest sequences is taken.

Sequences filled alike are handled as runs, so the time does not grow with the number of pieces.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.encoding import encoder, portions
from graphloom.llm.shared import cut, lean, slices

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary"


def best_configuration(sizes: np.ndarray, values: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The multiset of sizes within the capacity that has the highest value (unbounded knapsack)."""
    best = np.zeros(capacity + 1)
    layers = [best]
    takes = []
    order = np.nonzero(values > 1e-12)[0]
    for _ in range(capacity // int(sizes.min())):
        now, take = layers[-1].copy(), np.full(capacity + 1, -1)
        for k in order.tolist():
            s = int(sizes[k])
            with_k = layers[-1][: capacity + 1 - s] + values[k]
            better = with_k > now[s:] + 1e-12
            if better.any():
                now[s:][better] = with_k[better]
                take[s:][better] = k
        if (take < 0).all():
            break
        layers.append(now)
        takes.append(take)
    counts, c = np.zeros(len(sizes), np.int64), capacity
    for take in reversed(takes):
        if (k := take[c]) >= 0:
            counts[k] += 1
            c -= int(sizes[k])
    return float(layers[-1][capacity]), counts


def configurations(sizes: np.ndarray, counts: np.ndarray, capacity: int, rounds: int = 1500) -> list[tuple[np.ndarray, int]]:
    """Configurations and how often each is used: the linear program's basis solution, rounded down."""
    n = len(sizes)
    columns = [np.bincount([k], minlength=n) * (capacity // int(sizes[k])) for k in range(n)]
    inverse = np.diag([1.0 / c[k] for k, c in enumerate(columns)])
    x = inverse @ counts
    for step in range(rounds):
        if step % 50 == 49:
            inverse = np.linalg.inv(np.array(columns, float).T)
            x = inverse @ counts
        value, config = best_configuration(sizes, inverse.sum(axis=0), capacity)
        if value <= 1 + 1e-7:
            break
        direction = inverse @ config
        ratio = np.where(direction > 1e-9, np.maximum(x, 0) / np.where(direction > 1e-9, direction, 1), np.inf)
        out = int(ratio.argmin())
        x = x - ratio[out] * direction
        x[out] = ratio[out]
        row = inverse[out] / direction[out]
        inverse = inverse - np.outer(direction, row)
        inverse[out] = row
        columns[out] = config
    return [(c, m) for c, m in zip(columns, np.floor(np.maximum(x, 0) + 1e-6).astype(np.int64).tolist()) if m]


@dataclass
class Plan:
    """Rows (length, first rank, pieces, first sequence, pieces per sequence, offset of the first of them)."""

    capacity: int
    rows: list[tuple[int, int, int, int, int, int]] = field(default_factory=list)
    sequences: int = 0
    room: dict[int, list[tuple[int, int]]] = field(default_factory=dict)  # free tokens -> runs (first sequence, sequences)
    frees: list[int] = field(default_factory=list)

    def leave(self, free: int, first: int, n: int) -> None:
        if n and free:
            if free not in self.room:
                self.room[free] = []
                insort(self.frees, free)
            self.room[free].append((first, n))

    def best_fit(self, length: int, rank: int, n: int) -> None:
        while n:
            k = bisect_left(self.frees, length)
            if k == len(self.frees):
                free, each = self.capacity, self.capacity // length
                first, count = self.sequences, -(-n // each)
                self.sequences += count
            else:
                free = self.frees[k]
                each = free // length
                first, count = self.room[free].pop()
                if not self.room[free]:
                    del self.room[free]
                    self.frees.pop(k)
            full = min(count, n // each)
            if full:
                self.rows.append((length, rank, full * each, first, each, self.capacity - free))
                self.leave(free - each * length, first, full)
                rank, n, first, count = rank + full * each, n - full * each, first + full, count - full
            if n and count:  # fewer than a sequence takes
                self.rows.append((length, rank, n, first, n, self.capacity - free))
                self.leave(free - n * length, first, 1)
                rank, n, first, count = rank + n, 0, first + 1, count - 1
            self.leave(free, first, count)


def plan(histogram: dict[int, int], capacity: int, groups: int = 96, larges: tuple[float, ...] = (0.5, 0.25, 0.125, 1.0)) -> Plan:
    """Where the pieces of each length go; ``histogram`` has the number of pieces by length.  The best of a plan for each
    bound in ``larges``, the first of equals; none is worse than best fit alone if 1 is among them."""
    least, found = -(-sum(s * n for s, n in histogram.items()) // capacity), None
    for large in larges:
        tried = grouped(histogram, capacity, groups, large)
        if found is None or tried.sequences < found.sequences:
            found = tried
        if found.sequences == least:
            break
    return found


def grouped(histogram: dict[int, int], capacity: int, groups: int, large: float) -> Plan:
    """Linear grouping of the pieces above the share ``large`` of the capacity, best fit for the others."""
    out = Plan(capacity)
    lengths = sorted((s for s in histogram if s > large * capacity), reverse=True)
    total = sum(histogram[s] for s in lengths)
    left: list[tuple[int, int, int]] = [(s, 0, n) for s, n in histogram.items() if s <= large * capacity]
    members: list[list[tuple[int, int, int]]] = []  # of each group: (length, first rank, pieces), by falling length
    each, space = -(-total // groups) if total else 0, 0
    for s in lengths:
        rank = 0
        while rank < histogram[s]:
            if not space:
                members.append([])
                space = each
            n = min(space, histogram[s] - rank)
            members[-1].append((s, rank, n))
            rank, space = rank + n, space - n
    if members:
        sizes = np.array([g[0][0] for g in members])
        counts = np.array([sum(n for _, _, n in g) for g in members])
        for config, times in configurations(sizes, counts.astype(float), capacity):
            places = []  # for each place of the configuration, its pieces as (length, first rank, pieces)
            for k in np.nonzero(config)[0].tolist():
                for _ in range(int(config[k])):
                    need, own = times, []
                    while need and members[k]:
                        s, rank, n = members[k].pop(0)
                        m = min(n, need)
                        own.append((s, rank, m))
                        need -= m
                        if n > m:
                            members[k].insert(0, (s, rank + m, n - m))
                    places.append(own)
            _fill(out, places, times)
    left += [x for g in members for x in g]
    for s, rank, n in sorted(left, key=lambda x: (-x[0], x[1])):
        out.best_fit(s, rank, n)
    return out


def _fill(out: Plan, places: list[list[tuple[int, int, int]]], times: int) -> None:
    """``times`` new sequences; a run of them ends where the length of any place changes."""
    first, done = out.sequences, 0
    out.sequences += times
    heads = [list(p[::-1]) for p in places]
    while done < times:
        run = min([p[-1][2] for p in heads if p] + [times - done])
        used = 0
        for p in heads:
            if p:
                s, rank, n = p.pop()
                out.rows.append((s, rank, run, first + done, 1, used))
                used += s
                if n > run:
                    p.append((s, rank + run, n - run))
        out.leave(out.capacity - used, first + done, run)
        done += run


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int | None = 0, keep_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pieces of every whole document: only what is longer than the capacity is cut, into full pieces and a rest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer_path)
        end = np.array([] if end_id is None else [end_id], "<u4")
        for b in slices(batches, 1, 8 << 20):
            doc_ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            for i, j in portions(texts):
                rows = []
                for doc_id, raw in zip(doc_ids[i:j], enc.ids(texts[i:j])):
                    ids = np.concatenate([np.frombuffer(raw, enc.dtype).astype("<u4"), end])
                    for piece, start in enumerate(range(0, len(ids), capacity)):
                        part = ids[start : start + capacity].tobytes()
                        rows.append((doc_id, piece, start, len(part) // 4, zlib.crc32(part), part if keep_ids else None))
                cols = list(zip(*rows)) or [[]] * 6
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], ["doc_id", "piece", "start", "length", "ids_crc32", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(lean(run), PIECES)


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int | None = 0, groups: int = 96, keep_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32, ids, sequence_id, offset)``: a row per piece, and its place.

    A null or empty text is its end id alone.  Rows that repeat an id, and null ids, are documents of their own.  An
    empty table gives no rows; other columns are ignored.  ``ids`` is null unless ``keep_ids`` (little-endian u32).

    Pieces are numbered within their length, in groups dealt out by a hash so that no length, however frequent, lies in
    one task; the number picks the place from the plan.
    """
    held = cut(pieces(docs, tokenizer_path, capacity, end_id, keep_ids, id_col, text_col))
    histogram = {r["length"]: r["count"] for r in held.groupBy("length").count().collect()}  # at most ``capacity`` rows
    rows = np.array(sorted(plan(histogram, capacity, groups).rows), np.int64).reshape(-1, 6)
    salts = max(1, int(max(histogram.values(), default=1) ** 0.5))
    salted = held.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    bases = salted.groupBy("length", "salt").count().select("length", "salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    order = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = salted.withColumn("nth", F.row_number().over(order)).join(bases, ["length", "salt"]).select("doc_id", "piece", "start", "length", "ids_crc32", "ids", (F.col("base") + F.col("nth") - 1).alias("rank"))
    keys = rows[:, 0] << 44 | rows[:, 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = b.column(3).to_numpy(), b.column(6).to_numpy()
            at = np.searchsorted(keys, length << 44 | rank, side="right") - 1
            nth = rank - rows[at, 1]
            yield pa.RecordBatch.from_arrays([*b.columns[:6], pa.array(rows[at, 3] + nth // rows[at, 4]), pa.array(rows[at, 5] + nth % rows[at, 4] * length)], [*b.schema.names[:6], "sequence_id", "offset"])

    return ranked.mapInArrow(run, PIECES + ", sequence_id long, offset long")
