"""Token ids in binary files of patched frame-of-reference blocks.

A file holds whole documents in id order.  Its ids are cut into blocks of ``BLOCK``.  A block stores its minimum, and
the differences to it in as many bits as a given percentile of them needs; a difference that needs more keeps its low
bits in place, and its position and high bits go to the block's exception list.  The index at the end of the file has
the start of every block, so any document can be read without decoding what stands before its first block.

    "TPF1"
    blocks: u32 minimum, u8 width, u8 0, u16 exceptions, u16 ids, u16 0,
            u64 words (64 differences of w bits are w words), u16 positions, u32 high bits
    u64 starts of blocks, i64 ids of documents, u8 1 where that id is null, u64 first tokens of documents
    u64 blocks, u64 documents, u64 tokens, u64 start of this index, "TPF1"

All numbers are little-endian.  Files are written under a name of the task's attempt and then renamed, so a repeated or
abandoned task leaves no half file under a final name, and readers open only the files of the manifest.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.llm.encoding import encoder, portions
from graphloom.llm.shared import cut, lean, slices

MAGIC = b"TPF1"
BLOCK = 1024
HEAD = struct.Struct("<IBBHHH")
FOOT = struct.Struct("<QQQQ4s")
MANIFEST = "part int, seq int, path string, n_docs long, n_tokens long, bytes long"


def pack(values: np.ndarray, width: int) -> np.ndarray:
    """Rows of 64 values below 2**width as rows of ``width`` words."""
    out = np.zeros((len(values), width), np.uint64)
    for j in range(64 if width else 0):
        word, shift = divmod(j * width, 64)
        out[:, word] |= values[:, j] << np.uint64(shift)
        if shift + width > 64:
            out[:, word + 1] |= values[:, j] >> np.uint64(64 - shift)
    return out


def unpack(words: np.ndarray, width: int) -> np.ndarray:
    out = np.zeros((len(words), 64), np.uint64)
    mask = np.uint64((1 << width) - 1)
    for j in range(64 if width else 0):
        word, shift = divmod(j * width, 64)
        x = words[:, word] >> np.uint64(shift)
        if shift + width > 64:
            x = x | words[:, word + 1] << np.uint64(64 - shift)
        out[:, j] = x & mask
    return out


def _bits(x: np.ndarray) -> np.ndarray:
    """How many bits a nonnegative number below 2**32 needs."""
    return np.frexp(x.astype(np.float64))[1]


def encode_blocks(ids: np.ndarray, percentile: float = 0.9) -> list[bytes]:
    """The blocks of some ids; only the last may be shorter than BLOCK."""
    n = -(-len(ids) // BLOCK)
    if not n:
        return []
    rows = np.full(n * BLOCK, ids[-1], np.int64)
    rows[: len(ids)] = ids
    rows = rows.reshape(n, BLOCK)
    low = rows.min(axis=1)
    rest = (rows - low[:, None]).astype(np.uint64)
    count = np.full(n, BLOCK)
    count[-1] = len(ids) - (n - 1) * BLOCK
    at = min(BLOCK - 1, int(np.ceil(percentile * BLOCK)) - 1)
    widths = _bits(np.partition(rest, at, axis=1)[:, at])
    out: list[bytes] = [b""] * n
    for w in np.unique(widths).tolist():
        of = np.nonzero(widths == w)[0]
        part = rest[of]
        high = part >> np.uint64(w)
        words = pack((part & np.uint64((1 << w) - 1)).reshape(-1, 64), w).reshape(len(of), -1)
        for k, b in enumerate(of.tolist()):
            where = np.nonzero(high[k, : count[b]])[0]
            out[b] = HEAD.pack(int(low[b]), w, 0, len(where), int(count[b]), 0) + words[k].tobytes() + where.astype("<u2").tobytes() + high[k, where].astype("<u4").tobytes()
    return out


def decode_blocks(blocks: list[memoryview]) -> np.ndarray:
    """The ids of some blocks, one after another, as u32."""
    heads = [HEAD.unpack_from(b) for b in blocks]
    out = np.zeros((len(blocks), BLOCK), np.uint64)
    by_width: dict[int, list[int]] = {}
    for k, h in enumerate(heads):
        by_width.setdefault(h[1], []).append(k)
    for w, of in by_width.items():
        if w:
            words = np.stack([np.frombuffer(blocks[k], "<u8", w * BLOCK // 64, HEAD.size) for k in of])
            out[of] = unpack(words.reshape(-1, w), w).reshape(len(of), BLOCK)
    for k, (low, w, _, n, _, _) in enumerate(heads):
        if n:
            at = HEAD.size + w * BLOCK // 8
            where = np.frombuffer(blocks[k], "<u2", n, at)
            out[k, where] |= np.frombuffer(blocks[k], "<u4", n, at + 2 * n).astype(np.uint64) << np.uint64(w)
        out[k] += np.uint64(low)
    keep = np.arange(BLOCK)[None] < np.array([h[4] for h in heads]).reshape(-1, 1)
    return out[keep].astype("<u4")


class Writer:
    """One file; documents in the order of ``add``."""

    def __init__(self, stream, percentile: float):
        self.stream, self.percentile = stream, percentile
        self.ids, self.firsts, self.starts = [], [], []
        self.held, self.n_held, self.n_tokens, self.at = [], 0, 0, len(MAGIC)
        stream.write(MAGIC)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.ids.append(doc_id)
        self.firsts.append(self.n_tokens)
        self.held.append(ids)
        self.n_held += len(ids)
        self.n_tokens += len(ids)
        if self.n_held >= 1024 * BLOCK:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.concatenate(self.held) if self.held else np.empty(0, np.int64)
        n = len(ids) if last else len(ids) // BLOCK * BLOCK
        for block in encode_blocks(ids[:n], self.percentile):
            self.starts.append(self.at)
            self.at += self.stream.write(block) or len(block)
        self.held, self.n_held = [ids[n:]], len(ids) - n

    def close(self) -> int:
        self._flush(True)
        null = np.array([i is None for i in self.ids], np.uint8)
        index = b"".join((np.array(self.starts, "<u8").tobytes(), np.array([i or 0 for i in self.ids], "<i8").tobytes(), null.tobytes(), np.array(self.firsts, "<u8").tobytes()))
        self.stream.write(index + FOOT.pack(len(self.starts), len(self.ids), self.n_tokens, self.at, MAGIC))
        self.stream.close()
        return self.at + len(index) + FOOT.size


def read_file(stream, size: int, blocks_at_once: int = 1024) -> Iterator[tuple[int | None, int, np.ndarray]]:
    """(document id, first token in the file, ids as u32) of every document of a file."""
    foot = FOOT.unpack(stream.read_at(FOOT.size, size - FOOT.size))
    n_blocks, n_docs, n_tokens, index, magic = foot
    if magic != MAGIC:
        raise ValueError("not a token file")
    rest = stream.read_at(size - FOOT.size - index, index)
    starts = np.append(np.frombuffer(rest, "<u8", n_blocks), index).astype(np.int64)
    doc_ids = np.frombuffer(rest, "<i8", n_docs, 8 * n_blocks)
    null = np.frombuffer(rest, "u1", n_docs, 8 * (n_blocks + n_docs))
    firsts = np.append(np.frombuffer(rest, "<u8", n_docs, 8 * n_blocks + 9 * n_docs), n_tokens).astype(np.int64).tolist()
    held, base, doc = np.empty(0, "<u4"), 0, 0
    for k in range(0, n_blocks, blocks_at_once):
        own = starts[k : k + blocks_at_once + 1]
        raw = memoryview(stream.read_at(int(own[-1] - own[0]), int(own[0])))
        edges = (own - own[0]).tolist()
        held = np.concatenate([held, decode_blocks([raw[a:b] for a, b in zip(edges, edges[1:])])])
        while doc < n_docs and firsts[doc + 1] <= base + len(held):
            yield None if null[doc] else int(doc_ids[doc]), firsts[doc], held[firsts[doc] - base : firsts[doc + 1] - base]
            doc += 1
        at = firsts[doc] - base
        held, base = held[at:], base + at
    while doc < n_docs:  # documents without ids, where no block follows
        yield None if null[doc] else int(doc_ids[doc]), firsts[doc], held[:0]
        doc += 1


def write_token_files(docs: DataFrame, tokenizer_path: str, folder: str, end_id: int | None = 2, percentile: float = 0.9, tokens_per_file: int = 1 << 26, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every whole text, append ``end_id``, and write the ids of all documents in ascending id order.

    -> manifest ``(part, seq, path, n_docs, n_tokens, bytes)``, in whose order the files hold the documents.  ``folder``
    is a URI that every executor can write.  A null or empty text has the end id alone; a null id comes first; rows that
    repeat an id are documents of their own, ordered by a hash of the text, which also deals them to tasks.  An empty table gives an empty manifest.

    One range partitioning brings the texts into order; each task encodes and writes its own range, a file at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        enc, task = encoder(tokenizer_path), TaskContext.get()
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        end = np.array([] if end_id is None else [end_id], np.int64)
        made, writer = [], None

        def finish() -> None:
            size, final = writer.close(), f"part-{task.partitionId():06d}-{len(made):04d}.tpf"
            target = f"{root}/{final}"
            if store.get_file_info(target).type != fs.FileType.NotFound:
                store.delete_file(target)  # an earlier attempt's, of the same bytes
            store.move(f"{root}/{name}", target)
            made.append((task.partitionId(), len(made), f"{folder}/{final}", len(writer.ids), writer.n_tokens, size))

        for b in slices(batches, 1, 8 << 20):
            texts, ids = b.column(1).to_pylist(), b.column(0).to_pylist()
            for i, j in portions(texts):
                for doc_id, raw in zip(ids[i:j], enc.ids(texts[i:j])):
                    if writer is None:
                        name = f".{task.partitionId()}-{len(made)}-{task.taskAttemptId()}.tmp"
                        writer = Writer(store.open_output_stream(f"{root}/{name}"), percentile)
                    writer.add(doc_id, np.concatenate([np.frombuffer(raw, enc.dtype).astype(np.int64), end]))
                    if writer.n_tokens >= tokens_per_file:
                        finish()
                        writer = None
        if writer is not None:
            finish()
        cols = list(zip(*made)) or [[]] * 6
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64()))], ["part", "seq", "path", "n_docs", "n_tokens", "bytes"])

    ordered = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).withColumn("hash", F.xxhash64("text")).repartitionByRange("doc_id", "hash").sortWithinPartitions("doc_id", "hash", "text").drop("hash")
    return cut(ordered.mapInArrow(lean(run), MANIFEST))


def read_token_files(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """``(doc_id, start, n_tokens, ids binary)``: ids are little-endian u32; start counts the ids of all documents before.

    A task reads whole files, a bounded number of blocks at a time.  The running sum over files is taken in one task: it
    has a row for each file, not for each document.
    """
    order = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(order), F.lit(0))).select("path", "bytes", "base")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for b in batches:
            for path, size, base in zip(*(b.column(k).to_pylist() for k in range(3))):
                store, place = fs.FileSystem.from_uri(path)
                rows, held = [], 0
                with store.open_input_file(place) as stream:
                    for doc_id, first, ids in read_file(stream, size):
                        rows.append((doc_id, base + first, len(ids), ids.tobytes()))
                        held += len(ids)
                        if held > 1 << 20:
                            yield _batch(rows)
                            rows, held = [], 0
                yield _batch(rows)

    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return files.repartition(tasks, "path").mapInArrow(lean(run), "doc_id long, start long, n_tokens long, ids binary")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.binary()))], ["doc_id", "start", "n_tokens", "ids"])
