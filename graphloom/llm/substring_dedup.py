"""Substring deduplication by hashing stretches of lines.

A text's words are runs of other than ASCII white space, A-Z in lower case, of 16 characters at most; characters of
scripts that are written without spaces are words of their own.  Passages that documents share seldom begin and end with
a line, so lines are cut further where their content says: a unit begins with every line and with every word whose hash is
the least of some ``spread`` neighbouring words (winnowing), which puts the same borders into a passage wherever it
stands.  A word that one of the ``spread - 1`` words before it equals doesn't count there, so words said over and over
aren't cut.  A stretch is the shortest run of units from a unit on that has ``min_words`` words, and the shortest inside a
line up to its end, so that whole lines go too; its digest is taken over its words joined by spaces.  With ``unit="line"`` units are whole lines, with ``unit="paragraph"`` what blank lines
separate.  All of that is arithmetic on arrays of a text's code points.

Of all stretches with one digest the earliest ranked, by document id and then position, stays; every other one goes, from
its first word to the next word that stays.  So the earliest occurrence of every unit stays, and what goes is recorded with
its offsets in the original text.

The shuffle carries a digest and four numbers per unit.  A digest's first place is a grouped minimum, combined before the
shuffle; it is joined back to the stretches, where a digest that a third of all documents share is a skewed join side that
adaptive execution splits.  The only lists built are those of one document's own stretches.  Texts are shuffled only to
documents that lose something: a bitmap of ``BITS`` bits, which is all that is broadcast, lets the others pass by.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.shared import cut, free_name, lean, slices

SPANS = "array<struct<start:int,stop:int,kept_doc_id:bigint,kept_start:int>>"
UNITS = ("stretch", "line", "paragraph")
#: First and last characters of scripts without spaces (Thai, Lao, Tibetan; Burmese; Khmer; kana; ideographs).
UNSPACED = [(0x0E00, 0x0FFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3040, 0x30FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF)]
LONGEST = 16  # characters of a word
BITS = 1 << 24
DIGEST = 12  # bytes
#: A word's hash is the polynomial of its code points at BASE, times MIX, modulo 2^64: the upper half.
BASE, MIX = 0x2545F4914F6CDD1D, 0x1B873593CC9E2D51


class Powers:
    """Powers of BASE and of its inverse modulo 2^64, as many as the longest text so far needed."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            self.up, self.down = (np.cumprod(np.append(np.uint64(1), np.full(size - 1, b, np.uint64))) for b in (BASE, pow(BASE, -1, 2**64)))
        return self.up[:n], self.down[:n]


POWERS = Powers()


def words(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The code points with A-Z in lower case, which of them are white space, and where each word begins and ends."""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    code = np.where((code >= 65) & (code <= 90), code + 32, code).astype(np.uint32)
    blank = (code == 32) | (code - np.uint32(9) < 5)
    n = len(code)
    breaks = np.ones(n + 1, bool)  # before each character: whether a word can't go on
    breaks[1:n] = blank[1:] != blank[:-1]
    if n and code.max() >= UNSPACED[0][0]:
        alone = np.zeros(n, bool)
        for low, high in UNSPACED:
            alone |= (code >= low) & (code <= high)
        breaks[:n] |= alone
        breaks[1:] |= alone
    run = np.nonzero(breaks)[0]
    long = np.diff(run) > LONGEST
    if long.any():
        more = [np.arange(a + LONGEST, z, LONGEST) for a, z in zip(run[:-1][long], run[1:][long])]
        run = np.sort(np.concatenate([run, *more]))
    first, past = run[:-1], run[1:]
    said = ~blank[first]
    return code, blank, first[said], past[said]


def winnowed(hashes: np.ndarray, spread: int) -> np.ndarray:
    """The positions that have the least hash, the leftmost of several, of some ``spread`` neighbours, where a hash that
    repeats one of the ``spread - 1`` before it doesn't count."""
    n = len(hashes)
    if n < spread:
        return np.empty(0, np.int64)
    stale = np.zeros(n, bool)
    for k in range(1, spread):
        stale[k:] |= hashes[k:] == hashes[:-k]
    none = np.uint64(2**64 - 1)
    least, width = np.where(stale, none, hashes << np.uint64(32) | np.arange(n, dtype=np.uint64)), 1
    while width < spread:
        step = min(width, spread - width)
        least, width = np.minimum(least[:-step], least[step:]), width + step
    return np.unique(least[least < none] & np.uint64(0xFFFFFFFF)).astype(np.int64)


def stretches(text: str | None, unit: str = "stretch", min_words: int = 20, spread: int = 15) -> tuple[np.ndarray, np.ndarray, bytes]:
    """Starts, stops and, one after another, 96-bit digests of a text's stretches; one stops where the word after it starts."""
    if unit not in UNITS:
        raise ValueError(f"no unit {unit!r}")
    code, blank, first, past = words(text or "")
    n = len(first)
    if n < min_words:
        return np.empty(0, np.int64), np.empty(0, np.int64), b""
    # How many line feeds come before each word tells which ones begin a line.
    feeds = np.concatenate([[0], np.cumsum(code == 10)])
    gap = feeds[first[1:]] - feeds[past[:-1]]
    line = np.concatenate([[0], np.nonzero(gap > (unit == "paragraph"))[0] + 1, [n]])
    begins = np.zeros(n + 1, bool)
    begins[line] = True
    if unit == "stretch":
        up, down = POWERS.to(len(code))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(code * down)])
        hashes = (sums[past] - sums[first]) * up[past - 1] * np.uint64(MIX) >> np.uint64(32)
        begins[winnowed(hashes, spread)] = True
    borders = np.nonzero(begins)[0]
    ends = np.searchsorted(borders, borders[:-1] + min_words)
    onward = np.stack([borders[:-1][ends < len(borders)], borders[ends[ends < len(borders)]]], 1)
    upto = line[1:][np.diff(line) >= min_words]
    back = np.stack([borders[np.searchsorted(borders, upto - min_words, side="right") - 1], upto], 1)
    a, z = np.unique(np.concatenate([onward, back]), axis=0).T
    # The words, each with a space after it.
    at = np.concatenate([[0], np.cumsum(past - first + 1)])
    form = np.full(at[-1], 32, np.uint32)
    kept = np.ones(at[-1], bool)
    kept[at[1:] - 1] = False
    form[kept] = code[~blank]
    raw = memoryview(form.tobytes())
    digests = b"".join([xxhash.xxh3_128_digest(raw[i:j])[:DIGEST] for i, j in zip((4 * at[a]).tolist(), (4 * at[z] - 4).tolist())])
    places = np.append(first, len(code))
    return places[a], places[z], digests


def merged(repeats: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """(start, stop, kept_doc_id, kept_start) of stretches -> disjoint spans: overlapping stretches that stay in one document
    are a span, with the place where its beginning stays; a span stops where the next one starts."""
    out: list[tuple[int, int, int, int]] = []
    last = (-1, -1)  # start and keeper of the stretch before
    for start, stop, kept, at in sorted(repeats):
        if out and start <= out[-1][1]:
            first, end, *place = out.pop()
            if start == last[0] or kept == last[1]:
                out.append((first, max(stop, end), *place))
            else:
                out += [(first, start, *place), (start, max(stop, end), kept, at)]
        else:
            out.append((start, stop, kept, at))
        last = (start, kept)
    return out


def without(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without some disjoint spans of it."""
    parts, at = [], 0
    for start, stop in sorted(spans):
        parts.append(text[at:start])
        at = stop
    return "".join(parts) + text[at:]


def repeated_stretches(docs: DataFrame, unit: str = "stretch", min_words: int = 20, spread: int = 15, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, text_hash, start, stop, kept_doc_id, kept_start)``: a row per stretch that goes, offsets in code points.

    A document is an id with a text; where an id repeats with another text, the hash of the text ranks after the id.
    Rows with a null id or text give none, nor does an empty table; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 2):
            own = [stretches(text, unit, min_words, spread) for text in b.column(2).to_pylist()]
            at = pa.array(np.repeat(np.arange(len(own)), [len(x[0]) for x in own]))
            raw = pa.py_buffer(b"".join(x[2] for x in own))
            digests = pa.FixedSizeBinaryArray.from_buffers(pa.binary(DIGEST), len(at), [None, raw]).cast(pa.binary())
            places = [pa.array(np.concatenate([x[k] for x in own]).astype(np.int32)) for k in range(2)]
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), *places, digests], ["doc_id", "text_hash", "start", "stop", "digest"])

    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).cast("string"))
    found = rows.mapInArrow(lean(run), "doc_id long, text_hash long, start int, stop int, digest binary")
    first = found.groupBy("digest").agg(F.min(F.struct("doc_id", "text_hash", "start")).alias("first"), F.count("*").alias("n"))
    again = cut(first.where("n > 1").select("digest", "first"))  # a table of its own, so that the join below can be split
    held = found.join(again, "digest").where("struct(doc_id, text_hash, start) <> first")
    return held.select("doc_id", "text_hash", "start", "stop", F.col("first.doc_id").alias("kept_doc_id"), F.col("first.start").alias("kept_start"))


def substring_dedup(docs: DataFrame, unit: str = "stretch", min_words: int = 20, spread: int = 15, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row of ``docs`` with its text deduplicated, and the column ``removed``: the spans that went, in order,
    as offsets (code points) in the original text, each with the place where its beginning stays.

    A null or empty text, and one without a repeated stretch, stays as it is with an empty list.  A text that consists of
    repeated stretches becomes empty, or the white space before its first word; its row stays.  Rows with a null id take no
    part.  Rows that repeat an id and a text are one document: all lose the same spans, so a first occurrence is never lost.
    A very long text is one row's work, in arrays over its words.  An input column named ``removed`` is replaced; no other
    name of the input clashes.
    """
    docs = docs.drop("removed")
    own_id, own_hash, at, bits = (free_name(docs, c) for c in ("id", "hash", "at", "bits"))
    spans = cut(
        repeated_stretches(docs, unit, min_words, spread, id_col, text_col)
        .distinct()
        .groupBy("doc_id", "text_hash")
        .agg(F.collect_list(F.struct("start", "stop", "kept_doc_id", "kept_start")).alias("removed"))
        .select(F.col("doc_id").alias(own_id), F.col("text_hash").alias(own_hash), "removed")
    )

    def bit(of_id: Column, of_hash: Column) -> Column:
        return F.pmod(F.xxhash64(of_id, of_hash), F.lit(BITS))

    marked = spans.select(bit(F.col(own_id), F.col(own_hash)).alias("bit")).groupBy(F.expr("bit div 64").alias(at)).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit % 64 as int))")).alias(bits))
    key = bit(F.col(id_col).cast("long"), F.xxhash64(text_col))
    flagged = docs.join(F.broadcast(marked), F.floor(key / 64) == F.col(at), "left")
    loses = F.coalesce(F.getbit(F.col(bits), key % 64) == 1, F.lit(False))
    others = flagged.where(~loses).select(*[F.col(f"`{c}`") for c in docs.columns]).withColumn("removed", F.array().cast(SPANS))
    own = (F.col(id_col).cast("long") == F.col(own_id)) & (F.xxhash64(text_col) == F.col(own_hash))
    joined = flagged.where(loses).select(*[F.col(f"`{c}`") for c in docs.columns]).join(spans, own, "left").drop(own_id, own_hash).withColumn("removed", F.coalesce("removed", F.array().cast(SPANS)))
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, place):
            lists = b.column(b.num_columns - 1)
            flat, lengths = lists.flatten(), lists.value_lengths().to_pylist()
            fields = [flat.field(k).to_pylist() for k in range(4)]
            columns, texts, at, spans = b.columns, b.column(place).to_pylist(), 0, []
            for row, n in enumerate(lengths):
                own = merged(list(zip(*(f[at : at + n] for f in fields))))
                spans.append(own)
                at += n
                if n:
                    texts[row] = without(texts[row], [s[:2] for s in own])
            columns[place] = pa.array(texts, b.column(place).type)
            every = [s for own in spans for s in own]
            values = pa.StructArray.from_arrays([pa.array([s[k] for s in every], lists.type.value_type.field(k).type) for k in range(4)], fields=list(lists.type.value_type))
            offsets = pa.array(np.concatenate([[0], np.cumsum([len(own) for own in spans])]), pa.int32())
            columns[-1] = pa.ListArray.from_arrays(offsets, values, type=lists.type)
            yield pa.RecordBatch.from_arrays(columns, schema=b.schema)

    return joined.mapInArrow(lean(run), joined.schema).unionByName(others)
