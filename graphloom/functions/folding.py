"""Many texts folded into one: each is added after a space unless what is there contains it.

Containment is settled by searching; but nearly all texts are known to be new without it.  Words stand between spaces.
Where a text is contained, its words but the first and the last are whole words there, and so are two neighbours of them,
unless one text ends and the next begins between the two.  So a text with a word or a pair that no earlier text has is new,
if that pair can't be the end of one text and the beginning of another.  Words and pairs are compared by hashes in tables of
bounded size, whose collisions can only lead to a search."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WEIGHTS = np.cumprod(np.full(64, 0x9E3779B97F4A7C15, np.uint64))
MIX = np.uint64(0xD6E8FEB86659FD93)
#: Fewer bytes than this are searched right away; about so many are hashed at a time.
SMALL, CHUNK = 1 << 12, 1 << 20


def _words(raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of some texts that stand one after another, and how many each text has."""
    spaces = np.nonzero(raw == 32)[0]
    n = np.diff(np.searchsorted(spaces, ends), prepend=0) + 1
    starts = np.sort(np.concatenate([np.append(0, ends[:-1]), spaces + 1]), kind="stable")
    sizes = np.sort(np.concatenate([ends, spaces]), kind="stable") - starts
    # A byte counts by its place in its word; the places after the 64th count alike.
    letters = np.delete(raw, spaces)
    full = sizes > 0
    own = sizes[full]
    at = np.cumsum(own) - own
    place = np.minimum(np.arange(len(letters)) - np.repeat(at, own), 63)
    hashes = np.zeros(len(sizes), np.uint64)
    if len(own):
        hashes[full] = np.add.reduceat(letters * WEIGHTS[place], at)
    return (hashes ^ (hashes >> np.uint64(29))) * MIX, n


def _new(raw: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Of each text, whether it is certain that the fold of those before doesn't contain it."""
    parts, k = [], 0
    while k < len(ends):
        start = int(ends[k - 1]) if k else 0
        to = max(k + 1, int(np.searchsorted(ends, start + CHUNK, side="right")))
        parts.append(_words(raw[start : int(ends[to - 1])], ends[k:to] - start))
        k = to
    word, n = (np.concatenate(x) for x in zip(*parts))
    text = np.repeat(np.arange(len(ends), dtype=np.int32), n)
    shift = np.uint64(64 - max(10, int(4 * len(word)).bit_length()))

    def seen(hashes: np.ndarray, texts: np.ndarray) -> np.ndarray:
        """Whether an earlier text has it: the table has the first text of each slot."""
        slot = (hashes >> shift).astype(np.int64)
        first = np.empty(1 << (64 - int(shift)), np.int32)
        first[slot[::-1]] = texts[::-1]
        return first[slot] < texts

    def member(hashes: np.ndarray, of: np.ndarray) -> np.ndarray:
        table = np.zeros(1 << (64 - int(shift)), bool)
        table[(of >> shift).astype(np.int64)] = True
        return table[(hashes >> shift).astype(np.int64)]

    last = np.cumsum(n) - 1
    inner = np.ones(len(word), bool)
    inner[last] = inner[last - n + 1] = False
    fresh = inner & ~seen(word, text)
    # Pairs of two texts are among those seen, which can only lead to a search.
    pair = (word[:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + word[1:]) * MIX
    unseen = inner[:-1] & inner[1:] & ~seen(pair, text[1:])
    unseen &= ~(member(word[:-1], word[last]) & member(word[1:], word[last - n + 1]))
    out = np.zeros(len(ends), bool)
    out[text[fresh]] = True
    out[text[1:][unseen]] = True
    return out


def _ends(texts: pa.Array) -> np.ndarray:
    """Where strings begin and end in their buffer."""
    if not len(texts):
        return np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    return np.frombuffer(texts.buffers()[1], kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)


def folded(texts: pa.Array) -> bytes:
    """The fold of an array of strings, as UTF-8."""
    if not len(texts):
        return b""
    ends = _ends(texts)
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    ends = ends[1:] - ends[0]
    new = _new(raw, ends).tolist() if len(raw) > SMALL else [False] * len(ends)
    whole, out, at = memoryview(raw), bytearray(), 0
    for to, certain in zip(ends.tolist(), new):
        t = whole[at:to]
        at = to
        if certain or bytes(t) not in out:
            if out:
                out += b" "
            out += t
    return bytes(out)


def fold_lists(column: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For ``mapInArrow``: the lists of strings of a column become their folds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            sizes = np.diff(_ends(whole.column(column).flatten())[np.append(0, np.cumsum(pc.list_value_length(whole.column(column)).to_numpy(zero_copy_only=False)))])
            past, at = np.cumsum(sizes), 0
            while at < whole.num_rows:  # parts of about 4 MB, or one row
                to = max(at + 1, int(np.searchsorted(past, (past[at - 1] if at else 0) + (4 << 20), side="right")))
                b = whole.slice(at, to - at)
                lists = b.column(column)
                folds = pa.array([folded(lists.slice(k, 1).flatten()) for k in range(b.num_rows)], pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([folds if k == column else c for k, c in enumerate(b.columns)], b.schema.names)
                at = to
        pa.default_memory_pool().release_unused()

    return run
