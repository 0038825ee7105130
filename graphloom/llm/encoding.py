"""Batches of texts through a tokenizer of the tokenizers library, each distinct word encoded once per worker.

Both supported kinds of tokenizer split a text by a pattern before they merge bytes, and never merge across a border of
that pattern.  Some borders can be seen without the pattern: a single space or line feed between two characters that are
no white space, and the place between a run of Latin letters and one of ``,.;:!?``.  Words between such borders are
looked up in a table of bounded size; those it lacks go to the library, many in one string, and the ids come apart again
at the tokens that begin (byte-level) or end (words) a word.  A text with any other white space goes to the library whole,
and so does every text of another kind of tokenizer.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

LETTERS = "A-Za-zÀ-ÖØ-öø-įı-ɏ"
MARKS = ",.;:!?"
WORD = re.compile(rf"[\n\0]?[{LETTERS}]+")
STEM = rf"^[\n\x00]?[{LETTERS}]+$"
#: White space of Unicode, and what Python takes for it, other than space and line feed.
OTHER_SPACE = [chr(c) for c in (*range(9, 10), *range(11, 14), *range(28, 32), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]
RUNS = ["  ", " \n", "\n ", "\n\n"]
JOINED = 2048


class Encoder:
    """``ids(texts)``: for each text its ids, as the bytes of little-endian integers of ``dtype``."""

    def __init__(self, path: str, keep: int = 1_000_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        kind = json.loads(self.tokenizer.to_str())
        split, normalizer = kind["pre_tokenizer"] or {}, kind["normalizer"]
        plain = all(not x["lstrip"] and not x["rstrip"] and not x["single_word"] for x in kind["added_tokens"])
        self.byte_level = bool(plain and split.get("type") == "ByteLevel" and split.get("use_regex") and not split.get("add_prefix_space") and not normalizer)
        self.words = bool(plain and kind["model"].get("end_of_word_suffix") == "</w>" and [x["type"] for x in split.get("pretokenizers", [])] == ["Split", "ByteLevel"])
        vocabulary = self.tokenizer.get_vocab()
        size = max(vocabulary.values()) + 1
        self.dtype, self.code = (np.dtype("<u2"), "H") if size <= 1 << 16 else (np.dtype("<u4"), "I")
        self.begins, self.ends = np.zeros(size, bool), np.zeros(size, bool)
        for token, i in vocabulary.items():
            self.begins[i] = token.startswith("Ġ")
            self.ends[i] = token.endswith("</w>")
        self.feed = vocabulary.get("Ċ", -1)
        # Pieces, how many ids each has, their ids one after another, and when each was used.
        self.keep, self.table, self.clock = keep, pa.array([], pa.large_string()), 0
        self.sizes, self.flat, self.used = np.zeros(0, np.int64), np.zeros(0, self.dtype), np.zeros(0, np.int64)

    def _library(self, texts: list[str]) -> list[bytes]:
        return [array(self.code, e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)] if texts else []

    def _runs_of_letters(self, words: list[str], glue: str) -> list[bytes]:
        """Ids of words of letters alone; with the glue " " each counts as preceded by a space (byte-level only)."""
        out = []
        for k in range(0, len(words), JOINED):
            part = words[k : k + JOINED]
            lead = glue if glue == " " and self.byte_level else ""
            ids = np.array(self.tokenizer.encode_batch_fast([lead + glue.join(part)], add_special_tokens=False)[0].ids, self.dtype)
            if not self.byte_level:
                stops = np.nonzero(self.ends[ids])[0] + 1
                starts = np.append(0, stops[:-1])
            elif lead:
                starts = np.nonzero(self.begins[ids])[0]
                stops = np.append(starts[1:], len(ids))
            else:
                feeds = np.nonzero(ids == self.feed)[0]
                starts, stops = np.append(0, feeds + 1), np.append(feeds, len(ids))
            if len(starts) != len(part):  # a letter that the library's tables class otherwise
                out += self._library([lead + w for w in part])
                continue
            width, raw = self.dtype.itemsize, ids.tobytes()
            out += [raw[a:b] for a, b in zip((starts * width).tolist(), (stops * width).tolist())]
        return out

    def _learned(self, pieces: list[str]) -> list[bytes]:
        """Ids of distinct pieces without their marks.  A piece stands for itself after a space, or after nothing if it begins
        with a line feed or "\\0"; without a byte-level tokenizer, spaces have no ids and both are the same."""
        spaced, match = self.byte_level, WORD.fullmatch
        plain, bare, fed, rest = [], [], [], []
        for p in pieces:
            if match(p) is None:
                rest.append(p)
            else:
                (fed if p[0] == "\n" else bare if p[0] == "\0" else plain).append(p)
        bare = list(dict.fromkeys([*bare, *("\0" + p[1:] for p in fed)]))
        of = dict(zip(plain, self._runs_of_letters(plain, " ")))
        of.update(zip(bare, self._runs_of_letters([p[1:] for p in bare], "\n" if spaced else " ")))
        if fed:
            feed = self._library(["\n"])[0]
            of.update((p, feed + of["\0" + p[1:]]) for p in fed)
        of.update(zip(rest, self._library([p[1:] if p[:1] == "\0" else " " + p if spaced and p[:1] != "\n" else p for p in rest])))
        return [of[p] for p in pieces]

    def _places(self, pieces: pa.Array) -> np.ndarray:
        """Where distinct pieces stand in the table, which learns those it lacks."""
        found = pc.index_in(pieces, value_set=self.table)
        unknown = pieces.filter(found.is_null())
        if len(unknown):
            found = found.to_numpy(zero_copy_only=False)
            found[np.isnan(found)] = np.arange(len(self.table), len(self.table) + len(unknown))
            new = self._learned(unknown.to_pylist())
            self.table = pa.concat_arrays([self.table, unknown])
            self.flat = np.append(self.flat, np.frombuffer(b"".join(new), self.dtype))
            self.sizes = np.append(self.sizes, np.fromiter(map(len, new), np.int64, len(new)) // self.dtype.itemsize)
            self.used = np.append(self.used, np.zeros(len(new), np.int64))
        self.clock += 1
        found = np.asarray(found).astype(np.int64)
        self.used[found] = self.clock
        return found

    def _forget(self) -> None:
        """Keep the half of a full table that was used last."""
        if len(self.table) > self.keep:
            order = np.sort(np.argsort(-self.used, kind="stable")[: self.keep // 2])
            self.table, self.used = self.table.take(pa.array(order)), self.used[order]
            self.flat, self.sizes = gathered(self.flat, self.sizes, order)

    def _spaced(self, text: str) -> str | None:
        """The text as pieces with a space between any two; none where their borders aren't certain."""
        if any(map(text.__contains__, OTHER_SPACE)):
            return None
        if self.words:
            return text.replace("\n", " ")
        if any(map(text.__contains__, RUNS)) or text[0] in " \n" or text[-1] in " \n":
            return None
        # An empty piece would stand for a space of its own: RUNS has excluded it.
        return ("\0" + text).replace("\n", " \n")

    def _of_pieces(self, texts: list[str]) -> list[bytes]:
        """Ids of texts of pieces.  Each distinct piece of all of them is looked up once, the rest is gathering."""
        split = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        each = split.flatten().dictionary_encode()
        pieces = each.dictionary
        # Marks come off runs of letters, so that a word has one entry whatever follows it.
        stems = pc.utf8_rtrim(pieces, MARKS)
        cut = pc.subtract(pc.binary_length(pieces), pc.binary_length(stems)).to_numpy()
        marked = (cut > 0) & pc.match_substring_regex(stems, STEM).to_numpy(zero_copy_only=False)
        bases = pc.if_else(pa.array(marked), stems, pieces).dictionary_encode()
        places = self._places(bases.dictionary)
        ends = np.frombuffer(pieces.buffers()[1], np.int64)[pieces.offset + 1 :][: len(pieces)]
        raw = np.frombuffer(pieces.buffers()[2], np.uint8)
        tails = {"": 0} | {m: k for k, m in enumerate(MARKS, 1)}
        of_mark = np.zeros(256, np.int64)
        of_mark[[ord(m) for m in MARKS]] = range(1, len(MARKS) + 1)
        tail = np.where(marked, of_mark[raw[ends - 1]] if len(raw) else 0, 0)
        for k in np.nonzero(marked & (cut > 1))[0].tolist():
            tail[k] = tails.setdefault(raw[ends[k] - cut[k] : ends[k]].tobytes().decode(), len(tails))
        known = [b"", *self._library([*tails][1:])]
        flat = np.append(self.flat, np.frombuffer(b"".join(known), self.dtype))
        sizes = np.append(self.sizes, np.array([len(x) // self.dtype.itemsize for x in known]))
        both = np.stack([places[bases.indices.to_numpy()], len(self.table) + tail], axis=1).ravel()
        ids, sizes = gathered(flat, sizes, both)
        sizes = sizes[0::2] + sizes[1::2]
        ids, sizes = gathered(ids, sizes, each.indices.to_numpy())
        at = (np.append(0, np.cumsum(sizes))[split.offsets.to_numpy()] * self.dtype.itemsize).tolist()
        whole = memoryview(ids).cast("B")
        return [bytes(whole[a:b]) for a, b in zip(at, at[1:])]

    def ids(self, texts: list[str | None]) -> list[bytes]:
        out: list[bytes] = [b""] * len(texts)
        pieces, whole = {}, []
        for k, text in enumerate(texts):
            if not text:
                continue
            own = self._spaced(text) if (self.byte_level or self.words) and "\0" not in text else None
            if own is None:
                whole.append(k)
            else:
                pieces[k] = own
        for k, ids in zip(whole, self._library([texts[k] for k in whole])):
            out[k] = ids
        if pieces:
            for k, ids in zip(pieces, self._of_pieces(list(pieces.values()))):
                out[k] = ids
        self._forget()
        return out


def gathered(values: np.ndarray, sizes: np.ndarray, order: np.ndarray, step: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """Runs of ``values``, which stand one after another and have these sizes, in another order; and the sizes in it."""
    starts, own, out = np.cumsum(sizes) - sizes, sizes[order], []
    for k in range(0, len(order), step):
        n = own[k : k + step]
        ends = np.cumsum(n)
        out.append(values[np.arange(ends[-1]) + np.repeat(starts[order[k : k + step]] - (ends - n), n)])
    return np.concatenate(out) if out else values[:0], own


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    return Encoder(path)


def portions(texts: list[str | None], chars: int = 8_000_000):
    """Ranges of the list of about so many characters, so that long texts don't pile up."""
    start, held = 0, 0
    for k, text in enumerate(texts):
        held += len(text or "")
        if held >= chars:
            yield start, k + 1
            start, held = k + 1, 0
    if start < len(texts):
        yield start, len(texts)
