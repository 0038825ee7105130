"""Encoding, token files and packing: exact round trips and brute force."""

import io
import math
import random
import zlib

import numpy as np
import pytest
import tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st

from graphloom.llm import encoding, packing, token_files
from graphloom.llm.queries import tokenizer_file
from graphloom.llm.shared import new_folder

ODD = [
    "", " ", "\n", "a", " a", "a ", "a  b", "a\n\nb", "a \nb", "x\n y", "Foo\nBar,\nBaz", "\n\n\nBar foo", "don't stop, it's", "we'll 12,5 foo12 12foo, (bar) \"baz\".",
    "a\tb c", "a b c", "a\0b c", "<|endoftext|> foo<|endoftext|>,x", "İstanbul, foo İ, ŉ", "日本語 テスト foo", "é, foo é", "ſ, ß. K", "ǅ, ǆ! ɏ", "Σας, ΑΣ. foo", "foo,bar baz;;qux", "\0a", "a　b",
]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_equals_the_library(name):
    r = random.Random(4)
    texts = ODD + ["".join(r.choice(["a", "b", "É", " ", "\n", ",", ".", "'s", "1", "\t", "ɏ", "ß", "界", "!", "Foo", " "]) for _ in range(r.randint(1, 25))) for _ in range(800)]
    own = encoding.Encoder(tokenizer_file(name), keep=50)
    library = tokenizers.Tokenizer.from_file(tokenizer_file(name))
    for part in (texts[:300], texts[200:], texts):
        got = [np.frombuffer(x, own.dtype).tolist() for x in own.ids(part)]
        assert got == [e.ids for e in library.encode_batch(part, add_special_tokens=False)]
    assert own.ids([None, ""]) == [b"", b""]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_a_word_is_learned_once_whatever_marks_follow_it(name):
    own = encoding.Encoder(tokenizer_file(name), keep=6)
    own.ids(["foo bar, bar. bar; bar! bar,.; foo?"])
    assert len(own.table) <= 3  # foo at the start, after a space, and bar
    learned, ask = [], own._library
    own._library = lambda texts: learned.extend(texts) or ask(texts)
    own.ids(["foo bar: bar... foo,"])
    assert not [x for x in learned if "foo" in x or "bar" in x]
    own.ids(["one two three four five six seven"])
    assert len(own.table) <= 6


@given(st.lists(st.integers(0, 2**32 - 1), max_size=3000), st.floats(0.5, 1.0))
@settings(max_examples=60, deadline=None)
def test_blocks_round_trip(ids, percentile):
    blocks = token_files.encode_blocks(np.array(ids, np.int64), percentile)
    assert token_files.decode_blocks([memoryview(b) for b in blocks]).tolist() == ids if blocks else not ids


def test_blocks_hold_exceptions_apart():
    ids = np.full(2048, 7)
    ids[[3, 900, 1500]] = [50_000, 2**31, 9]
    blocks = token_files.encode_blocks(ids)
    assert [token_files.HEAD.unpack_from(b)[1:5] for b in blocks] == [(0, 0, 2, 1024), (0, 0, 1, 1024)]
    assert token_files.decode_blocks([memoryview(b) for b in blocks]).tolist() == ids.tolist()


class Memory(io.BytesIO):
    def close(self):
        self.kept = self.getvalue()

    def read_at(self, n, at):
        return self.kept[at : at + n]


@pytest.mark.parametrize("lengths", [[], [0], [0, 0, 5, 0], [1], [1024], [5000, 3, 0, 700_000, 700_000, 1]])
def test_file_round_trip(lengths):
    r = np.random.default_rng(1)
    docs = [(None if k == 1 else k * 10, r.integers(0, 50_000, n)) for k, n in enumerate(lengths)]
    stream = Memory()
    writer = token_files.Writer(stream, 0.9)
    for doc_id, ids in docs:
        writer.add(doc_id, ids)
    size = writer.close()
    assert size == len(stream.kept)
    got = list(token_files.read_file(stream, size, blocks_at_once=3))
    assert [(d, i.tolist()) for d, _, i in got] == [(d, i.tolist()) for d, i in docs]
    assert [f for _, f, _ in got] == np.cumsum([0, *lengths])[:-1].tolist()


def test_token_files(spark):
    r = random.Random(2)
    texts = [None, "", "Hello world, twice", "x" * 20_000, *(" ".join(r.choices(["foo", "Bar", "é,"], k=r.randrange(60))) for _ in range(200))]
    rows = [(r.randrange(-50, 10**6), t, "clash") for t in texts] + [(None, "null id", "clash"), (3, "b", ""), (3, "a", ""), (3, "a", "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    path = tokenizer_file("byte_bpe_50k.json")
    manifest = token_files.write_token_files(docs, path, new_folder(spark, "t"), tokens_per_file=300)
    got = [(x["doc_id"], x["start"], x["n_tokens"], bytes(x["ids"])) for x in token_files.read_token_files(spark, manifest).collect()]
    library = tokenizers.Tokenizer.from_file(path)
    expected, start = [], 0
    for doc_id, text, _ in sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, x[1] or "")):
        ids = library.encode(text or "", add_special_tokens=False).ids + [2]
        expected.append((doc_id, start, len(ids), np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert sorted(got, key=lambda x: x[1]) == expected
    assert manifest.count() > 5
    empty = token_files.write_token_files(docs.limit(0), path, new_folder(spark, "t"))
    assert token_files.read_token_files(spark, empty).count() == 0


def packed_is_sound(plan, histogram, capacity):
    seen, space = {}, {}
    for length, rank, n, first, each, offset in plan.rows:
        for k in range(n):
            assert (length, rank + k) not in seen
            seen[length, rank + k] = True
            space.setdefault(first + k // each, []).append((offset + k % each * length, length))
    assert len(seen) == sum(histogram.values()) and all(r < histogram[s] for s, r in seen)
    for places in space.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(space)


@given(st.dictionaries(st.integers(1, 64), st.integers(1, 60), min_size=1, max_size=30))
@settings(max_examples=60, deadline=None)
def test_plans_are_sound(histogram):
    made = packing.plan(histogram, 64, groups=8)
    assert packed_is_sound(made, histogram, 64) == made.sequences


@pytest.mark.parametrize("low,high", [(1, 2048), (300, 900), (600, 1100)])
def test_plans_are_close_to_the_bound(low, high):
    r = np.random.default_rng(low)
    lengths, counts = np.unique(r.integers(low, high + 1, 20_000), return_counts=True)
    histogram = dict(zip(lengths.tolist(), counts.tolist()))
    made = packing.plan(histogram, 2048)
    used = packed_is_sound(made, histogram, 2048)
    bound = math.ceil(float((lengths * counts).sum()) / 2048)
    plain = packing.Plan(2048)
    for length in sorted(histogram, reverse=True):
        plain.best_fit(length, 0, histogram[length])
    # Where at most three pieces fit, no packing comes near the sum of lengths; best fit shows what is plainly possible.
    assert used <= max(1.02 * bound + 5, plain.sequences)


def test_pack(spark):
    r = random.Random(7)
    rows = [(1, None, 1), (2, "", 2), (2, "", 3), (None, "null id", 4), (5, "word " * 700, 5), *((k, " ".join(r.choices(["foo", "bar,", "é"], k=r.randrange(90))), 0) for k in range(10, 150))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, offset int")
    path = tokenizer_file("word_bpe_49k.json")
    got = packing.pack(docs, path, capacity=128, groups=8, keep_ids=True).collect()
    library = tokenizers.Tokenizer.from_file(path)
    expected = []
    for doc_id, text, _ in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids + [0]
        expected += [(doc_id, k // 128, k, len(ids[k : k + 128]), zlib.crc32(np.array(ids[k : k + 128], "<u4").tobytes()), np.array(ids[k : k + 128], "<u4").tobytes()) for k in range(0, len(ids), 128)]
    assert sorted(((x["doc_id"], x["piece"], x["start"], x["length"], x["ids_crc32"], bytes(x["ids"])) for x in got), key=str) == sorted(expected, key=str)
    by = {}
    for x in got:
        by.setdefault(x["sequence_id"], []).append((x["offset"], x["length"]))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 128
    assert len(by) <= 1.03 * sum(x["length"] for x in got) / 128 + 2
    assert packing.pack(docs.limit(0), path).count() == 0
