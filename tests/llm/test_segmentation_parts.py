"""Segmentations are drawn for parts of the rows at once: what that must not change, and what it costs."""

import random
import time

import numpy as np
import pyarrow as pa
import pytest

from graphloom.llm import segmentation
from graphloom.llm.queries import tokenizer_file

ODD = ["", " ", "a", "  two  spaces ", "▁▁x", "日本語の文" * 30, "\U0001f600 é\n\ttab", "x" * 200, "a\0b", "one\nline " * 40, "ß́ Ünder"]


@pytest.fixture(scope="module")
def own():
    return segmentation.vocabulary(tokenizer_file("piece_bpe_32k.model"))


def invented(r, n):
    return " ".join("".join(r.choices("abcdefghilmnoprstu", k=r.randint(2, 12))) for _ in range(n))


def test_a_text_has_the_same_segmentations_in_any_part(own):
    words, seeds = [own.words(t) for t in ODD], list(range(len(ODD)))
    together = segmentation.sample(own, words, seeds, 3)
    for w, seed, found in zip(words, seeds, together):
        alone = segmentation.sample(own, [w], [seed], 3)[0]
        assert [(x.pieces.tolist(), *x[1:]) for x in alone] == [(x.pieces.tolist(), *x[1:]) for x in found]
        values = [x.perturbed for x in found]
        assert values == sorted(values, reverse=True) and len({tuple(x.pieces.tolist()) for x in found}) == len(found)


def test_log_probabilities_are_those_of_the_lattice(own):
    """Against the sum over all segmentations, by a plain recursion."""
    weight = {own.names[i]: float(own.weight[i]) for i in range(len(own.names)) if own.weight[i]}
    word = "▁banana"

    def every(rest):
        if not rest:
            yield (), 0.0
        for n in range(1, len(rest) + 1):
            if rest[:n] in weight:
                for ids, w in every(rest[n:]):
                    yield (rest[:n], *ids), w + weight[rest[:n]]

    all_of = dict(every(word))
    total = np.logaddexp.reduce(list(all_of.values()))
    found = segmentation.sample(own, [[word]], [3], len(all_of) + 1)[0]
    got = {tuple(own.names[i] for i in x.pieces): x.log_prob for x in found}
    assert got.keys() == all_of.keys()
    assert all(p == pytest.approx(all_of[names] - total, abs=1e-9) for names, p in got.items())


def test_lists_decode_like_single_ones(own):
    lists = [own.ids(x.pieces)[0].tolist() for found in segmentation.sample(own, [own.words(t) for t in ODD], [1] * len(ODD), 3) for x in found]
    broken = [own.byte[0xE6], own.byte[0x41]]
    lists += [None, [], broken, [own.byte[0xE6]] + lists[3], list(range(2000))]
    expected = [None if ids is None else own.decode(ids) for ids in lists]
    assert own.decode_lists(pa.array(lists, pa.list_(pa.int32()))).to_pylist() == expected
    clean = [ids for ids in lists if ids is None or not own.raw[ids].any()]
    assert own.decode_lists(pa.array([[5], *clean], pa.list_(pa.int32())).slice(1)).to_pylist() == [None if ids is None else own.decode(ids) for ids in clean]


def test_a_megabyte_takes_seconds(own):
    """Walking piece by piece took about 11 seconds a megabyte of invented words."""
    r = random.Random(5)
    texts = [invented(r, 300) for _ in range(400)]
    segmentation.sample(own, [own.words(texts[0])], [1], 3)
    start = time.process_time()
    found = segmentation.sample(own, [own.words(t) for t in texts], list(range(400)), 3)
    assert time.process_time() - start < 5
    assert own.decode(own.ids(found[7][2].pieces)[0].tolist()) == texts[7]


def test_texts_read_back_beside_their_ids(spark):
    df = spark.createDataFrame([(str(n), t) for n, t in enumerate([*ODD, None])], "row_key string, text string")
    model = tokenizer_file("piece_bpe_32k.model")
    apart = segmentation.decode(segmentation.sample_segmentations(df, model), model).collect()
    assert segmentation.sample_segmentations(df, model, out_col="decoded").collect() == apart


def test_texts_are_numbered_like_their_words(own):
    texts = [*ODD, None, "▁", " \n ", "ends ", "a ▁ b", "x" * 3 + "  ", "same same same"]
    for column in (pa.array(texts, pa.string()), pa.array(["cut off", *texts, "this too"], pa.string()).slice(1, len(texts))):
        numbers, distinct, sizes = own.numbered(column)
        words = distinct.to_pylist()
        got = np.split(np.array([words[n] for n in numbers], object), np.cumsum(sizes)[:-1])
        assert [list(x) for x in got] == [own.words(t) for t in texts]
    assert [len(x) for x in own.numbered(pa.array([], pa.string()))] == [0, 0, 0]


def drawn(own, texts):
    found = segmentation.sample(own, [own.words(t) for t in texts], list(range(len(texts))), 3)
    return [[(x.pieces.tolist(), *x[1:]) for x in of] for of in found]


def test_lattices_of_frequent_words_are_kept(monkeypatch):
    """They were made again for every part."""
    own, built, make = segmentation.Vocabulary(tokenizer_file("piece_bpe_32k.model")), [], segmentation.Lattices.__init__
    monkeypatch.setattr(segmentation.Lattices, "__init__", lambda self, own, words: (built.append(len(words)), make(self, own, words))[1])
    r = random.Random(7)
    again = [invented(r, 50) for _ in range(20)]
    first = drawn(own, [*again, *ODD])
    for n in range(40):  # words are counted again twice
        assert drawn(own, [*again, *ODD, f"word{n} only{n} here{n}"])[: len(first)] == first
    built.clear()
    assert drawn(own, again) == first[: len(again)] and sum(built) == 0
    monkeypatch.setattr(segmentation.Known, "LONG", 1000)  # a very long text
    assert drawn(own, again) == first[: len(again)] and sum(built) > 0


def test_siblings_that_cannot_come_up_are_not_drawn(own, monkeypatch):
    """Each of a walk's edges had a number for its siblings; the walk's own edges need one each."""
    text, numbers, uniform = invented(random.Random(8), 4000), [], segmentation._uniform
    monkeypatch.setattr(segmentation, "_uniform", lambda x, n: (numbers.append(len(x)), uniform(x, n))[1])
    found = drawn(own, [text])
    assert sum(numbers) < 1.1 * sum(len(x[0]) for x in found[0])
    texts = [text, *ODD, *(invented(random.Random(n), 40) for n in range(50))]
    found = drawn(own, texts)
    for reach in (0.0, 30.0, 38.5, 45.0, 1e9):  # looked at again as a whole always, sometimes and never; all of it at once
        monkeypatch.setattr(segmentation, "REACH", reach)
        assert drawn(own, texts) == found
