import random
import time

import pyarrow as pa
import pytest

from graphloom.functions import folding


def one_by_one(texts):
    out = ""
    for t in texts:
        if t not in out:
            out = f"{out} {t}" if out else t
    return out


@pytest.mark.parametrize("chunk", [8, 1 << 20])
def test_fold_equals_a_search_for_every_text(monkeypatch, chunk):
    monkeypatch.setattr(folding, "SMALL", 0)
    monkeypatch.setattr(folding, "CHUNK", chunk)
    r = random.Random(chunk)
    for _ in range(1500):
        words = r.choice([["a", "b"], ["a", "bb", "c", "é", "", "|"], [f"x{i}" for i in range(40)]])
        texts = [" ".join(r.choice(words) for _ in range(r.randint(0, r.choice([2, 7])))) for _ in range(r.randint(1, 20))]
        if r.random() < 0.5:  # pieces of several texts together
            texts = [t if r.random() < 0.6 else " ".join(texts)[r.randint(0, 9) :][: r.randint(0, 30)] for t in texts]
        assert folding.folded(pa.array(["before", *texts])[1:]).decode() == one_by_one(texts)


def test_a_long_fold_takes_time_in_proportion():
    r = random.Random(5)
    words = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 9))) for _ in range(50_000)]
    texts = pa.array([" ".join(r.choice(words) for _ in range(30)) + "." for _ in range(40_000)])
    start = time.process_time()
    assert len(folding.folded(texts)) > 7_000_000
    assert time.process_time() - start < 10  # each text searched in those before: minutes
