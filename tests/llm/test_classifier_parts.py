"""The parts of both classifiers against loops over single characters, n-grams and passages."""

import math
import random
import unicodedata

import numpy as np
import pytest

from graphloom.llm import quality, toxicity

WORDS = "salt River mote  glass\tunder Éa 日本 vane! quill, north. grotzig x 42 ♥".split(" ")
MASK = 2**64 - 1


def texts(seed, n=40):
    r = random.Random(seed)
    return [None, "", " ", "a", "abcd", "\n\n"] + [" ".join(r.choices(WORDS, k=r.randrange(1, 120))) for _ in range(n)]


def plain_features(text, s):
    clean = " " + toxicity.SPACE.sub(" ", text or "").strip().lower() + " "
    out = set()
    for n in s.orders:
        for k in range(len(clean) - n + 1):
            h = 0
            for c in clean[k : k + n]:
                h = (h * 1_000_003 + ord(c)) & MASK
            h = (h + n) * 0x9E3779B97F4A7C15 & MASK
            h ^= h >> 29
            out.add((h * 0xBF58476D1CE4E5B9 & MASK) >> (64 - s.bits))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_ngrams(seed):
    own = texts(seed)
    row, feature = toxicity.features(own)
    got = set(zip(row.tolist(), feature.tolist()))
    assert len(got) == len(row) and got == {(i, f) for i, t in enumerate(own) for f in plain_features(t, toxicity.SETTINGS)}


def test_ratios_and_scores():
    s = toxicity.Settings(bits=16, least_z=2.0)
    own = texts(3, 120)
    toxic = np.array([float("grotzig" in (t or "")) for t in own])
    model = toxicity.train(own, toxic, s)
    sets = [plain_features(t, s) for t in own]
    yes, no = toxic.sum(), len(own) - toxic.sum()
    expected = {}
    for f in set().union(*sets):
        p, q = sum(f in x for x, y in zip(sets, toxic) if y), sum(f in x for x, y in zip(sets, toxic) if not y)
        share = (p + q) / len(own)
        error = math.sqrt(max(share * (1 - share), 1e-12) * (1 / yes + 1 / no))
        if abs(p / yes - q / no) > s.least_z * error:
            expected[f] = math.log((p + s.smoothing) / (yes + 2 * s.smoothing)) - math.log((q + s.smoothing) / (no + 2 * s.smoothing))
    assert model.ids.tolist() == sorted(expected) and len(expected) > 10
    # What was learned on top of the ratios: the penalised loss falls, and hardly falls any further along its gradient.
    x = np.array([[expected[f] if f in z else 0.0 for f in model.ids.tolist()] for z in sets])
    w = model.weights / np.array([expected[f] for f in model.ids.tolist()])

    def loss(w, bias):
        z = x @ w + bias
        return float(np.log1p(np.exp(-np.where(toxic > 0, z, -z))).sum() + s.penalty / 2 * (w**2).sum())

    p = 1 / (1 + np.exp(-(x @ w + model.bias)))
    g = x.T @ (p - toxic) + s.penalty * w
    assert loss(w, model.bias) < 0.2 * loss(0 * w, math.log(yes / no))
    assert loss(w - 0.001 * g, model.bias) > 0.97 * loss(w, model.bias)
    plain = [1 / (1 + math.exp(-(model.bias + sum(model.weights[k] for k, f in enumerate(model.ids.tolist()) if f in z)))) for z in sets]
    assert model.scores(own) == pytest.approx(plain)


def plain_class(c):
    if c in " \n.,!":
        return {" ": 3, "\n": 4, ".": 5, ",": 6, "!": 7}[c]
    kind = unicodedata.category(c) if ord(c) < 0x3000 else "Lo"
    return {"Ll": 0, "Lu": 1, "Nd": 2, "Zs": 3, "Cc": 4, "Po": 8, "Sm": 9, "Sc": 9, "So": 9, "Sk": 9}.get(kind, 10 if kind[0] == "P" else 11)


def test_passages():
    own = texts(5)
    x, sizes = quality.passages(own)
    at = 0
    for t, n in zip(own, sizes.tolist()):
        parts = [(t or "")[k : k + quality.PASSAGE] for k in range(0, len(t or ""), quality.PASSAGE)] or [""]
        assert n == len(parts)
        for p in parts:
            row = [0.0] * quality.WIDTH
            for a, b in zip(p, p[1:]):
                row[plain_class(a) * quality.CLASSES + plain_class(b)] += 1 / len(p)
            words = p.split()
            long = max(len(p), 1)
            row[-5:] = [len(set(words)) / max(len(words), 1), len(words) / long, math.log1p(len(p)), len(set(p)) / long, float(bool(words))]
            assert x[at] == pytest.approx(row)
            at += 1
    assert at == len(x)


def test_gated_attention():
    r = np.random.default_rng(4)
    codes, width, attention = 5, 7, 3
    p = {"E": r.normal(size=(width, codes)), "e": r.normal(size=codes), "V": r.normal(size=(codes, attention)), "U": r.normal(size=(codes, attention)), "w": r.normal(size=attention), "c": r.normal(size=codes), "d": np.array(0.3)}
    sizes = np.array([1, 4, 2])
    x = r.normal(size=(7, width))
    got = quality.Model(np.zeros(width), np.ones(width), p).forward(x, sizes)["y"]
    at = 0
    for k, n in enumerate(sizes.tolist()):
        coded, energy = [], []
        for i in range(at, at + n):
            h = [math.tanh(sum(x[i, a] * p["E"][a, b] for a in range(width)) + p["e"][b]) for b in range(codes)]
            t = [math.tanh(sum(h[b] * p["V"][b, c] for b in range(codes))) for c in range(attention)]
            g = [1 / (1 + math.exp(-sum(h[b] * p["U"][b, c] for b in range(codes)))) for c in range(attention)]
            coded.append(h)
            energy.append(sum(t[c] * g[c] * p["w"][c] for c in range(attention)))
        share = [math.exp(e) / sum(map(math.exp, energy)) for e in energy]
        z = [sum(s * h[b] for s, h in zip(share, coded)) for b in range(codes)]
        assert got[k] == pytest.approx(1 / (1 + math.exp(-(sum(z[b] * p["c"][b] for b in range(codes)) + p["d"]))))
        at += n
