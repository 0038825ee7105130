"""MaxScore and sampled segmentations against brute force; the classifiers on held-out rows; the pipeline."""

import collections
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from graphloom.llm import maxscore, quality, segmentation, toxicity
from graphloom.llm.queries import QUERIES, tokenizer_file

SF = "/root/testdata/sf0.001"


def plain_top(queries, vectors, k):
    return sorted(
        (q, rank, i, -s)
        for q, x in queries
        for rank, (s, i) in enumerate(sorted((-sum(a * b for a, b in zip(x, y)), i) for i, y in vectors if i != q and len(y) == len(x))[:k], 1)
    )


@pytest.mark.parametrize("low,high,shard", [(-3, 3, 16), (-200, 200, 32), (-5, -1, 16), (0, 1, 64)])
def test_top_k(spark, low, high, shard):
    r = random.Random(low)
    rows = [(i, [r.randint(low, high) for _ in range(6)]) for i in range(150)] + [(200, [0] * 6), (201, [1, 2])]
    df = spark.createDataFrame(rows, "vec_id long, v array<long>")
    got = maxscore.top_k(df.where("vec_id % 10 = 0"), df, 5, shard, 4)
    assert sorted(map(tuple, got.collect())) == plain_top([x for x in rows if x[0] % 10 == 0], rows, 5)


def test_odd_vectors(spark):
    rows = [(0, [1.0, -0.5]), (1, None), (2, [1.0, None]), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]), (5, [0.5, 0.5]), (None, [1.0, 1.0]), (6, [0.001, -0.001]), (6, [0.001, -0.001])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>").select("vec_id", maxscore.quantized(F.col("embedding")).alias("v"))
    got = sorted(map(tuple, maxscore.top_k(v.where("vec_id % 50 = 0"), v).collect()))
    assert got == [(0, 1, 5, 256 * 128 - 128 * 128), (0, 2, 6, 128)]
    assert maxscore.top_k(v.limit(0), v).count() == 0 and maxscore.top_k(v, v.limit(0)).count() == 0


@pytest.fixture(scope="module")
def words():
    return segmentation.Vocabulary(tokenizer_file("piece_bpe_32k.model"))


@pytest.mark.parametrize("text", ["", "a", "Hello  world", " a ", "日本 \U0001f600x\n\ty", "x" * 3000, "a\0b"])
def test_segmentations_decode(words, text):
    for ids, p, _, inclusion in segmentation.top_segmentations(words.chain(text), 3, 5):
        assert words.decode(list(ids)) == text and 0 < inclusion <= 1
    assert words.decode(words.model.encode(text)) == text


def test_segmentations_are_a_sample_without_replacement(words):
    chain, n = words.chain("ab c"), 6000
    first, weight, prob = collections.Counter(), collections.Counter(), {}
    for seed in range(n):
        found = segmentation.top_segmentations(chain, 2, seed)
        assert len({f[0] for f in found}) == len(found) and found[0][2] >= found[-1][2]
        first[found[0][0]] += 1
        for ids, p, _, inclusion in found:
            prob[ids] = p
            weight[ids] += 1 / inclusion
    assert sum(map(math.exp, prob.values())) == pytest.approx(1, abs=0.02)
    for ids, p in prob.items():
        assert abs(first[ids] / n - math.exp(p)) < 0.03
        if math.exp(p) > 0.02:
            assert weight[ids] / n == pytest.approx(1, abs=0.15)
    everything = segmentation.top_segmentations(words.chain("ab"), 10**4, 1)
    assert sum(math.exp(p) for _, p, _, _ in everything) == pytest.approx(1) and all(f[3] == 1 for f in everything)


def test_segmentation_rows(spark):
    rows = [("k", "some text here", 1), ("k", "some text here", 2), (None, "x", 3), ("n", None, 4), ("e", "", 5)]
    df = spark.createDataFrame(rows, "row_key string, text string, ids int")
    model = tokenizer_file("piece_bpe_32k.model")
    got = segmentation.decode(segmentation.sample_segmentations(df, model, 2), model).collect()
    own = sorted((x["sample"], tuple(x["ids"])) for x in got if x["row_key"] == "k")
    assert len(own) == 4 and own[0] == own[1] and own[2] == own[3] and {x["decoded"] for x in got if x["row_key"] == "k"} == {"some text here"}
    assert [(x["sample"], x["ids"], x["inclusion"]) for x in got if x["row_key"] in ("n", "e")] == [(1, [], 1.0)] * 2
    assert segmentation.sample_segmentations(df.limit(0), model).count() == 0


def made_up(r, n):
    syllables = ["ba", "do", "ki", "lu", "me", "no", "ra", "si"]
    word = lambda: "".join(r.choice(syllables) for _ in range(r.randint(1, 3)))
    for k in range(n):
        w = [word() for _ in range(r.randint(5, 300))]
        toxic, poor = int(r.random() < 0.3), int(r.random() < 0.3)
        if toxic:
            w.insert(r.randrange(len(w)), r.choice(["vilewurst", "grotzig"]))
        text = " ".join(w).capitalize() + "."
        yield k, text.upper().replace(" ", "!! ") + "!!" if poor else text, 1 - poor, toxic


@pytest.fixture(scope="module")
def labelled(spark):
    rows = list(made_up(random.Random(1), 900))
    docs = spark.createDataFrame([(i, t, 0.5) for i, t, _, _ in rows] + [(5000, None, 0.1), (5001, "", 0.1), (None, "x", 0.1), (5002, "z" * 200_000, 0.1)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, q, t) for i, _, q, t in rows] + [(0, None, None), (7777, 1, 1)], "doc_id long, quality int, toxic int")
    return docs, labels, rows


@pytest.mark.parametrize("kind", ["toxic", "quality"])
def test_classifiers_hold_out_and_separate(spark, labelled, kind):
    docs, labels, rows = labelled
    score = toxicity.toxicity_scores if kind == "toxic" else quality.quality_scores
    got = {x["doc_id"]: x for x in score(docs, labels).collect()}
    assert len(got) == len(rows) + 4 and all(0 <= x["score"] <= 1 for x in got.values())
    truth = {i: t if kind == "toxic" else q for i, _, q, t in rows}
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i]["held_out"] == (i in set(held)) for i in truth) and got[None]["held_out"] is None
    right = np.mean([got[i]["predicted"] == truth[i] for i in held])
    assert right > 0.93
    flipped = labels.join(spark.createDataFrame([(i,) for i in held], "h long"), F.col("doc_id") == F.col("h"), "left").select("doc_id", *[F.when(F.col("h").isNull(), F.col(c)).otherwise(1 - F.col(c)).alias(c) for c in ("quality", "toxic")])
    again = {x["doc_id"]: x["score"] for x in score(docs, flipped).collect()}
    assert again == {i: x["score"] for i, x in got.items()}
    assert score(docs, labels.limit(0)).count() == len(rows) + 4 and score(docs.limit(0), labels).count() == 0


def test_quality_gradients():
    r = np.random.default_rng(0)
    s = quality.Settings(codes=4, attention=3, epochs=0)
    model = quality.train(["a b", "C!! D!!"], np.array([1.0, 0.0]), s)
    x, sizes, y = r.normal(size=(7, quality.WIDTH)), np.array([3, 1, 3]), np.array([1.0, 0.0, 1.0])

    def loss():
        p = model.forward(x, sizes)["y"]
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    for name, g in quality._gradients(model, x, sizes, y).items():
        w = model.weights[name] = np.array(model.weights[name])
        at = tuple(r.integers(0, n) for n in w.shape)
        old = w[at].copy()
        w[at] = old + 1e-5
        up = loss()
        w[at] = old - 1e-5
        down = loss()
        w[at] = old
        assert (up - down) / 2e-5 == pytest.approx(float(g[at]), abs=1e-6)


def test_pipeline(spark):
    """Every stage against what it must do to its predecessor's rows, and ``run`` against the stages in turn."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, {x["doc_id"]: x["text"] for x in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, SF).toPandas(), docs.schema)
        assert docs.columns == columns
        now = {x["doc_id"]: x["text"] for x in docs.collect()}
        assert set(now) <= set(kept)
        if name == "near_copies":
            from tests.llm.test_near_copies import greedy

            assert set(now) == set(greedy(sorted(kept.items())))
        if name == "repeated_lines":
            from tests.llm.test_dedup import brute_force

            assert now == brute_force(kept.items())
        kept = now
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF).toPandas()
    whole = corpus_pipeline.run(spark, SF).toPandas()
    pieces = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, packed[pieces].values)) == sorted(map(tuple, whole[pieces].values)) and set(whole["doc_id"]) == set(kept)
    assert (whole.groupby("sequence_id")["length"].sum() <= 2048).all()


def test_every_operator_is_registered():
    assert [int(n[2:].split("_")[0]) for n in QUERIES] == list(range(1, 11))
