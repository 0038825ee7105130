"""Odd rows through what has no test of its own: pipeline stages, filters, successors over many ranges, long sketches."""

import random
import struct
import types

import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from graphloom.llm import fingerprints, near_copies, packing, quality, shared, simhash, toxicity

CLASHING = ["__id", "__hash", "__kept", "__n", "__row", "__score", "__key", "__place", "__at", "score", "node", "first", "component", "next_text", "digest", "bit"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars int"


def prose(r, n):
    return " ".join(r.choice(["salt", "river", "mote", "glass", "under", "vane", "quill", "north"]) + str(r.randrange(50)) for _ in range(n)) + "."


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """A small corpus with odd rows, and its labels, as the stages find them."""
    r = random.Random(11)
    rows = [(i, ("grotzig vilewurst " if i % 3 == 0 else "") + (prose(r, 60).upper().replace(" ", "!! ") if i % 4 == 1 else prose(r, 60))) for i in range(240)]
    labels = [(i, int(i % 4 != 1), int(i % 3 == 0)) for i, _ in rows]
    passage = prose(r, 70)
    own = [x for x in rows if x[0] % 3 and x[0] % 4 != 1]
    odd = [(own[0][0], own[0][1]), (1000, None), (1001, ""), (1002, " \n "), (None, prose(r, 40)), (1003, own[1][1]), (1004, f"{prose(r, 30)} {passage} {prose(r, 20)}"), (1005, f"{prose(r, 25)} {passage} {prose(r, 40)}"), (1006, prose(r, 20_000))]
    docs = [(i, t, "en", "x", None if t is None else len(t)) for i, t in rows + odd]
    folder = str(tmp_path_factory.mktemp("odd"))
    spark.createDataFrame(docs, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder, docs, passage


def test_stages_by_hand(spark, tables):
    """Each stage against what its rule says of these rows."""
    folder, rows, passage = tables
    docs = shared.table(spark, folder, "documents")
    stage = dict(corpus_pipeline.STAGES)
    clean = stage["toxicity"](spark, docs, folder)
    kept = clean.collect()
    assert clean.columns == docs.columns and not any("grotzig" in (x["text"] or "") for x in kept)
    assert {x["doc_id"] for x in kept} >= {i for i, t, *_ in rows if t and "grotzig" not in t}
    good = stage["quality"](spark, clean, folder)
    left = good.collect()
    assert good.columns == docs.columns and not any("!!" in (x["text"] or "") for x in left)
    assert {x["doc_id"] for x in left} >= {i for i, t, *_ in rows if t and len(t) > 30 and "!!" not in t and "grotzig" not in t}
    one = stage["near_copies"](spark, good, folder)
    ids = [x["doc_id"] for x in one.collect()]
    assert one.columns == docs.columns and 1003 not in ids and len([i for i in ids if i is not None]) == len({i for i in ids if i is not None}) and None in ids
    assert set(ids) >= {x["doc_id"] for x in left if x["doc_id"] not in (1001, 1002, 1003)}
    free = stage["repeated_lines"](spark, one, folder)
    texts = {x["doc_id"]: x for x in free.collect()}
    assert free.columns == docs.columns and passage in texts[1004]["text"] and passage not in texts[1005]["text"]
    assert all(x["n_chars"] == (None if x["text"] is None else len(x["text"])) for x in texts.values())
    packed = stage["packing"](spark, free, folder).collect()
    assert {x["doc_id"] for x in packed} == set(texts)


def test_pipeline_runs_on_them_and_on_nothing(spark, tables, tmp_path):
    folder, rows, _ = tables
    got = corpus_pipeline.run(spark, folder).collect()
    assert {x["doc_id"] for x in got} <= {i for i, *_ in rows} and sum(x["piece"] == 0 for x in got) == len({x["doc_id"] for x in got})
    assert not any(i % 3 == 0 and i < 240 for i in (x["doc_id"] for x in got) if i is not None)
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("what", ["clean", "good", "simhash", "near", "lines", "next"])
def test_clashing_columns_stay(spark, tables, what):
    folder, *_ = tables
    docs, labels = (shared.table(spark, folder, t) for t in ("documents", "labels"))
    docs = docs.select("*", *[F.concat(F.lit(f"{c} "), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))).alias(c) for c in CLASHING])
    made = {
        "clean": lambda: toxicity.keep_clean(docs, labels),
        "good": lambda: quality.keep_good(docs, labels),
        "simhash": lambda: simhash.keep_one(docs),
        "near": lambda: near_copies.keep_one(docs),
        "lines": lambda: corpus_pipeline.drop_repeated_lines(spark, docs, folder),
        "next": lambda: fingerprints.with_next(docs.drop("next_text"), ["text"]).withColumn("next_text", F.concat(F.lit("next_text "), F.coalesce(F.col("doc_id").cast("string"), F.lit("-")))),
    }[what]()
    assert sorted(made.columns) == sorted(docs.columns)
    rows = made.collect()
    assert len(rows) > 50
    for x in rows:
        assert all(x[c] == f"{c} {'-' if x['doc_id'] is None else x['doc_id']}" for c in CLASHING)


def test_empty_tables_give_no_rows(spark, tables):
    labels = shared.table(spark, tables[0], "labels")
    none = spark.createDataFrame([], SCHEMA)
    for made in (toxicity.keep_clean(none, labels), quality.keep_good(none, labels), simhash.keep_one(none), near_copies.keep_one(none), corpus_pipeline.drop_repeated_lines(spark, none, ""), fingerprints.with_next(none, ["text"])):
        assert made.count() == 0
    assert set(corpus_pipeline.drop_repeated_lines(spark, none, "").columns) == set(none.columns)


@pytest.mark.parametrize("rows", [1, 3, 10, 4096])
def test_next_over_many_ranges(spark, rows):
    r = random.Random(rows)
    ids = sorted(r.sample(range(10**6), 130)) + [5 * 10**6] * 9
    docs = spark.createDataFrame([(i, f"t{k}") for k, i in r.sample(list(enumerate(ids)), len(ids))], "doc_id long, text string").repartition(5)
    got = {(x["doc_id"], x["text"]): x["next_text"] for x in fingerprints.with_next(docs, ["text"], rows).collect()}
    order = sorted((i, f"t{k}") for k, i in enumerate(ids))
    assert got == {order[k]: order[(k + 1) % len(order)][1] for k in range(len(order))}


def test_long_sketches_against_brute_force(spark):
    def signed(x):
        return x - (1 << 64) if x >> 63 else x

    def plain(text, k=128, size=5):
        hashes = [xxhash.xxh64(w.lower().encode(), seed=42).intdigest() for w in text.split()]
        out = set()
        for i in range(len(hashes) - size + 1):
            h = 42
            for x in hashes[i : i + size]:
                h = xxhash.xxh64(struct.pack("<Q", x), seed=h).intdigest()
            out.add(signed(h))
        return sorted(out)[:k]

    r = random.Random(8)
    texts = [prose(r, n) for n in (200, 900, 5000)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").select("doc_id", fingerprints.sketch(F.col("text")).alias("s")).collect()
    assert all(x["s"] == plain(texts[x["doc_id"]]) for x in rows)


def test_plans_never_take_more_than_best_fit():
    r = random.Random(2)
    for _ in range(20):
        histogram = {r.randint(1, 128): r.randint(1, 40) for _ in range(r.randint(1, 60))}
        plain = packing.Plan(128)
        for length in sorted(histogram, reverse=True):
            plain.best_fit(length, 0, histogram[length])
        assert packing.plan(histogram, 128, groups=8).sequences <= plain.sequences


def test_a_cluster_needs_a_shared_folder():
    conf = types.SimpleNamespace(get=lambda name: None)
    session = types.SimpleNamespace(sparkContext=types.SimpleNamespace(getConf=lambda: conf, getCheckpointDir=lambda: None, master="spark://x:7077"))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared.shared_folder(session)
