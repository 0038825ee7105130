"""Operators of the retrieval engine on small inputs with known results."""

import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from graphloom.functions import parse, vectors
from graphloom.functions import text as T
from graphloom.operators import evaluate, extract, graph, packing, search
from graphloom.plans import index
from graphloom.plans import search as routes
from graphloom.sources import datasets, graph_json
from graphloom.streaming.mentions import write_mentions

SAME = settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "c string").select(f(F.col("c")).alias("r")).first()["r"]


@pytest.mark.parametrize("raw,name", [(' "A b" ', "a b"), ("'x'", "x"), ('"', ""), (None, ""), (" Q ", "q"), ("'a\"", "'a\"")])
def test_canon(spark, raw, name):
    assert one(spark, raw, T.canon) == name


def test_sentences_keep_a_trailing_piece(spark):
    assert one(spark, "x. ", T.sentences) == ["x.", ""]
    docs = spark.createDataFrame([(1, "A b. C! D?\nE"), (2, None), (3, "")], "doc_id long, text string")
    assert [r["text"] for r in extract.windows(docs).orderBy("win_idx").collect()] == ["A b. C!", "C! D?", "D? E", "E"]


@pytest.mark.parametrize("raw,cut", [("a because b", "a"), ("C# is", "C"), ("plain", "plain"), ("x ``` y", "x")])
def test_before_mark(spark, raw, cut):
    assert one(spark, raw, T.before_mark) == cut


def test_entity_blocks(spark):
    said = "ENTITIES:\nentity_name: Ann\nentity_type: person\nentity_description: first\nline\n entity_name: Bo\nentity_type: dog\nentity_description: second\n.\nentity_name: lost\nentity_type: x\nentity_description: no end"
    assert [tuple(r) for r in one(spark, said, parse.entities)] == [("Ann", "person", "first\nline"), ("Bo", "dog", "second")]
    assert one(spark, "", parse.entities) == []


def test_relation_blocks(spark):
    said = "source_entity: Ann\ntarget_entity: Bo\nrelation: owns\nrelationship_description: first\nsecond line\nsource_entity: Bo\ntarget_entity: Ann\nrelation: likes\nrelationship_description:\nsource_entity: x\n."
    got = [tuple(r) for r in one(spark, said, parse.relations)]
    assert got == [("Ann", "Bo", "owns", "first"), ("Bo", "Ann", "likes", "source_entity: x")]
    assert one(spark, "NONE", parse.relations) == []


@pytest.mark.parametrize("said,answer,score", [("ANSWER: yes \nSCORE: 90", "yes", 90), ("SCORE: 250", "insufficient information", 250), ("ANSWER: a\nSCORE: -3", "a", 0), ("", "insufficient information", 0), ("SCORE: " + "9" * 30, "insufficient information", 10**30 - 1), ("ANSWER:\u00a0\n x\nSCORE:\u00a07", "x", 7)])
def test_map_output(spark, said, answer, score):
    assert tuple(one(spark, said, parse.map_output)) == (answer, score)


@pytest.mark.parametrize("said,got", [("assistant: FINAL ANSWER: a\nSELECTED SUMMARY: s", ("a", "s")), ("SELECTED SUMMARY: s", (T.NO_ANSWER, "s")), ("FINAL ANSWER: a", (T.NO_ANSWER, "")), ("", (T.NO_ANSWER, "")), ("Insufficient information. SELECTED SUMMARY: s", (T.NO_ANSWER, ""))])
def test_final_output(spark, said, got):
    assert tuple(one(spark, said, parse.final_output)) == got


@pytest.mark.parametrize("said,value", [("answer: 1", 1), ("answer: {1}", 1), ("answer: 0", 0), ("Answer: 1", 0), ("", 0)])
def test_judgement(spark, said, value):
    assert one(spark, said, parse.judgement) == value


def merged(spark, descriptions):
    rows = [(k, "ann", "X", d, 0, 1) for k, d in enumerate(descriptions)]
    return graph.global_entities(spark.createDataFrame(rows, "doc_id long, name string, etype string, descr string, first_win int, mentions long")).first()["entity_description"]


def test_description_fold(spark):
    assert merged(spark, ["a", "b", "", "a b", "c"]) == "a b c"


@given(st.lists(st.text("ab ", max_size=4), min_size=1, max_size=8))
@SAME
def test_description_fold_is_the_plain_fold(spark, descriptions):
    acc = ""
    for d in descriptions:
        if d and d not in acc:
            acc = f"{acc} {d}" if acc else d
    assert merged(spark, descriptions) == acc


def test_packs(spark):
    df = spark.createDataFrame([([4, 5, 12, 1, 6],)], "n array<int>")
    assert df.select(packing.packs(F.col("n"), 10).alias("p")).first()["p"] == [[2], [0, 1, 3], [4]]


@given(st.lists(st.integers(0, 15), max_size=12))
@SAME
def test_packs_keep_limit_and_order(spark, sizes):
    got = spark.createDataFrame([(sizes,)], "n array<int>").select(packing.packs(F.col("n"), 10).alias("p")).first()["p"]
    assert sorted(i for p in got for i in p) == list(range(len(sizes)))
    assert all(sum(sizes[i] for i in p) <= 10 or len(p) == 1 for p in got)
    small = [i for p in got for i in p if sizes[i] <= 10]
    assert small == sorted(small)


def test_budget_prefix(spark):
    rows = [(1, 0, 9, 5), (1, 1, 8, 4), (1, 2, 7, 9), (1, 3, 6, 1), (1, 4, 0, 0), (2, 0, 1, 99)]
    got = packing.budget_prefix(spark.createDataFrame(rows, "question_id int, ord int, score int, tokens int"), 10)
    assert sorted((r["question_id"], r["ord"]) for r in got.collect()) == [(1, 0), (1, 1)]


def test_reduction_ends_in_one_text(spark):
    rows = [(1, str(k), "word " * 30) for k in range(40)] + [(2, "a", "x " * 500), (3, "a", "")]
    got = {r["cluster_id"]: r["summary"] for r in packing.reduce_texts(spark.createDataFrame(rows, "cluster_id int, ord string, text string"), 1600, lambda c: T.first_words(c, 5)).collect()}
    assert got == {1: "word word word word word", 2: "x x x x x"}


def test_token_f1(spark):
    rows = [(1, "the cat the", "the cat sat"), (2, "", ""), (3, "a a b", "a a a")]
    got = {r["id"]: r["f1"] for r in evaluate.token_f1(spark.createDataFrame(rows, "id int, answer string, gold string")).collect()}
    assert got == {1: pytest.approx(2 / 3), 2: 0.0, 3: pytest.approx(2 / 3)}


def test_empty_gold_counts_as_held(spark):
    r = evaluate.scores(spark.createDataFrame([(1, "x", "")], "id int, answer string, gold string")).first()
    assert (r["exact"], r["held"], r["hit"]) == (0, 1, 1)
    assert evaluate.evaluate(spark.createDataFrame([], "id int, answer string, gold string")).first()["f1"] is None


def test_string_matches(spark):
    texts = spark.createDataFrame([(1, "ann lee"), (2, "nn"), (3, "lee tree"), (4, "zz"), (5, "")], "text_id int, text string")
    names = spark.createDataFrame([("Ann Lee",), ("Bo",)], "node string")
    got = {(r["text_id"], r["node"]): round(r["score"], 6) for r in search.string_matches(texts, names).collect()}
    assert got == {(1, "Ann Lee"): 1.2, (2, "Ann Lee"): 1.0, (3, "Ann Lee"): 0.3, (5, "Ann Lee"): 1.0, (5, "Bo"): 1.0}


def test_expansion_paths(spark):
    links = [("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("d", "e"), ("e", "f")]
    adj = spark.createDataFrame([(x, y, "r", "") for a, b in links for x, y in ((a, b), (b, a))], "src string, dst string, rel string, descr string")
    starts = spark.createDataFrame([(1, "a", 1)], "question_id int, node string, rank int")
    admitted = spark.createDataFrame([(1, n) for n in "abcdef"], "question_id int, node string")
    nodes, edges = search.expand(starts, adj, admitted)
    assert sorted("".join(r["path"]) for r in nodes.where("hop > 0").collect()) == ["ab", "abd", "abde", "ac"]
    closed = search.expand(starts, adj, admitted.where("node <> 'b'"))[0]
    assert sorted("".join(r["path"]) for r in closed.where("hop > 0").collect()) == ["ac", "acd", "acde"]
    assert edges.where("src = 'a'").count() == 2


def test_vectors(spark):
    assert abs(sum(x * x for x in one(spark, "some words and more", vectors.embed)) - 1) < 1e-6
    assert set(one(spark, " ", vectors.embed)) == {0.0}


def test_chunks_hold_whole_sentences(spark):
    text = " ".join(f"w{k} x y." for k in range(10))
    got = [r["text"] for r in extract.chunks(spark.createDataFrame([(1, text)], "doc_id long, text string"), 9, 3).orderBy("chunk_idx").collect()]
    assert all(len(c.split()) <= 9 + 3 for c in got) and got[0].startswith("w0") and got[-1].endswith("w9 x y.")
    assert [c.split(".")[0] for c in got[1:]] == [c.rstrip(".").split(". ")[-1] for c in got[:-1]]


def linked(spark, links):
    return spark.createDataFrame([(x, y, "r", "") for a, b in links for x, y in ((a, b), (b, a))], "src string, dst string, rel string, descr string")


def plain_modularity(links, label):
    m = len(links)
    degree = {}
    for a, b in links:
        degree[a], degree[b] = degree.get(a, 0) + 1, degree.get(b, 0) + 1
    inside = sum(label[a] == label[b] for a, b in links) / m
    return inside - sum((sum(d for n, d in degree.items() if label[n] == c) / (2 * m)) ** 2 for c in set(label.values()))


def test_partition_finds_planted_communities(spark):
    r = random.Random(5)
    links = {tuple(sorted(r.sample(range(60), 2))) for _ in range(60)} | {(i, j) for i in range(60) for j in range(i) if i // 15 == j // 15 and r.random() < 0.6}
    links = sorted({(f"n{max(x):02}", f"n{min(x):02}") for x in links})
    got = {x["node"]: x["label"] for x in graph.partition(linked(spark, links)).collect()}
    planted = {n: f"n{int(n[1:]) // 15 * 15:02}" for n in got}
    assert plain_modularity(links, got) >= plain_modularity(links, planted) - 0.02 and 3 <= len(set(got.values())) <= 6
    assert all(label == min(n for n in got if got[n] == label) for label in got.values())


def test_communities_nest(spark):
    """A ring of cliques, pairs of which modularity joins; on their own the pairs part again."""
    size, n = 3, 24
    links = [(f"n{i:03}", f"n{j:03}") for i in range(size * n) for j in range(i) if i // size == j // size] + [(f"n{size * k:03}", f"n{(size * k + size + 1) % (size * n):03}") for k in range(n)]
    coms = graph.communities(linked(spark, links), size).cache()
    tree = graph.community_tree(coms)
    sizes = {(x["level"], x["cluster_id"]): x["count"] for x in coms.groupBy("level", "cluster_id").count().collect()}
    assert max(level for level, _ in sizes) > 0 and min(sizes.values()) >= 1
    assert coms.groupBy("level", "node").count().where("count > 1").isEmpty()
    assert tree.groupBy("child").count().where("count > 1").isEmpty()
    leaves = graph.leaf_communities(coms, tree)
    assert coms.join(leaves, "cluster_id").select("node").distinct().count() == size * n
    assert coms.join(leaves, "cluster_id").groupBy("cluster_id").count().agg(F.max("count")).first()[0] == size


def test_no_links_no_communities(spark):
    none = spark.createDataFrame([], "src string, dst string, rel string, descr string")
    assert graph.communities(none, 10).count() == 0 and graph.label_propagation(none).count() == 0


def test_labels_settle(spark):
    """On an even path labels take turns for ever; the smaller of two stays.  A star settles at once."""
    path = [(f"p{i}", f"p{i + 1}") for i in range(5)]
    neighbours = {}
    for a, b in path:
        neighbours.setdefault(a, []).append(b)
        neighbours.setdefault(b, []).append(a)
    states = [{n: n for n in neighbours}]
    while len(states) < 3 or states[-1] not in (states[-2], states[-3]):
        states.append({n: min((-[states[-1][m] for m in ms].count(states[-1][x]), states[-1][x]) for x in ms)[1] for n, ms in neighbours.items()})
    expected = {n: min(states[-1][n], states[-2][n]) for n in neighbours}
    assert {x["node"]: x["label"] for x in graph.label_propagation(linked(spark, path)).collect()} == expected


def test_datasets(spark):
    context = {"title": ["T", "U", "V"], "sentences": [["a.", "b."], ["c."]]}
    rows = [(k, "q", "a", lv, "bridge", context) for k, lv in enumerate(["easy", "medium", "hard", "easy", "easy", "medium"])]
    df = spark.createDataFrame(rows, "row_idx long, question string, answer string, level string, type string, context struct<title:array<string>,sentences:array<array<string>>>")
    assert [r["text"] for r in datasets.hotpot(df, "easy", 2).collect()] == ["T: a. b.U: c."] * 2
    assert datasets.two_wiki(df, "bridge", 1).first()["text"] == "T: a. b.\nU: c.\n"
    for num, levels in {1: {"easy": 1}, 4: {"easy": 2, "medium": 1, "hard": 1}, 5: {"easy": 2, "medium": 2, "hard": 1}}.items():
        taken = [r["row_idx"] for r in datasets.hotpot(df, "all", num).collect()]
        assert {lv: sum(rows[i][3] == lv for i in taken) for lv in levels} == levels and len(taken) == num
    with pytest.raises(ValueError):
        datasets.two_wiki(df, "none", 1, strict=True)
    m = spark.createDataFrame([(0, "q", "a", False, [("t", "p")]), (1, "q", "a", True, [("t", "p")])], "row_idx long, question string, answer string, answerable boolean, paragraphs array<struct<title:string,paragraph_text:string>>")
    assert [(r["row_idx"], r["text"]) for r in datasets.musique(m, 5).collect()] == [(1, "t: p\n")]


def test_graph_through_json(spark, tmp_path):
    docs = spark.createDataFrame([(1, "Ann met Bob. Bob saw Carl! Then Ann left."), (2, "Ann and Carl spoke."), (3, None), (4, "")], "doc_id long, text string")
    g = index.build(docs)
    graph_json.write(g.entities, g.relations, str(tmp_path / "g"))
    entities, relations = graph_json.read(spark, str(tmp_path / "g"))
    assert sorted(map(tuple, entities.collect())) == sorted(map(tuple, g.entities.select(entities.columns).collect()))
    assert sorted(map(tuple, relations.collect())) == sorted(map(tuple, g.relations.select(relations.columns).collect()))
    members = {tuple(r) for r in graph_json.read_members(spark, str(tmp_path / "g")).collect()}
    assert members == {tuple(r) for r in g.relations.select("label", "source_id", "target_id").collect()}
    whole = tmp_path / "one.json"
    whole.write_text('{"entities": [{"id": "other", "name": "x", "label": "L", "properties": {"entity_description": "d"}}],\n "relations": [{"id": "r", "label": "l", "source_id": "x", "target_id": "x", "properties": {"relationship_description": "e"}}]}')
    a, b = graph_json.read_object(spark, str(whole))
    assert tuple(a.first()) == ("x", "L", "d") and tuple(b.first()) == ("l", "x", "x", "e")
    questions = spark.createDataFrame([(1, "Where did Ann go with Bob"), (2, "")], "question_id long, question string")
    found = {r["question_id"]: r for r in routes.local_search(questions, g, threshold=0.0).collect()}
    assert set(found) == {1, 2} and found[1]["summary"] != ""
    for parts in ("1", "16"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        again = index.build(docs)
        assert sorted(map(tuple, again.adjacency.collect())) == sorted(map(tuple, g.adjacency.collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_streamed_mentions(spark, tmp_path):
    docs = spark.createDataFrame([(1, "Ann met Bob. Bob left."), (2, "Carl came.")], "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "in"))
    write_mentions(spark.readStream.schema(docs.schema).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out")).drop("batch")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, extract.merge_entities(extract.window_entities(extract.named_windows(extract.windows(docs)))).collect()))
