"""Plans through a model that is told apart by its prompts, and faults that were found in the engine."""

import re

import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from graphloom import models
from graphloom.functions import parse, vectors
from graphloom.functions import text as T
from graphloom.operators import evaluate, extract, graph, packing, search
from graphloom.plans import index
from graphloom.plans import search as routes

SAME = settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def answer(prompt: str) -> str:
    """A model that does what each prompt asks, in its grammar."""
    text = prompt.split("TEXT:\n")[-1]
    if prompt.startswith("List the entities"):
        names = sorted(set(re.findall("[A-Z][a-z]+", text)))
        return "\n".join(f"entity_name: {n}\nentity_type: person\nentity_description: {n} is named" for n in names) + "\n."
    if prompt.startswith("List the relations"):
        names = re.findall("entity_name: (.*)", prompt.split("ENTITIES:\n")[1].split("TEXT:\n")[0])
        assert len(names) > 1
        return "\n".join(f"source_entity: {a}\ntarget_entity: {b}\nrelation: KNOWS\nrelationship_description: {a} knows {b}" for a, b in zip(names, names[1:])) + "\n."
    if prompt.startswith("Summarise what these elements"):
        return "community of " + ", ".join(sorted(set(re.findall("Node (\\w+)", text))))
    if prompt.startswith("Summarise what this evidence"):
        return "evidence for " + prompt.split("QUESTION:\n")[1].split("\n")[0]
    if prompt.startswith("Answer the question from the summary alone. Print"):
        return f"ANSWER: from {text}\nSCORE: 70"
    if prompt.startswith("Choose the best"):
        assert "COMMUNITY_ID:" in prompt and "ANSWER:" in prompt
        return "assistant: FINAL ANSWER: the chosen one\nSELECTED SUMMARY: its summary"
    if prompt.startswith("Answer the question from the summary alone, in"):
        return "local answer # and why"
    if prompt.startswith("Give one answer"):
        assert "COMMUNITY ANSWER:\nthe chosen one" in prompt and "GRAPH ANSWER:\nlocal answer" in prompt
        return "both answers because"
    if prompt.startswith("Does the answer"):
        return "answer: {1}" if "right" in text else "answer: 0"
    raise AssertionError(prompt)


@F.pandas_udf(StringType())
def model(prompts: pd.Series) -> pd.Series:
    return prompts.map(answer)


def test_plans_ask_a_model(spark, tmp_path):
    docs = spark.createDataFrame([(1, "Ann met Bob. Bob saw Carl! then nobody."), (2, "Ann and Dora spoke."), (3, None)], "doc_id long, text string")
    provider = models.Provider(model)
    g = index.complete(index.build(docs, provider, chunk_size=1000), provider)
    assert {(r["name"], r["label"], r["entity_description"]) for r in g.entities.collect()} == {(n.lower(), "person", f"{n} is named") for n in ("Ann", "Bob", "Carl", "Dora")}
    assert {(r["source_id"], r["target_id"], r["label"], r["relationship_description"]) for r in g.relations.collect()} == {("ann", "bob", "knows", "Ann knows Bob"), ("bob", "carl", "knows", "Bob knows Carl"), ("ann", "dora", "knows", "Ann knows Dora")}
    assert all(r["summary"].startswith("community of ") for r in g.summaries.collect())
    index.store(g, str(tmp_path / "index"))
    g = index.opened(spark, str(tmp_path / "index"))
    questions = spark.createDataFrame([(1, "Whom does Ann know"), (2, None)], "question_id long, question string")
    local = routes.local_search(questions, g, threshold=-1.0, provider=provider)
    found = {r["question_id"]: r for r in local.collect()}
    assert found[1]["answer"] == "local answer" and found[1]["summary"] == "evidence for Whom does Ann know"
    overall = routes.global_search(questions, g.summaries, provider=provider)
    assert {r["question_id"]: (r["answer"], r["summary"]) for r in overall.collect()}[1] == ("the chosen one", "its summary")
    both = routes.final_answers(questions.where("question_id = 1"), local, overall, provider)
    assert both.first()["answer"] == "both answers"


def test_a_model_is_asked_again(spark):
    tries = spark.sparkContext.accumulator(0)

    @F.pandas_udf(StringType())
    def silent(prompts: pd.Series) -> pd.Series:
        tries.add(len(prompts))
        return pd.Series([""] * len(prompts))

    wins = spark.createDataFrame([(1, 0, "Ann met Bob.")], "doc_id long, win_idx int, text string")
    assert extract.named_windows(wins, models.Provider(silent)).count() == 0
    assert tries.value == 2
    assert routes.question_entities(spark.createDataFrame([(1, "Ann?")], "question_id long, question string"), models.Provider(silent)).count() == 0
    assert tries.value >= 2 + 5


def test_the_judge(spark):
    rows = spark.createDataFrame([(1, "q", "right", "g"), (2, "q", "wrong", "g")], "id int, question string, answer string, gold string")
    assert evaluate.evaluate(rows, provider=models.Provider(model)).first()["llm_score"] == 0.5
    with pytest.raises(ValueError):
        evaluate.judged(rows, None)


def test_question_entities_stand_in_the_question(spark):
    said = "entity_name: Ann\nentity_type: x\nentity_description: d\nentity_name: ANN\nentity_type: x\nentity_description: d\nentity_name: q\nentity_type: x\nentity_description: d\nentity_name: Zed\nentity_type: x\nentity_description: d\n."
    got = spark.createDataFrame([(said, "what q did ann do")], "s string, q string").select(parse.question_entities(parse.entities(F.col("s")), F.col("q")).alias("r")).first()["r"]
    assert got == ["Ann"]


def test_fields_hold_braces(spark):
    df = spark.createDataFrame([("{text} {question}", "{b}")], "t string, q string")
    assert df.select(models.fill("Q {question} T {text}!", text=F.col("t"), question=F.col("q")).alias("r")).first()["r"] == "Q {b} T {text} {question}!"


def test_offline_rules_say_what_their_responses_say(spark):
    texts = ["Ann met Bob in Paris.\nThen they left.", "nobody here", "Ann alone", ""]
    o = models.OFFLINE
    df = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("e", o.entities(F.col("t")))
    for r in df.select("e", parse.entities(o.entity_response(F.col("t"))).alias("p"), o.relations(F.col("t"), F.col("e")).alias("r"), parse.relations(o.relation_response(F.col("t"), F.col("e"))).alias("q")).collect():
        assert r["e"] == r["p"] and r["r"] == r["q"]


#: The grammars once more, as the plain patterns of a test.
E = re.compile(r"entity_name:\s*(.*?)\s*entity_type:\s*(.*?)\s*entity_description:\s*(\S.*?)(?=\n\s*entity_name:|\n\s*RELATIONSHIPS:|\n\s*\.)", re.S)
LINES = ["entity_name: Ann", "entity_type: x", "entity_description: some words", "entity_description: a", "RELATIONSHIPS:", ".", "  .", "more", "", "entity_name: B entity_type: y entity_description: z"]


@given(st.lists(st.sampled_from(LINES), max_size=9))
@SAME
def test_entities_of_any_lines(spark, lines):
    said = "\n".join(lines)
    got = [tuple(x) for x in spark.createDataFrame([(said,)], "s string").select(parse.entities(F.col("s")).alias("r")).first()["r"]]
    assert got == [tuple(f.strip() for f in m) for m in E.findall(said)]


def test_unicode_white_space(spark):
    df = spark.createDataFrame([("a\u00a0b\u2003c!", "assistant:\u00a0x", "answer:\u00a0{1}")], "a string, b string, c string")
    assert tuple(df.select(T.normalized_answer(F.col("a")), T.without_assistant(F.col("b")), parse.judgement(F.col("c"))).first()) == ("a b c", "x", 1)


def test_vectors_without_a_length(spark):
    nan = float("nan")
    rows = [("neg", [-1.0, 0.0]), ("zero", [0.0, 0.0]), ("nan", [nan, 1.0]), ("pos", [0.5, 0.0])]
    assert {r[0] for r in spark.createDataFrame(rows, "n string, v array<double>").where(vectors.usable(F.col("v"))).collect()} == {"neg", "pos"}


@pytest.mark.parametrize("kind", ["string", "long"])
def test_ties_stay_bounded(spark, kind):
    nodes = spark.createDataFrame([(str(k) if kind == "string" else k, [0.0, 1.0]) for k in range(300)], f"node {kind}, v array<double>")
    questions = spark.createDataFrame([(1, [0.0, 0.0]), (2, [0.0, 1.0])], "question_id long, qv array<double>")
    found = search.similarities(questions, nodes, 5, block=512)
    assert found.count() == 10
    first = sorted(map(str, range(300)))[:5] if kind == "string" else list(range(5))
    assert [r["node"] for r in search.top(found, 5).where("question_id = 1").orderBy("rank").collect()] == first


def test_a_question_without_a_vector_gets_the_first_rows(spark):
    nodes = spark.createDataFrame([(k, [float(k), 1.0]) for k in range(9)], "node long, v array<double>")
    questions = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 0.0])], "question_id long, qv array<double>")
    got = sorted((r["question_id"], r["rank"], r["node"]) for r in routes.top_nodes(questions, nodes, nodes, 2).collect())
    assert got == [(1, 1, 0), (1, 2, 1), (2, 1, 8), (2, 2, 7)]


@given(st.lists(st.integers(1, 140), min_size=1, max_size=25), st.sampled_from([1, 64]))
@SAME
def test_packs_of_rows_keep_the_limit(spark, sizes, lists):
    rows = spark.createDataFrame([(1, k, n) for k, n in enumerate(sizes)], "cluster_id int, ord int, n int")
    got = packing.pack_rows(rows, 100, lists=lists).collect()
    assert sorted(r["ord"] for r in got) == list(range(len(sizes)))
    held = {}
    for r in got:
        held.setdefault((r["chunk"], r["pack"]), []).append(r["n"])
    assert all(sum(p) <= 100 or len(p) == 1 for p in held.values())


def test_reduction_follows_the_sequential_rule(spark):
    seen = []
    rows = [(1, f"{k:02}", " ".join([f"w{k}"] * n)) for k, n in enumerate([40, 50, 20, 90, 10])]
    texts = spark.createDataFrame(rows, "cluster_id int, ord string, text string")
    got = packing.reduce_texts(texts, 1600, lambda c: F.concat(F.lit("["), F.array_join(F.array_distinct(T.tokens(c)), " "), F.lit("]")))
    assert got.first()["summary"] == "[[w0 w1] [w2] [w3 w4]]" and not seen
    with pytest.raises(RuntimeError):
        packing.reduce_texts(spark.createDataFrame([(1, str(k), "x " * 90) for k in range(3)], "cluster_id int, ord string, text string"), 1600, lambda c: F.concat(c, F.lit(" y")))


def test_leaks_and_unknown_ends(spark):
    r = spark.createDataFrame([(1, 0, "a", "b", "r", "first"), (1, 1, "a", "c", "r", "second"), (1, 1, "a", "b", "r", "again"), (1, 2, "b", "zz", "r", "third")], "doc_id long, win_idx int, src string, dst string, rel string, descr string")
    assert [(x["descr"], x["leaked"]) for x in extract.leaked_descriptions(r).orderBy("src", "dst").collect()] == [("again | first", None), ("second", "again | first"), ("third", "second")]
    e = spark.createDataFrame([(1, 0, n, "T", "d") for n in "abc"], "doc_id long, win_idx int, name string, etype string, descr string")
    got = extract.extraction_stats(e, r).first()
    assert (got["raw_relations"], got["relation_merges"], got["unknown_entity_relations"]) == (4, 1, 1)


def test_neighbours_without_a_vector_count_as_zero(spark):
    adj = spark.createDataFrame([("a", "b", "r", ""), ("a", "c", "r", "")], "src string, dst string, rel string, descr string")
    starts = spark.createDataFrame([(1, "a", 1)], "question_id int, node string, rank int")
    questions = spark.createDataFrame([(1, [1.0])], "question_id int, qv array<double>")
    nodes = spark.createDataFrame([("b", [0.9])], "node string, v array<double>")
    for threshold, reached in ((0.5, {"a", "b"}), (0.0, {"a", "b", "c"}), (0.95, {"a"})):
        got = search.expand(starts, adj, search.similar_enough(questions, nodes, threshold))[0]
        assert {r["node"] for r in got.collect()} == reached


def test_counts_and_members(spark):
    edges = spark.createDataFrame([("a", "b", "l", "d"), ("a", "c", "l", "d"), ("b", "c", "m", "d")], "src string, dst string, label string, descr string")
    assert {tuple(r) for r in graph.label_members(edges).collect()} == {("l", "a", "b"), ("l", "a", "c"), ("m", "b", "c")}
    assert {tuple(r) for r in graph.counts(edges, "label").collect()} == {("l", 2), ("m", 1)}
