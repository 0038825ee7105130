from graphloom import models
from graphloom.functions import text as T
from graphloom.plans import index

DOCS = [
    (1, "Anna met Berta in Cairo. Berta left. Nobody else did."),
    (2, "Cairo and Anna! Dora said so? Anna met Berta in Cairo."),
    (2, "Emil, Anna, Emil."),
    (3, ""),
    (4, None),
    (5, "no name here"),
]


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_skeleton_is_the_graph_without_its_texts(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    g, s = index.build(docs), index.skeleton(docs)
    assert rows(s.entities) == rows(g.entities.select("name", "label"))
    assert rows(s.adjacency) == rows(g.adjacency.select("src", "dst", "rel")) and s.adjacency.count() > 8
    assert rows(s.vectors) == rows(index.node_vectors(g.entities))


def test_documents_move_instead_of_mentions(spark):
    """One exchange, of documents, before the merge inside a document: no copy of a text for each name or pair moves."""
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    for table in index.merged(docs):
        plan = table._jdf.queryExecution().executedPlan().toString()
        assert plan.split("== Initial Plan ==")[0].count("Exchange") <= 1, plan


def test_a_window_is_put_on_one_line_once(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string").where("text is not null")
    found = docs.select("text", models.OFFLINE.entities(docs.text).alias("found"))
    got = found.select("found", models.OFFLINE.relations(found.text, found.found).alias("r")).collect()
    assert [x["name"] for x in got[0].found] == ["anna", "berta", "cairo", "nobody"]
    assert {x["descr"] for x in got[0].found} | {x["descr"] for x in got[0].r} == {DOCS[0][1]}
    assert len(got[0].r) == 6 and got[3].found == got[3].r == []


def test_strip_takes_a_column_or_its_name(spark):
    df = spark.createDataFrame([(1, " a b\u2003\n"), (2, "a b"), (3, ""), (4, "\t"), (5, None)], "k int, c string")
    for c in (df.c, "c"):
        assert [r[0] for r in df.orderBy("k").select(T.strip(c)).collect()] == ["a b", "a b", "", "", None]
