"""The undirected property graph: aggregation over chunks, adjacency, statistics, communities, elements."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import text as T
from graphloom.functions.folding import fold_lists
from graphloom.operators.blocks import Numbered
from graphloom.storage import cut


def entity_descriptions(entities: DataFrame) -> DataFrame:
    """``(name, descr, doc_id, first_win, label)``: every distinct description of a name in a row of its own, with the place
    that has it first.  This is the form for names that a large part of all documents has."""
    d = F.coalesce(F.col("descr"), F.lit("")).alias("descr")
    once = entities.groupBy(T.strip(F.lower("name")).alias("name"), d).agg(F.min(F.struct("doc_id", "first_win", F.lower("etype").alias("label"))).alias("ord"))
    return once.select("name", "descr", "ord.*")


def global_entities(entities: DataFrame) -> DataFrame:
    """One row per name: the first label, and a description to which each further one is added unless it is part of it.

    That fold depends on the order, (document, first window, type); it drops equal descriptions itself, so they need no
    grouping of their own before.  A name's row holds all its distinct descriptions, as its definition says."""
    d = F.coalesce(F.col("descr"), F.lit("")).alias("descr")
    parts = entities.groupBy(T.strip(F.lower("name")).alias("name")).agg(F.array_sort(F.collect_list(F.struct("doc_id", "first_win", F.lower("etype").alias("label"), d))).alias("parts"))
    lists = parts.select("name", F.get("parts", F.lit(0))["label"].alias("label"), F.col("parts.descr").alias("entity_description"))
    return lists.mapInArrow(fold_lists(2), "name string, label string, entity_description string")


def counts(rows: DataFrame, *by: str) -> DataFrame:
    return rows.groupBy(*by).agg(F.count("*").alias("n"))


def undirected_edges(relations: DataFrame) -> DataFrame:
    """``(src, dst, label, descr)`` with src <= dst: distinct relations joined by |, distinct descriptions by " | "."""
    named = relations.select(F.lower("src").alias("a"), F.lower("dst").alias("b"), F.lower("rel").alias("rel"), T.strip(F.coalesce("descr", F.lit(""))).alias("d")).where("a <> '' and b <> ''")
    return named.groupBy(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).agg(
        F.array_join(F.array_sort(F.collect_set("rel")), "|").alias("label"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("d") != "", F.col("d")))), " | ").alias("descr"),
    )


def label_groups(edges: DataFrame) -> DataFrame:
    return edges.groupBy("label").agg(F.count("*").alias("members"), F.min("src").alias("first_src"), F.max("dst").alias("last_dst"))


def label_members(edges: DataFrame) -> DataFrame:
    """``(label, source_id, target_id)``: the members of every label's group, a row each; a relation meets its group's
    members by joining on the label, instead of carrying a copy of them all."""
    return edges.select("label", F.col("src").alias("source_id"), F.col("dst").alias("target_id")).distinct()


def label_sizes(edges: DataFrame) -> DataFrame:
    """``(label, cluster_size)``: how many members each label's group has."""
    return edges.groupBy("label").agg(F.count("*").alias("cluster_size"))


def final_relations(edges: DataFrame, entities: DataFrame | None, sizes: DataFrame | None = None) -> DataFrame:
    """Edges whose two ends are entities, each with the number of its label's members; the members themselves stay in
    one place, the edge table, and are joined by label where a row must carry them.

    Without ``entities`` all ends are some, as ``merge_relations`` has it.  ``sizes`` of all edges, if they are made already
    of less than the edges' texts, are few and go to where the edges are."""
    kept = edges
    if entities is not None:
        names = entities.select("name")
        kept = edges.join(names.withColumnRenamed("name", "src"), "src", "left_semi").join(names.withColumnRenamed("name", "dst"), "dst", "left_semi")
    sized = kept.join(label_sizes(edges), "label") if sizes is None else kept.join(F.broadcast(sizes), "label")
    return sized.select("label", F.col("src").alias("source_id"), F.col("dst").alias("target_id"), F.col("descr").alias("relationship_description"), "cluster_size")


def adjacency(relations: DataFrame, paired: bool = False) -> DataFrame:
    """``(src, dst, rel, descr)`` in both directions; of several relations of a pair the greatest label wins, a self-loop
    stands once.  Relations that ``undirected_edges`` made are ``paired``: a pair has one, its ends in order, and no text
    moves again."""
    if paired:
        one = relations.select(F.col("source_id").alias("a"), F.col("target_id").alias("b"), F.col("label").alias("rel"), F.col("relationship_description").alias("descr"))
    else:
        pair = [F.least("source_id", "target_id").alias("a"), F.greatest("source_id", "target_id").alias("b")]
        one = relations.groupBy(*pair).agg(F.max(F.struct("label", "relationship_description")).alias("r")).select("a", "b", F.col("r.label").alias("rel"), F.col("r.relationship_description").alias("descr"))
    ends = F.when(F.col("a") == F.col("b"), F.array(F.struct(F.col("a").alias("src"), F.col("b").alias("dst")))).otherwise(F.array(F.struct(F.col("a").alias("src"), F.col("b").alias("dst")), F.struct(F.col("b").alias("src"), F.col("a").alias("dst"))))
    return one.select(F.explode(ends).alias("e"), "rel", "descr").select("e.src", "e.dst", "rel", "descr")


def graph_stats(entities: DataFrame, adj: DataFrame) -> DataFrame:
    degrees = adj.groupBy("src").agg(F.count("*").alias("degree"))
    both = entities.select("name").distinct().join(degrees, F.col("name") == F.col("src"), "left").select(F.coalesce("degree", F.lit(0)).alias("degree"))
    loops = adj.agg(F.count("*").alias("n"), F.sum(F.when(F.col("src") == F.col("dst"), 1).otherwise(0)).alias("loops"))
    stats = both.agg(F.count("*").alias("nodes"), F.sum(F.when(F.col("degree") == 0, 1).otherwise(0)).alias("isolated"), F.max("degree").alias("max_degree"), F.round(F.avg("degree"), 6).alias("avg_degree"))
    return stats.join(loops.select(((F.col("n") + F.coalesce("loops", F.lit(0))) / 2).cast("long").alias("edges")))


def cluster_size(stats: DataFrame) -> DataFrame:
    """The greatest size of a community: n / (10 + edges / n), kept between 500 and 3000; 100 for an empty graph."""
    n = F.col("nodes")
    value = F.floor(n / (F.lit(10) + F.col("edges") / F.nullif(n, F.lit(0))))
    return stats.select("nodes", "edges", F.when(n == 0, 100).otherwise(F.greatest(F.lit(500), F.least(value, F.lit(3000)))).cast("long").alias("max_cluster_size"))


def _inside(adj: DataFrame, groups: DataFrame | None) -> DataFrame:
    """Distinct links ``(src, dst)`` without loops; with ``groups (node, cluster_id)`` only those inside a group."""
    links = adj.where("src <> dst").select("src", "dst").distinct()
    if groups is None:
        return links
    a, b = groups.select(F.col("node").alias("src"), F.col("cluster_id").alias("g")), groups.select(F.col("node").alias("dst"), F.col("cluster_id").alias("h"))
    return links.join(a, "src").join(b, "dst").where("g = h").select("src", "dst", "g")


def label_propagation(adj: DataFrame, bound: int = 1000) -> DataFrame:
    """``(node, label)``: every node takes the most frequent label of its neighbours, the smallest of several, until
    nothing changes.

    All nodes move at once, and such majorities end in a fixed point or in two states that take turns; of those a node keeps
    the smaller label.  Not to have ended after ``bound`` rounds is an error."""
    net = Numbered(_inside(adj, None))
    return net.named(net.propagated(bound)) if net.n else _no_labels(adj)


def _no_labels(adj: DataFrame) -> DataFrame:
    return adj.select(F.col("src").alias("node"), F.col("src").alias("label")).limit(0)


def partition(adj: DataFrame, groups: DataFrame | None = None, settled: float = 0.01) -> DataFrame:
    """``(node, label)``: communities of high modularity inside each group, by local moving and aggregation.

    Half of the nodes move at a time, the halves dealt anew by a hash, so two nodes seldom change places for ever.  Moving
    goes on until only the share ``settled`` of the nodes wants to, or for three rounds no fewer did than ever before; then
    communities become nodes, and it begins again, until modularity gains nothing.  Last, what isn't connected inside its community is parted.  A
    label is the least node of its community, so the result doesn't depend on how the data is dealt."""
    net = Numbered(_inside(adj, groups))
    return net.named(net.partition(settled)) if net.n else _no_labels(adj)


def communities(adj: DataFrame, max_size: int) -> DataFrame:
    """``(level, cluster_id, node)``: level 0 is the partition by modularity; the nodes of a cluster above ``max_size`` are
    partitioned again on the next level, by links inside the cluster, until nothing splits.

    A cluster's id is the id of the one it is part of and its least node.  A cluster that no longer splits stays as large as
    it is, as no part of it has more links inside than chance would give."""
    level = partition(adj).select(F.lit(0).alias("level"), F.col("label").alias("cluster_id"), "node")
    found = level = cut(level)
    k = 0
    while True:
        sizes = level.groupBy("cluster_id").count().where(F.col("count") > max_size)
        large = cut(level.join(sizes, "cluster_id"))
        if large.isEmpty():
            return found
        k += 1
        part = large.join(partition(adj, large.select("node", "cluster_id")), "node", "left").withColumn("label", F.coalesce("label", "node"))
        split = part.groupBy("cluster_id").agg(F.count_distinct("label").alias("parts")).where("parts > 1").select("cluster_id")
        level = cut(part.join(split, "cluster_id").select(F.lit(k).alias("level"), F.concat_ws("/", "cluster_id", "label").alias("cluster_id"), "node"))
        found = found.unionByName(level)


def community_tree(coms: DataFrame) -> DataFrame:
    """``(parent, child, n_nodes)`` from the nodes that a cluster shares with one a level deeper."""
    up = coms.select((F.col("level") + 1).alias("level"), F.col("cluster_id").alias("parent"), "node")
    return up.join(coms.select("level", F.col("cluster_id").alias("child"), "node"), ["level", "node"]).groupBy("parent", "child").agg(F.count("*").alias("n_nodes"))


def leaf_communities(coms: DataFrame, tree: DataFrame) -> DataFrame:
    return coms.select("cluster_id").distinct().join(tree.select(F.col("parent").alias("cluster_id")), "cluster_id", "left_anti")


def elements(coms: DataFrame, entities: DataFrame, adj: DataFrame) -> DataFrame:
    """``(cluster_id, kind, src, dst, text, tokens)``: the node texts and, in both directions, the edge texts inside."""
    members = coms.select("cluster_id", "node")
    desc = F.coalesce("entity_description", F.lit(" "))
    nodes = members.join(entities.withColumnRenamed("name", "node"), "node").select("cluster_id", F.lit("node").alias("kind"), F.col("node").alias("src"), F.lit("").alias("dst"), F.concat(F.lit("Node "), "node", F.lit(": "), desc).alias("text"))
    a, b = members.withColumnRenamed("node", "src"), members.withColumnRenamed("node", "dst")
    inside = a.join(adj, "src").join(b, ["cluster_id", "dst"])
    edges = inside.select("cluster_id", F.lit("edge").alias("kind"), "src", "dst", F.concat("src", F.lit(" -> "), "dst", F.lit(" : "), "rel", F.lit(" | "), "descr").alias("text"))
    return nodes.unionByName(edges).withColumn("tokens", T.count_tokens(F.col("text")))


def first_rows(df: DataFrame, key: str, groups: str, num: int, order: list[str]) -> DataFrame:
    """Equal quotas of ``num`` rows for the groups in ``order``; what doesn't divide goes to the first of them."""
    quota = F.create_map(*[F.lit(x) for i, g in enumerate(order) for x in (g, num // len(order) + (i < num % len(order)))])
    nth = F.row_number().over(Window.partitionBy(groups).orderBy(key))
    return df.where(F.col(groups).isin(order)).withColumn("nth", nth).where(F.col("nth") <= F.element_at(quota, F.col(groups))).drop("nth")
