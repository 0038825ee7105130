"""Communities and labels by rounds over blocks of links."""

import random

import numpy as np
from pyspark.sql import functions as F

from graphloom.operators import blocks, graph


def linked(spark, links):
    return spark.createDataFrame([(x, y) for a, b in links for x, y in ((a, b), (b, a))], "src string, dst string")


def random_links(n, m, seed=3):
    r = random.Random(seed)
    return sorted({tuple(sorted(f"é{x}" if x % 3 else f"n{x}" for x in r.sample(range(n), 2))) for _ in range(m)})


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_a_round_is_one_job(spark):
    """On an even path the end's labels travel a node a round; such a round took two jobs and more."""
    path = linked(spark, [(f"p{i:03}", f"p{i + 1:03}") for i in range(59)])
    spark.sparkContext.setJobGroup("rounds", "rounds")
    counted, each = [], blocks.Numbered._each
    try:
        blocks.Numbered._each = lambda *a, **b: counted.append(1) or each(*a, **b)
        graph.label_propagation(path)
        graph.partition(path)
    finally:
        blocks.Numbered._each = each
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(counted) > 10 and len(spark.sparkContext.statusTracker().getJobIdsForGroup("rounds")) <= len(counted) + 80


def test_results_do_not_depend_on_blocks(spark, monkeypatch):
    adj = linked(spark, random_links(80, 150))
    groups = adj.select(F.col("src").alias("node"), F.length("src").cast("string").alias("cluster_id")).distinct()
    whole = [rows(graph.partition(adj)), rows(graph.partition(adj, groups)), rows(graph.label_propagation(adj))]
    monkeypatch.setattr(blocks, "BLOCK", 20)
    assert whole == [rows(graph.partition(adj)), rows(graph.partition(adj, groups)), rows(graph.label_propagation(adj))]
    of = dict(rows(groups))
    assert all(of[node] == of[label] for node, label in whole[1])


def test_numbers_follow_names_and_halves_follow_hashes(spark):
    net = blocks.Numbered(linked(spark, random_links(40, 60)))
    names = [r["node"] for r in net.names.orderBy("id").collect()]
    assert names == sorted(names, key=str.encode) and len(names) == net.n
    for k in (0, 1, 7):
        said = [r[0] for r in net.names.orderBy("id").select(F.xxhash64("node", F.lit(k))).collect()]
        assert blocks._mixed(net.seeds.view(np.uint64), k).view(np.int64).tolist() == said
