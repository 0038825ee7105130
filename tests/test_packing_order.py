"""Packing in order of groups that many tasks share, against the plain rule."""

import random

from graphloom.operators import packing


def plain(sizes, room):
    """How many packs are there before, and the rows of the one that is open."""
    out, open_, used = [], [], 0
    for i, n in enumerate(sizes):
        if n > room:
            out.append([i])
        elif used + n > room:
            out.append(open_)
            open_, used = [i], n
        else:
            open_, used = [*open_, i], used + n
    return [p for p in [*out, open_] if p]


def test_large_groups_are_packed_in_order(spark):
    """Groups of more than 64 packs, over many ranges of rows, with rows that fit in no pack and rows without a word."""
    r = random.Random(3)
    sizes = {g: [r.choice([0, 1, r.randrange(60), r.randrange(60), r.randrange(130)]) for _ in range(n)] for g, n in (("a", 900), ("b", 1), ("c", 400), (None, 300))}
    sizes["d"] = [500] * 40 + [1] * 40
    rows = [(g, k, n) for g, ns in sizes.items() for k, n in enumerate(ns)]
    for parts in ("1", "7", "40"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        got = {}
        for x in packing.pack_in_order(spark.createDataFrame(rows, "source string, ord int, n int"), 100, "source").collect():
            got.setdefault(x["source"], {}).setdefault(x["pack"], []).append(x["ord"])
        assert {g: [sorted(packs[k]) for k in range(len(packs))] for g, packs in got.items()} == {g: plain(ns, 100) for g, ns in sizes.items()}
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert packing.pack_in_order(spark.createDataFrame([], "source string, ord int, n int"), 100, "source").count() == 0


def test_a_large_source_is_packed_in_order(spark, tmp_path):
    import __spark_entry__ as entry

    r = random.Random(4)
    sizes = [r.randrange(1, 2300) for _ in range(260)]
    spark.createDataFrame([(k, "w " * n, "s") for k, n in enumerate(sizes)], "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted((x["pack"], x["documents"], x["words"], x["chunk"]) for x in entry.queries()["token_pack"](spark, str(tmp_path)).collect())
    assert got == [(k, len(p), sum(sizes[i] for i in p), 0) for k, p in enumerate(plain(sizes, 2000))]
