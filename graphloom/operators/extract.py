"""From documents to entity and relation mentions, and their merge within a document (the default chunk).

Names, types and texts come from a provider (see ``models``): its model, prompts and parsers, or rules without a model.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import text as T
from graphloom.models import OFFLINE, Provider
from graphloom.storage import cut


def chunks(docs: DataFrame, size: int = 1024, overlap: int = 20) -> DataFrame:
    """``(doc_id, chunk_idx, text)``: whole sentences up to ``size`` words; a chunk begins with those last sentences of the
    one before that have at most ``overlap`` words.  A longer sentence is a chunk of its own."""
    unit = F.transform(T.sentences(F.col("text")), lambda s: F.struct(s.alias("s"), T.count_tokens(s).alias("n")))
    start = F.struct(F.array().cast("array<array<struct<s:string,n:int>>>").alias("done"), F.array().cast("array<struct<s:string,n:int>>").alias("open"))

    def words(a):
        return F.aggregate(a, F.lit(0), lambda t, x: t + x["n"])

    def step(state, x):
        full = (F.size(state["open"]) > 0) & (words(state["open"]) + x["n"] > size)
        back = F.aggregate(F.reverse(state["open"]), F.array().cast("array<struct<s:string,n:int>>"), lambda a, y: F.when(words(a) + y["n"] <= overlap, F.concat(F.array(y), a)).otherwise(F.concat(F.array(F.struct(F.lit("").alias("s"), F.lit(size).alias("n"))), a)))
        tail = F.filter(back, lambda y: y["n"] < size)
        return F.when(full, F.struct(F.concat(state["done"], F.array(state["open"])).alias("done"), F.concat(tail, F.array(x)).alias("open"))).otherwise(
            F.struct(state["done"].alias("done"), F.concat(state["open"], F.array(x)).alias("open"))
        )

    packed = F.aggregate(unit, start, step, lambda s: F.concat(s["done"], F.array(s["open"])))
    return docs.select("doc_id", F.posexplode(packed).alias("chunk_idx", "c")).select("doc_id", "chunk_idx", F.array_join(F.transform("c", lambda x: x["s"]), " ").alias("text"))


def chunked(docs: DataFrame, size: int = 1024, overlap: int = 20) -> DataFrame:
    """``(doc_id, text)`` where every chunk is a document: its id is the pair of both."""
    return chunks(docs, size, overlap).select(F.struct("doc_id", "chunk_idx").alias("doc_id"), "text")


def windows(docs: DataFrame) -> DataFrame:
    """``(doc_id, win_idx, text)``: each sentence with the next; empty windows are left out.  No shuffle."""
    split = docs.select("doc_id", T.sentences(F.col("text")).alias("s"))
    pairs = F.transform("s", lambda x, i: T.strip(F.concat_ws(" ", x, F.get(F.col("s"), i + 1))))
    return split.select("doc_id", F.posexplode(pairs).alias("win_idx", "text")).where("text <> ''")


def named_windows(wins: DataFrame, provider: Provider = OFFLINE) -> DataFrame:
    """``(doc_id, win_idx, text, found)``: what the provider finds in each window; windows without anything are asked for
    again as often as the provider says, and then left out."""
    named = wins.withColumn("found", provider.entities(F.col("text")))
    if provider.joins_all and provider.attempts == 1:
        return named  # a filter would find everything twice; windows without anything give no rows later
    if provider.attempts == 1:
        return named.where("size(found) > 0")
    named = cut(named)
    for _ in range(provider.attempts - 1):
        empty = named.where("size(found) = 0")
        if empty.isEmpty():
            break
        named = cut(named.where("size(found) > 0").unionByName(empty.withColumn("found", provider.entities(F.col("text")))))
    return named.where("size(found) > 0")


def window_entities(named: DataFrame) -> DataFrame:
    """``(doc_id, win_idx, name, etype, descr)``: each name and type once per window, the first description of several."""
    each = F.transform("found", lambda e: F.struct(T.strip(e["name"]).alias("name"), T.strip(e["etype"]).alias("etype"), T.strip(e["descr"]).alias("descr")))
    keys = F.transform("each", lambda e: F.struct(e["name"], e["etype"]))
    first = F.filter("each", lambda e, i: F.array_position(F.col("keys"), F.struct(e["name"], e["etype"])) == i + 1)
    once = F.when(F.size(F.array_distinct("keys")) < F.size("keys"), first).otherwise(F.col("each"))
    return named.select("doc_id", "win_idx", each.alias("each")).withColumn("keys", keys).select("doc_id", "win_idx", F.inline(once))


def window_relations(named: DataFrame, provider: Provider = OFFLINE) -> DataFrame:
    """``(doc_id, win_idx, src, dst, rel, descr)`` of the windows with two entities or more, made inside the window's row."""
    several = named if provider.joins_all else named.where("size(found) > 1")
    asked = several.select("doc_id", "win_idx", provider.relations(F.col("text"), F.col("found")).alias("r"))
    return asked.select("doc_id", "win_idx", F.explode("r").alias("r")).select("doc_id", "win_idx", *[T.strip(F.col(f"r.{c}")).alias(c) for c in ("src", "dst", "rel", "descr")])


def merge_entities(mentions: DataFrame) -> DataFrame:
    """Per document one row for each (name, type), its distinct descriptions sorted and joined."""
    return mentions.groupBy("doc_id", "name", "etype").agg(F.array_join(F.array_sort(F.collect_set("descr")), " | ").alias("descr"), F.min("win_idx").alias("first_win"), F.count("*").alias("mentions"))


def _known(relations: DataFrame, entities: DataFrame, how: str) -> DataFrame:
    names = entities.select("doc_id", F.col("name")).distinct()
    return relations.join(names.withColumnRenamed("name", "src"), ["doc_id", "src"], how).join(names.withColumnRenamed("name", "dst"), ["doc_id", "dst"], how)


def merge_relations(mentions: DataFrame, entities: DataFrame | None) -> DataFrame:
    """Per document one row for each (source, target, relation) whose two ends are entities of that document; without
    ``entities`` all ends are, as the provider joins entities alone."""
    merged = mentions.groupBy("doc_id", "src", "dst", "rel").agg(F.array_join(F.array_sort(F.collect_set("descr")), " | ").alias("descr"), F.count("*").alias("mentions"))
    known = merged if entities is None else _known(merged, entities, "left_semi")
    return known.select("doc_id", "dst", "src", "rel", "descr", "mentions")


def extraction_stats(mentions: DataFrame, relations: DataFrame) -> DataFrame:
    """How many descriptions were merged, per kind, how many relations were read, and how many distinct ones of a document
    have an end that is no entity of it: one row."""
    e = mentions.groupBy("doc_id", "name", "etype").agg((F.count_distinct("descr") - 1).alias("m")).agg(F.sum("m").alias("entity_merges"), F.count("*").alias("entities"))
    each = relations.groupBy("doc_id", "src", "dst", "rel").agg((F.count_distinct("descr") - 1).alias("m"), F.count("*").alias("n"))
    r = each.agg(F.sum("m").alias("relation_merges"), F.sum("n").alias("raw_relations"), F.count("*").alias("distinct_relations"))
    known = _known(each, mentions, "left_semi").agg(F.count("*").alias("known"))
    return e.join(r).join(known).withColumn("unknown_entity_relations", F.col("distinct_relations") - F.col("known")).drop("distinct_relations", "known")


def leaked_descriptions(mentions: DataFrame) -> DataFrame:
    """Compatibility: the description that both ends of relation k of a document carry is relation k - 1's, and none for the
    first; relations are numbered as they were first read: by window, then as the window gives them."""
    merged = mentions.withColumn("at", F.struct("win_idx", "src", "dst", "rel")).groupBy("doc_id", "src", "dst", "rel").agg(F.array_join(F.array_sort(F.collect_set("descr")), " | ").alias("descr"), F.min("at").alias("at"))
    return merged.withColumn("leaked", F.lag("descr").over(Window.partitionBy("doc_id").orderBy("at"))).drop("at")
