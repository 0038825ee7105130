"""Corpus preparation in five stages; each works on the documents that its predecessor kept.

``run`` applies them to the table of documents.  Between stages the rows are written as Parquet under the shared folder
and read again, so a stage never runs its predecessors anew and a lost executor costs no more than its own tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import near_copies, packing, quality, substring_dedup, toxicity
from graphloom.llm.queries import tokenizer_file
from graphloom.llm.shared import new_folder, remove, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier scores below 0.5, with all their columns (odd rows: see ``keep_clean``)."""
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier scores 0.3 or more, with all their columns (odd rows: see ``keep_good``)."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without those whose 5-word shingles are 0.8 or more like those of one that stays (odd rows: see
    ``near_copies.keep_one``)."""
    return near_copies.keep_one(docs)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the stretches of 20 words or more that an earlier document or place has; ``n_chars`` follows
    the text.

    Null and empty texts and rows with a null id stay as they are, rows that repeat an id and a text lose the same, a text
    of repeated stretches only becomes empty and its row stays; an empty table gives none; other columns stay.
    """
    out = substring_dedup.substring_dedup(docs).drop("removed")
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every piece of every document in sequences of 2048 tokens (odd rows: see ``packing.pack``)."""
    return packing.pack(docs, tokenizer_file("word_bpe_49k.json")).drop("ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", drop_poor),
    ("near_copies", drop_near_copies),
    ("repeated_lines", drop_repeated_lines),
    ("packing", pack_sequences),
]

#: Classifiers are trained and tokenizers merge by tables: SQL expresses neither.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; an empty table of documents gives none."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        folder = new_folder(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
        if before:  # nothing reads it any more; the last one stays, as the result is read from it
            remove(spark, before)
        before = folder
    return STAGES[-1][1](spark, docs, sf_dir)
