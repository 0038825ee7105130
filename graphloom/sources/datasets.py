"""Multi-hop question-answering datasets -> ``(row_idx, question, answer, text)``.

Three shapes: ``hotpot`` and ``two_wiki`` have ``context struct<title array, sentences array of arrays>``, ``musique`` has
``paragraphs array<struct<title, paragraph_text>>``.  Filters come before the limit and reach the Parquet scan.  The first
``num`` rows are taken in the order of ``row_idx``; asking for more than there are gives what there is, or with ``strict``
an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators.graph import first_rows

LEVELS = ["easy", "medium", "hard"]


def read(spark: SparkSession, path: str, form: str = "parquet") -> DataFrame:
    """The rows of a dataset with ``row_idx``: a column of that name, or else the place in the files."""
    df = spark.read.format(form).load(path)
    if "row_idx" in df.columns:
        return df
    return df.withColumn("row_idx", F.monotonically_increasing_id())  # grows with the place in the files


def titled_text(context: Column, end: str = "") -> Column:
    """``title: sentences`` of every paragraph, one after another; the shorter of both lists decides how many."""
    n = F.least(F.size(context["title"]), F.size(context["sentences"]))
    each = F.arrays_zip(F.slice(context["title"], 1, n).alias("t"), F.slice(context["sentences"], 1, n).alias("s"))
    return F.array_join(F.transform(each, lambda x: F.concat(x["t"], F.lit(": "), F.array_join(x["s"], " "), F.lit(end))), "")


def paragraph_text(paragraphs: Column) -> Column:
    return F.array_join(F.transform(paragraphs, lambda p: F.concat(p["title"], F.lit(": "), p["paragraph_text"], F.lit("\n"))), "")


def _first(df: DataFrame, num: int, strict: bool) -> DataFrame:
    out = df.orderBy("row_idx").limit(num)
    if strict and out.count() < num:
        raise ValueError(f"fewer than {num} rows")
    return out


def hotpot(df: DataFrame, level: str, num: int = 1, strict: bool = False, seed: int = 42) -> DataFrame:
    """One level, or with ``all`` equal quotas of the three in an order that the seed shuffles."""
    if level == "all":
        rows = first_rows(df, "row_idx", "level", num, LEVELS).orderBy(F.xxhash64("row_idx", F.lit(seed)))
    else:
        rows = _first(df.where(F.col("level") == level), num, strict)
    return rows.select("row_idx", "question", "answer", titled_text(F.col("context")).alias("text"))


def musique(df: DataFrame, num: int = 1, answerable_only: bool = True, strict: bool = False) -> DataFrame:
    rows = _first(df.where("answerable") if answerable_only else df, num, strict)
    return rows.select("row_idx", "question", "answer", paragraph_text(F.col("paragraphs")).alias("text"))


def two_wiki(df: DataFrame, kind: str = "all", num: int = 1, strict: bool = False) -> DataFrame:
    rows = _first(df if kind == "all" else df.where(F.col("type") == kind), num, strict)
    return rows.select("row_idx", "question", "answer", titled_text(F.col("context"), "\n").alias("text"))


def documents(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("row_idx").alias("doc_id"), "text")
