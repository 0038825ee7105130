"""Answer metrics over ``(id, answer, gold)``; the mean of no rows is null."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions import parse
from graphloom.functions import text as T
from graphloom.models import Provider


def scores(rows: DataFrame, k: int = 10) -> DataFrame:
    """Per row: exact match, containment of the gold answer, and containment in the first ``k`` words."""
    a, g = T.normalized_answer(F.col("answer")), T.normalized_answer(F.col("gold"))
    n = rows.select("id", a.alias("a"), g.alias("g"))
    prefix = F.array_join(F.slice(F.split("a", " "), 1, k), " ")
    return n.select("id", (F.col("a") == F.col("g")).cast("int").alias("exact"), F.contains("a", "g").cast("int").alias("held"), F.contains(prefix, F.col("g")).cast("int").alias("hit"))


def token_f1(rows: DataFrame) -> DataFrame:
    """``(id, f1)``: twice the shared words, each as often as both have it, over the words of both; 0 without any."""

    def words(c: str, n: str) -> DataFrame:
        each = rows.select("id", F.explode(T.tokens(T.normalized_answer(F.col(c)))).alias("w"))
        return each.groupBy("id", "w").agg(F.count("*").alias(n))

    shared = words("answer", "p").join(words("gold", "q"), ["id", "w"]).groupBy("id").agg(F.sum(F.least("p", "q")).alias("m"))
    size = T.count_tokens(T.normalized_answer(F.col("answer"))) + T.count_tokens(T.normalized_answer(F.col("gold")))
    return rows.select("id", size.alias("n")).join(shared, "id", "left").select("id", F.when(F.col("m") > 0, 2.0 * F.col("m") / F.col("n")).otherwise(F.lit(0.0)).alias("f1"))


def judged(rows: DataFrame, provider: Provider | None) -> DataFrame:
    """``(id, judged)``: the model's 0 or 1 for each ``(id, question, answer, gold)``; without a provider an error."""
    if provider is None:
        raise ValueError("a judge needs a provider")
    return rows.select("id", parse.judgement(provider.judge_response(F.col("question"), F.col("gold"), F.col("answer"))).alias("judged"))


def evaluate(rows: DataFrame, k: int = 10, provider: Provider | None = None) -> DataFrame:
    """All metrics in one row; the judge's only with a provider, for which rows need a question."""
    s = scores(rows, k).agg(F.avg("exact").alias("exact_match"), F.avg("held").alias("contains_answer"), F.avg("hit").alias(f"hit_at_{k}"))
    out = s.join(token_f1(rows).agg(F.avg("f1").alias("f1")))
    return out if provider is None else out.join(judged(rows, provider).agg(F.avg("judged").alias("llm_score")))
