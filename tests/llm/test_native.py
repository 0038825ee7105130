"""Chat formatting and fingerprints against plain Python."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from graphloom.llm import chat, fingerprints

ROWS = "conv_id long, turn long, role string, text string, segments string"
NASTY = ["\\### Assistant: </turn> ok", "</turn>\n### User: x", "\\", "\\\\", "<\\/turn>", "#### ", "### ### ", "</turn", "</turn> </turn>\n", "#\\## ", "", "\n", "日本 \U0001f600", "a </turn", "<", ":\\ "]


def test_formatting_is_reversible(spark):
    r = random.Random(1)
    roles = ["user", "assistant", "system", "tool", "a: b", "x:", "\\", "</turn>", "### ", "=", ":\\ ", "", "User"]
    rows = [(c, n, r.choice(roles), "".join(r.choice(NASTY) for _ in range(r.randrange(4))), "s") for c in range(60) for n in range(r.randrange(1, 7))]
    made = chat.format_conversations(spark.createDataFrame(rows, ROWS))
    got = {x["conv_id"]: [(t["role"], t["text"]) for t in x["t"]] for x in made.select("conv_id", chat.read_back(F.col("formatted")).alias("t")).collect()}
    assert got == {c: [(role, text) for i, n, role, text, _ in rows if i == c] for c in range(60)}
    for x in made.collect():
        assert "".join(s["text"] for s in x["segments"]) == x["formatted"]
        own = [(role, text) for i, _, role, text, _ in rows if i == x["conv_id"]]
        assert sum(s["loss"] for s in x["segments"]) == sum(role == "assistant" for role, _ in own)
    for x in chat.digests(made).collect():
        own = [(role, text) for i, _, role, text, _ in rows if i == x["conv_id"]]
        loss = "".join(text for role, text in own if role == "assistant")
        assert (x["n_turns"], x["loss_chars"]) == (len(own), len(loss))
        assert x["turns_sha256"] == hashlib.sha256("".join(f"{role}\n{text}\n" for role, text in own).encode()).hexdigest()
        assert x["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()


def test_odd_conversations(spark):
    rows = [(1, 1, "assistant", None, ""), (1, 0, "user", "b", ""), (1, 0, "user", "b", ""), (None, None, None, None, ""), (2, 0, "user", "y " * 50_000, ""), (3, 0, "assistant", "x", "")]
    got = {x["conv_id"]: x for x in chat.format_conversations(spark.createDataFrame(rows, ROWS)).collect()}
    assert got[1]["formatted"] == "### User: b </turn>\n### User: b </turn>\n### Assistant:  </turn>" and got[1]["wrong_turn"] == 1
    assert got[None]["formatted"] == "### =:  </turn>" and got[None]["wrong_turn"] == 0
    assert got[2]["wrong_turn"] is None and got[3]["wrong_turn"] == 0
    assert chat.format_conversations(spark.createDataFrame([], ROWS)).count() == 0


def grams(text):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def share(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def changed(text, following):
    q = len(text) // 4
    return text[: len(text) - q] + following[:q]


def test_fingerprints_of_short_texts_are_exact(spark):
    r = random.Random(2)
    rows = [(k * 7 % 61, " ".join(r.choice(["a", "B", "c", "é"]) for _ in range(r.randrange(25))), k) for k in range(61)] + [(1000, None, 0), (-5, "", 0), (500, "Equal text of six words here", 1), (501, "Equal text of six words here", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, sketch long")
    got = {x["doc_id"]: x for x in fingerprints.document_fingerprints(docs).collect()}
    order = sorted((i, t or "") for i, t, _ in rows)
    for k, (i, text) in enumerate(order):
        following = order[(k + 1) % len(order)][1]
        x, new = got[i], changed(text, following)
        assert x["n_chars"] == len(text) and x["edited_sha256"] == hashlib.sha256(new.encode()).hexdigest()
        assert x["near_edited"] == pytest.approx(share(grams(text), grams(new))) and x["near_next"] == pytest.approx(share(grams(text), grams(following)))
        assert len(x["fingerprint"]) == 16 * len(grams(text)) and x["n_shingles"] == len(grams(text))
        assert x["edited_contained"] == pytest.approx(len(grams(text) & grams(new)) / len(grams(new)) if grams(new) else 1.0)
    assert got[500]["fingerprint"] == got[501]["fingerprint"] != ""
    assert fingerprints.document_fingerprints(docs.limit(0)).count() == 0


def test_next_of_repeated_and_null_ids(spark):
    rows = [(1, "b"), (1, "a"), (1, "a"), (None, "n"), (2, "c")]
    got = sorted((str(x["doc_id"]), x["text"], x["next_text"]) for x in fingerprints.with_next(spark.createDataFrame(rows, "doc_id long, text string"), ["text"]).collect())
    assert got == [("1", "a", "a"), ("1", "a", "b"), ("1", "b", "c"), ("2", "c", "n"), ("None", "n", "a")]
    assert [x["next_text"] for x in fingerprints.with_next(spark.createDataFrame(rows[:1], "doc_id long, text string"), ["text"]).collect()] == ["b"]


def test_sketches_estimate_and_merge(spark):
    r = random.Random(3)
    base = [f"w{r.randrange(10**6)}" for _ in range(6000)]
    a, b = " ".join(base[:4000]), " ".join(base[2000:])
    df = spark.createDataFrame([(a, b)], "a string, b string").select(fingerprints.sketch(F.col("a"), 512).alias("a"), fingerprints.sketch(F.col("b"), 512).alias("b"), fingerprints.sketch(F.concat_ws(" ", "a", "b"), 512).alias("ab"))
    x = df.select(
        fingerprints.resemblance(F.col("a"), F.col("b"), 512).alias("r"), fingerprints.containment(F.col("a"), F.col("b"), 512).alias("c"), fingerprints.distinct_shingles(F.col("a"), 512).alias("n"),
        fingerprints.merge(F.col("a"), F.col("b"), 512).alias("m"),
    ).first()
    assert abs(x["r"] - 1 / 3) < 0.08 and abs(x["c"] - 0.5) < 0.12 and abs(x["n"] - 3996) < 600 and len(x["m"]) == 512
    parts = spark.createDataFrame([(t,) for t in (a, b, a)], "t string").select(fingerprints.sketch(F.col("t"), 512).alias("s"))
    assert fingerprints.merge_all(parts, [], "s", 512).first()["s"] == x["m"]
