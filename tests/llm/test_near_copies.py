"""The pipeline's near-copies stage against brute force."""

import random

import corpus_pipeline
from graphloom.llm import near_copies, simhash

DOCS = "doc_id long, text string, lang string"


def plain_set(text, size=5):
    words = (text or "").lower().split()
    return {tuple(words[k : k + size]) for k in range(len(words) - size + 1)} or {tuple(words)}


def greedy(rows):
    """Ids in order; each stays unless one that stayed is 0.8 or more like it."""
    kept = []
    for doc_id, text in sorted(rows):
        own = plain_set(text)
        if not any(5 * len(own & other) >= 4 * len(own | other) for _, other in kept):
            kept.append((doc_id, own))
    return [doc_id for doc_id, _ in kept]


def edited(r, text, changes):
    words = text.split()
    for k in r.sample(range(len(words)), changes):
        words[k] = f"new{r.randrange(10**6)}"
    return " ".join(words)


def corpus():
    r = random.Random(11)
    fresh = lambda n: " ".join(f"w{r.randrange(5000)}" for _ in range(n))
    rows, k = [], 0
    for n in (6, 40, 200, 200, 400):
        base = fresh(n)
        for changes in (0, 0, 1, 2, 3, 4, 6, 9, 15):
            rows.append((k, edited(r, base, min(changes, n))))
            k += 1
    return rows + [(100 + i, fresh(60)) for i in range(30)]


def test_stage_drops_near_copies(spark):
    """Edits of a few words leave fingerprints more than two bits apart; they go all the same."""
    rows = corpus()
    docs = spark.createDataFrame([(*x, "en") for x in rows], DOCS)
    kept = corpus_pipeline.drop_near_copies(spark, docs, "")
    assert kept.columns == ["doc_id", "text", "lang"]
    assert sorted(x["doc_id"] for x in kept.collect()) == greedy(rows)


def test_odd_rows(spark):
    text = "the quick brown fox jumps over the lazy dog " * 3
    rows = [(5, text, "en"), (2, text.upper(), None), (9, None, "en"), (4, "", "en"), (7, " \n ", "en"), (None, text, "en"), (8, "all else", "en"), (8, text, "en")]
    kept = near_copies.keep_one(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted(map(str, (x["doc_id"] for x in kept))) == ["2", "4", "8", "None"]
    twice = [(1, text, "en"), (1, text, "en"), (3, text + "end", "en")]
    assert {x["doc_id"] for x in near_copies.keep_one(spark.createDataFrame(twice, DOCS)).collect()} == {1}
    assert near_copies.keep_one(spark.createDataFrame([], DOCS)).count() == 0


def test_kept_compares_all_pairs():
    rows = corpus()
    kept = near_copies.Kept(0.8)
    assert [k for k, t in rows if not kept.holds(near_copies.shingle_set(near_copies.normal_words(t)))] == greedy(rows)


def test_one_of_repeated_rows_stays(spark):
    rows = [(1, "one text of a few words", "en")] * 3 + [(2, "another text of other words", "de")] * 2 + [(None, "no id", "en")] * 2
    kept = near_copies.keep_one(spark.createDataFrame(rows, DOCS))
    assert sorted(map(str, map(tuple, kept.collect()))) == sorted(map(str, [rows[0], rows[3], rows[5], rows[6]]))


def test_simhash_links_are_candidates(spark):
    """Fingerprints at two or fewer differing bits link texts that have no band in common, and the exact check follows."""
    a = 0x0123456789ABCDEF
    rows = [(1, a, [10]), (2, a ^ 0b11, [20]), (3, a ^ 0b111 << 40, [30]), (4, a, [40]), (5, 77, [30])]
    marks = spark.createDataFrame(rows, "node long, fp long, bands array<long>")
    found = {x["node"]: x["component"] for x in near_copies.components(near_copies.candidates(marks)).collect()}
    assert found == {1: 1, 2: 1, 4: 1, 3: 3, 5: 3}
    text = "one two three four five six seven"
    docs = spark.createDataFrame([(1, text, "en"), (2, "other words are here for this one", "en")], DOCS)
    made = {x["doc_id"]: x["fp"] for x in near_copies._marks(docs, "doc_id", "text", 5).collect()}
    assert made == {x["doc_id"]: simhash.fingerprint(x["text"], 5) - (1 << 64) * (simhash.fingerprint(x["text"], 5) >> 63) for x in docs.collect()}
