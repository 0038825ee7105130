"""SimHash, components and line deduplication against brute force."""

import random
import re

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from graphloom.llm import components, simhash, substring_dedup
from graphloom.llm.shared import cut

DOCS = "doc_id long, text string, lang string, removed string"


def roots(n, links):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in links:
        x, y = find(i), find(j)
        root[max(x, y)] = min(x, y)
    return [find(i) for i in range(n)]


def near(values, radius=2):
    return [(i, j) for i in range(len(values)) for j in range(i + 1, len(values)) if (values[i] ^ values[j]).bit_count() <= radius]


@given(st.integers(0, 2**64 - 1), st.integers(0, 63), st.integers(0, 63))
@settings(max_examples=300, deadline=None)
def test_masks_cover_the_radius(x, i, j):
    y = x ^ (1 << i) ^ (1 << j)
    first = [t for t, m in enumerate(simhash.TABLES) if x & m == y & m]
    assert first
    for t in first:
        assert any(x & m == y & m for m in simhash.SECOND[t])


def test_second_masks_leave_few_bits_free():
    assert max(64 - m.bit_count() for ms in simhash.SECOND for m in ms) <= 12


def plain_fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode())
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64(g, seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("text", [None, "", " \n", "One", "Two words", "a b c", "A b\tC d\x0b e", "É Ü ß ñ 日本 x", "x " * 40_000])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == plain_fingerprint(text)


def test_forest_spans_the_groups():
    r = random.Random(3)
    base = [r.getrandbits(64) for _ in range(6)]
    values = list({b ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)) for b in base for _ in range(60)})
    got = simhash.forest(np.array(values, np.uint64))
    assert roots(len(values), got) == roots(len(values), near(values))
    assert len(got) < len(values)


@pytest.mark.parametrize("split_above", [2048, 3])
def test_links_keep_every_component(spark, split_above):
    r = random.Random(5)
    base = [r.getrandbits(64) for _ in range(8)] + [0]
    values = sorted({b ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)) for b in base for _ in range(40)} | {r.getrandbits(64) for _ in range(300)})
    reps = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v, k) for k, v in enumerate(values)], "fp long, rep long")
    found = {x["node"]: x["component"] for x in components.components(simhash.near_links(reps, split_above)).collect()}
    assert [found.get(i, i) for i in range(len(values))] == roots(len(values), near(values))


def test_components_of_a_chain_a_star_and_nothing(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, x) for x in range(101, 140)] + [(7, 7), (None, 3), (200, 201), (201, 200)]
    found = {x["node"]: x["component"] for x in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {i: 0 for i in range(61)} | {i: 100 for i in range(100, 140)} | {200: 200, 201: 200}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_duplicates_of_odd_rows(spark):
    text = "the quick brown fox jumps over the lazy dog " * 3
    rows = [(5, text, "en", ""), (2, text, None, None), (9, None, "en", ""), (4, "", "en", ""), (7, " \n ", "en", ""), (None, text, "en", ""), (8, "all else", "en", ""), (8, text, "en", "")]
    got = sorted(((x["doc_id"], x["fingerprint"], x["component_id"]) for x in simhash.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()), key=str)
    zero, own, other = "0" * 16, f"{plain_fingerprint(text):016x}", f"{plain_fingerprint('all else'):016x}"
    assert got == sorted([(5, own, 2), (2, own, 2), (9, zero, 4), (4, zero, 4), (7, zero, 4), (None, own, None), (8, other, 2), (8, own, 2)], key=str)
    kept = simhash.keep_one(spark.createDataFrame(rows, DOCS))
    assert kept.columns == ["doc_id", "text", "lang", "removed"] and sorted(map(str, (x["doc_id"] for x in kept.collect()))) == ["2", "4", "None"]
    assert simhash.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0


LINE, OTHER = "one line that is long enough", "another line that is long enough"


def plain_words(text):
    """(start, word, whether a line starts with it), a character at a time."""
    out, fresh = [], True
    for i, c in enumerate(text):
        unspaced = any(a <= ord(c) <= b for a, b in ((0xE00, 0xFFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3040, 0x30FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF)))
        if c in " \t\n\x0b\x0c\r":
            fresh = fresh or c == "\n"
            joins = False
        elif out and joins and not unspaced and len(out[-1][1]) < 16:
            out[-1][1] += c.lower() if "A" <= c <= "Z" else c
        else:
            out.append([i, c.lower() if "A" <= c <= "Z" else c, fresh])
            joins, fresh = not unspaced, False
    return out


def plain_stretches(text, unit, min_words, spread):
    words = plain_words(text)
    borders = {k for k, w in enumerate(words) if w[2]}
    if unit == "stretch":
        h = []
        for w in words:
            x = 0
            for c in w[1]:
                x = (x * substring_dedup.BASE + ord(c)) % 2**64
            h.append(x * substring_dedup.MIX % 2**64 >> 32)
        fresh = [h[k] not in h[max(0, k - spread + 1) : k] for k in range(len(h))]
        for k in range(len(h) - spread + 1):
            if held := [p for p in range(k, k + spread) if fresh[p]]:
                borders.add(min(held, key=lambda p: (h[p], p)))
    ends = sorted(borders | {len(words)})
    found = {(a, z) for a in borders for z in [next((z for z in ends if z >= a + min_words), None)] if z is not None}
    for z in range(1, len(words) + 1):
        if z == len(words) or words[z][2]:
            line = max(k for k in range(z) if words[k][2])
            found |= {(a, z) for a in [max((a for a in borders if line <= a <= z - min_words), default=None)] if a is not None}
    for a, z in sorted(found):
        yield words[a][0], words[z][0] if z < len(words) else len(text), " ".join(w[1] for w in words[a:z])


def brute_force(rows, unit="stretch", min_words=20, spread=15):
    """Texts by document; of equal stretches the first place stays, every character of the others goes."""
    seen, out = {}, {}
    for i, text in sorted(rows):
        gone = set()
        for start, stop, form in plain_stretches(text, unit, min_words, spread):
            if seen.setdefault(form, (i, start)) != (i, start):
                gone.update(range(start, stop))
        out[i] = "".join(c for k, c in enumerate(text) if k not in gone)
    return out


def spliced(r, n=60):
    """Texts of random words and lines with passages of 50 words and more, put in at any word."""
    say = lambda k: " ".join(r.choice(["the", "Of", "a"]) if r.random() < 0.3 else "".join(r.choices("abcdeXYZé", k=r.randrange(1, 9))) + r.choice(["", "", "", ",", ".", ".\n"]) for _ in range(k))
    passages = [say(k) for k in (50, 55, 80, 130)]
    rows = []
    for i in range(n):
        parts = [say(r.randrange(2, 90)) for _ in range(3)]
        if i % 2:
            parts.insert(r.randrange(4), passages[i // 2 % 4])
        rows.append((i, " ".join(parts)))
    return rows, passages


@pytest.mark.parametrize("unit, min_words, spread", [("stretch", 20, 15), ("stretch", 8, 4), ("line", 5, 15)])
def test_stretches_against_brute_force(spark, unit, min_words, spread):
    r = random.Random(1)
    lines = [" ".join(r.choice(["a", "B", "c", "É"]) for _ in range(n)) for n in (4, 5, 5, 6, 7)] + ["", " ", "  a b  C\td e ", "日本語の長い行です", "x" * 70]
    rows = spliced(r)[0] + [(i, "\n".join(r.choice(lines) for _ in range(r.randrange(1, 9)))) for i in range(100, 160)]
    got = substring_dedup.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string"), unit, min_words, spread)
    originals = dict(rows)
    found = got.collect()
    assert {x["doc_id"]: x["text"] for x in found} == brute_force(rows, unit, min_words, spread)
    assert sum(len(x["removed"]) for x in found) > 20
    for x in found:
        assert substring_dedup.without(originals[x["doc_id"]], [(s["start"], s["stop"]) for s in x["removed"]]) == x["text"]
        for s in x["removed"]:  # what went begins, word for word, like what stays where the span says
            went = [w[1] for w in plain_words(originals[x["doc_id"]][s["start"] : s["stop"]])][:min_words]
            assert [w[1] for w in plain_words(originals[s["kept_doc_id"]][s["kept_start"] :])][: len(went)] == went


def test_spliced_passages_go(spark):
    rows, passages = spliced(random.Random(4))
    got = substring_dedup.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all(len(p.split()) >= 50 for p in passages)
    first = {passages[i // 2 % 4]: i for i in range(59, 0, -2)}
    for x in got:
        carries = x["doc_id"] % 2 and x["doc_id"] not in first.values()
        assert bool(x["removed"]) == bool(carries)
        if carries:
            assert not any(p in x["text"] for p in passages)


def test_a_very_long_text(spark):
    r = random.Random(9)
    words = ["".join(r.choices("abcdefgh", k=5)) for _ in range(400_000)]
    rows = [(1, " ".join(words)), (2, "new " + " ".join(words[200_000:200_060]) + " end"), (3, "x" * 1_000_000)]
    got = {x["doc_id"]: (x["text"], len(x["removed"])) for x in substring_dedup.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == (rows[0][1], 0) and got[2][1] == 1 and len(got[2][0]) < 200
    assert got[3] == (rows[2][1], 0)  # one word over and over is one unit


def test_lines_of_odd_rows(spark):
    rows = [(1, None, "en", "x"), (2, "", "en", "x"), (3, LINE, "en", "x"), (3, LINE, "en", "x"), (4, f"{LINE}\n{OTHER}\n{LINE.upper()}", None, "x"), (None, LINE, "en", "x"), (3, f"{OTHER}\nx", "de", "x")]
    got = substring_dedup.substring_dedup(spark.createDataFrame(rows, DOCS), "line", 5)
    assert got.columns == ["doc_id", "text", "lang", "removed"]
    assert sorted(((x["doc_id"], x["text"]) for x in got.collect()), key=str) == sorted([(1, None), (2, ""), (3, LINE), (3, LINE), (4, ""), (None, LINE), (3, f"{OTHER}\nx")], key=str)
    assert substring_dedup.substring_dedup(spark.createDataFrame([], DOCS)).count() == 0


def test_clashing_names(spark):
    names = ["__id", "__hash", "digest", "first", "n", "text_hash", "start"]
    docs = spark.createDataFrame([(1, LINE, *names), (2, LINE, *names)], "doc_id long, text string, " + ", ".join(f"{c} string" for c in names))
    got = substring_dedup.substring_dedup(docs, "line", 5)
    assert got.columns == [*docs.columns, "removed"]
    assert sorted((x["doc_id"], x["text"], x["__id"], x["start"]) for x in got.collect()) == [(1, LINE, "__id", "start"), (2, "", "__id", "start")]


def test_paragraphs():
    text = "one two three\nfour five six\n\nseven eight nine ten eleven\n"
    starts, stops, _ = substring_dedup.stretches(text, "paragraph", 5)
    assert [text[a:b] for a, b in zip(starts.tolist(), stops.tolist())] == ["one two three\nfour five six\n\n", "seven eight nine ten eleven\n"]


def test_cut_keeps_rows(spark):
    assert cut(spark.range(5)).count() == 5
