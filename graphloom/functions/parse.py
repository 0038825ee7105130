"""Grammars of model output, as Column expressions.

A response is cut before every label and its pieces are folded, in order, by a small machine: it waits for the first
label, then for each next one, and a piece with any other label belongs to the field that is open.  What ends the last
field, the description, differs: an entity's ends before a line with the next entity's label, with RELATIONSHIPS: or with
a full stop, and without such a line the record is lost; a relation's ends with its line, and an empty one takes the next
line that isn't blank, unless that is a full stop.

The field labels are fixed values: they are what prompts ask models to print.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from graphloom.functions import text as T
from graphloom.functions.text import NO_ANSWER, WS, before_mark, strip, without_assistant

ENTITY = {"entity_name:": "name", "entity_type:": "etype", "entity_description:": "descr"}
RELATION = {"source_entity:": "src", "target_entity:": "dst", "relation:": "rel", "relationship_description:": "descr"}
DIGITS = 38  # of a score


def _left(c: Column) -> Column:
    return F.regexp_replace(c, f"\\A{WS}+", "")


def _entity_end(open_text: Column) -> Column:
    """The description, or null while no line inside the text ends it."""
    parts = F.split(_left(open_text), f"\n{WS}*(?=RELATIONSHIPS:|[.])", 2)
    return F.when(F.size(parts) > 1, F.get(parts, F.lit(0)))


def _relation_end(open_text: Column) -> Column:
    text = _left(open_text)
    line = F.get(F.split(text, "\n", 2), F.lit(0))
    stop = (strip(line) == ".") & (F.length(open_text) > F.length(text)) & F.contains(F.substring(open_text, F.lit(1), F.length(open_text) - F.length(text)), F.lit("\n"))
    return F.when(stop, F.lit("")).when(F.contains(text, F.lit("\n")), line)


def _records(c: Column, labels: dict[str, str], end: Callable[[Column], Column], repeats: bool) -> Column:
    """``repeats``: whether the first label on a line of its own ends a record, and whether the end of the text doesn't."""
    names, last = list(labels), len(labels)
    pieces = F.split(c, "(?=" + "|".join(names) + ")")
    record = "struct<" + ",".join(f"{f}:string" for f in labels.values()) + ">"
    none, empty = F.array().cast("array<string>"), F.array().cast(f"array<{record}>")

    def state(at: Column, values: Column, out: Column) -> Column:
        return F.struct(at.cast("int").alias("at"), values.alias("values"), out.alias("out"))

    def made(values: Column, descr: Column) -> Column:
        fields = [F.get(values, F.lit(k)) for k in range(last - 1)] + [descr]
        return F.array(F.struct(*[strip(x).alias(f) for x, f in zip(fields, labels.values())]))

    def longer(values: Column, more: Column) -> Column:
        n = F.size(values)
        return F.concat(F.slice(values, F.lit(1), n - 1), F.array(F.concat(F.element_at(values, -1), more)))

    def begun(piece: Column, out: Column) -> Column:
        own = F.startswith(piece, F.lit(names[0]))
        rest = F.substring(piece, F.lit(len(names[0]) + 1), F.length(piece))
        return F.when(own, state(F.lit(1), F.array(rest), out)).otherwise(state(F.lit(0), none, out))

    def settled(s: Column) -> Column:
        """After a piece is in: the record is written if its description has ended."""
        found = F.when(s["at"] == last, end(F.element_at(s["values"], -1)))
        return F.when(found.isNotNull(), state(F.lit(0), none, F.concat(s["out"], made(s["values"], found)))).otherwise(s)

    def step(s: Column, piece: Column) -> Column:
        label = F.get(F.lit(names), s["at"])
        rest = F.substring(piece, F.length(label) + 1, F.length(piece))
        named = state(s["at"] + 1, F.concat(s["values"], F.array(rest)), s["out"])
        grown = state(s["at"], longer(s["values"], piece), s["out"])
        moved = F.when(s["at"] == 0, begun(piece, s["out"])).when(F.startswith(piece, label), named).otherwise(grown)
        if repeats:
            held = F.element_at(s["values"], -1)
            over = (s["at"] == last) & F.startswith(piece, F.lit(names[0])) & F.rlike(held, F.lit("(?Us)[^\\s\\x1c-\\x1f].*\n[\\s\\x1c-\\x1f]*\\z"))
            moved = F.when(over, begun(piece, F.concat(s["out"], made(s["values"], held)))).otherwise(moved)
        return settled(moved)

    def finish(s: Column) -> Column:
        if repeats:
            return s["out"]
        return F.when(s["at"] == last, F.concat(s["out"], made(s["values"], F.element_at(s["values"], -1)))).otherwise(s["out"])

    return F.aggregate(pieces, state(F.lit(0), none, empty), step, finish)


def entities(c: Column) -> Column:
    """``array<struct<name, etype, descr>>``; a record that nothing ends is lost."""
    return _records(c, ENTITY, _entity_end, True)


def relations(c: Column) -> Column:
    """``array<struct<src, dst, rel, descr>>``; the end of the text ends a record too."""
    return _records(c, RELATION, _relation_end, False)


def after(c: Column, label: str) -> Column:
    """What follows the first place of a label, or null."""
    at = F.instr(c, F.lit(label))
    return F.when(at > 0, F.substring(c, at + len(label), F.length(c)))


def map_output(c: Column) -> Column:
    """``struct<answer, score>``: the rest of the ANSWER line and the digits after SCORE, or the defaults.  A score is a
    decimal of 38 digits, the widest number there is; a longer one counts as the greatest of these."""
    line = strip(F.get(F.split(_left(after(c, "ANSWER:")), "\n", 2), F.lit(0)))
    digits = F.nullif(F.regexp_extract(c, f"SCORE:{WS}*([0-9]+)", 1), F.lit(""))
    score = F.when(F.length(digits) > DIGITS, F.lit("9" * DIGITS)).otherwise(digits).cast("decimal(38,0)")
    return F.struct(F.coalesce(line, F.lit("insufficient information")).alias("answer"), F.coalesce(score, F.lit(0).cast("decimal(38,0)")).alias("score"))


def final_output(c: Column) -> Column:
    """``struct<answer, summary>`` of a final response: marker cut, sentinel for missing parts; an answer needs both labels."""
    text = before_mark(without_assistant(strip(c)))
    weak = (text == "") | F.startswith(text, F.lit("Insufficient information"))
    answer = F.when(~weak, strip(F.get(F.split(F.when(after(after(text, "FINAL ANSWER:"), "SELECTED SUMMARY:").isNotNull(), after(text, "FINAL ANSWER:")), "SELECTED SUMMARY:", 2), F.lit(0))))
    summary = F.when(~weak, strip(after(text, "SELECTED SUMMARY:")))
    return F.struct(F.coalesce(answer, F.lit(NO_ANSWER)).alias("answer"), F.coalesce(summary, F.lit("")).alias("summary"))


def judgement(c: Column) -> Column:
    """The judge's 0 or 1, 0 where it gave none."""
    return F.when(F.regexp_extract(c, f"answer:{WS}*\\{{?([01])\\}}?", 1) == "1", F.lit(1)).otherwise(F.lit(0))


def question_entities(found: Column, question: Column) -> Column:
    """Names of parsed entities that stand in the question, of more than one character, each once whatever its case."""
    asked = F.lower(question)

    def step(names: Column, e: Column) -> Column:
        name = T.strip(e["name"])
        fresh = ~F.array_contains(F.transform(names, lambda n: F.lower(n)), F.lower(name))
        return F.when((F.length(name) > 1) & F.contains(asked, F.lower(name)) & fresh, F.concat(names, F.array(name))).otherwise(names)

    return F.aggregate(found, F.array().cast("array<string>"), step)
