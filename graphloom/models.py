"""What stands for models: a provider of text, vectors and token counts, with the prompts and parsers around it.

``generate`` is a function from a prompt column to a response column; a real one is an iterator pandas UDF, whose weights
are then loaded once per worker:

    @F.pandas_udf("string")
    def model(prompts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        weights = load()
        for p in prompts:
            yield p.map(weights.complete)

    provider = Provider(model)

Every plan takes a provider.  ``Offline`` needs no model: it answers by rules over whole texts, in the same grammars.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from graphloom.functions import parse
from graphloom.functions import text as T
from graphloom.functions.vectors import embed

TextModel = Callable[[Column], Column]
Embedder = Callable[[Column], Column]
TokenCounter = Callable[[Column], Column]
Parser = Callable[[Column], Column]

NAMES = "(?:^|[^\\p{L}])(\\p{Lu}\\p{L}{2,})"


@dataclass(frozen=True)
class Prompts:
    """Templates; a field stands in braces."""

    entities: str = (
        "List the entities that the text names. For each print three lines that begin with entity_name:, entity_type: and "
        "entity_description:, and after the last one a line with a full stop.\n\nTEXT:\n{text}"
    )
    relations: str = (
        "List the relations that the text states between the entities given. For each print four lines that begin with "
        "source_entity:, target_entity:, relation: and relationship_description:, and after the last one a line with a full "
        "stop. Without any, print NONE.\n\nENTITIES:\n{entities}\n\nTEXT:\n{text}"
    )
    community: str = "Summarise what these elements of one community say together.\n\nTEXT:\n{text}"
    evidence: str = "Summarise what this evidence says that helps to answer the question.\n\nQUESTION:\n{question}\n\nTEXT:\n{text}"
    map: str = (
        "Answer the question from the summary alone. Print a line that begins with ANSWER: and one that begins with SCORE:, "
        "from 0 to 100, for how much the summary helps.\n\nQUESTION:\n{question}\n\nTEXT:\n{text}"
    )
    final: str = (
        "Choose the best of the answers to the question. Print FINAL ANSWER: and the answer, then SELECTED SUMMARY: and the "
        "summary it rests on.\n\nQUESTION:\n{question}\n\nTEXT:\n{text}"
    )
    local: str = "Answer the question from the summary alone, in a few words.\n\nQUESTION:\n{question}\n\nTEXT:\n{text}"
    synthesis: str = (
        "Give one answer to the question from these two.\n\nQUESTION:\n{question}\n\nCOMMUNITY ANSWER:\n{community_answer}\n\n"
        "COMMUNITY SUMMARY:\n{community_summary}\n\nGRAPH ANSWER:\n{graph_answer}\n\nGRAPH SUMMARY:\n{graph_summary}"
    )
    judge: str = "Does the answer say what the expected one says? Print answer: 1 or answer: 0.\n\nQUESTION:\n{question}\n\nEXPECTED:\n{gold}\n\nTEXT:\n{answer}"


def fill(template: str, **fields: Column) -> Column:
    """The template with every field's text in its place, whatever braces those texts hold."""
    parts, rest = [], template
    while rest:
        at = min((rest.find("{" + f + "}") for f in fields if "{" + f + "}" in rest), default=-1)
        if at < 0:
            parts.append(F.lit(rest))
            break
        name = next(f for f in fields if rest.startswith("{" + f + "}", at))
        parts += [F.lit(rest[:at]), F.coalesce(fields[name], F.lit(""))]
        rest = rest[at + len(name) + 2 :]
    return F.concat(*parts)


def entity_blocks(found: Column) -> Column:
    """Entities as text for the prompt that asks for relations: three labelled lines each, a blank line between."""
    return F.array_join(F.transform(found, lambda e: F.concat(F.lit("entity_name: "), e["name"], F.lit("\nentity_type: "), e["etype"], F.lit("\nentity_description: "), e["descr"], F.lit("\n"))), "\n")


def intermediate(context: Column) -> Column:
    """``array<struct<cluster_id, answer, summary>>`` as text: the answers to choose from, a blank line between."""
    return F.array_join(F.transform(context, lambda c: F.concat(F.lit("COMMUNITY_ID:"), c["cluster_id"].cast("string"), F.lit("\nANSWER:"), c["answer"], F.lit("\nSUMMARY:"), c["summary"])), "\n\n")


class Provider:
    """A text model with its prompts and parsers, an embedder and a token counter.

    A provider whose relations are every two of a window's entities says that it ``joins_all``: then links are known without
    asking for relations.  ``attempts`` and ``question_attempts`` say how often a model is asked again that named no entity of a window or of a
    question (see ``plans``); what a ``costly`` provider said is kept rather than asked for twice."""

    attempts, question_attempts, costly, joins_all = 2, 5, True, False

    def __init__(self, generate: TextModel, embed: Embedder = embed, count_tokens: TokenCounter = T.count_tokens, prompts: Prompts = Prompts(), parse_entities: Parser = parse.entities, parse_relations: Parser = parse.relations):
        self.generate, self.embed, self.count_tokens, self.prompts = generate, embed, count_tokens, prompts
        self.parse_entities, self.parse_relations = parse_entities, parse_relations

    def entity_response(self, text: Column) -> Column:
        return self.generate(fill(self.prompts.entities, text=text))

    def relation_response(self, text: Column, found: Column) -> Column:
        return self.generate(fill(self.prompts.relations, text=text, entities=entity_blocks(found)))

    def entities(self, text: Column) -> Column:
        """``array<struct<name, etype, descr>>``"""
        return self.parse_entities(self.entity_response(text))

    def relations(self, text: Column, found: Column) -> Column:
        """``array<struct<src, dst, rel, descr>>`` between the entities found, of which there are two or more."""
        return self.parse_relations(self.relation_response(text, found))

    def names(self, text: Column) -> Column:
        """``array<struct<name, etype>>``: the entities without their descriptions."""
        return F.transform(self.entities(text), lambda e: F.struct(e["name"].alias("name"), e["etype"].alias("etype")))

    def question_entities(self, question: Column) -> Column:
        return parse.question_entities(self.entities(question), question)

    def summarise(self, text: Column) -> Column:
        return self.generate(fill(self.prompts.community, text=text))

    def summarise_evidence(self, text: Column, question: Column) -> Column:
        return self.generate(fill(self.prompts.evidence, text=text, question=question))

    def map_response(self, question: Column, summary: Column) -> Column:
        return self.generate(fill(self.prompts.map, question=question, text=summary))

    def final_response(self, question: Column, context: Column) -> Column:
        """``context``: array<struct<cluster_id, answer, summary>>, the best first."""
        return self.generate(fill(self.prompts.final, question=question, text=intermediate(context)))

    def local_response(self, question: Column, summary: Column) -> Column:
        return self.generate(fill(self.prompts.local, question=question, text=summary))

    def synthesis_response(self, question: Column, community: tuple[Column, Column], graph: tuple[Column, Column]) -> Column:
        return self.generate(fill(self.prompts.synthesis, question=question, community_answer=community[0], community_summary=community[1], graph_answer=graph[0], graph_summary=graph[1]))

    def judge_response(self, question: Column, gold: Column, answer: Column) -> Column:
        return self.generate(fill(self.prompts.judge, question=question, gold=gold, answer=answer))


@F.pandas_udf(StringType())
def central_sentences(texts: pd.Series) -> pd.Series:
    """The sentences of a whole text whose words it says most often, in their order, up to 40 words; words of a sentence
    beyond that are left out."""

    def of(text: str | None) -> str:
        sentences = [s.split() for s in (text or "").replace("! ", "!\n").replace("? ", "?\n").replace(". ", ".\n").split("\n")]
        sentences = [s for s in dict.fromkeys(map(tuple, sentences)) if s]
        often: dict[str, int] = {}
        for s in sentences:
            for w in s:
                often[w.lower()] = often.get(w.lower(), 0) + 1
        order = sorted(range(len(sentences)), key=lambda i: (-sum(often[w.lower()] for w in sentences[i]) / len(sentences[i]), i))
        chosen, room = {}, 40
        for i in order:
            if not chosen or len(sentences[i]) <= room:
                chosen[i] = sentences[i][:room]
                room -= len(chosen[i])
        return " ".join(" ".join(chosen[i]) for i in sorted(chosen))

    return texts.map(of)


def covered(query: Column, text: Column) -> Column:
    """The percentage of a query's distinct words that a text has."""
    q = F.array_distinct(T.tokens(F.lower(query)))
    shared = F.size(F.array_intersect(q, T.tokens(F.lower(text))))
    return F.when(F.size(q) > 0, F.floor(100 * shared / F.size(q))).otherwise(F.lit(0)).cast("long")


def best_sentence(query: Column, text: Column) -> Column:
    """The sentence of a whole text that has most of a query's distinct words, the first of several, on one line."""
    q = F.array_distinct(T.tokens(F.lower(query)))
    each = F.transform(T.sentences(text), lambda s, i: F.struct(F.size(F.array_intersect(q, T.tokens(F.lower(s)))).alias("n"), (-i).alias("i"), F.array_join(T.tokens(s), " ").alias("s")))
    return F.coalesce(F.array_max(each)["s"], F.lit(""))


def _with_line(text: Column, names: Column, make: Callable[[Column, Column], Column]) -> Column:
    """``make`` of the names and of the text on one line, each computed once for all names, and the line only with names."""
    line = lambda names: F.when(F.size(names) > 0, F.array_join(T.tokens(text), " "))
    return F.get(F.transform(F.array(names), lambda n: F.get(F.transform(F.array(line(n)), lambda descr: make(n, descr)), F.lit(0))), F.lit(0))


class Offline(Provider):
    """Rules in the place of a model, over whole texts, in the grammars that models are asked for.

    Entities are the capitalised words of a window, described by the window's text on one line; relations join every two of
    them.  ``entities`` and ``relations`` give what the parsers make of the responses, without printing and parsing them.
    """

    attempts, question_attempts, costly, joins_all = 1, 1, False, True

    def __init__(self, embed: Embedder = embed, count_tokens: TokenCounter = T.count_tokens):
        super().__init__(lambda prompt: prompt, embed, count_tokens)

    def names(self, text: Column) -> Column:
        names = F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(NAMES), F.lit(1)), lambda x: F.lower(x))))
        return F.transform(names, lambda n: F.struct(n.alias("name"), F.when(F.length(n) <= 5, F.lit("SHORT")).otherwise(F.lit("LONG")).alias("etype")))

    def entities(self, text: Column) -> Column:
        return _with_line(text, self.names(text), lambda names, descr: F.transform(names, lambda e: F.struct(e["name"].alias("name"), e["etype"].alias("etype"), descr.alias("descr"))))

    def relations(self, text: Column, found: Column) -> Column:
        def pair(a: Column, b: Column, descr: Column) -> Column:
            rel = F.concat(F.lit("co_"), F.substring(a["name"], 1, 1), F.substring(b["name"], 1, 1))
            return F.struct(a["name"].alias("src"), b["name"].alias("dst"), rel.alias("rel"), descr.alias("descr"))

        return _with_line(text, found, lambda found, descr: F.flatten(F.transform(found, lambda a, i: F.transform(F.slice(found, i + 2, F.size(found)), lambda b: pair(a, b, descr)))))

    def entity_response(self, text: Column) -> Column:
        block = F.transform(self.entities(text), lambda e: F.concat(F.lit("entity_name: "), e["name"], F.lit("\nentity_type: "), e["etype"], F.lit("\nentity_description: "), e["descr"]))
        return F.concat(F.lit("ENTITIES:\n"), F.array_join(block, "\n"), F.lit("\n."))

    def relation_response(self, text: Column, found: Column) -> Column:
        block = F.transform(self.relations(text, found), lambda r: F.concat(F.lit("source_entity: "), r["src"], F.lit("\ntarget_entity: "), r["dst"], F.lit("\nrelation: "), r["rel"], F.lit("\nrelationship_description: "), r["descr"]))
        return F.when(F.size(block) > 0, F.concat(F.array_join(block, "\n"), F.lit("\n."))).otherwise(F.lit("NONE"))

    def question_entities(self, question: Column) -> Column:
        names = F.array_distinct(F.transform(F.regexp_extract_all(question, F.lit(NAMES), F.lit(1)), lambda x: F.lower(x)))
        return F.filter(names, lambda n: F.length(n) > 1)

    def summarise(self, text: Column) -> Column:
        return central_sentences(text)

    def summarise_evidence(self, text: Column, question: Column) -> Column:
        return central_sentences(text)

    def map_response(self, question: Column, summary: Column) -> Column:
        return F.concat(F.lit("ANSWER: "), best_sentence(question, summary), F.lit("\nSCORE: "), covered(question, summary).cast("string"))

    def final_response(self, question: Column, context: Column) -> Column:
        best = F.get(context, F.lit(0))
        return F.when(F.size(context) > 0, F.concat(F.lit("FINAL ANSWER: "), best["answer"], F.lit("\nSELECTED SUMMARY: "), best["summary"])).otherwise(F.lit(""))

    def local_response(self, question: Column, summary: Column) -> Column:
        return best_sentence(question, summary)

    def synthesis_response(self, question: Column, community: tuple[Column, Column], graph: tuple[Column, Column]) -> Column:
        weak = graph[0].isNull() | F.startswith(graph[0], F.lit("Insufficient information"))
        return F.coalesce(F.when(weak, community[0]).otherwise(graph[0]), F.lit(""))

    def judge_response(self, question: Column, gold: Column, answer: Column) -> Column:
        return F.concat(F.lit("answer: "), F.contains(T.normalized_answer(answer), T.normalized_answer(gold)).cast("int").cast("string"))


OFFLINE = Offline()


def extraction_response(names: Column, descr: Column) -> Column:
    """Entities of a window in the labelled-block grammar."""
    block = F.transform(names, lambda n: F.concat(F.lit("entity_name: "), n, F.lit("\nentity_type: term\nentity_description: "), descr))
    return F.concat(F.lit("ENTITIES:\n"), F.array_join(block, "\n"), F.lit("\n."))


def relation_response(names: Column, descr: Column) -> Column:
    """Relations of neighbouring names of a window in the labelled-block grammar; NONE for fewer than two."""
    pairs = F.transform(F.slice(names, 2, F.greatest(F.size(names), F.lit(1))), lambda n, i: F.concat(F.lit("source_entity: "), F.get(names, i), F.lit("\ntarget_entity: "), n, F.lit("\nrelation: next_to\nrelationship_description: "), descr))
    return F.when(F.size(names) > 1, F.concat(F.array_join(pairs, "\n"), F.lit("\n."))).otherwise(F.lit("NONE"))
