"""Chat formatting by a finite-state machine over roles and a declarative template, by SQL functions alone.

A template is data: what stands before and after each role's text, which roles count towards the loss, and which role may
follow which.  The machine walks a conversation's roles in the order of its turns, from ``start``; a step that the
template doesn't allow makes the conversation invalid, and it is formatted nevertheless, with its first wrong turn named.

Inside texts, the escape character is doubled and every control string gets one inside it, so that no control string is
left and the text can be told from the escaped one alone.  Reading a formatted conversation back splits it at the closing
mark, which no text can contain.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    open: str = "### {name}: "
    close: str = " </turn>"
    after: str = "\n"  # between turns; belongs to no turn
    escape: str = "\\"
    controls: tuple[str, ...] = ("</turn>", "### ")
    names: dict[str, str] = field(default_factory=lambda: {"system": "System", "user": "User", "assistant": "Assistant"})
    loss: tuple[str, ...] = ("assistant",)
    follows: dict[str, tuple[str, ...]] = field(default_factory=lambda: {"start": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)})


TEMPLATE = Template()


def _broken(control: str, escape: str) -> str:
    return control[0] + escape + control[1:]


def escaped(text: Column, t: Template = TEMPLATE) -> Column:
    out = F.replace(text, F.lit(t.escape), F.lit(t.escape * 2))
    return reduce(lambda c, s: F.replace(c, F.lit(s), F.lit(_broken(s, t.escape))), t.controls, out)


def unescaped(text: Column, t: Template = TEMPLATE) -> Column:
    out = reduce(lambda c, s: F.replace(c, F.lit(_broken(s, t.escape)), F.lit(s)), reversed(t.controls), text)
    return F.replace(out, F.lit(t.escape * 2), F.lit(t.escape))


def _opening(role: Column, t: Template) -> Column:
    """A role without a name in the template is written as it is, escaped, what follows a name being a control string too."""
    before, after = t.open.split("{name}")
    known = F.create_map(*[F.lit(x) for pair in t.names.items() for x in pair])
    other = F.concat(F.lit("="), escaped(role, replace(t, controls=(*t.controls, after))))
    return F.concat(F.lit(before), F.coalesce(F.try_element_at(known, role), other), F.lit(after))


def _role(name: Column, t: Template) -> Column:
    known = F.create_map(*[F.lit(x) for role, shown in t.names.items() for x in (shown, role)])
    other = unescaped(F.substring(name, 2, 1 << 30), replace(t, controls=(*t.controls, t.open.split("{name}")[1])))
    return F.coalesce(F.try_element_at(known, name), other)


def wrong_turn(roles: Column, t: Template = TEMPLATE) -> Column:
    """The machine: the number (from 0) of the first turn that may not stand where it stands, or null."""
    steps = F.lit([f"{a}>{b}" for a, bs in t.follows.items() for b in bs])
    begin = F.struct(F.lit("start").alias("state"), F.lit(0).alias("n"), F.lit(None).cast("int").alias("wrong"))

    def step(s: Column, role: Column) -> Column:
        bad = ~F.array_contains(steps, F.concat(s["state"], F.lit(">"), role))
        return F.struct(role.alias("state"), (s["n"] + 1).alias("n"), F.coalesce(s["wrong"], F.when(bad, s["n"])).alias("wrong"))

    return F.aggregate(roles, begin, step, lambda s: s["wrong"])


def format_conversations(rows: DataFrame, t: Template = TEMPLATE, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``(conv_id, formatted, segments, wrong_turn)``, a row per conversation.

    ``segments`` are the parts of ``formatted`` in order, each with its text as it stands there and its loss flag:
    opening, text and closing of every turn; only the texts of the template's loss roles carry the loss.

    A null role or text counts as empty, and an empty role is unknown to the machine.  Turns come in the order of turn
    (null first), then role, then text; repeated rows are turns of their own.  Rows with a null conversation form one
    conversation.  An empty table gives no rows; other columns are ignored.  A conversation is one row of the result, so
    it is also what a task holds at once.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    role = F.coalesce(F.col(role_col).cast("string"), F.lit(""))
    turns = F.sort_array(F.collect_list(F.struct(F.col(turn_col).cast("long").alias("turn"), role.alias("role"), text.alias("text"))))
    grouped = rows.groupBy(F.col(conv_col).cast("long").alias("conv_id")).agg(turns.alias("turns"))

    def parts(x: Column, i: Column) -> Column:
        last = F.when(i == F.size("turns") - 1, F.lit("")).otherwise(F.lit(t.after))
        text_part = F.struct(escaped(x["text"], t).alias("text"), x["role"].isin(list(t.loss)).alias("loss"))
        return F.array(
            F.struct(_opening(x["role"], t).alias("text"), F.lit(False).alias("loss")),
            text_part,
            F.struct(F.concat(F.lit(t.close), last).alias("text"), F.lit(False).alias("loss")),
        )

    made = grouped.withColumn("segments", F.flatten(F.transform("turns", parts)))
    return made.select(
        "conv_id",
        F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
        "segments",
        wrong_turn(F.transform("turns", lambda x: x["role"]), t).alias("wrong_turn"),
    )


def read_back(formatted: Column, t: Template = TEMPLATE) -> Column:
    """The turns ``array<struct<role, text, loss>>`` of a formatted conversation: role and text as they were, and whether
    the text is under the loss mask."""
    before, after = t.open.split("{name}")
    # An escaped text never holds the closing mark, so cutting at it is exact.
    pieces = F.split(F.concat(formatted, F.lit(t.after)), _literal(t.close + t.after))

    def turn(piece: Column) -> Column:
        at = F.instr(piece, F.lit(after))
        name = F.substring(piece, F.lit(len(before) + 1), at - len(before) - 1)
        role = _role(name, t)
        return F.struct(role.alias("role"), unescaped(F.substring(piece, at + len(after), F.lit(1 << 30)), t).alias("text"), role.isin(list(t.loss)).alias("loss"))

    return F.transform(F.slice(pieces, 1, F.size(pieces) - 1), turn)


def _literal(s: str) -> str:
    return "".join(f"\\x{{{ord(c):x}}}" for c in s)


def digests(made: DataFrame, t: Template = TEMPLATE) -> DataFrame:
    """What the formatted conversations hold when read back, as counts and digests."""
    back = made.withColumn("turns", read_back(F.col("formatted"), t))
    under_loss = F.transform(F.filter("turns", lambda x: x["loss"]), lambda x: x["text"])
    whole = F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n")))
    return back.withColumn("loss_text", F.array_join(under_loss, "")).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(whole, ""), 256).alias("turns_sha256"),
        F.char_length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
        F.col("wrong_turn").isNull().alias("valid"),
    )
