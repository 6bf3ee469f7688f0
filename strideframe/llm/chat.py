"""Chat formatting: a finite-state machine over roles, and a declarative template with a loss flag per text segment.

DataFrame functions only.  One row per conversation: its turns are gathered and sorted inside the row.  A conversation is
as long as the string it is formatted to, so a row is as large as one result value and no larger.

Defined results: a null text or role counts as empty; a null turn number sorts first; ties of the turn number are ordered
by role and text; repeated rows are repeated turns; rows whose conversation id is null form one conversation; extra columns
are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ESCAPE = "\\"


@dataclass(frozen=True)
class Template:
    """``open role sep text close`` per turn.

    ``loss`` names the roles whose text is trained on.  ``control`` strings never occur in an escaped text: a backslash is
    put behind their first character, and every backslash of the text is doubled.  ``moves`` is the state machine: from
    state to role to next state; ``final`` are the states in which a conversation may end.
    """

    open: str = "<|im_start|>"
    sep: str = "<|im_sep|>"
    close: str = "<|im_end|>"
    loss: tuple[str, ...] = ("assistant",)
    reserved: tuple[str, ...] = ("<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]")
    start: str = "start"
    moves: dict[str, dict[str, str]] = field(default_factory=lambda: {
        "start": {"system": "system", "user": "user"}, "system": {"user": "user"},
        "user": {"assistant": "assistant"}, "assistant": {"user": "user"}})
    final: tuple[str, ...] = ("assistant",)

    @property
    def control(self) -> tuple[str, ...]:
        return (self.open, self.sep, self.close, *self.reserved)

    def check(self) -> None:
        marks = (self.open, self.sep, self.close)
        if len(set(marks)) < 3 or any(len(x) < 2 or ESCAPE in x or x[0] in x[1:] for x in self.control):
            raise ValueError("control strings need two characters, a first one that doesn't come again, and no backslash")


def escaped(text: Column, template: Template) -> Column:
    """Reversible: no control string is left in the result."""
    heads = "|".join(f"{re.escape(x[0])}(?={re.escape(x[1:])})" for x in template.control)
    return F.regexp_replace(text, rf"\\|{heads}", r"$0\\")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(\\?)", "$1")


def format_chats(turns: DataFrame, template: Template = Template(), conv: str = "conv_id", turn: str = "turn",
                 role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation: ``conv, segments array<struct<text, loss>>, formatted, valid, first_bad``.

    ``formatted`` is the concatenation of the segments.  ``valid`` says whether the state machine accepts the order of
    roles, ``first_bad`` is the index of the first turn it refuses (the number of turns when the end is refused).
    """
    template.check()
    one = F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"),
                   F.coalesce(F.col(text), F.lit("")).alias("text"))
    chats = turns.groupBy(F.col(conv).alias(conv)).agg(F.array_sort(F.collect_list(one)).alias("_turns"))

    def segments(t: Column) -> Column:
        plain = lambda c: F.struct(c.alias("text"), F.lit(False).alias("loss"))
        return F.array(plain(F.lit(template.open)), plain(escaped(t["role"], template)), plain(F.lit(template.sep)),
                       F.struct(escaped(t["text"], template).alias("text"), t["role"].isin(*template.loss).alias("loss")),
                       plain(F.lit(template.close)))

    names = sorted({template.start, *template.moves, *(s for m in template.moves.values() for s in m.values())})
    table = F.create_map(*[F.lit(x) for s in names for r, to in template.moves.get(s, {}).items() for x in (f"{s}\x00{r}", to)])
    begin = F.struct(F.lit(template.start).alias("state"), F.lit(0).alias("n"), F.lit(None).cast("int").alias("bad"))

    def move(acc: Column, t: Column) -> Column:
        to = table[F.concat(acc["state"], F.lit("\x00"), t["role"])]
        refused = acc["bad"].isNull() & to.isNull()
        return F.struct(F.coalesce(to, acc["state"]).alias("state"), (acc["n"] + 1).alias("n"),
                        F.when(refused, acc["n"]).otherwise(acc["bad"]).alias("bad"))

    run = F.aggregate("_turns", begin, move)
    chats = chats.select(conv, F.flatten(F.transform("_turns", segments)).alias("segments"), run.alias("_run"))
    bad = F.when(F.col("_run.bad").isNotNull(), F.col("_run.bad")).when(~F.col("_run.state").isin(*template.final), F.col("_run.n"))
    return chats.select(conv, "segments", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
                        bad.isNull().alias("valid"), bad.alias("first_bad"))


def parsed(formatted: Column, template: Template = Template()) -> Column:
    """Turns read back from a formatted string: array<struct<role, text>>."""
    chunks = F.filter(F.split(formatted, re.escape(template.open)), lambda c: c != "")

    def one(chunk: Column) -> Column:
        halves = F.split(F.substring(chunk, F.lit(1), F.length(chunk) - len(template.close)), re.escape(template.sep), 2)
        return F.struct(unescaped(halves[0]).alias("role"), unescaped(halves[1]).alias("text"))

    return F.transform(chunks, one)


def loss_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped, with nothing between."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescaped(s["text"])), "")
