"""Chat formatting: a declarative template, a state machine over roles, and a loss flag per segment.

A conversation becomes segments: for each turn the mark that opens it, its text and the mark that closes it.
Only the texts of roles that are learned carry the loss flag. The state machine counts turns that may not
follow the one before. Control strings inside texts are broken by a backslash and backslashes are doubled, so
that marks are unambiguous and `read_turns` recovers roles and texts exactly.

Defined results: a null text counts as empty, a null role as an empty role name; rows with the same turn number
stand by role and text, rows without one come first; roles unknown to the template are written with their name
and count as errors of order; rows without a conversation id form one conversation; an empty table gives an
empty result. Other columns are not read. A conversation's turns meet in one row, as its text is one string.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_of


@dataclass(frozen=True)
class Mark:
    """How turns of a role are written; every role's closing mark holds a control string of its own."""

    opening: str
    closing: str
    loss: bool = False


@dataclass(frozen=True)
class Template:
    marks: Mapping[str, Mark]
    # Any other role: opening, name, middle, text, closing.
    other: tuple[str, str, str] = ("[ROLE]", "[TEXT]", "[/ROLE]")
    start: str = "start"
    # Which roles may follow a state; the state is the role last seen.
    follows: Mapping[str, tuple[str, ...]] = field(default_factory=dict)
    # May a conversation end after this role?
    final: tuple[str, ...] = ()


TEMPLATE = Template(
    marks={
        "system": Mark("<<SYS>>", "<</SYS>>\n"),
        "user": Mark("<s>[INST] ", " [/INST]"),
        "assistant": Mark(" ", " </s>", loss=True),
    },
    follows={
        "start": ("system", "user"),
        "system": ("user",),
        "user": ("assistant",),
        "assistant": ("user",),
    },
    final=("user", "assistant"),
)

# Control strings of all marks, as a first character and what must follow it.
_BROKEN = r"<(?=/?s>|</?SYS>>)|\[(?=/?INST\]|/?ROLE\]|TEXT\])"
_MENDED = r"(<)\\(?=/?s>|</?SYS>>)|(\[)\\(?=/?INST\]|/?ROLE\]|TEXT\])"
_CLOSING = r"(?s)(.*?)(<</SYS>>\n| \[/INST\]| </s>|\[/ROLE\])"


def escaped(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), _BROKEN, r"$0\\")


def unescaped(text: Column) -> Column:
    return F.replace(F.regexp_replace(text, _MENDED, "$1$2"), F.lit("\\\\"), F.lit("\\"))


def _by_role(role: Column, template: Template, of, other: Column) -> Column:
    cases = reduce(
        lambda c, item: c.when(role == item[0], of(item[1])), template.marks.items(), F.when(F.lit(False), other)
    )
    return cases.otherwise(other)


def segments(turn: Column, template: Template) -> Column:
    """Opening mark, text and closing mark of a turn, each struct(text, loss)."""
    role = turn["role"]
    opening = _by_role(
        role, template, lambda m: F.lit(m.opening),
        F.concat(F.lit(template.other[0]), escaped(role), F.lit(template.other[1])),
    )
    closing = _by_role(role, template, lambda m: F.lit(m.closing), F.lit(template.other[2]))
    loss = role.isin([r for r, m in template.marks.items() if m.loss])

    def segment(text: Column, flag: Column) -> Column:
        return F.struct(text.alias("text"), flag.alias("loss"))

    return F.array(
        segment(opening, F.lit(False)), segment(escaped(turn["text"]), loss), segment(closing, F.lit(False))
    )


def order_errors(roles: Column, template: Template) -> Column:
    """How often a turn may not follow the state before it, counting a last turn that may not end it."""

    def allowed(state: Column, role: Column) -> Column:
        return reduce(
            Column.__or__, ((state == s) & role.isin(*next_) for s, next_ in template.follows.items())
        )

    walked = F.aggregate(
        roles,
        F.struct(F.lit(template.start).alias("state"), F.lit(0).alias("errors")),
        lambda at, role: F.struct(
            role.alias("state"), (at["errors"] + F.when(allowed(at["state"], role), 0).otherwise(1)).alias("errors")
        ),
    )
    return walked["errors"] + F.when(walked["state"].isin(*template.final), 0).otherwise(1)


def format_chats(
    turns: DataFrame,
    template: Template = TEMPLATE,
    conv_column: str = "conv_id",
    turn_column: str = "turn",
    role_column: str = "role",
    text_column: str = "text",
) -> DataFrame:
    """One row per conversation: conv_id, segments array<struct<text, loss>>, errors, valid."""
    turn = F.struct(
        F.col(turn_column).alias("turn"), text_of(role_column).alias("role"), text_of(text_column).alias("text")
    )
    return (
        turns.groupBy(F.col(conv_column).alias("conv_id"))
        .agg(F.sort_array(F.collect_list(turn)).alias("_turns"))
        .select(
            "conv_id",
            F.flatten(F.transform("_turns", lambda t: segments(t, template))).alias("segments"),
            order_errors(F.transform("_turns", lambda t: t["role"]), template).alias("errors"),
        )
        .withColumn("valid", F.col("errors") == 0)
    )


def formatted(found: Column) -> Column:
    """The conversation as one string."""
    return F.array_join(F.transform(found, lambda s: s["text"]), "")


def loss_text(found: Column) -> Column:
    """All text under the loss mask, with its escapes undone."""
    return F.array_join(F.transform(F.filter(found, lambda s: s["loss"]), lambda s: unescaped(s["text"])), "")


def read_turns(text: Column, template: Template = TEMPLATE) -> Column:
    """array<struct<role, text>> of a formatted conversation."""
    parts = F.arrays_zip(
        F.regexp_extract_all(text, F.lit(_CLOSING), 1).alias("body"),
        F.regexp_extract_all(text, F.lit(_CLOSING), 2).alias("closing"),
    )

    def turn(part: Column) -> Column:
        body, closing = part["body"], part["closing"]
        named = F.split(body, r"\[TEXT\]", -1)
        role, own = unescaped(F.substring(named[0], len(template.other[0]) + 1, 2**31 - 1)), named[1]
        for name, mark in template.marks.items():
            here = closing == mark.closing
            role = F.when(here, F.lit(name)).otherwise(role)
            own = F.when(here, F.substring(body, len(mark.opening) + 1, 2**31 - 1)).otherwise(own)
        return F.struct(role.alias("role"), unescaped(own).alias("text"))

    return F.transform(parts, turn)
