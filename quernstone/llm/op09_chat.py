"""Chat formatting: a finite-state machine over roles and a declarative template.

A conversation's turns, in order, drive a table of allowed successions; the first role that breaks it
is reported. The template gives each role a heading, an end mark and whether its text is
learnt; out comes a list of text segments with a loss flag each. Control strings inside texts are
escaped so that they can be put back exactly. Everything is DataFrame expressions.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """headings: role -> heading; other roles get `other` with their name. learnt: roles whose texts are in the loss.

    follows: state -> roles allowed next (a state is the last role, "" at first); ends: roles that may come last.
    escapes: (control string, code), the escape character first; codes begin with it.
    """

    headings: dict[str, str] = field(default_factory=lambda: {"system": "### System: ", "user": "### User: ", "assistant": "### Assistant: "})
    other: tuple[str, str] = ("### (", "): ")
    end: str = "</turn>\n"
    learnt: tuple[str, ...] = ("assistant",)
    follows: dict[str, tuple[str, ...]] = field(default_factory=lambda: {"": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)})
    ends: tuple[str, ...] = ("user", "assistant")
    escapes: tuple[tuple[str, str], ...] = (("\\", "\\b"), ("###", "\\h"), ("</turn>", "\\t"), ("):", "\\c"))


CHAT = Template()


def escape(text: Column, template: Template = CHAT) -> Column:
    """No control string is left in the result: each becomes a code of the escape character and a letter."""
    for plain, code in template.escapes:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescape(text: Column, template: Template = CHAT) -> Column:
    for plain, code in reversed(template.escapes):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def first_fault(roles: Column, template: Template = CHAT) -> Column:
    """1-based number of the first turn that may not follow, the number of turns + 1 if it may not end there, else null."""
    allowed = [f"{state}>{role}" for state, follow in template.follows.items() for role in follow]
    start = F.struct(F.lit("").alias("state"), F.lit(0).alias("at"), F.lit(None).cast("int").alias("fault"))

    def step(seen: Column, role: Column) -> Column:
        at = seen["at"] + 1
        ok = F.concat(seen["state"], F.lit(">"), role).isin(allowed)
        return F.struct(role.alias("state"), at.alias("at"), F.coalesce(seen["fault"], F.when(~ok, at)).alias("fault"))

    return F.aggregate(roles, start, step, lambda seen: F.coalesce(seen["fault"], F.when(~seen["state"].isin(*template.ends), seen["at"] + 1)))


def segments_of(turns: Column, template: Template = CHAT) -> Column:
    """Segments (text, loss) of an array of turns (role, text): heading, text and end of each turn."""

    def parts(turn: Column) -> Column:
        heading = F.concat(F.lit(template.other[0]), escape(turn["role"], template), F.lit(template.other[1]))
        for role, known in template.headings.items():
            heading = F.when(turn["role"] == role, F.lit(known)).otherwise(heading)
        piece = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
        no = F.lit(False)
        return F.array(piece(heading, no), piece(escape(turn["text"], template), turn["role"].isin(*template.learnt)), piece(F.lit(template.end), no))

    return F.flatten(F.transform(turns, parts))


def chat_format(conversations: DataFrame, template: Template = CHAT, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """key, n_turns, fault (see first_fault), segments for each conversation.

    Turns are in order of number, then role and text (ties and repeated rows stay, nulls come last). Null text and
    role are empty; rows with a null key are one conversation. A faulty conversation is formatted like others. No rows give no rows.
    """
    one = F.struct(F.col(turn).isNull().alias("none"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    whole = conversations.groupBy(F.col(key)).agg(F.array_sort(F.collect_list(one)).alias("turns"))
    return whole.select(key, F.size("turns").cast("long").alias("n_turns"), first_fault(F.transform("turns", lambda t: t["role"]), template).alias("fault"), segments_of(F.col("turns"), template).alias("segments"))


def formatted(segments: Column) -> Column:
    return F.array_join(F.transform(segments, lambda s: s["text"]), "")


def read_back(text: Column, template: Template = CHAT) -> Column:
    """The turns (role, text) of a formatted conversation, control strings put back."""
    pieces = F.filter(F.split(text, _quoted(template.end)), lambda x: x != "")

    def turn(piece: Column) -> Column:
        before, after = template.other
        named = F.struct(
            unescape(F.substring_index(F.substr(piece, F.lit(len(before) + 1)), after, 1), template).alias("role"),
            unescape(F.substr(piece, F.instr(piece, after) + len(after)), template).alias("text"),
        )
        for role, heading in template.headings.items():
            named = F.when(F.startswith(piece, F.lit(heading)), F.struct(F.lit(role).alias("role"), unescape(F.substr(piece, F.lit(len(heading) + 1)), template).alias("text"))).otherwise(named)
        return named

    return F.transform(pieces, turn)


def _quoted(plain: str) -> str:
    """A Java regular expression that matches just this text."""
    return r"\Q" + plain + r"\E"
