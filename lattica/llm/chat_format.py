"""Chat formatting by a declared template, in DataFrame operations only.

A finite-state machine over the roles checks the order of the turns. The template
turns each turn into three segments: its opening mark with the role, its text, and
its closing mark; each segment has a loss flag. Control strings inside a text are
escaped by one backslash between ``<`` and ``|`` (one more if some stand there), which
is undone by taking one away. Roles are url-encoded.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: state -> role -> next state; a conversation may end in a state of ``final``
CHATML_ORDER = {
    "start": {"system": "system", "user": "user"},
    "system": {"user": "user"},
    "user": {"assistant": "assistant"},
    "assistant": {"user": "user", "tool": "tool"},
    "tool": {"assistant": "assistant"},
}


@dataclass(frozen=True)
class Template:
    opening: str = "<|im_start|>"
    after_role: str = "\n"
    closing: str = "<|im_end|>\n"
    loss_roles: tuple[str, ...] = ("assistant",)
    order: dict = field(default_factory=lambda: CHATML_ORDER)
    start: str = "start"
    final: tuple[str, ...] = ("assistant",)


CHATML = Template()


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def end_state(roles: Column, template: Template = CHATML) -> Column:
    """The state after a sequence of roles, null once a turn isn't allowed (rejecting for good)."""
    pairs = [F.lit(x) for state, steps in template.order.items() for role, after in steps.items() for x in (f"{state}\n{role}", after)]
    steps = F.create_map(*pairs)
    return F.aggregate(roles, F.lit(template.start), lambda state, role: F.try_element_at(steps, F.concat(state, F.lit("\n"), role)))


def _segments(turn: Column, template: Template) -> Column:
    def segment(text: Column, loss: Column) -> Column:
        return F.struct(text.alias("text"), loss.alias("loss"))

    no = F.lit(False)
    return F.array(
        segment(F.concat(F.lit(template.opening), F.url_encode(turn["role"]), F.lit(template.after_role)), no),
        segment(escape(turn["text"]), turn["role"].isin(*template.loss_roles)),
        segment(F.lit(template.closing), no),
    )


def format_conversations(conversations: DataFrame, template: Template = CHATML) -> DataFrame:
    """One row per conversation of ``conversations(conv_id, turn, role, text)``; other columns are not read.

    Returns conv_id, n_turns, valid (the machine accepts the order of roles) and segments,
    an array of ``(text, loss)``. Turns go by turn number, a null one first; turns of
    one number by role and text, repeated rows side by side. Null text and null role count
    as empty. Rows with a null conv_id are one conversation. Empty table: no rows.

    The turns of a conversation meet in one task, as they become one text; a
    conversation must fit there, however many there are.
    """
    turn = F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    whole = conversations.groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    state = end_state(F.transform("turns", lambda t: t["role"]), template)
    return whole.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.coalesce(state.isin(*template.final), F.lit(False)).alias("valid"),
        F.flatten(F.transform("turns", lambda t: _segments(t, template))).alias("segments"),
    )


def formatted_text(segments: Column) -> Column:
    return F.array_join(F.transform(segments, lambda s: s["text"]), "")


def loss_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")


def read_back(formatted: Column, template: Template = CHATML) -> Column:
    """The turns ``array<struct<role, text>>`` of a formatted text; what :func:`format_conversations` wrote."""
    quoted = "\\Q" + template.closing + "\\E"
    parts = F.split(formatted, quoted, -1)
    whole = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))

    def turn(part: Column) -> Column:
        at = F.locate(template.after_role, part)
        role = F.substr(part, F.lit(len(template.opening) + 1), at - len(template.opening) - 1)
        return F.struct(F.url_decode(role).alias("role"), unescape(F.substr(part, at + len(template.after_role))).alias("text"))

    return F.transform(whole, turn)
