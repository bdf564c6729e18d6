"""Chat formatting: a finite-state machine over roles and a declarative template."""

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """Marks of a turn, who is trained on, and which role may follow which state.

    `escapes` maps every control string, and the escape mark itself, to what stands for
    it inside texts. The mark comes first: it is escaped first and restored last, so
    restoring is exact. No replacement holds a control string.
    """

    turn: str = "<|turn|>"
    text: str = "<|text|>"
    end: str = "</s>"
    escapes: dict[str, str] = field(default_factory=lambda: {
        "&": "&amp;",
        "<|turn|>": "&lt;|turn|>",
        "<|text|>": "&lt;|text|>",
        "</s>": "&lt;/s>",
        "[INST]": "&#91;INST]",
        "[/INST]": "&#91;/INST]",
    })
    loss_roles: tuple[str, ...] = ("assistant",)
    start: str = "start"
    moves: dict[tuple[str, str], str] = field(default_factory=lambda: {
        ("start", "system"): "briefed",
        ("start", "user"): "asked",
        ("briefed", "user"): "asked",
        ("asked", "assistant"): "answered",
        ("answered", "user"): "asked",
    })
    accepting: tuple[str, ...] = ("answered",)


BROKEN = "broken"


def escape(c: Column, template: Template) -> Column:
    for raw, safe in template.escapes.items():
        c = F.replace(c, F.lit(raw), F.lit(safe))
    return c


def unescape(c: Column, template: Template) -> Column:
    for raw, safe in reversed(template.escapes.items()):
        c = F.replace(c, F.lit(safe), F.lit(raw))
    return c


def _state(roles: Column, template: Template) -> Column:
    """The machine's state after all roles; a move that the template lacks breaks it for good."""
    step = F.lit(BROKEN)
    def move(state: Column, role: Column) -> Column:
        out = step
        for (a, r), b in template.moves.items():
            out = F.when((state == a) & (role == r), b).otherwise(out)
        return out

    return F.aggregate(roles, F.lit(template.start), move)


def format_chat(rows: DataFrame, template: Template = Template()) -> DataFrame:
    """One row per conversation: conv_id, n_turns, state, valid, complete, segments, formatted.

    `segments` is a list of (text, loss): marks carry no loss, a text carries loss if its
    role is one of `loss_roles`. `formatted` is the segments' text in a row. `valid`: the
    machine never broke; `complete`: it also ended in an accepting state. Conversations
    that are not valid are formatted all the same; the caller may filter.

    Turns are ordered by (turn, role, text), nulls first, so ties and repeated rows have one
    order and every row counts. A null text or role is empty. Rows without conv_id form one
    conversation whose id is null. Other columns are ignored.

    Escaping runs on rows, before the shuffle. A conversation becomes one text, so its rows
    must meet; nothing else is gathered.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turns = rows.select(
        "conv_id",
        F.struct(
            F.col("turn").alias("turn"), role.alias("role"), text.alias("raw"),
            escape(role, template).alias("role_text"), escape(text, template).alias("text"),
        ).alias("t"),
    )
    each = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))

    def pieces(t: Column) -> Column:
        piece = lambda s, loss: F.struct(s.alias("text"), loss.alias("loss"))
        return F.array(
            piece(F.concat(F.lit(template.turn), t["role_text"], F.lit(template.text)), F.lit(False)),
            piece(t["text"], t["role"].isin(*template.loss_roles)),
            piece(F.lit(template.end), F.lit(False)),
        )

    return (
        each.select(
            "conv_id",
            F.size("turns").cast("bigint").alias("n_turns"),
            _state(F.transform("turns", lambda t: t["role"]), template).alias("state"),
            F.flatten(F.transform("turns", pieces)).alias("segments"),
        )
        .withColumn("valid", F.col("state") != BROKEN)
        .withColumn("complete", F.col("state").isin(*template.accepting))
        .withColumn("formatted", F.concat_ws("", F.transform("segments", lambda s: s["text"])))
    )


def read_turns(formatted: Column, template: Template = Template()) -> Column:
    """The turns (role, text) of a formatted conversation, read from its text alone."""
    parts = F.split(formatted, re.escape(template.turn))
    def turn(p: Column) -> Column:
        role = F.substring_index(p, template.text, 1)
        skip = F.length(role) + len(template.text)
        body = F.substr(p, skip + 1, F.length(p) - skip - len(template.end))
        return F.struct(unescape(role, template).alias("role"), unescape(body, template).alias("text"))

    return F.transform(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), turn)


def loss_text(segments: Column, template: Template = Template()) -> Column:
    """All text under the loss mask, as the author wrote it."""
    under = F.filter(segments, lambda s: s["loss"])
    return F.concat_ws("", F.transform(under, lambda s: unescape(s["text"], template)))
