"""Chat formatting: a finite-state machine over roles and text segments with loss flags from a declarative template.

Everything is DataFrame operations. A conversation becomes one row, as its formatted text must.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ESCAPE = "\\"


@dataclass(frozen=True)
class Template:
    """How turns are marked, which of them are learned, and which turn orders are valid.

    `turns`: role -> (opening, closing). `other`: opening, mark between role and text, closing for any other role.
    `transitions`: (state, role) -> state; a role without a transition is an error. `accepting`: states to end in.
    """

    turns: dict[str, tuple[str, str]]
    other: tuple[str, str, str]
    trained: tuple[str, ...] = ("assistant",)
    transitions: dict[tuple[str, str], str] = field(default_factory=dict)
    accepting: tuple[str, ...] = ("assistant",)

    def controls(self) -> list[str]:
        """The control strings, without the white space around them, that no text may hold unescaped."""
        marks = [m.strip() for pair in (*self.turns.values(), self.other) for m in pair]
        return sorted({m for m in marks if m}, key=lambda m: (-len(m), m))

    def pattern(self) -> str:
        """A regular expression whose matches are the turns; group 2k + 2 is the text of the k-th known role."""
        quote = lambda s: re.sub(r"([^\w\s])", r"\\\1", s)
        known = [f"({quote(a)}(.*?){quote(b)})" for a, b in self.turns.values()]
        a, b, c = map(quote, self.other)
        return "(?s)" + "|".join([*known, f"({a}(.*?){b}(.*?){c})"])


DEFAULT = Template(
    turns={"system": ("<<SYS>>\n", "\n<</SYS>>\n"), "user": ("[INST] ", " [/INST]"), "assistant": ("[OUT] ", " </s>")},
    other=("[ROLE] ", " [SAYS] ", " [/ROLE]"),
    transitions={("start", "system"): "system", ("start", "user"): "user", ("system", "user"): "user", ("user", "assistant"): "assistant", ("assistant", "user"): "user"},
)


def escaped(text: Column, template: Template) -> Column:
    """Backslashes are doubled, then one is put behind the first character of every control string."""
    out = F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE * 2))
    return reduce(lambda c, m: F.replace(c, F.lit(m), F.lit(m[0] + ESCAPE + m[1:])), template.controls(), out)


def unescaped(text: Column) -> Column:
    """Of two backslashes one stays, a single one goes."""
    return F.regexp_replace(text, r"\\(\\?)", "$1")


def state_after(roles: Column, template: Template) -> Column:
    """The machine's state after an array of roles; 'error' from the first turn out of order on."""
    table = F.create_map(*[F.lit(x) for (state, role), to in template.transitions.items() for x in (f"{state}>{role}", to)])
    step = lambda state, role: F.coalesce(F.element_at(table, F.concat(state, F.lit(">"), role)), F.lit("error"))
    return F.aggregate(roles, F.lit("start"), step)


def format_conversations(rows: DataFrame, template: Template = DEFAULT) -> DataFrame:
    """rows(conv_id, turn, role, text) -> conv_id, n_turns, state, valid, segments array<struct<text, loss>>, formatted.

    Rows are ordered by turn, then role and text (a tie or a repeated row is a turn of its own); null turns come
    first. Null text and null role are empty. Conversations whose turns are out of order are formatted too, with
    valid = false and state 'error' (or the state they stop in). A null conv_id is a conversation of its own.
    """
    said = rows.select("conv_id", F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    turns = said.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))

    def marks(t: Column) -> tuple[Column, Column]:
        a, b, c = template.other
        opening, closing = F.concat(F.lit(a), escaped(t["role"], template), F.lit(b)), F.lit(c)
        for role, (x, y) in template.turns.items():
            opening, closing = F.when(t["role"] == role, F.lit(x)).otherwise(opening), F.when(t["role"] == role, F.lit(y)).otherwise(closing)
        return opening, closing

    def segments(t: Column) -> Column:
        opening, closing = marks(t)
        part = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
        return F.array(part(opening, F.lit(False)), part(escaped(t["text"], template), t["role"].isin(*template.trained)), part(closing, F.lit(False)))

    out = turns.select("conv_id", F.size("turns").cast("long").alias("n_turns"), state_after(F.col("turns.role"), template).alias("state"), F.flatten(F.transform("turns", segments)).alias("segments"))
    return out.withColumn("valid", F.col("state").isin(*template.accepting)).withColumn("formatted", F.array_join("segments.text", ""))


def read_back(formatted: Column, template: Template = DEFAULT) -> Column:
    """The turns of a formatted text: array<struct<role, text>>, unescaped."""
    pattern = template.pattern()
    last = 2 * len(template.turns) + 2

    def turn(t: Column) -> Column:
        role, text = unescaped(F.regexp_extract(t, pattern, last)), F.regexp_extract(t, pattern, last + 1)
        for k, (name, (opening, _)) in enumerate(template.turns.items()):
            role, text = F.when(t.startswith(opening), F.lit(name)).otherwise(role), F.when(t.startswith(opening), F.regexp_extract(t, pattern, 2 * k + 2)).otherwise(text)
        return F.struct(role.alias("role"), unescaped(text).alias("text"))

    return F.transform(F.regexp_extract_all(formatted, F.lit(pattern), 0), turn)


def masked_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped, in order."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescaped(s["text"])), "")
