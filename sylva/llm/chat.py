"""Chat formatting (operator 4): a role automaton and a declarative template, all in DataFrame functions.

A conversation's rows are ordered by turn (then role, then text, so that repeated turns have one
order; null turns come first). An automaton over roles tells whether the order of turns is one the
template allows. Every turn becomes three segments: header, text and end mark. Only the texts of
roles that the template trains carry the loss flag.

Defined results: null text and null role count as empty; an empty table gives no rows; repeated rows are turns of their own; rows with a
null conv_id form one conversation; a conversation, however long its texts, is one row of at most 2 GB, which is the only bound of a group; conversations the automaton refuses are still formatted, with
valid = false; other columns of the input, whatever their names, are not read.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ChatTemplate:
    """open + label + sep + text + close for each turn.

    Texts hold neither open nor close nor a bare escape mark once escaped: each control string
    has a two-character code that begins with the escape mark.
    """

    open: str = "### "
    sep: str = ": "
    close: str = "</turn>\n"
    escape: str = "\\"
    labels: dict = field(default_factory=lambda: {"system": "System", "user": "User", "assistant": "Assistant", "tool": "Tool"})
    trained: tuple = ("assistant",)
    #: state -> role -> state; "start" is the first state, a missing entry refuses.
    moves: dict = field(
        default_factory=lambda: {
            "start": {"system": "system", "user": "user"},
            "system": {"user": "user"},
            "user": {"assistant": "assistant"},
            "assistant": {"user": "user", "tool": "tool"},
            "tool": {"assistant": "assistant", "tool": "tool"},
        }
    )
    #: States in which a conversation may end.
    final: tuple = ("user", "assistant")

    def codes(self) -> list[tuple[str, str]]:
        """Control strings and their codes, the escape mark first."""
        return [(self.escape, self.escape + "s"), (self.open.strip(), self.escape + "h"), (self.close.strip(), self.escape + "e")]


def _chain(c: Column, pairs: list[tuple[str, str]]) -> Column:
    for old, new in pairs:
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def escape(c: Column, t: ChatTemplate) -> Column:
    return _chain(c, t.codes())


def unescape(c: Column, t: ChatTemplate) -> Column:
    return _chain(c, [(code, text) for text, code in reversed(t.codes())])


def _label(role: Column, t: ChatTemplate) -> Column:
    """A declared role's label; any other role is written as @ and the escaped role, its colons coded."""
    known = F.create_map(*[F.lit(x) for kv in t.labels.items() for x in kv])
    other = F.concat(F.lit("@"), F.replace(escape(role, t), F.lit(":"), F.lit(t.escape + "c")))
    return F.coalesce(F.element_at(known, role), other)


def _role(label: Column, t: ChatTemplate) -> Column:
    known = F.create_map(*[F.lit(x) for r, name in t.labels.items() for x in (name, r)])
    other = unescape(F.replace(F.substring(label, 2, 1 << 30), F.lit(t.escape + "c"), F.lit(":")), t)
    return F.coalesce(F.element_at(known, label), other)


def format_conversations(rows: DataFrame, template: ChatTemplate | None = None) -> DataFrame:
    """One row per conversation: conv_id, valid, end_state, segments (text, loss) and formatted text."""
    t = template or ChatTemplate()
    turns = rows.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")))).alias("turns")
    )
    moves = F.create_map(*[F.lit(x) for s, to in t.moves.items() for role, end in to.items() for x in (f"{s}|{role}", end)])
    state = F.aggregate("turns", F.lit("start"), lambda s, x: F.coalesce(F.element_at(moves, F.concat(s, F.lit("|"), x.role)), F.lit("refused")))
    segments = F.flatten(
        F.transform(
            "turns",
            lambda x: F.array(
                F.struct(F.concat(F.lit(t.open), _label(x.role, t), F.lit(t.sep)).alias("text"), F.lit(False).alias("loss")),
                F.struct(escape(x.text, t).alias("text"), x.role.isin(*t.trained).alias("loss")),
                F.struct(F.lit(t.close).alias("text"), F.lit(False).alias("loss")),
            ),
        )
    )
    return (
        turns.select("conv_id", state.alias("end_state"), segments.alias("segments"))
        .withColumn("valid", F.col("end_state").isin(*t.final))
        .withColumn("formatted", F.array_join(F.transform("segments", lambda s: s.text), ""))
    )


def parse_formatted(formatted: Column, template: ChatTemplate | None = None) -> Column:
    """array<struct<role, text>> read back from a formatted text."""
    t = template or ChatTemplate()
    quoted = "".join(f"\\x{ord(c):02x}" for c in t.close)
    pieces = F.slice(F.split(formatted, quoted, -1), 1, F.greatest(F.size(F.split(formatted, quoted, -1)) - 1, F.lit(0)))

    def turn(piece: Column) -> Column:
        body = F.substring(piece, len(t.open) + 1, 1 << 30)
        at = F.instr(body, t.sep)
        return F.struct(_role(F.substring(body, F.lit(1), at - 1), t).alias("role"), unescape(F.substring(body, at + len(t.sep), F.lit(1 << 30)), t).alias("text"))

    return F.transform(pieces, turn)


def masked_text(segments: Column, template: ChatTemplate | None = None) -> Column:
    """All text under the loss mask, unescaped."""
    t = template or ChatTemplate()
    return F.array_join(F.transform(F.filter(segments, lambda s: s.loss), lambda s: unescape(s.text, t)), "")
