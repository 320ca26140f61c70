"""Chat formatting by a declarative template, DataFrame functions only.

A template names the marks around each turn and the roles whose text carries loss. Control strings begin with `<|`;
inside texts and roles they are escaped reversibly (& becomes &amp; and <| becomes &lt;|). A finite-state machine over
the roles says whether the turns of a conversation come in a valid order.

Defined cases: turns are ordered by turn, then role, then text; null texts and roles are empty; repeated rows are
turns of their own; a null conv_id is one conversation; an unknown role makes the order invalid but is still written.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    begin: str = "<|im_start|>"
    after_role: str = "\n"
    end: str = "<|im_end|>\n"
    loss_roles: tuple[str, ...] = ("assistant",)
    #: state -> role -> next state; a conversation is valid if it ends in an accepting state.
    moves: dict = field(default_factory=lambda: {"start": {"system": "ready", "user": "asked"}, "ready": {"user": "asked"}, "asked": {"assistant": "answered"}, "answered": {"user": "asked"}})
    accepting: tuple[str, ...] = ("answered",)


CHATML = Template()


def escape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<|"), F.lit("&lt;|"))


def unescape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("&lt;|"), F.lit("<|")), F.lit("&amp;"), F.lit("&"))


def escape_role(c: Column) -> Column:
    return F.replace(escape(c), F.lit("\n"), F.lit("&#10;"))


def unescape_role(c: Column) -> Column:
    return unescape(F.replace(c, F.lit("&#10;"), F.lit("\n")))


def final_state(turns: Column, template: Template) -> Column:
    """The machine's state after all roles; 'invalid' once a role has no move."""

    def step(state: Column, turn: Column) -> Column:
        out = F.lit("invalid")
        for name, moves in template.moves.items():
            for role, to in moves.items():
                out = F.when((state == name) & (turn["role"] == role), to).otherwise(out)
        return out

    return F.aggregate(turns, F.lit("start"), step)


def format_conversations(rows: DataFrame, template: Template = CHATML, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, segments, formatted, valid): segments are (text, loss) in order, formatted is their texts joined.

    A segment with loss is exactly one escaped text of a role under loss; marks and other texts have none."""
    none = F.lit("")
    turns = rows.select(F.col(conv_id).alias("conv_id"), F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role).cast("string"), none).alias("role"), F.coalesce(F.col(text).cast("string"), none).alias("text")).alias("t"))
    grouped = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))

    def segment(value: Column, loss: Column) -> Column:
        return F.struct(value.alias("text"), loss.alias("loss"))

    def emit(t: Column) -> Column:
        no = F.lit(False)
        head = F.concat(F.lit(template.begin), escape_role(t["role"]), F.lit(template.after_role))
        return F.array(segment(head, no), segment(escape(t["text"]), t["role"].isin(*template.loss_roles)), segment(F.lit(template.end), no))

    out = grouped.select("conv_id", F.flatten(F.transform("turns", emit)).alias("segments"), final_state(F.col("turns"), template).isin(*template.accepting).alias("valid"))
    return out.select("conv_id", "segments", F.concat_ws("", F.transform("segments", lambda s: s["text"])).alias("formatted"), "valid")


def read_turns(formatted: Column, template: Template = CHATML) -> Column:
    """The turns of a formatted conversation as array<(role, text)>, unescaped."""
    parts = F.split(formatted, f"\\Q{template.end}\\E", -1)
    parts = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    mark = template.after_role

    def one(p: Column) -> Column:
        body = F.substr(p, F.lit(len(template.begin) + 1))
        head = F.substring_index(body, mark, 1)
        return F.struct(unescape_role(head).alias("role"), unescape(F.substr(body, F.char_length(head) + len(mark) + 1)).alias("text"))

    return F.transform(parts, one)


def loss_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.concat_ws("", F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])))
