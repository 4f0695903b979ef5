"""Chat formatting: a finite-state machine over roles emits text segments with loss flags. Native expressions only.

A Template declares how each role opens and closes, which roles bear loss, and which turn may follow which. Every
control string of a template starts with "<" or "[". Inside texts "~", "<" and "[" become "~0", "~1" and "~2", so no
text can hold a control string, and the escape is undone exactly (in the reverse order, as JSON pointers do).

Defined results: turns are ordered by (turn, role, text), nulls first; null text and null role are empty; repeated
rows are turns of their own; a role that the template does not name gets the generic markers and no loss; an order of
roles that the machine refuses is formatted all the same and has valid = false; rows of a null conv_id form one
conversation; an empty table gives an empty result. A conversation is one row here, because its digests are: its turns
must fit a task.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    opens: dict[str, str] = field(default_factory=lambda: {"system": "<<SYS>>", "user": "[INST]", "assistant": "[/INST]"})
    other: tuple[str, str] = ("<|", "|>")
    close: str = "</s>"
    loss: frozenset[str] = frozenset({"assistant"})
    #: state -> role -> next state; a conversation is valid if it ends in one of accept.
    moves: dict[str, dict[str, str]] = field(default_factory=lambda: {"start": {"system": "primed", "user": "asked"}, "primed": {"user": "asked"}, "asked": {"assistant": "answered"}, "answered": {"user": "asked"}})
    accept: frozenset[str] = frozenset({"answered"})
    #: Whether a turn after (or at) a refused move still bears loss.
    loss_when_refused: bool = True


LLAMA_LIKE = Template()


def escape(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("~"), F.lit("~0")), F.lit("<"), F.lit("~1")), F.lit("["), F.lit("~2"))


def unescape(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("~2"), F.lit("[")), F.lit("~1"), F.lit("<")), F.lit("~0"), F.lit("~"))


def _opening(role: Column, t: Template) -> Column:
    generic = F.concat(F.lit(t.other[0]), F.replace(escape(role), F.lit("|"), F.lit("~3")), F.lit(t.other[1]))
    out = None
    for name, mark in t.opens.items():
        out = F.when(role == name, mark) if out is None else out.when(role == name, mark)
    return generic if out is None else out.otherwise(generic)


def _step(s: Column, r: Column, t: Template) -> Column:
    out = None
    for state, by in t.moves.items():
        for role, to in by.items():
            hit = (s == state) & (r == role)
            out = F.when(hit, to) if out is None else out.when(hit, to)
    return (F.when(F.lit(False), "") if out is None else out).otherwise("refused")


def format_conversations(rows: DataFrame, template: Template = LLAMA_LIKE, conv_col: str = "conv_id") -> DataFrame:
    """One row a conversation: formatted, segments (text, loss), turn_loss, state, valid.

    The machine reads roles and emits a loss flag a turn (turn_loss). segments cover formatted without gaps; loss is
    true for the text (with its closing mark excluded) of a turn that bears loss.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turns = rows.select(F.col(conv_col), F.struct(F.col("turn"), role.alias("role"), text.alias("text")).alias("t"))
    grouped = turns.groupBy(conv_col).agg(F.array_sort(F.collect_list("t")).alias("_turns"))

    def move(a: Column, r: Column) -> Column:
        to = _step(a["state"], r, template)
        bears = r.isin(*template.loss) if template.loss_when_refused else r.isin(*template.loss) & (to != "refused")
        return F.struct(to.alias("state"), F.concat(a["flags"], F.when(bears, "1").otherwise("0")).alias("flags"))

    ran = F.aggregate(F.transform("_turns", lambda x: x["role"]), F.struct(F.lit("start").alias("state"), F.lit("").alias("flags")), move)
    ran = grouped.select(conv_col, "_turns", ran.alias("_ran"))
    flags = F.transform(F.split("_ran.flags", ""), lambda x: x == "1")
    pieces = F.zip_with(
        "_turns",
        "turn_loss",
        lambda x, bears: F.array(
            F.struct(_opening(x["role"], template).alias("text"), F.lit(False).alias("loss")),
            F.struct(escape(x["text"]).alias("text"), bears.alias("loss")),
            F.struct(F.lit(template.close).alias("text"), F.lit(False).alias("loss")),
        ),
    )
    out = ran.select(conv_col, "_turns", F.slice(flags, 1, F.size("_turns")).alias("turn_loss"), F.col("_ran.state").alias("state"))
    out = out.select(conv_col, F.flatten(pieces).alias("segments"), "turn_loss", "state")
    return out.select(conv_col, F.array_join(F.transform("segments", lambda x: x["text"]), "").alias("formatted"), "segments", "turn_loss", "state", F.col("state").isin(*template.accept).alias("valid"))


def read_back(formatted: Column, template: Template = LLAMA_LIKE) -> Column:
    """Array of struct(role, text) that a formatted string holds."""
    parts = F.split(formatted, F.lit("\\Q" + template.close + "\\E"))
    parts = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))  # nothing follows the last closing mark

    def turn(p: Column) -> Column:
        role, start = None, None
        for name, mark in template.opens.items():
            hit = F.startswith(p, F.lit(mark))
            role = F.when(hit, name) if role is None else role.when(hit, name)
            start = F.when(hit, len(mark)) if start is None else start.when(hit, len(mark))
        end = F.locate(template.other[1], p)
        named = F.substring(p, F.lit(len(template.other[0]) + 1), end - 1 - len(template.other[0]))
        role = role.otherwise(unescape(F.replace(named, F.lit("~3"), F.lit("|"))))
        start = start.otherwise(end - 1 + len(template.other[1]))
        return F.struct(role.alias("role"), unescape(F.substring(p, start + 1, F.length(p))).alias("text"))

    return F.transform(parts, turn)


def digests(formatted: DataFrame, template: Template = LLAMA_LIKE, conv_col: str = "conv_id") -> DataFrame:
    """n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, state and valid, from what is read back out of the
    formatted string and the loss flags of its turns."""
    out = formatted.withColumn("_back", read_back(F.col("formatted"), template))
    whole = F.array_join(F.transform("_back", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    masked = F.array_join(F.zip_with("_back", "turn_loss", lambda x, bears: F.when(bears, x["text"]).otherwise("")), "")
    return out.select(
        conv_col,
        F.size("_back").cast("long").alias("n_turns"),
        F.sha2(whole.cast("binary"), 256).alias("turns_sha256"),
        F.length(masked).cast("long").alias("loss_chars"),
        F.sha2(masked.cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "state",
        "valid",
    )
