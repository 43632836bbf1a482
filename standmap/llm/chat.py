"""Chat formatting: a finite-state machine over roles, and text segments with loss flags from a declarative template.

Everything is column functions. Turn order is checked on (turn, role) alone, range by range, so a conversation may be
longer than a task; segments are made row by row; only :func:`format_chats` puts a conversation into one row, as a
training sample is.
"""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from standmap.llm.common import once


def _moves() -> Mapping[str, Mapping[str, str]]:
    """An optional system turn, then user and assistant in turn; an assistant may call tools and go on."""
    return {
        "start": {"system": "told", "user": "asked"},
        "told": {"user": "asked"},
        "asked": {"assistant": "answered"},
        "answered": {"user": "asked", "tool": "called"},
        "called": {"tool": "called", "assistant": "answered"},
    }


@dataclass(frozen=True)
class Template:
    """A turn is ``opens``, the role, ``named``, the text, ``closes``; texts of the roles in ``loss`` are trained on.

    ``moves`` gives by state and role the next state; a conversation begins in ``start`` and is whole in one of ``ends``.
    ``openers``: pairs of different characters, no backslash, one of which begins each control string. Inside texts and
    roles a backslash is put between the two (after those that stand there), so that no text holds a control string and
    every text comes back. ``named`` is a control string too, or a line break, which roles then hold as %0A.
    """

    opens: str = "<|im_start|>"
    named: str = "\n"
    closes: str = "<|im_end|>\n"
    loss: tuple[str, ...] = ("assistant",)
    openers: tuple[tuple[str, str], ...] = (("<", "|"),)
    start: str = "start"
    ends: tuple[str, ...] = ("answered",)
    moves: Mapping[str, Mapping[str, str]] = field(default_factory=_moves)

    def __post_init__(self):
        for a, b in self.openers:
            if len(a) != 1 or len(b) != 1 or a == b or "\\" in a + b:
                raise ValueError(f"an opener is two different characters without backslash: {a}{b}")
        for x in (self.opens, self.closes, *([] if self.named == "\n" else [self.named])):
            if not any(x.startswith(a + b) for a, b in self.openers):
                raise ValueError(f"no opener begins {x!r}")

    @property
    def states(self) -> list[str]:
        return sorted({self.start, *self.ends, *self.moves, *(s for m in self.moves.values() for s in m.values())})


CHATML = Template()


def _swapped(text: Column, template: Template, add: bool) -> Column:
    for a, b in template.openers if add else template.openers[::-1]:
        quoted = [re.sub(r"([$\\])", r"\\\1", x) for x in (a, b)]
        more, less = (rf"{re.escape(a)}(\\*){re.escape(b)}", rf"{quoted[0]}\\$1{quoted[1]}"), (rf"{re.escape(a)}\\(\\*){re.escape(b)}", f"{quoted[0]}$1{quoted[1]}")
        text = F.regexp_replace(text, *(more if add else less))
    return text


def escaped(text: Column, template: Template = CHATML) -> Column:
    """``text`` without any control string of ``template``."""
    return _swapped(text, template, True)


def unescaped(text: Column, template: Template = CHATML) -> Column:
    """What :func:`escaped` was given."""
    return _swapped(text, template, False)


def _role(role: Column, template: Template) -> Column:
    return F.replace(F.replace(escaped(role, template), F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A"))


def _role_back(role: Column, template: Template) -> Column:
    return unescaped(F.replace(F.replace(role, F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%")), template)


def _segments(role: Column, text: Column, template: Template) -> Column:
    """A turn's segments: its mark with the role, the text, and its end; the flag says whether it is trained on."""
    part = lambda c, loss: F.struct(c.alias("text"), loss.alias("loss"))
    return F.array(
        part(F.concat(F.lit(template.opens), _role(role, template), F.lit(template.named)), F.lit(False)),
        part(escaped(text, template), role.isin(*template.loss)),
        part(F.lit(template.closes), F.lit(False)),
    )


def chat_segments(rows: DataFrame, template: Template = CHATML) -> DataFrame:
    """(conv_id, turn, role, segment, text, loss): the segments of each row (conv_id, turn, role, text), without any shuffle.

    Null texts and roles are empty. Repeated rows give their segments again.
    """
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    return rows.select("conv_id", "turn", "role", F.posexplode(_segments(role, text, template)).alias("segment", "s")).select("conv_id", "turn", "role", "segment", "s.text", "s.loss")


def turn_order(rows: DataFrame, template: Template = CHATML) -> DataFrame:
    """(conv_id, valid, state, rejected, bad_turn, bad_role) of conversations: where the machine over roles ends, and what stopped it.

    Turns go by ``turn`` (null last), equal ones by role. A role that the state has no move for, null among them, stops
    the machine in that state: ``rejected``, with the turn and role. ``valid``: nothing was rejected and the state is one
    of the template's ends, so that a conversation that waits for an answer isn't valid. Rows without conv_id are one
    conversation. Each range of turns becomes a function from state to state, and a conversation's functions are applied
    in order, so that no task needs a conversation's turns.
    """
    states = template.states
    table = F.create_map(*(F.lit(x) for s, m in template.moves.items() for r, to in m.items() for x in (f"{s} {r}", to)))
    blank = lambda state: F.struct(state.alias("state"), F.lit(False).alias("rejected"), F.lit(None).cast(kinds["turn"]).alias("bad_turn"), F.lit(None).cast("string").alias("bad_role"))
    kinds = dict(rows.dtypes)

    def step(at: Column, t: Column) -> Column:
        stop = F.struct(at["state"].alias("state"), F.lit(True).alias("rejected"), t["turn"].alias("bad_turn"), t["role"].alias("bad_role"))
        to = F.element_at(table, F.concat(at["state"], F.lit(" "), t["role"]))
        return F.when(at["rejected"], at).otherwise(once(to, lambda x: F.when(x.isNull(), stop).otherwise(blank(x))))

    late = F.col("turn").isNull()
    dealt = rows.select("conv_id", "turn", "role").repartitionByRange("conv_id", late, "turn", "role").withColumn("range", F.spark_partition_id())
    ranges = dealt.groupBy("conv_id", "range").agg(F.array_sort(F.collect_list(F.struct(late.alias("late"), "turn", "role"))).alias("turns"))  # a range's turns at most
    ranges = ranges.select("conv_id", "range", F.create_map(*(x for s in states for x in (F.lit(s), F.aggregate("turns", blank(F.lit(s)), step)))).alias("by"))
    whole = ranges.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("range", F.map_values("by").alias("to")))).alias("ranges"))  # one for each range of turns
    place = F.create_map(*(x for i, s in enumerate(states) for x in (F.lit(s), F.lit(i))))
    end = F.aggregate("ranges", blank(F.lit(template.start)), lambda at, r: F.when(at["rejected"], at).otherwise(F.get(r["to"], F.element_at(place, at["state"]))))
    return whole.select("conv_id", end.alias("e")).select("conv_id", (~F.col("e.rejected") & F.col("e.state").isin(*template.ends)).alias("valid"), "e.*")


def format_chats(rows: DataFrame, template: Template = CHATML) -> DataFrame:
    """One row for each conversation: conv_id, n_turns, ``formatted``, ``segments`` array<struct<text, loss>>, and :func:`turn_order`'s verdict.

    Rows (conv_id, turn, role, text) go by turn (null last), then role and text; repeated rows are turns of their own.
    All conversations are formatted, those that the machine rejects too: ``valid`` tells them apart. Null texts and
    roles are empty, other columns are passed over. The segments make up ``formatted``; those with ``loss`` are the
    texts of the template's trained roles, each whole, escaped and by itself.
    """
    role, text = (F.coalesce(c, F.lit("")).alias(c) for c in ("role", "text"))
    turns = F.array_sort(F.collect_list(F.struct(F.col("turn").isNull().alias("late"), "turn", role, text)))  # a conversation, which is one sample
    whole = rows.groupBy("conv_id").agg(turns.alias("turns"))
    whole = whole.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.flatten(F.transform("turns", lambda t: _segments(t["role"], t["text"], template))).alias("segments"))
    order = turn_order(rows, template).withColumnRenamed("conv_id", "__conv")
    out = whole.join(order, F.col("conv_id").eqNullSafe(F.col("__conv"))).drop("__conv")
    return out.select("conv_id", "n_turns", F.array_join(F.col("segments.text"), "").alias("formatted"), "segments", "valid", "state", "rejected", "bad_turn", "bad_role")


def read_turns(formatted: Column, template: Template = CHATML) -> Column:
    """array<struct<role, text>> that a conversation was formatted from."""
    parts = F.split(formatted, re.escape(template.opens))  # no text holds one; what stands before the first is empty

    def turn(part: Column) -> Column:
        role = F.substring_index(part, template.named, 1)
        start = F.char_length(role) + len(template.named) + 1
        text = F.substring(part, start, F.char_length(part) - start + 1 - len(template.closes))
        return F.struct(_role_back(role, template).alias("role"), unescaped(text, template).alias("text"))

    return F.transform(F.slice(parts, F.lit(2), F.greatest(F.lit(0), F.size(parts) - 1)), turn)


def loss_texts(segments: Column, template: Template = CHATML) -> Column:
    """The texts under the loss mask as they were before formatting."""
    return F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescaped(s["text"], template))
