"""Chat formatting: a state machine over roles, a declarative template, per-segment loss flags. DataFrame functions only."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STRETCH = 64  # turns that are joined in one aggregation buffer; longer conversations are joined stretch by stretch


@dataclass(frozen=True)
class Template:
    """How turns look. A turn is prefix, role, separator, text, suffix; only the text of `trained` roles carries loss.

    `opening` must begin every control string; escaping takes it and the escape character out of texts and roles, so a control
    string can't occur inside them.
    """

    opening: str = "<"
    escape: str = "\\"
    stand_in: str = "l"
    prefix: str = "<|turn|>"
    separator: str = "<|text|>"
    suffix: str = "<|end|>"
    loss_suffix: str = "<|end loss|>"
    trained: tuple[str, ...] = ("assistant",)
    #: state -> {role: next state}; a role that a state does not list ends in the state "error".
    transitions: dict[str, dict[str, str]] = field(default_factory=lambda: {
        "start": {"system": "system", "user": "user"}, "system": {"user": "user"}, "user": {"assistant": "assistant"},
        "assistant": {"user": "user"}})
    final: tuple[str, ...] = ("assistant",)

    def __post_init__(self):
        for mark in (self.prefix, self.separator, self.suffix, self.loss_suffix):
            if not mark.startswith(self.opening) or self.escape in mark or self.opening in mark[1:]:
                raise ValueError(f"{mark!r} must hold the opening once, at its start, and no escape character")
        if len({self.prefix, self.separator, self.suffix, self.loss_suffix}) < 4 or self.stand_in in (self.opening, self.escape):
            raise ValueError("control strings and stand-in must differ")
        if any(set(self.transitions[s]) != {r for r, t in self.transitions[s].items() if t == r} for s in self.transitions):
            raise ValueError("a state is named after the role that leads to it")


def escaped(text: Column, t: Template) -> Column:
    return F.replace(F.replace(text, F.lit(t.escape), F.lit(t.escape * 2)), F.lit(t.opening), F.lit(t.escape + t.stand_in))


def unescaped(text: Column, t: Template) -> Column:
    """Undo escaped(): a pair of escape characters is one; between pairs an escaped stand-in is the opening."""
    pair = "".join(f"\\{c}" for c in t.escape * 2)
    parts = F.transform(F.split(text, pair, -1), lambda p: F.replace(p, F.lit(t.escape + t.stand_in), F.lit(t.opening)))
    return F.array_join(parts, t.escape)


def segments(conversations: DataFrame, template: Template | None = None) -> DataFrame:
    """(conv_id, turn, role, text, formatted, loss, valid): one row per turn with its segment and whether it may follow the one
    before it (the machine's states are the roles, so the row before decides). Null roles and texts count as empty."""
    t = template or Template()
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"))
    rows = rows.withColumn("loss", F.col("role").isin(*t.trained))
    # the row before is in the same stretch of turns or is the last of an earlier one, so no window holds a whole conversation
    rows = rows.withColumn("_stretch", F.floor(F.coalesce("turn", F.lit(0)) / STRETCH))
    inside = Window.partitionBy("conv_id", "_stretch").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    ends = rows.groupBy("conv_id", "_stretch").agg(F.max_by("role", F.struct(F.coalesce("turn", F.lit(-(1 << 63))), "role", "text")).alias("_end"))
    across = Window.partitionBy("conv_id").orderBy("_stretch")
    ends = ends.select("conv_id", "_stretch", F.lag("_end").over(across).alias("_earlier"))
    rows = rows.withColumn("_before", F.lag("role").over(inside))
    rows = rows.join(ends.withColumnRenamed("conv_id", "_c").withColumnRenamed("_stretch", "_s"),
                     F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("_stretch") == F.col("_s")), "left")
    state = F.coalesce("_before", "_earlier", F.lit("start"))
    allowed = F.lit(False)
    for name, steps in t.transitions.items():
        allowed = allowed | ((state == name) & F.col("role").isin(*steps))
    formatted = F.concat(F.lit(t.prefix), escaped(F.col("role"), t), F.lit(t.separator), escaped(F.col("text"), t),
                         F.when(F.col("loss"), F.lit(t.loss_suffix)).otherwise(F.lit(t.suffix)))
    return rows.select("conv_id", "turn", "_stretch", "role", "text", formatted.alias("formatted"), "loss", allowed.alias("valid"))


def format_conversations(conversations: DataFrame, template: Template | None = None) -> DataFrame:
    """(conv_id, formatted, valid): one string per conversation, turns in order (ties by role, then text).

    Conversations the machine rejects are formatted too, with valid = false. Turns are joined stretch by stretch and the
    stretches' strings then per conversation: the one string is the feature, nothing else of a conversation is gathered. Null
    conv_id is a conversation of its own; repeated rows are turns of their own; an empty table gives none; extra columns are
    not read.
    """
    t = template or Template()
    rows = segments(conversations, t)
    order = F.struct(F.coalesce("turn", F.lit(-(1 << 63))).alias("turn"), "role", "text", "formatted")
    stretch = rows.groupBy("conv_id", "_stretch").agg(F.sort_array(F.collect_list(order)).alias("_turns"), F.min("valid").alias("valid"),
                                                      F.max_by("role", order).alias("_last"))
    stretch = stretch.select("conv_id", "_stretch", "valid", "_last", F.array_join(F.col("_turns.formatted"), "").alias("formatted"))
    whole = stretch.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("_stretch", "formatted"))).alias("_parts"),
                                           F.min("valid").alias("valid"), F.max_by("_last", "_stretch").alias("_last"))
    return whole.select("conv_id", F.array_join(F.col("_parts.formatted"), "").alias("formatted"),
                        (F.col("valid") & F.col("_last").isin(*t.final)).alias("valid"))


def read_back(formatted: DataFrame, template: Template | None = None) -> DataFrame:
    """formatted with `turns`: the array of (role, text, loss) that the string holds."""
    t = template or Template()
    pieces = F.slice(F.split("formatted", "".join(f"\\{c}" if not c.isalnum() else c for c in t.prefix), -1), 2, 1 << 30)

    def turn(piece: Column) -> Column:
        role = F.substring_index(piece, t.separator, 1)
        rest = F.substr(piece, F.length(role) + len(t.separator) + 1)
        loss = F.endswith(rest, F.lit(t.loss_suffix))
        body = F.substr(rest, F.lit(1), F.length(rest) - F.when(loss, len(t.loss_suffix)).otherwise(len(t.suffix)))
        return F.struct(unescaped(role, t).alias("role"), unescaped(body, t).alias("text"), loss.alias("loss"))

    return formatted.withColumn("turns", F.transform(pieces, turn))
