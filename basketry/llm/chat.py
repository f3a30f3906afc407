r"""Chat formatting: a finite-state machine over roles checks the turn order and
a declarative template turns each conversation into text segments with a loss
flag each. DataFrame functions only.

Markers are bracketed control strings. A text that holds a control string gets
a backslash behind its opening bracket (one more if backslashes follow it
already), so that no text can imitate a marker and ``unescape`` gives the exact
text back.

Defined results: a null text or role is empty; a role without markers of its
own is written between the markers of ``other`` with its name; rows with the
same conversation and turn number are ordered by role, then text (nulls
first), repeated rows are repeated turns; a null conversation id or turn
number is a value like any other (nulls first); an empty table gives no rows;
other columns are not read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ChatTemplate:
    """``markers``: role -> (before, after). ``other``: (before, between role
    and text, after) for every other role. ``loss``: roles whose text is
    learned. ``transitions``: state -> roles that may follow; ``accept``:
    states in which a conversation may end. A state is the last role, or ""."""

    markers: dict[str, tuple[str, str]] = field(default_factory=lambda: {
        "system": ("[SYS]", "[/SYS]"), "user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>")})
    other: tuple[str, str, str] = ("[TURN]", "[TEXT]", "[/TURN]")
    loss: tuple[str, ...] = ("assistant",)
    transitions: dict[str, tuple[str, ...]] = field(default_factory=lambda: {
        "": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)})
    accept: tuple[str, ...] = ("assistant",)

    def control_strings(self) -> list[str]:
        return [m for pair in self.markers.values() for m in pair] + list(self.other)

    def _pattern(self, backslashes: str) -> str:
        rest = "|".join(re.escape(m[1:]) for m in self.control_strings())
        return rf"([<\[]){backslashes}({rest})"

    def escape(self, text: Column) -> Column:
        return F.regexp_replace(text, self._pattern(r"(\\*)"), r"$1\\$2$3")

    def unescape(self, text: Column) -> Column:
        return F.regexp_replace(text, self._pattern(r"\\(\\*)"), "$1$2$3")


def _known_role(template: ChatTemplate, role: Column, value, default):
    out = default
    for name, pair in template.markers.items():
        out = F.when(role == name, value(name, pair)).otherwise(out)
    return out


def format_chats(turns: DataFrame, template: ChatTemplate = ChatTemplate()) -> DataFrame:
    """conv_id, turns (role, text), valid, error_turn (0-based place of the
    first turn out of order; the number of turns if only the end is wrong; null
    if valid), segments (text, loss), formatted. ``segments`` joined is
    ``formatted``."""
    turn = F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"),
                    F.coalesce("text", F.lit("")).alias("text"))
    chats = (turns.select("conv_id", turn.alias("t")).groupBy("conv_id")
             .agg(F.sort_array(F.collect_list("t")).alias("turns")))

    edges = F.create_map(*[x for state, roles in template.transitions.items()
                           for x in (F.lit(state), F.array(*[F.lit(r) for r in roles]))])

    def step(machine: Column, t: Column) -> Column:
        allowed = F.coalesce(F.array_contains(F.try_element_at(edges, machine["state"]), t["role"]), F.lit(False))
        return F.struct(t["role"].alias("state"), (machine["place"] + 1).alias("place"),
                        F.coalesce(machine["error"], F.when(~allowed, machine["place"])).alias("error"))

    start = F.struct(F.lit("").alias("state"), F.lit(0).alias("place"), F.lit(None).cast("int").alias("error"))
    end = F.aggregate("turns", start, step)
    ends_well = F.col("end.state").isin(*template.accept)

    def segments(t: Column) -> Column:
        def segment(text, loss=F.lit(False)):
            return F.struct(text.alias("text"), loss.alias("loss"))
        begin, between, close = template.other
        before = _known_role(template, t["role"], lambda _, m: F.lit(m[0]),
                             F.concat(F.lit(begin), template.escape(t["role"]), F.lit(between)))
        after = _known_role(template, t["role"], lambda _, m: F.lit(m[1]), F.lit(close))
        return F.array(segment(before), segment(template.escape(t["text"]), t["role"].isin(*template.loss)),
                       segment(after))

    return (chats.withColumn("end", end)
            .withColumn("error_turn", F.coalesce("end.error", F.when(~ends_well, F.size("turns"))))
            .withColumn("segments", F.flatten(F.transform("turns", segments)))
            .select("conv_id", F.transform("turns", lambda t: t.dropFields("turn")).alias("turns"),
                    F.col("error_turn").isNull().alias("valid"), "error_turn", "segments",
                    F.concat_ws("", F.transform("segments", lambda s: s["text"])).alias("formatted")))


def read_turns(formatted: Column, template: ChatTemplate = ChatTemplate()) -> Column:
    """The turns (role, text) read back from formatted text alone."""
    def between(before: str, after: str) -> str:
        return rf"{re.escape(before)}.*?{re.escape(after)}"

    begin, middle, close = template.other
    pattern = "(?s)" + "|".join(between(*m) for m in [*template.markers.values(), (begin, close)])

    def turn(raw: Column) -> Column:
        def inside(before: Column, after: int) -> Column:
            return template.unescape(F.substr(raw, before + 1, F.length(raw) - before - after))
        at = F.instr(raw, middle)
        name = template.unescape(F.substr(raw, F.lit(len(begin) + 1), at - F.lit(len(begin) + 1)))
        out = F.struct(name.alias("role"), inside(at + F.lit(len(middle) - 1), len(close)).alias("text"))
        for role, (before, after) in template.markers.items():
            out = F.when(F.startswith(raw, F.lit(before)),
                         F.struct(F.lit(role).alias("role"),
                                  inside(F.lit(len(before)), len(after)).alias("text"))).otherwise(out)
        return out

    return F.transform(F.regexp_extract_all(formatted, F.lit(pattern), F.lit(0)), turn)


def chat_digest(formatted: DataFrame, template: ChatTemplate = ChatTemplate()) -> DataFrame:
    """Counts and digests of formatted conversations, read back from
    ``formatted`` (turns) and ``segments`` (the texts under the loss mask)."""
    loss = F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: template.unescape(s["text"]))
    turns = F.transform("read", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return (formatted.withColumn("read", read_turns(F.col("formatted"), template))
            .withColumn("loss", F.concat_ws("", loss))
            .select("conv_id", F.size("read").cast("long").alias("n_turns"),
                    F.sha2(F.concat_ws("", turns), 256).alias("turns_sha256"),
                    F.length("loss").cast("long").alias("loss_chars"),
                    F.sha2(F.col("loss"), 256).alias("loss_sha256"),
                    F.length("formatted").cast("long").alias("formatted_chars"),
                    "valid", F.col("error_turn").cast("long").alias("error_turn")))
