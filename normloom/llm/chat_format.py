"""Chat formatting: a finite-state machine over roles checks turn order, a template emits segments with loss flags.

Only DataFrame functions are used. The template is data: what stands before and after a turn of each role and
whether its text counts for the loss. Inside texts a backslash and the template's control strings
are escaped, so the formatted conversation can be read back turn by turn.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from normloom.llm.shared import column

START = "start"


@dataclass(frozen=True)
class Template:
    """``roles``: name of each role in the text, a letter-only word; ``learned``: roles whose text counts for the
    loss; ``turns``: allowed ``(state, role)`` pairs, the state being the role before (``start`` at first)."""

    roles: dict[str, str] = field(default_factory=lambda: {"system": "System", "user": "User", "assistant": "Assistant"})
    learned: tuple[str, ...] = ("assistant",)
    turns: tuple[tuple[str, str], ...] = ((START, "system"), (START, "user"), ("system", "user"), ("user", "assistant"), ("assistant", "user"))
    opening: str = "### "
    middle: str = ": "
    closing: str = "</turn>\n"

    @property
    def control(self) -> list[str]:
        """Strings that a text must not contain unescaped: each turn's end, and what opens a turn."""
        return [self.closing.strip(), self.opening.strip()]


def escaped(text: Column, template: Template) -> Column:
    """Backslashes are doubled; a control string gets one backslash after its first character, at overlapping places too."""
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for mark in template.control:
        first, rest = (rf"\Q{part}\E" for part in (mark[0], mark[1:]))
        out = F.regexp_replace(out, rf"({first})(?={rest})", r"$1\\")
    return out


def unescaped(text: Column) -> Column:
    """Each backslash goes, and the character after it stays."""
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _role_name(role: Column, template: Template) -> Column:
    """The template's name of a role, else ``@`` and the role, escaped and without the character that begins the middle mark."""
    plain = F.replace(F.replace(role, F.lit("~"), F.lit("~0")), F.lit(template.middle[0]), F.lit("~1"))
    name = F.concat(F.lit("@"), escaped(plain, template))
    for raw, shown in template.roles.items():
        name = F.when(role == raw, F.lit(shown)).otherwise(name)
    return name


def format_conversations(turns: DataFrame, template: Template | None = None, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row a conversation: ``conv_id, n_turns, valid, first_error, segments, formatted``.

    ``segments`` is the list of emitted texts with a loss flag each; ``formatted`` is their
    concatenation. ``valid`` tells whether the role order is allowed, ``first_error`` the position from 0 of the
    first turn that breaks it (null if none); such conversations are formatted all the same. Turns are ordered by
    turn number (null first), ties by role, then text; repeated rows are turns of their own. Null texts and roles count as
    empty; rows without a conversation id form one conversation of their own. An empty table gives no row. Texts and roles
    may be of any length. Further columns are left out, whatever their names. A conversation's rows meet in one
    row of the result, as its text must.
    """
    template = template or Template()
    said = F.struct(column(turn).alias("turn"), F.coalesce(column(role), F.lit("")).alias("role"), F.coalesce(column(text), F.lit("")).alias("text"))
    talks = turns.select(column(conv).alias("conv_id"), said.alias("said")).groupBy("conv_id").agg(F.sort_array(F.collect_list("said")).alias("said"))
    allowed = F.array(*[F.lit(f"{a}\n{b}") for a, b in template.turns])
    machine = F.aggregate(
        "said",
        F.struct(F.lit(START).alias("state"), F.lit(0).alias("at"), F.lit(None).cast("int").alias("error")),
        lambda s, x: F.struct(
            x["role"].alias("state"),
            (s["at"] + 1).alias("at"),
            F.coalesce(s["error"], F.when(~F.array_contains(allowed, F.concat(s["state"], F.lit("\n"), x["role"])), s["at"])).alias("error"),
        ),
    )

    def segments(x: Column) -> Column:
        head = F.concat(F.lit(template.opening), _role_name(x["role"], template), F.lit(template.middle))
        flags = [F.lit(False).alias("loss"), x["role"].isin(*template.learned).alias("loss"), F.lit(False).alias("loss")]
        return F.array(*[F.struct(t.alias("text"), flag) for t, flag in zip((head, escaped(x["text"], template), F.lit(template.closing)), flags, strict=True)])

    made = talks.select("conv_id", F.size("said").cast("long").alias("n_turns"), machine["error"].alias("first_error"), F.flatten(F.transform("said", segments)).alias("segments"))
    return made.select("conv_id", "n_turns", F.col("first_error").isNull().alias("valid"), "first_error", "segments", F.array_join(F.col("segments.text"), "").alias("formatted"))


def read_back(formatted: Column, template: Template | None = None) -> Column:
    """The turns of a formatted conversation: an array of ``role, text``.

    A closing mark never stands inside a turn, so splitting there gives the turns; the first middle
    mark ends the role, which holds none of it.
    """
    template = template or Template()
    quoted = "".join("\\" + c if not c.isalnum() and c not in "\n " else c for c in template.closing)
    turns = F.filter(F.split(formatted, quoted), lambda t: t != "")

    def one(t: Column) -> Column:
        shown = F.substr(F.substring_index(t, template.middle, 1), F.lit(len(template.opening) + 1))
        role = F.replace(F.replace(unescaped(F.substr(shown, F.lit(2))), F.lit("~1"), F.lit(template.middle[0])), F.lit("~0"), F.lit("~"))
        for raw, name in template.roles.items():
            role = F.when(shown == name, F.lit(raw)).otherwise(role)
        body = F.substr(t, F.length(shown) + len(template.opening) + len(template.middle) + 1)
        return F.struct(role.alias("role"), unescaped(body).alias("text"))

    return F.transform(turns, one)


def loss_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped, in order, with nothing between."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescaped(s["text"])), "")
