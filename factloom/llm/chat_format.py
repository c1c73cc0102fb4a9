"""Chat formatting in SQL functions alone: a finite-state machine over roles, and segments with loss flags.

A template declares for each role the strings before and after its text and whether its text counts for the loss. Texts
are escaped so that no control string of the template occurs in them, and the formatted text can be read back exactly.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ESCAPE = "\\"


@dataclass(frozen=True)
class Template:
    """Declarative chat template.

    ``roles``: role -> (before, after, loss). ``other``: (before, between, after) for any other role, whose name is
    written between the first two; it never counts for the loss. ``turn_end`` closes each turn. ``moves``: the states of
    the machine and the roles each allows next; ``final``: the states in which a conversation may end.
    Every control string starts with ``<`` or ``[``, has two characters at least, and no control string ends as another
    begins, so one can't arise across a boundary.
    """

    roles: dict[str, tuple[str, str, bool]] = field(default_factory=lambda: {
        "system": ("<<SYS>>", "<</SYS>>", False), "user": ("[INST]", "[/INST]", False), "assistant": ("[ANS]", "[/ANS]", True)})
    other: tuple[str, str, str] = ("[ROLE]", "[TEXT]", "[/TEXT]")
    turn_end: str = "</s>"
    extra: tuple[str, ...] = ("<s>",)
    moves: dict[str, tuple[str, ...]] = field(default_factory=lambda: {"start": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)})
    final: tuple[str, ...] = ("assistant",)

    def controls(self) -> list[str]:
        return list(dict.fromkeys([x for b, a, _ in self.roles.values() for x in (b, a)] + [*self.other, self.turn_end, *self.extra]))


def escape(text: Column, t: Template) -> Column:
    """Doubles the escape character, then puts one behind the first character of every control string."""
    text = F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE * 2))
    for c in t.controls():
        text = F.replace(text, F.lit(c), F.lit(c[0] + ESCAPE + c[1:]))
    return text


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(\\?)", "$1")


def format_chats(df: DataFrame, template: Template | None = None, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per conversation: conv_id, segments array<struct<text, loss>>, formatted, valid.

    Rows are ordered by turn (nulls first), ties by role and text; repeated rows are turns of their own. A null text is
    empty; a null role is written as an empty other role. ``valid`` says whether the machine accepts the order of roles;
    conversations that it doesn't accept are formatted all the same. Rows with a null conv_id form one conversation.
    Other columns aren't read; an empty table gives no rows. A conversation is one record of the output, so its turns
    meet in one task, after they have been formatted in parallel.
    """
    t = template or Template()
    role, text = F.coalesce(F.col(f"`{role_col}`"), F.lit("")), F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    before, after, loss = F.concat(F.lit(t.other[0]), escape(role, t), F.lit(t.other[1])), F.lit(t.other[2]), F.lit(False)
    for name, (b, a, counts) in t.roles.items():
        before, after, loss = F.when(role == name, b).otherwise(before), F.when(role == name, a).otherwise(after), F.when(role == name, F.lit(counts)).otherwise(loss)
    turns = df.select(
        F.col(f"`{conv_col}`").cast("long").alias("conv_id"),
        F.struct(F.col(f"`{turn_col}`").cast("long").alias("turn"), role.alias("role"), text.alias("text"), before.alias("before"), escape(text, t).alias("body"), F.concat(after, F.lit(t.turn_end)).alias("after"), loss.alias("loss")).alias("x"))
    convs = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list("x")).alias("turns"))
    segment = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
    segments = F.flatten(F.transform("turns", lambda x: F.array(segment(x.before, F.lit(False)), segment(x.body, x.loss), segment(x.after, F.lit(False)))))
    allowed = F.array(*[F.lit(f"{a}>{b}") for a, bs in t.moves.items() for b in bs])
    state = F.aggregate("turns", F.lit("start"), lambda s, x: F.when((s == "reject") | ~F.array_contains(allowed, F.concat(s, F.lit(">"), x.role)), F.lit("reject")).otherwise(x.role))
    return convs.select("conv_id", segments.alias("segments"), state.isin(*t.final).alias("valid")).select(
        "conv_id", "segments", F.array_join(F.transform("segments", lambda s: s.text), "").alias("formatted"), "valid")


def read_back(formatted: Column, template: Template | None = None) -> Column:
    """array<struct<role, text>> of the turns in a formatted text."""
    t = template or Template()
    parts = F.split(formatted, F.lit(_literal(t.turn_end)), -1)

    def turn(part: Column) -> Column:
        inner = F.substring(part, F.lit(len(t.other[0]) + 1), F.length(part) - len(t.other[0]) - len(t.other[2]))
        out = F.struct(unescape(F.split_part(inner, F.lit(t.other[1]), F.lit(1))).alias("role"), unescape(F.split_part(inner, F.lit(t.other[1]), F.lit(2))).alias("text"))
        for name, (b, a, _) in t.roles.items():
            body = F.substring(part, F.lit(len(b) + 1), F.length(part) - len(b) - len(a))
            out = F.when(F.startswith(part, F.lit(b)), F.struct(F.lit(name).alias("role"), unescape(body).alias("text"))).otherwise(out)
        return out

    return F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), turn)


def _literal(s: str) -> str:
    return "".join("\\" + c if not c.isalnum() else c for c in s)


def digest_rows(chats: DataFrame, template: Template | None = None) -> DataFrame:
    """Per conversation what can be read back from the formatted text and from the segments under the loss mask."""
    turns = chats.select("*", read_back(F.col("formatted"), template).alias("turns"))
    lost = unescape(F.array_join(F.transform(F.filter("segments", lambda s: s.loss), lambda s: s.text), ""))
    said = F.array_join(F.transform("turns", lambda x: F.concat(x.role, F.lit("\n"), x.text, F.lit("\n"))), "")
    return turns.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), lost.alias("lost"), F.length("formatted").cast("long").alias("formatted_chars"), "valid").select(
        "conv_id", "n_turns", "turns_sha256", F.length("lost").cast("long").alias("loss_chars"), F.sha2("lost", 256).alias("loss_sha256"), "formatted_chars", "valid")
