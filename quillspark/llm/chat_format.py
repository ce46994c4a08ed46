"""Chat formatting: a finite-state machine over roles and a declarative template.

The template says for each role what stands before and after a turn and whether its text is trained on.
Control strings cannot arise from texts: every ``<``, ``[`` and escape character of a text is followed by
the escape character, which unescaping takes away again.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import digest_hex

ESCAPE = "\\"


@dataclass(frozen=True)
class Template:
    """``open`` + role + ``"\\n"`` + text + ``close`` for each turn; ``trained``: roles under the loss.

    ``moves``: (state, role) to the next state; a turn without a move makes the conversation invalid.
    ``ends``: states in which a conversation may end.
    """

    open: str = "<|turn|>"
    close: str = "<|end|>\n"
    trained: tuple[str, ...] = ("assistant",)
    moves: dict[tuple[str, str], str] = field(
        default_factory=lambda: {
            ("start", "system"): "system",
            ("start", "user"): "user",
            ("system", "user"): "user",
            ("user", "assistant"): "assistant",
            ("assistant", "user"): "user",
        }
    )
    ends: tuple[str, ...] = ("assistant",)

    def __post_init__(self) -> None:
        if any(not x or x[0] not in "<[" for x in (self.open, self.close)):
            raise ValueError("control strings have to begin with < or [")


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[\\])", r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[\\])\\", "$1")


def format_chats(chats: DataFrame, template: Template = Template()) -> DataFrame:
    """conv_id, segments (array of text, loss), formatted, valid, failed_at: a row per conversation.

    Turns are taken in the order (turn, role, text), nulls first. A null text or role counts as empty; a
    null conv_id is a conversation of its own; repeated rows are turns of their own. Roles the machine
    does not know are formatted too, not trained on, and make the conversation invalid; ``failed_at`` is
    the index of the first turn without a move (null: none), and a conversation that stops in a state
    other than ``ends`` is invalid. Only conv_id, turn, role and text are read.
    """
    one = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = chats.groupBy("conv_id").agg(F.sort_array(F.collect_list(one)).alias("turns"))

    def move(acc: Column, t: Column) -> Column:
        after = F.lit("")
        for (state, role), to in template.moves.items():
            after = F.when((acc["state"] == state) & (t["role"] == role), F.lit(to)).otherwise(after)
        failed = F.coalesce(acc["failed"], F.when(after == "", acc["at"]))
        return F.struct(after.alias("state"), (acc["at"] + 1).alias("at"), failed.alias("failed"))

    start = F.struct(F.lit("start").alias("state"), F.lit(0).alias("at"), F.lit(None).cast("int").alias("failed"))
    part = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
    segments = F.flatten(
        F.transform(
            "turns",
            lambda t: F.array(
                part(F.concat(F.lit(template.open), F.replace(escape(t["role"]), F.lit("\n"), F.lit("[n")), F.lit("\n")), F.lit(False)),
                part(escape(t["text"]), t["role"].isin(*template.trained)),
                part(F.lit(template.close), F.lit(False)),
            ),
        )
    )
    out = turns.select("conv_id", segments.alias("segments"), F.aggregate("turns", start, move).alias("end"))
    return out.select(
        "conv_id",
        "segments",
        F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
        (F.col("end.failed").isNull() & F.col("end.state").isin(*template.ends)).alias("valid"),
        F.col("end.failed").alias("failed_at"),
    )


def read_back(formatted: Column, template: Template = Template()) -> Column:
    """Array of (role, text) of a formatted conversation."""
    quote = lambda s: "\\Q" + s + "\\E"
    pieces = F.filter(F.split(formatted, quote(template.close)), lambda p: p != "")
    bare = F.transform(pieces, lambda p: F.substring(p, len(template.open) + 1, 2**31 - 1))
    # a role's own line ends are written as "[n", which no escaped text has, so the first line end ends the role
    return F.transform(
        bare,
        lambda p: F.struct(
            unescape(F.replace(F.substring_index(p, "\n", 1), F.lit("[n"), F.lit("\n"))).alias("role"),
            unescape(F.substring(p, F.instr(p, "\n") + 1, F.lit(2**31 - 1))).alias("text"),
        ),
    )


def digests(formatted_chats: DataFrame, template: Template = Template()) -> DataFrame:
    """What the output says about each conversation, read back from it."""
    rows = formatted_chats.select("*", read_back(F.col("formatted"), template).alias("turns"))
    loss = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    rows = rows.withColumns({"loss": loss, "said": said})
    return rows.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        digest_hex(F.col("said")).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        digest_hex(F.col("loss")).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
        "failed_at",
    )
