"""Conversations rebuilt from event logs and rendered in a chat template, with a loss mask.

Only DataFrame and SQL functions. An event is (conv_id, seq, message, kind, role, text). Of each
message of a conversation the events are sorted by ``seq`` and folded: ``message`` and ``regenerate``
start its text anew, ``edit`` replaces it, ``delta`` appends to it. The messages follow each other
by their first ``seq``. The fold is per message, so a conversation with a third of all events is
spread over tasks; only its rendering, which is one value, is made in one.

A turn is rendered as ``<s>[INST] role [/INST]text</s>``. Inside roles and texts each control
string gets a backslash after its first character, one more than it has there, so ``unescaped`` is
exact for every text. Null texts and roles are empty. Events that tie in ``seq`` are ordered by
kind, role and text; an event that repeats exactly counts once, as logs deliver them again. Null
``conv_id`` is a conversation of its own. An empty table gives no row; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, MIDDLE, CLOSE = "<s>[INST] ", " [/INST]", "</s>"
_CONTROL = r"(<\\*)(/?s>)|(\[\\*)(/?INST\])"
_ESCAPED = r"(<\\*)\\(/?s>)|(\[\\*)\\(/?INST\])"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, _CONTROL, r"$1$3\\$2$4")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPED, "$1$3$2$4")


def turn_events(turns: DataFrame) -> DataFrame:
    """A table of finished turns (conv_id, turn, role, text) as a log: each row is one message.

    Rows that share a turn stay messages of their own, ordered by role and text; exact repeats too.
    """
    same = turns.groupBy("conv_id", F.col("turn").alias("seq"), "role", "text").agg(F.count("*").alias("times"))
    return same.select(
        "conv_id", "seq", F.explode(F.sequence(F.lit(1).cast("long"), "times")).alias("copy"), "role", "text"
    ).select(
        "conv_id", "seq", F.struct("seq", "role", "text", "copy").alias("message"),
        F.lit("message").alias("kind"), "role", "text",
    )


def messages(events: DataFrame) -> DataFrame:
    """``conv_id``, ``seq`` (of the first event), ``role`` and final ``text`` of each message."""
    logged = F.array_sort(F.collect_set(F.struct(
        "seq", F.coalesce("kind", F.lit("message")).alias("kind"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    )))
    # The deltas after the last event that starts the text anew, joined once.
    restarts = F.transform("log", lambda e, at: F.when(e["kind"] != "delta", at + 1))
    last = F.coalesce(F.array_max(restarts), F.lit(1))
    text = F.array_join(F.transform(F.slice("log", last, F.size("log")), lambda e: e["text"]), "")
    role = F.aggregate(
        F.col("log"), F.lit(""), lambda name, e: F.when(e["role"] != "", e["role"]).otherwise(name)
    )
    return (
        events.groupBy("conv_id", "message").agg(logged.alias("log"))
        .select("conv_id", F.col("log")[0]["seq"].alias("seq"), role.alias("role"), text.alias("text"), "message")
    )


def rendered(turns: DataFrame, learnt: str = "assistant") -> DataFrame:
    """``conv_id``, ``formatted`` and ``loss_mask``: the [start, end) characters of the learnt role's texts.

    Places are running sums over the rows of a conversation, before they become one value.
    """
    order = ("seq", "role", "text", "message")
    rows = turns.select(
        "conv_id", "seq", escaped(F.col("role")).alias("role"), escaped(F.col("text")).alias("text"), "message"
    )
    size = F.length("role") + F.length("text") + len(OPEN) + len(MIDDLE) + len(CLOSE)
    before = Window.partitionBy("conv_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("at", F.coalesce(F.sum(size.cast("long")).over(before), F.lit(0)))
    start = F.col("at") + len(OPEN) + F.length("role") + len(MIDDLE)
    turn = F.struct(
        "at", F.concat(F.lit(OPEN), "role", F.lit(MIDDLE), "text", F.lit(CLOSE)).alias("turn"),
        start.alias("start"), (start + F.length("text")).alias("end"), (F.col("role") == learnt).alias("learnt"),
    )
    whole = F.array_join(F.transform("parts", lambda p: p["turn"]), "")
    mask = F.transform(
        F.filter("parts", lambda p: p["learnt"]), lambda p: F.struct(p["start"].alias("start"), p["end"].alias("end"))
    )
    return (
        placed.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("parts"))
        .select("conv_id", whole.alias("formatted"), mask.alias("loss_mask"))
    )


def parsed(formatted: Column) -> Column:
    """The turns (role, text) of a rendered conversation, unescaped."""
    turns = F.filter(F.split(formatted, CLOSE, -1), lambda t: t != "")

    def turn(t: Column) -> Column:
        middle = F.instr(t, MIDDLE)
        return F.struct(
            unescaped(F.substring(t, F.lit(len(OPEN) + 1), middle - 1 - len(OPEN))).alias("role"),
            unescaped(F.substring(t, middle + len(MIDDLE), F.length(t))).alias("text"),
        )

    return F.transform(turns, turn)


def learnt_text(formatted: Column, mask: Column) -> Column:
    """All text under a loss mask, unescaped. Each range is counted from the start of the text, so
    ``digests`` reads the turns instead."""
    return F.array_join(
        F.transform(mask, lambda m: unescaped(F.substring(formatted, (m["start"] + 1).cast("int"), (m["end"] - m["start"]).cast("int")))), ""
    )


def mask_sum(mask: Column) -> Column:
    """A checksum of the ranges of a mask, in their order."""
    return F.aggregate(mask, F.lit(0).cast("long"), lambda s, m: _mixed(s, m["start"], m["end"]))


def _mixed(total: Column, start: Column, end: Column) -> Column:
    prime = (1 << 31) - 1
    return F.pmod(F.pmod(total * 1000003 + F.pmod(start, F.lit(prime)), F.lit(prime)) * 1000003 + F.pmod(end, F.lit(prime)), F.lit(prime))


def read_mask_sum(formatted: Column, learnt: str = "assistant") -> Column:
    """The checksum of the ranges where the learnt role's texts stand in a rendering."""
    pieces = F.filter(F.split(formatted, CLOSE, -1), lambda t: t != "")

    def step(state: Column, piece: Column) -> Column:
        head = F.instr(piece, MIDDLE) - 1 + len(MIDDLE)
        start, end = state["at"] + head, state["at"] + F.length(piece)
        own = F.substring(piece, F.lit(len(OPEN) + 1), head - len(OPEN) - len(MIDDLE)) == learnt
        return F.struct(
            (end + len(CLOSE)).alias("at"),
            F.when(own, _mixed(state["sum"], start, end)).otherwise(state["sum"]).alias("sum"),
        )

    zero = F.struct(F.lit(0).cast("long").alias("at"), F.lit(0).cast("long").alias("sum"))
    return F.aggregate(pieces, zero, step)["sum"]


def digests(chats: DataFrame, learnt: str = "assistant") -> DataFrame:
    """Counts and digests of rendered conversations, read back from the rendering.

    The text under the loss mask is that of the parsed turns whose ranges the mask has; a mask with
    other ranges is an error.
    """
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    own = F.array_join(F.transform(F.filter("turns", lambda t: t["role"] == learnt), lambda t: t["text"]), "")
    same = read_mask_sum(F.col("formatted"), learnt) == mask_sum(F.col("loss_mask"))
    checked = F.when(same, own).otherwise(F.raise_error(F.lit("the loss mask is not of this rendering")))
    return chats.withColumn("turns", parsed(F.col("formatted"))).withColumn("learnt", checked).select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length("learnt").cast("long").alias("loss_chars"), F.sha2("learnt", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
