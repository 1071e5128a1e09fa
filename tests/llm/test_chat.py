"""Rendered conversations and their digests against plain Python."""

from __future__ import annotations

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from __spark_entry__ import queries
from shelfwise.llm import chat

SIGNS = ["<s>", "</s>", "[INST]", "[/INST]", "\\", "<", "/", "s>", "a", " ", "é", "😀", "\n", "assistant"]


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain(turns):
    """Turns of a conversation in order, as (role, text)."""
    learnt = "".join(text for role, text in turns if role == "assistant")
    return (
        len(turns), digest("".join(f"{role}\n{text}\n" for role, text in turns)), len(learnt), digest(learnt)
    )


def got(frame):
    return {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in frame.collect()}


def test_digests_equal_a_plain_reading(spark):
    draw = random.Random(2)
    turns = [
        (conv, n, draw.choice(["user", "assistant", "assistant", "system", "[INST]", ""]), "".join(draw.choices(SIGNS, k=draw.randrange(6))))
        for conv in range(150) for n in range(draw.randrange(1, 9))
    ]
    frame = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").repartition(5)
    chats = chat.rendered(chat.messages(chat.turn_events(frame)))
    wanted = {}
    for conv, _, role, text in sorted(turns):
        wanted.setdefault(conv, []).append((role, text))
    assert got(chat.digests(chats)) == {conv: plain(t) for conv, t in wanted.items()}
    # The ranges of the mask hold the same text.
    under = chats.select("conv_id", chat.learnt_text(F.col("formatted"), F.col("loss_mask")).alias("t"))
    assert {r.conv_id: digest(r.t) for r in under.collect()} == {conv: plain(t)[3] for conv, t in wanted.items()}


def test_a_mask_of_another_rendering_is_an_error(spark):
    frame = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "assistant", "bc")], "conv_id long, turn long, role string, text string")
    chats = chat.rendered(chat.messages(chat.turn_events(frame)))
    moved = F.transform("loss_mask", lambda m: F.struct((m["start"] + 1).alias("start"), m["end"].alias("end")))
    with pytest.raises(Exception, match="not of this rendering"):
        chat.digests(chats.withColumn("loss_mask", moved)).collect()


def test_long_conversations_and_messages(spark):
    """Work grows with turns and deltas, not with their square."""
    turns = spark.range(40_000).selectExpr("1L as conv_id", "id as turn", "if(id % 2 = 0, 'user', 'assistant') as role", "concat('text ', id) as text")
    out = got(chat.digests(chat.rendered(chat.messages(chat.turn_events(turns)))))
    assert out == {1: plain([("user" if n % 2 == 0 else "assistant", f"text {n}") for n in range(40_000)])}
    deltas = spark.range(60_000).selectExpr(
        "1L as conv_id", "id as seq", "1L as message", "if(id in (5, 100), 'edit', 'delta') as kind", "'assistant' as role", "concat(id, ' ') as text")
    text = "".join(f"{n} " for n in range(100, 60_000))
    assert [(r.role, r.text) for r in chat.messages(deltas).collect()] == [("assistant", text)]


def test_registered_query(spark):
    folder = "/root/testdata/sf0.001"
    wanted = {-1: [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")]}
    rows = spark.read.parquet(f"{folder}/conversations.parquet").collect()
    for r in sorted(rows, key=lambda r: (r.conv_id, r.turn)):
        wanted.setdefault(r.conv_id, []).append((r.role or "", r.text or ""))
    assert got(queries()["op5_chat_format"](spark, folder)) == {conv: plain(t) for conv, t in wanted.items()}
