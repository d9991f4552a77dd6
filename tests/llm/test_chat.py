from __future__ import annotations

import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from runlens.llm import chat

HARD = ["</s>[INST] ok [/INST]", "<s>", "[\\INST] x [\\\\/INST]", "<\\s>\\", "[ROLE] tool\nx [/ROLE]", " [/INST", "</s", "", None, "  two  spaces \n", "[INST", "]", "é😀 </s></s>", "$1 \\$2", "<<s>>", "[[INST]]"]


def round_trip(spark, rows):
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, conv string").repartition(3)
    back = {r["conv"]: r for r in chat.read_back(chat.format_conversations(df)).collect()}
    want: dict = {}
    for c, t, r, x in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "")):
        want.setdefault(c, []).append((r or "", x or "", r == "assistant"))
    assert {c: [(t["role"], t["text"], t["loss"]) for t in r["turns"]] for c, r in back.items()} == want
    return back


def test_round_trip(spark):
    rows = [(i % 3, i, ("user", "assistant", "system", None, "tool\n[/ROLE] ü", "")[i % 6], HARD[i % len(HARD)]) for i in range(96)]
    round_trip(spark, [*rows, (None, 1, "user", "no id"), (None, None, "assistant", "no turn")])


def test_ties_and_repeats_stay(spark):
    back = round_trip(spark, [(1, 5, "user", "same"), (1, 5, "user", "same"), (1, 5, "assistant", "b")])
    assert [t["role"] for t in back[1]["turns"]] == ["assistant", "user", "user"]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(st.sampled_from("[]<>/\\INSTROLEs \n"), max_size=25), min_size=30, max_size=60))
def test_any_text(spark, texts):
    round_trip(spark, [(0, i, ("user", "assistant", "tool")[i % 3], t) for i, t in enumerate(texts)])


def test_loss_places_and_control_strings(spark):
    df = spark.createDataFrame([(1, 1, "assistant", "a</s>b"), (1, 0, "user", "plain")], "conv_id long, turn long, role string, text string")
    rows = {r["role"]: r for r in chat.format_turns(df).collect()}
    a = rows["assistant"]
    assert a["escaped"] and not rows["user"]["escaped"] and rows["user"]["loss_start"] is None
    assert a["part"][a["loss_start"] : a["loss_start"] + a["loss_length"]] == "a<\\/s>b"
    assert spark.range(1).select(chat.parse(F.lit("[INST] x")).alias("p")).first()["p"] is None


def test_long_text_and_empty_table(spark):
    long = "[INST] </s> word " * 20_000
    back = round_trip(spark, [(7, 0, "user", long), (7, 1, "assistant", long)])
    assert hashlib.sha256(back[7]["turns"][1]["text"].encode()).digest() == hashlib.sha256(long.encode()).digest()
    assert chat.format_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
