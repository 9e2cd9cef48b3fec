from __future__ import annotations

from compare import rows
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from inkwell.llm import chat, queries

TURNS = "conv_id long, turn long, role string, text string"
TEXT = st.lists(st.sampled_from(["<", "[", "\\", "|im_start|>", "|im_sep|>", "|im_end|>", "\n", "/s>", "s>", "INST]", "/INST]", "<SYS>>", "SYS>>", "|", "a", "$1", "é", "🙂", "%", " "]), max_size=12).map("".join)


def test_any_turns_round_trip(spark):
    @settings(max_examples=12, deadline=None)
    @given(st.lists(st.lists(st.tuples(st.sampled_from(["user", "assistant", "user\n", "<|im_end|>%0A", ""]), TEXT), min_size=1, max_size=8), min_size=20, max_size=40))
    def check(chats):
        data = [(c, i, role, text) for c, turns in enumerate(chats) for i, (role, text) in enumerate(turns)]
        out = chat.format_chats(spark.createDataFrame(data, TURNS)).withColumn("back", chat.read_chats(F.col("formatted")))
        for r in out.collect():
            assert [(t["role"], t["text"]) for t in r["back"]] == chats[r["conv_id"]]
            assert r["loss"] == [role == "assistant" for role, _ in chats[r["conv_id"]]]
            # Marks are the template's own: one pair for each run of a role.
            runs = sum(1 for i, t in enumerate(chats[r["conv_id"]]) if not i or chats[r["conv_id"]][i - 1][0] != t[0])
            assert r["formatted"].count(chat.START) == r["formatted"].count("<|im_end|>") == runs
            assert not any(x in r["formatted"] for x in ("</s>", "[INST]", "<<SYS>>"))

    check()


def test_adjacent_turns_of_a_role_merge(spark):
    df = spark.createDataFrame([(1, 2, "user", "b"), (1, 1, "user", "a"), (1, 3, "assistant", "c")], TURNS)
    assert chat.format_chats(df).first()["formatted"] == "<|im_start|>user\na<|im_sep|>b<|im_end|>\n<|im_start|>assistant\nc<|im_end|>\n"


def test_nulls_ties_and_repeats(spark):
    data = [(1, 1, "user", None), (1, 1, "user", None), (1, None, None, "x"), (None, 1, "assistant", "y"), (2, 5, "assistant", "z" * 200_000)]
    df = spark.createDataFrame(data, TURNS).withColumn("turns", F.lit("clash")).withColumn("roles", F.lit(1))
    out = chat.format_chats(df).withColumn("back", chat.read_chats(F.col("formatted")))
    found = {r["conv_id"]: [(t["role"], t["text"]) for t in r["back"]] for r in out.collect()}
    assert found == {1: [("", "x"), ("user", ""), ("user", "")], None: [("assistant", "y")], 2: [("assistant", "z" * 200_000)]}
    assert chat.format_chats(df.where("turn = 99")).count() == 0


def test_query_reads_back_the_hard_conversation(spark, sf):
    found = queries.op9_chat_format(spark, sf).where("conv_id = -1").collect()
    text = "</s>[INST] ok [/INST]"
    import hashlib

    assert rows(queries.op9_chat_format(spark, sf).where("conv_id = -1").select("n_turns", "loss_chars", "loss_sha256")) == [(2, len(text), hashlib.sha256(text.encode()).hexdigest())]
    assert found[0]["turns_sha256"] == hashlib.sha256(f"user\n{text}\nassistant\n{text}\n".encode()).hexdigest()
