import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from labarr.llm import chat

SCHEMA = "conv_id long, turn int, role string, text string, formatted string, runs int"


def run(spark, rows, **kw):
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA)
    got = chat.format_chat(df, **kw).withColumn("turns", chat.read_turns(F.col("formatted"))).withColumn("loss", chat.read_loss(F.col("formatted"), F.col("loss_spans")))
    return {r["conv_id"]: r for r in got.collect()}


def test_round_trip_merging_and_loss(spark):
    rows = [(1, 1, "assistant", "b</s>"), (1, 0, "user", "a"), (1, 2, "assistant", "c"), (1, 3, "user", "[INST] \\ <|next|>"), (2, 0, "user", None)]
    got = run(spark, rows)
    assert [(t["role"], t["text"]) for t in got[1]["turns"]] == [("user", "a"), ("assistant", "b</s>"), ("assistant", "c"), ("user", "[INST] \\ <|next|>")]
    assert got[1]["loss"] == "b</s>c" and got[1]["formatted"].count(chat.OPEN) == 3
    assert got[2]["formatted"] == "<|open|>user<|body|><|close|>" and got[2]["loss"] == "" and got[2]["loss_spans"] == []
    assert "</s>" not in got[1]["formatted"] and "[INST]" not in got[1]["formatted"]


def test_nulls_ties_repeats_and_odd_roles(spark):
    rows = [(None, 0, "user", "n"), (3, None, "user", "first"), (3, 0, None, "x"), (3, 1, "user", "b"), (3, 1, "user", "a"), (3, 1, "user", "a"), (3, 1, "assistant", "z"), (3, 2, "we<|body|>ird\n", "")]
    got = run(spark, rows)
    assert got[None]["turns"][0]["text"] == "n"
    assert [(t["role"], t["text"]) for t in got[3]["turns"]] == [("user", "first"), ("", "x"), ("assistant", "z"), ("user", "a"), ("user", "a"), ("user", "b"), ("we<|body|>ird\n", "")]
    assert run(spark, []) == {}


def test_long_conversations_are_merged_over_blocks(spark):
    rows = [(5, k, "assistant" if k % 10 else "user", f"t{k} é" * (k % 3)) for k in range(500)]
    got = run(spark, rows)[5]
    assert [t["text"] for t in got["turns"]] == [r[3] for r in rows]
    assert got["loss"] == "".join(r[3] for r in rows if r[2] == "assistant")
    assert got["formatted"].count(chat.OPEN) == 100


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text(alphabet="\\<>|s/[]INST()open body next close", max_size=40), min_size=1, max_size=12))
def test_escape_is_reversible(spark, texts):
    texts += list(chat.FOREIGN) + [chat.OPEN + chat.CLOSE, "\\" + chat.NEXT, "[[INST]]", "<<s>", "\\\\[INST]"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat.escape(F.col("t")).alias("e")).select("t", "e", chat.unescape(F.col("e")).alias("u"))
    for r in df.collect():
        assert r["u"] == r["t"]
        assert not any(m in r["e"] for m in (chat.OPEN, chat.BODY, chat.NEXT, chat.CLOSE, *chat.FOREIGN))


def test_query_has_the_planted_conversation(spark):
    from labarr.llm import queries

    got = {r["conv_id"]: r for r in queries.op1_chat(spark, "/root/testdata/sf0.001").collect()}[-7]
    say = "</s>[INST] ok [/INST]"
    assert got["n_turns"] == 2 and got["loss_chars"] == len(say)
    assert got["turns_sha256"] == hashlib.sha256(f"user\n{say}\nassistant\n{say}\n".encode()).hexdigest()
    assert got["loss_sha256"] == hashlib.sha256(say.encode()).hexdigest()


def test_very_long_conversations(spark):
    """Work grows in proportion to the turns of one conversation; places stay exact."""
    n = 20_000
    role, text = F.when(F.col("id") % 3 == 1, "assistant").otherwise("user"), F.concat(F.lit("é 🙂 </s>"), F.col("id").cast("string"))
    df = spark.range(n).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), text.alias("text"))
    done = chat.format_chat(df)
    r = done.withColumn("loss", chat.read_loss(F.col("formatted"), F.col("loss_spans"))).withColumn("turns", chat.read_turns(F.col("formatted"))).first()
    assert r["loss"] == "".join(f"é 🙂 </s>{i}" for i in range(n) if i % 3 == 1)
    assert [t["text"] for t in r["turns"]] == [f"é 🙂 </s>{i}" for i in range(n)]
    for s in (r["loss_spans"][0], r["loss_spans"][-1]):
        assert r["formatted"][s["start"] : s["end"]].startswith("é 🙂 <\\/s>")
