"""Chat formatting: what is read back from the formatted text is what went in."""

import random
from collections import defaultdict

import pytest
from clausewise.llm import chat_format
from pyspark.sql import functions as F

PIECES = ["<", ">", "/", "s", "</s>", "<s>", "[INST]", "[/INST]", "[", "]", "\\", "INST", "IMG:1", "[IMG:2]", "[+]", "+",
          "<\\/s>", "[\\\\INST]", "$1", "\n", "é", "日", " ok "]


def nasty(r):
    return "".join(r.choice(PIECES) for _ in range(r.randint(0, 9)))


def test_escape_is_reversible(spark):
    r = random.Random(8)
    texts = [nasty(r) for _ in range(3000)] + PIECES
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    e = df.select("t", chat_format.escape(F.col("t")).alias("e")).withColumn("u", chat_format.unescape(F.col("e")))
    for t, e, u in e.collect():
        assert u == t
        assert not any(c in e for c in ("</s>", "<s>", "[INST]", "[/INST]", "[+]", "[IMG:2]"))


def read(df):
    return df.select("*", chat_format.read_turns(F.col("formatted")).alias("turns"),
                     chat_format.read_loss(F.col("formatted"), F.col("loss")).alias("learned")).collect()


def test_turns_and_loss_come_back(spark):
    r = random.Random(9)
    rows = [(c, t, r.choice(["user", "assistant", "system", nasty(r)]), nasty(r))
            for c in range(40) for t in r.sample(range(90), r.randint(1, 12))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    chats = defaultdict(list)
    for c, *turn in sorted(rows):
        chats[c].append(turn)
    found = read(chat_format.format_chat(df))
    assert sorted(x["conv_id"] for x in found) == sorted(chats)
    for x in found:
        want = chats[x["conv_id"]]
        assert [(t["role"], "".join(t["parts"])) for t in x["turns"]] == [(role, text) for _, role, text in want]
        assert x["learned"] == [text for _, role, text in want if role == "assistant"]
        assert x["formatted"].count("</s>") == len(want)


def test_typed_parts(spark):
    part = lambda kind, text=None, ref=None, w=None, h=None, s=None, n=None: (kind, text, ref, w, h, s, n)
    rows = [
        (1, 0, "user", [part("text", "look [IMG:0]"), part("image", ref="a.png", w=57, h=28), part("text", "</s>"),
                        part("audio", ref="b.wav", s=1.5)]),
        (1, 1, "assistant", [part("text", "</"), part("text", "s>"), part("image", ref="c.png", w=28, h=28),
                             part("text", "")]),
        (1, 2, "assistant", [part("document", ref="d.pdf", n=3), part("odd", "kept"), part("audio")]),
        (1, 3, "user", None), (1, 4, None, []),
    ]
    df = spark.createDataFrame(rows, f"conv_id long, turn long, role string, content array<{chat_format.PART}>")
    x, = read(chat_format.format_chat(df))
    assert [(t["role"], t["parts"]) for t in x["turns"]] == [
        ("user", ["look [IMG:0]", "[IMG:1]", "</s>", "[AUDIO:3]"]),
        ("assistant", ["</", "s>", "[IMG:2]", ""]), ("assistant", ["[DOC:0]", "kept", "[AUDIO:2]"]), ("user", [""]), ("", [""])]
    assert [tuple(a) for a in x["attachments"]] == [
        (0, 1, "image", "a.png", 3), (0, 3, "audio", "b.wav", 38), (1, 2, "image", "c.png", 1),
        (2, 0, "document", "d.pdf", 3072), (2, 2, "audio", None, 0)]
    assert x["attachment_tokens"] == 3 + 38 + 1 + 3072
    assert x["learned"] == ["</", "s>", "", "kept"]


def test_odd_rows(spark):
    """Null ids, turns, roles and texts, repeated and tied turns, clashing names, a long text."""
    rows = [(None, None, None, None), (None, 1, "user", ""), (2, 5, "user", "b"), (2, 5, "user", "b"), (2, 5, "assistant", "z"),
            (2, None, "assistant", "first"), (3, 0, "assistant", "x" * 300_000 + "</s>")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    df = df.select("*", *[F.lit(i).alias(c) for i, c in enumerate(("t", "turns", "parts", "loss", "piece", "formatted", "attachments"))])
    found = {x["conv_id"]: x for x in read(chat_format.format_chat(df))}
    assert [(t["role"], t["parts"]) for t in found[None]["turns"]] == [("", [""]), ("user", [""])]
    assert [(t["role"], t["parts"][0]) for t in found[2]["turns"]] == [
        ("assistant", "first"), ("assistant", "z"), ("user", "b"), ("user", "b")]
    assert found[3]["learned"] == ["x" * 300_000 + "</s>"]


def test_empty(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert read(chat_format.format_chat(df)) == []


def test_no_python_in_the_plan(spark):
    df = spark.createDataFrame([(1, 0, "user", "a")], "conv_id long, turn long, role string, text string")
    plan = chat_format.format_chat(df)._jdf.queryExecution().executedPlan().toString()
    assert not any(w in plan for w in ("Python", "Pandas", "Arrow"))


@pytest.mark.parametrize("n", [1, 3000])
def test_long_conversations(spark, n):
    df = spark.range(n).select(F.lit(5).alias("conv_id"), F.col("id").alias("turn"), F.lit("assistant").alias("role"),
                               F.concat(F.lit("é</s>"), F.col("id").cast("string")).alias("text"))
    x, = read(chat_format.format_chat(df.repartition(4)))
    assert x["learned"] == [f"é</s>{i}" for i in range(n)]
