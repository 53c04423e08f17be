import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from starling.llm import chat, queries

FOLDER = "/root/testdata/sf0.01"
SCHEMA = "conv_id bigint, turn bigint, role string, text string"


@pytest.fixture(scope="module")
def model(spark):
    said = chat.transcripts(queries.table(spark, FOLDER, "conversations"))
    return chat.fit(said.where("conv_id % 5 != 0"))


def test_speakers():
    marks = {"User: hi": "user", "human : x": "user", "### Response: y": "assistant", "[System] z": "system", "Q: w": "user",
             "A: w": "assistant", "**Bot:** w": "assistant", "<|assistant|>": "assistant", "Someone: w": "?"}
    assert {line: chat.speaker(line)[0] for line in marks} == marks
    for line in ("", "plain words", "user", "at 12:30 then", "Theusual thing"):
        assert chat.speaker(line) == ("", 0)
    assert "User: hi there"[chat.speaker("User: hi there")[1]:] == "hi there"


def test_path_is_the_likeliest_of_all():
    pick = np.random.default_rng(2)
    names = ["assistant", "assistant+", "user+"]
    for _ in range(20):
        values = {(k, v): np.log(pick.dirichlet(np.ones(3))) for k, v in [(0, ""), (0, "user"), (1, "first"), (1, "after text"),
                                                                         (1, "after blank")]}
        model = chat.ChatModel(names, np.log(pick.dirichlet(np.ones(3))), np.log(pick.dirichlet(np.ones(3), 3)), values,
                               np.full((5, 3), -2.0))
        lines = ["User: a", "", "b?", "c"][:pick.integers(1, 5)]
        seen = chat.observed(lines)

        def weight(path):
            total = model.start[path[0]] + sum(model.step[a, b] for a, b in zip(path, path[1:]))
            return total + sum(values.get((k, v), model.unseen[k])[s] for s, shown in zip(path, seen)
                               for k, v in enumerate(shown))

        best = max(itertools.product(range(3), repeat=len(lines)), key=weight)
        assert np.isclose(weight([names.index(s) for s in model.path(lines)]), weight(best))


def test_every_role_is_a_state(spark):
    """Twelve roles, each with lines of its own length and ending."""
    pick = random.Random(2)
    said = {f"role{i:02}": "w" * (1, 16, 32, 64, 128, 256)[i % 6] + ("." if i < 6 else "?") for i in range(12)}
    rows = []
    for _ in range(80):
        roles = [pick.choice(list(said)) for _ in range(12)]
        rows.append(([said[r] for r in roles], [r + chat.OPENS for r in roles]))
    fitted = chat.fit(spark.createDataFrame(rows, "lines array<string>, states array<string>"))
    assert fitted.states == sorted(r + chat.OPENS for r in said)
    lines = [said[r] for r in said] * 2
    assert fitted.path(lines) == [r + chat.OPENS for r in said] * 2


def test_held_out_roles(spark):
    out = queries.op8_chat(spark, FOLDER)
    held = out.where("held_out")
    assert held.where("all_right").count() >= 0.9 * held.count() > 0
    assert out.count() == queries.table(spark, FOLDER, "conversations").select("conv_id").distinct().count()


def test_rendering(spark, model):
    text = "User: What is it?\nA second line.\n\nAssistant: It is that.\n\nUser: Thanks."
    row = spark.createDataFrame([(text,)], "t string").select(chat.parse(spark, model, F.col("t")).alias("p")).first()["p"]
    assert [tuple(t) for t in row["turns"]] == [
        ("user", "What is it?\nA second line."), ("assistant", "It is that."), ("user", "Thanks.")]
    assert row["rendered"] == ("<|user|>\nWhat is it?\nA second line.\n<|end|>\n<|assistant|>\nIt is that.\n<|end|>\n"
                               "<|user|>\nThanks.\n<|end|>\n")


def test_transcripts(spark):
    rows = [(1, 1, "assistant", "two\nlines"), (1, 0, "user", "one"), (1, 0, "user", "one"), (2, 0, None, None),
            (None, None, "user", "x"), (3, 300, "user", "late"), (3, 1, "user", "early")]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("_k", F.lit(1)).withColumn("part", F.lit(2))
    out = {(r["conv_id"], r["part"]["_part"]): r for r in chat.transcripts(df).collect()}
    assert set(out) == {(1, 0), (2, 0), (None, -1), (3, 0), (3, 1)}
    one = out[1, 0]
    assert one["roles"] == ["user", "assistant"] and one["transcript"] == "\n".join(one["lines"])
    assert one["states"] == ["user+", "user", "assistant+", "assistant"]
    assert one["lines"][1] == "" and one["lines"][2].endswith("two") and one["lines"][3] == "lines"
    assert chat.transcripts(df.limit(0)).collect() == []


def test_crowded_conversation_is_dealt_out(spark):
    rows = [(7, 0, "user", f"turn {i}") for i in range(3000)]
    out = chat.transcripts(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sum(len(r["roles"]) for r in out) == 3000 and max(len(r["roles"]) for r in out) < 2 * chat.PART_TURNS


def test_odd_transcripts(spark, model):
    pick = random.Random(1)
    long = "\n".join(pick.choice(["User: a", "words here", "", "A: b?"]) for _ in range(20_000))
    texts = [None, "", "\n\n", "no marker at all", long, "日本語: はい", "User:"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    out = [r[0] for r in df.select(chat.parse(spark, model, F.col("t"))).collect()]
    assert out[0]["turns"] == out[1]["turns"] == [] and out[0]["rendered"] == ""
    assert len(out[3]["turns"]) == 1 and len(out[4]["turns"]) > 100
    nothing = chat.fit(spark.createDataFrame([], "lines array<string>, states array<string>"))
    assert nothing.turns("User: a") == []
