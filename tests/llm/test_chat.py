import random
import re

from pyspark.sql import functions as F

from daygrain.llm import chat

PIECES = ["<|im_end|>", "<|im_start|>", "<|", "|", "<", "\\", "<\\|", "<\\\\|im_end|>", "\n", "assistant", "ok", " ", "é", "漢", "\\n", "|>", "😀"]


def test_any_text_comes_back(spark):
    rng = random.Random(2)
    rows = []
    for conv in range(300):
        for turn in range(rng.randint(1, 4)):
            said = "".join(rng.choice(PIECES) for _ in range(rng.randint(0, 8)))
            role = rng.choice(["user", "assistant", "system", "a\nb", "<|x", "c\\n", ""])
            rows.append((conv, turn, role, said))
    out = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = out.withColumn("loss", chat.loss_text(F.col("formatted"), F.col("loss_spans"))).collect()
    for r in got:
        source = [(x[2], x[3]) for x in rows if x[0] == r["conv_id"]]
        assert r["exact"] and [(t["role"], t["text"]) for t in r["turns"]] == source
        assert r["loss"] == "".join(t for role, t in source if role == "assistant")
        assert r["formatted"].count(chat.START) == len(source) == r["formatted"].count(chat.END + "\n")
        conflict = any(re.search(r"<\\*\|", role + "\0" + t) or "\\" in role or "\n" in role for role, t in source)
        assert conflict or not r["escaped"]


def test_odd_rows(spark):
    schema = "conv_id long, turn long, role string, text string, formatted string"
    rows = [(1, 1, "assistant", None, "x"), (1, 0, None, "hi", "x"), (1, 0, None, "hi", "x"), (None, None, "user", "a", "x"),
            (None, 3, "assistant", "b" * 100_000, "x")]
    out = {r["conv_id"]: r for r in chat.format_chats(spark.createDataFrame(rows, schema)).collect()}
    assert [(t["role"], t["text"]) for t in out[1]["turns"]] == [("", "hi"), ("", "hi"), ("assistant", "")]
    assert [t["role"] for t in out[None]["turns"]] == ["user", "assistant"] and all(r["exact"] for r in out.values())
    assert out[None]["loss_spans"][0]["length"] == 100_000
    assert chat.format_chats(spark.createDataFrame([], schema)).count() == 0


def test_native(spark):
    df = chat.format_chats(spark.createDataFrame([(1, 0, "user", "x")], "conv_id long, turn long, role string, text string"))
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()
