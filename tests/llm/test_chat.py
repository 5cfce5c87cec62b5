import hashlib

from pyspark.sql import functions as F

from hushframe.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, parts string, turns int"
ROWS = [
    (1, 0, "system", "be </s> good\\", "p", 1), (1, 1, "user", "<|end|>hi\n[INST]", "p", 1), (1, 2, "user", "<|turn|>\\<\\|", None, 1), (1, 3, "assistant", "ok <", None, 1), (1, 4, "assistant", "|x|>", None, 1), (1, 5, "user", None, "p", 1),
    (2, 0, "assistant", "", "p", 1), (2, 0, "assistant", "", "p", 1), (2, 0, None, "tie", "p", 1), (2, None, "<|body|>", "né 𝒳", "p", 1),
    (None, 1, "assistant", "no id", "p", 1), (3, 1, "assistant", "long " * 50000, "p", 1),
]


def order(r):
    return (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")


def test_round_trip(spark):
    made = chat.format_chats(spark.createDataFrame(ROWS, SCHEMA).repartition(5))
    assert made.columns == ["conv_id", "formatted", "loss_spans", "n_turns", "n_blocks"]
    got = {r.conv_id: r for r in made.select("*", chat.read_turns(F.col("formatted")).alias("turns"), chat.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()}
    for conv in {r[0] for r in ROWS}:
        rows = sorted((r for r in ROWS if r[0] == conv), key=order)
        assert [tuple(x) for x in got[conv].turns] == [(r[2] or "", r[3] or "") for r in rows]
        assert got[conv].loss == [r[3] or "" for r in rows if r[2] == "assistant"]
        assert got[conv].n_turns == len(rows)
        assert got[conv].n_blocks == sum(i == 0 or (rows[i - 1][2] or "") != (r[2] or "") for i, r in enumerate(rows))
    text = got[1].formatted
    assert text.count("<|end|>") == 4 and text.count("<|also|>") == 2
    assert "</s>" not in text and "[INST]" not in text


def test_many_turns_and_empty(spark):
    rows = [(9, i, "user" if i % 3 else "assistant", f"t{i}", "", 0) for i in range(700)]
    made = chat.format_chats(spark.createDataFrame(rows, SCHEMA))
    loss = made.select(F.array_join(chat.read_loss(F.col("formatted"), F.col("loss_spans")), "").alias("x")).first().x
    assert hashlib.sha256(loss.encode()).digest() == hashlib.sha256("".join(r[3] for r in rows if r[2] == "assistant").encode()).digest()
    assert chat.format_chats(spark.createDataFrame([], SCHEMA)).count() == 0
