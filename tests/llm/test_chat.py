"""Chat formatting: parts, escapes, masks and reading back."""

import random

from pyspark.sql import functions as F

from depscope.llm import chat

SCHEMA = f"conv_id long, turn long, role string, parts array<{chat.PART}>, formatted string"


def _part(kind, text=None, ref=None, width=None, height=None, seconds=None, pages=None):
    return (kind, text, ref, width, height, seconds, pages)


def test_parts_become_placeholders_in_order(spark):
    rows = [
        (1, 0, "user", [_part("text", "see "), _part("image", ref="a.png", width=57, height=28), _part("text", " and "), _part("audio", ref="b.wav", seconds=1.5)], "x"),
        (1, 1, "assistant", [_part(None, "fine"), _part("document", ref="c.pdf", pages=2), _part("smell", ref="d")], "x"),
        (1, 2, "user", None, "x"),
    ]
    got = chat.format_conversations(spark.createDataFrame(rows, SCHEMA)).collect()[0]
    mark = lambda kind, n: f"{chat.ATTACH}{kind}|{n}{chat.CLOSE}"
    turn = lambda role, body: chat.TURN + role + chat.TEXT + body + chat.END
    assert got.formatted == turn("user", f"see {mark('image', 3)} and {mark('audio', 38)}") + turn(
        "assistant", f"fine{mark('document', 1024)}{mark('smell', 1)}") + turn("user", "")
    assert [tuple(a) for a in got.attachments] == [
        (0, 1, "image", "a.png", 3), (0, 3, "audio", "b.wav", 38), (1, 1, "document", "c.pdf", 1024), (1, 2, "smell", "d", 1)]
    assert [(s.turn, s.start) for s in got.loss] == [(1, len("assistant" + chat.TEXT))]


def test_escapes_are_reversible_and_hide_all_control_strings(spark):
    r = random.Random(1)
    pieces = [*chat.CONTROLS, "\\", ".", "<", "[", "|>", "<|", "INST]", "a", "\\.", "</", "s>", "\n", "é"]
    texts = ["".join(r.choice(pieces) for _ in range(r.randint(0, 12))) for _ in range(2000)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat.escape(F.col("t")).alias("e"))
    for row in rows.withColumn("u", chat.unescape(F.col("e"))).collect():
        assert row.u == row.t
        assert not any(c in row.e for c in chat.CONTROLS)


def test_read_back_with_nulls_ties_and_repeats(spark):
    rows = [
        (1, 1, "assistant", "b"), (1, 1, "assistant", "a"), (1, 1, "assistant", "a"), (1, None, "user", None), (1, 0, None, "</s>[INST] ok [/INST]"),
        (None, 0, "assistant", "<|turn|>x"), (2, 0, "user<|text|>", "y"),
    ]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    done = chat.format_conversations(turns.withColumn("parts", chat.text_part(F.col("text"))))
    got = {r.conv: r for r in done.select("conv", "n_turns", chat.read_back(F.col("formatted")).alias("read"), chat.under_loss(F.col("formatted"), F.col("loss")).alias("m")).collect()}
    assert [tuple(t) for t in got[1].read] == [("user", ""), ("", "</s>[INST] ok [/INST]"), ("assistant", "a"), ("assistant", "a"), ("assistant", "b")]
    assert got[1].m == "aab" and got[1].n_turns == 5
    assert [tuple(t) for t in got[None].read] == [("assistant", "<|turn|>x")] and got[None].m == "<|turn|>x"
    assert [tuple(t) for t in got[2].read] == [("user<|text|>", "y")]
    assert chat.format_conversations(turns.limit(0).withColumn("parts", chat.text_part(F.col("text")))).count() == 0


def test_parts_come_back_typed_and_placeholders_are_not_trained(spark):
    spelled = f"{chat.ATTACH}image|1{chat.CLOSE}"
    rows = [
        (1, 0, "assistant", [_part("text", spelled), _part("image", ref="a"), _part("text", "after"), _part("text", "")], "x"),
        (1, 1, "user", [_part("a|b<|text|>", ref="c"), _part("text", "é")], "x"),
        (1, 2, "assistant", [_part("audio", seconds=2.0)], "x"),
        (1, 3, "assistant", [], "x"),
    ]
    done = chat.format_conversations(spark.createDataFrame(rows, SCHEMA))
    got = done.select("loss", chat.read_parts(F.col("formatted")).alias("turns"), chat.under_loss(F.col("formatted"), F.col("loss")).alias("masked")).first()
    assert [(t.role, [tuple(p) for p in t.parts]) for t in got.turns] == [
        ("assistant", [("text", spelled, None), ("image", None, 1), ("text", "after", None)]),
        ("user", [("a|b<|text|>", None, 1), ("text", "é", None)]),
        ("assistant", [("audio", None, 50)]), ("assistant", []),
    ]
    assert got.masked == spelled + "after" and [s.turn for s in got.loss] == [0, 0]
