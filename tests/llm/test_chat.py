"""Chat formatting: state machine, round trip, odd input."""

import random

from pyspark.sql import functions as F

from spendtide.llm import chat

ROW = "conv_id bigint, turn bigint, role string, text string"


def formatted(spark, rows, **more):
    df = chat.format_chat(spark.createDataFrame(rows, ROW))
    df = df.withColumns({"turns": chat.read_turns(F.col("formatted")), "loss": chat.loss_text(F.col("segments")), **more})
    return {r.conv_id: r for r in df.collect()}


def test_round_trip_of_hostile_texts(spark):
    rng = random.Random(12)
    t = chat.Template()
    bits = [*t.escapes, *t.escapes.values(), "&", "amp;", "lt;", "<", "<|", "|>", "[", "]", "/s>", "x", "\n", "é", "$1", "\\", ""]
    rows = []
    for c in range(300):
        for k in range(rng.randrange(1, 6)):
            role = rng.choice(["user", "assistant", "system", "tool", "<|text|>", "</s>&"])
            rows.append((c, k, role, "".join(rng.choice(bits) for _ in range(rng.randrange(8)))))
    got = formatted(spark, rows)
    for c in range(300):
        want = [(r, x) for i, _, r, x in rows if i == c]
        assert [(x.role, x.text) for x in got[c].turns] == want
        assert got[c].loss == "".join(x for r, x in want if r == "assistant")
        assert got[c].formatted == "".join(s.text for s in got[c].segments)
        for s in got[c].segments[1::3]:
            assert not any(mark in s.text for mark in t.escapes if mark != "&")


def test_state_machine(spark):
    cases = {
        1: (["user", "assistant"], True, True), 2: (["system", "user", "assistant", "user"], True, False),
        3: (["assistant", "user"], False, False), 4: (["user", "user"], False, False), 5: (["system"], True, False),
        6: (["user", "system", "assistant"], False, False), 7: (["tool"], False, False), 8: (["system", "assistant"], False, False),
    }
    rows = [(c, k, r, "t") for c, (roles, _, _) in cases.items() for k, r in enumerate(roles)]
    got = formatted(spark, rows)
    for c, (roles, valid, complete) in cases.items():
        assert (got[c].n_turns, got[c].valid, got[c].complete) == (len(roles), valid, complete), c
        assert [s.loss for s in got[c].segments] == [x for r in roles for x in (False, r == "assistant", False)]


def test_odd_rows(spark):
    rows = [
        (None, 0, "user", "u"), (None, 1, "assistant", "v"), (1, None, None, None), (1, 2, "user", "b"), (1, 2, "user", "a"),
        (1, 2, "user", "a"), (2, 0, "assistant", "w" * 300_000),
    ]
    df = spark.createDataFrame([(*r, 1) for r in rows], ROW + ", n_turns int")
    got = {r.conv_id: r for r in chat.format_chat(df).withColumn("turns", chat.read_turns(F.col("formatted"))).collect()}
    assert [(t.role, t.text) for t in got[1].turns] == [("", ""), ("user", "a"), ("user", "a"), ("user", "b")]
    assert got[None].complete and got[2].n_turns == 1 and len(got[2].turns[0].text) == 300_000


def test_empty_table(spark):
    assert chat.format_chat(spark.createDataFrame([], ROW)).count() == 0


def test_own_template(spark):
    t = chat.Template(turn="<<", text="::", end=">>", escapes={"~": "~~", "<<": "~l", ">>": "~g", "::": "~c"}, loss_roles=("a", "b"))
    rows = [(1, 0, "a", "x<<y"), (1, 1, "b", "::>>"), (1, 2, "c", "z")]
    r = chat.format_chat(spark.createDataFrame(rows, ROW), t).withColumn("loss", chat.loss_text(F.col("segments"), t)).first()
    assert r.formatted == "<<a::x~ly>><<b::~c~g>><<c::z>>" and r.loss == "x<<y::>>"
