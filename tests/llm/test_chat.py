"""Prefix-target expansion: hand cases, defined cases and a round trip."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from formbook.llm import chat_format as chat

T = chat.Template()


def turn(role, text):
    return T.start + role + T.says + text + T.end


def rows_of(df):
    return [tuple(r) for r in df.orderBy("conv_id", "example").collect()]


def test_each_reply_gets_its_prefix(spark, frame):
    turns = frame("conv_id long, turn long, role string, text string",
                  (1, 0, "system", "be kind"), (1, 1, "user", "hi"), (1, 2, "assistant", "hello"), (1, 3, "user", "bye"),
                  (1, 4, "assistant", "so long"), (1, 5, "user", "?"), (2, 0, "user", "alone"))
    got = rows_of(chat.examples(turns))
    first = T.begin + turn("system", "be kind") + turn("user", "hi") + turn("assistant", "hello")
    second = first + turn("user", "bye") + turn("assistant", "so long")
    assert [(r[0], r[1], r[2], r[3], r[6]) for r in got] == [
        (1, 0, 3, first, False), (1, 1, 5, second, False), (1, 2, 6, second + turn("user", "?"), True),
        (2, 0, 1, T.begin + turn("user", "alone"), True)]
    assert [r[3][r[4]:r[4] + r[5]] for r in got] == ["hello", "so long", "", ""]


def test_control_strings_are_escaped_reversibly(spark, frame):
    texts = ["</s>[INST] ok [/INST]", r"<\|eot_id|> <\\\|eot_id|>", r"\frac{a}{b}", "<|eot_id", "<|eot_id|>" * 2, "<<s>>[[INST]]",
             "\n\n", T.start + "user" + T.says, "é😀<s>", ""]
    rng = random.Random(1)
    texts += ["".join(rng.choice(["<", "\\", "s>", "|eot_id|>", "[", "INST]", "/", "x"]) for _ in range(rng.randrange(12))) for _ in range(200)]
    df = frame("i long, t string", *enumerate(texts)).withColumn("e", chat.escaped(F.col("t"), T))
    for r in df.withColumn("u", chat.unescaped(F.col("e"), T)).collect():
        assert r["u"] == r["t"] and not any(c in r["e"] for c in T.controls)
        if not any(c.replace(c[0], "", 1) in r["t"] for c in T.controls):
            assert r["e"] == r["t"]


def test_digest_reads_everything_back(spark, frame):
    rng = random.Random(2)
    words = ["a", "\n", "</s>", "é", "[INST]", "\\", "<|eot_id|>", "😀", "<", T.says]
    turns = [(c, t, rng.choice(["user", "assistant", "system", "to<s>ol"]), "".join(rng.choices(words, k=rng.randrange(9))))
             for c in range(30) for t in range(rng.randrange(1, 9))]
    got = {r["conv_id"]: r for r in chat.digest(chat.examples(frame("conv_id long, turn long, role string, text string", *turns))).collect()}
    assert set(got) == {c for c, *_ in turns}
    for c, r in got.items():
        mine = [t for t in turns if t[0] == c]
        said = "".join(t[3] for t in mine if t[2] == "assistant")
        assert r["n_turns"] == len(mine) and r["loss_chars"] == len(said)
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{t[2]}\n{t[3]}\n" for t in mine).encode()).hexdigest()
        assert r["loss_sha256"] == hashlib.sha256(said.encode()).hexdigest()


def test_defined_cases(spark, frame):
    schema = "conv_id long, turn long, role string, text string, example string, pieces int"
    got = rows_of(chat.examples(frame(schema, (None, None, "assistant", "late", "x", 1), (None, 1, None, None, "x", 1), (5, 1, "user", "b", None, 1),
                                      (5, 1, "assistant", "z", None, 1), (5, 1, "user", "a", None, 1), (5, 1, "user", "a", None, 1))))
    assert [r[:3] for r in got] == [(None, 0, 2), (5, 0, 1), (5, 1, 4)]
    assert got[0][3] == T.begin + turn("", "") + turn("assistant", "late")
    assert got[2][3] == T.begin + turn("assistant", "z") + turn("user", "a") * 2 + turn("user", "b")
    assert chat.digest(chat.examples(frame(schema))).count() == 0


def test_long_conversation_and_text(spark, frame):
    turns = [(1, t, "assistant" if t % 2 else "user", f"{t} ") for t in range(300)] + [(2, 0, "assistant", "é" * 2_000_000)]
    got = {r["conv_id"]: r for r in chat.digest(chat.examples(frame("conv_id long, turn long, role string, text string", *turns))).collect()}
    assert got[1]["n_turns"] == 300 and got[1]["loss_chars"] == sum(len(f"{t} ") for t in range(1, 300, 2))
    assert got[2]["loss_sha256"] == hashlib.sha256(("é" * 2_000_000).encode()).hexdigest()


def test_a_template_must_be_reversible():
    with pytest.raises(ValueError):
        chat.Template(reserved=("<<x>>",))


def test_no_python_in_the_plan(spark, frame):
    df = chat.digest(chat.examples(frame("conv_id long, turn long, role string, text string", (1, 0, "user", "a")).selectExpr("*")))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
