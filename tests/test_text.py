import random

from pyspark.sql import functions as F

from loomset.functions.render import chat_messages, render, render_chat
from loomset.functions.text import (
    WHITESPACE,
    is_solid,
    py_strip,
    solid_length,
    utf8_ids,
    words,
)


def samples():
    rng = random.Random(3)
    pool = list(WHITESPACE) + list("ab​᠎é😀中")
    return ["".join(rng.choices(pool, k=rng.randint(0, 12))) for _ in range(300)] + ["", " ", "a"]


def test_whitespace_is_the_python_set():
    assert set(WHITESPACE) == {chr(i) for i in range(0x110000) if chr(i).isspace()}


def test_strip_and_words_follow_python(spark):
    df = spark.createDataFrame([(t,) for t in samples()], "t string")
    rows = df.select("t", py_strip(F.col("t")).alias("s"), words(F.col("t")).alias("w")).collect()
    for row in rows:
        assert row.s == row.t.strip()
        assert row.w == row.t.split()


def test_solid(spark):
    df = spark.createDataFrame([(t,) for t in samples()], "t string")
    rows = df.select(
        "t", solid_length(F.col("t")).alias("n"), is_solid(F.col("t"), 5).alias("ok")
    ).collect()
    for row in rows:
        n = len(row.t.replace("\n", "").replace(" ", "").replace("\t", ""))
        assert row.n == n and row.ok == (n >= 5)


def test_cjk_words(spark):
    df = spark.createDataFrame([("你好 world ok吗",)], "t string")
    assert df.select(words(F.col("t"), "cjk_char")).first()[0] == ["你", "好", "world", "ok", "吗"]


def test_utf8_ids(spark):
    texts = ["", "abc", "é😀", None, "x" * 50]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r.ids for r in df.select("i", utf8_ids(F.col("t"), 5).alias("ids")).collect()}
    for i, t in enumerate(texts):
        assert got[i] == (None if t is None else list(t.encode()[:5]))


def one(spark, column):
    return spark.range(1).select(column).first()[0]


def test_render(spark):
    p, r, s, c, e = (F.lit(x) for x in ("P", "R", "S", "C", ""))
    full = "<|im_start|>system\nS<|im_end|>\n<|im_start|>user\nP<|im_end|>\n<|im_start|>assistant\nR<|im_end|>"
    assert one(spark, render("instruction", p, r, s, e)) == full
    assert one(spark, render("instruction", e, r, s, e)) == "R"
    assert one(spark, render("text_completion", p, r, s, e)) == "P\nR"
    assert one(spark, render("chat", p, r, s, c)) == "P\nR"
    assert one(spark, render("text_completion", e, r, s, e)) == "R"
    assert one(spark, render("cot", p, r, s, c)) == full.replace("\nR<", "\n让我们一步步思考：C\nR<")
    assert one(spark, render("cot", p, r, s, e)) == "R"
    assert one(spark, render("classification", e, r, s, e)) == full.replace("P", "")


def test_render_chat(spark):
    p, r, s, e = (F.lit(x) for x in ("P", "R", "S", ""))
    text = one(spark, render_chat(chat_messages("cot", p, r, e, F.lit("C"))))
    assert text == (
        "<|im_start|>user\nP<|im_end|>\n<|im_start|>assistant\n让我们一步步思考：C\nR<|im_end|>\n"
        "<|im_start|>assistant\n"
    )
    text = one(spark, render_chat(chat_messages("instruction", p, r, s, e), False))
    assert text.startswith("<|im_start|>system\nS<|im_end|>\n") and text.endswith("R<|im_end|>\n")
