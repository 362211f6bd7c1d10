import json

import pytest
from pyspark.sql import functions as F

from loomset.operators.formats import detect_format, format_expr, to_pair


def frame(spark, records):
    rows = [("f", 0, i, json.dumps(r)) for i, r in enumerate(records)]
    df = spark.createDataFrame(rows, "path string, block_start long, rid long, json string")
    return df.withColumn("raw", F.try_parse_json("json"))


CASES = [
    ({"instruction": "i", "output": "o"}, "alpaca"),
    ({"instruction": None, "output": None, "messages": [{"role": "user"}]}, "alpaca"),
    ({"conversations": [{"from": "human", "value": "x"}], "text": "t"}, "sharegpt"),
    ({"conversations": [], "text": "t"}, "plain_text"),
    ({"conversations": "from", "messages": [{"role": "user", "content": "x"}]}, "chatml"),
    ({"messages": [{"content": "x"}], "Question": 1, "Complex_CoT": 2, "Response": 3}, "cot"),
    ({"Question": 1, "Response": 3, "text": None}, "plain_text"),
    ({"answer": "x"}, "general_json"),
    ({}, "general_json"),
    ([1], "general_json"),
]


def test_rules(spark):
    df = frame(spark, [r for r, _ in CASES])
    got = [r.f for r in df.orderBy("rid").select(format_expr(F.col("raw")).alias("f")).collect()]
    assert got == [f for _, f in CASES]


def test_modes(spark):
    df = frame(spark, [{"text": "x"}, {"instruction": 1, "output": 2}])
    df = df.unionByName(df.withColumn("path", F.lit("a")).where("rid = 1"))
    rows = lambda mode: sorted(
        (r.path, r.rid, r.fmt) for r in detect_format(df, mode).collect()
    )
    assert {f for *_, f in rows("first")} == {"alpaca"}
    assert rows("per_file") == [("a", 1, "alpaca"), ("f", 0, "plain_text"), ("f", 1, "plain_text")]
    assert rows("per_record") == [("a", 1, "alpaca"), ("f", 0, "plain_text"), ("f", 1, "alpaca")]
    empty = detect_format(df.where("rid > 9"), "first")
    assert "fmt" in empty.columns and empty.count() == 0
    with pytest.raises(ValueError):
        detect_format(df, "guess")


def pairs(spark, fmt, records, **kw):
    rows = to_pair(frame(spark, records), fmt, "S", **kw).orderBy("rid").collect()
    return ["error" if r.error else (r.prompt, r.response, r.cot) for r in rows]


def test_alpaca(spark):
    assert pairs(
        spark,
        "alpaca",
        [
            {"instruction": "i", "input": "", "output": "o"},
            {"instruction": "i", "output": 5},
            {"instruction": "i", "input": "n"},
            "text",
        ],
    ) == [("i", "o", ""), ("i", "5", ""), ("i\nn", "", ""), "error"]


def test_values_that_count_as_no_input(spark):
    inputs = ["", None, 0, False, [], {}, "0", "false", " ", 3, ["x"]]
    got = pairs(spark, "alpaca", [{"instruction": "i", "input": v, "output": "o"} for v in inputs])
    assert [p for p, *_ in got] == ["i"] * 6 + ["i\n0", "i\nfalse", "i\n ", "i\n3", 'i\n["x"]']


def turns(*said):
    return {"conversations": [{"from": f, "value": v} for f, v in said]}


def test_sharegpt_pairs(spark):
    assert pairs(
        spark,
        "sharegpt",
        [
            turns(("human", "a"), ("gpt", "b")),
            turns(("gpt", "b")),
            turns(("human", "a"), ("human", "c")),
            turns(("gpt", "same"), ("system", "s"), ("gpt", "same")),
            turns(("human", "a"), ("tool", "t"), ("human", "b")),
            {"conversations": [{"from": "human"}]},
            {"conversations": 3},
            {},
        ],
    ) == [
        ("a", "b", ""), ("", "b", ""), ("c", "", ""), ("助手: same", "same", ""),
        ("用户: a\n用户: b", "", ""), "error", "error", ("", "", ""),
    ]


def test_chatml_pairs(spark):
    def record(*said):
        return {"messages": [{"role": r, "content": c} for r, c in said]}

    records = [
        record(("system", "s"), ("user", "u"), ("assistant", "a")),
        record(("user", "u1"), ("assistant", "a1"), ("user", "u2")),
        record(("user", "u"), ("assistant", "a"), ("assistant", "")),
        {"messages": [{"role": "user"}]},
        {},
    ]
    expected = [("u", "a", ""), ("u2", "a1", ""), ("u", "a", ""), "error", ("", "", "")]
    assert pairs(spark, "chatml", records) == expected
    expected[1] = ("u1", "a1", "")
    assert pairs(spark, "chatml", records, strict_pair=True) == expected


def test_other_layouts(spark):
    assert pairs(spark, "cot", [{"Question": "q", "Complex_CoT": "c", "Response": "r"}, {}]) == [
        ("q", "r", "c"), ("", "", ""),
    ]
    assert pairs(spark, "plain_text", [{"text": "t"}]) == [("", "t", "")]
    assert pairs(
        spark,
        "general_json",
        [
            {"query": "x", "q": "y", "content": "c"},
            {"input": None, "prompt": "p", "answer": True},
            {"output": {"k": 1}, "response": "r"},
        ],
    ) == [("y", "c", ""), ("", "true", ""), ("", '{"k":1}', "")]


def test_prebuilt(spark):
    rows = to_pair(
        frame(spark, [{"_prebuilt": True, "prompt": "p", "system": "own"}]), "alpaca", "S"
    ).collect()
    assert (rows[0].prompt, rows[0].response, rows[0].system) == ("p", "", "own")
