import random

import pytest
from pyspark.sql import functions as F

from loomset.operators import dialogues, joins
from loomset.operators.dialogues import expand_dialogues, expand_turns, last_pair


def brute(turns, max_chars):
    """Expected rows per dialogue: (turn, prompt or None, response)."""
    out, lines = [], []
    for turn, role, text in sorted(turns):
        if role not in ("user", "assistant"):
            continue
        if role == "assistant" and lines:
            prompt = "\n".join(lines)
            out.append((turn, prompt if len(prompt) <= max_chars else None, text))
        lines.append(("用户: " if role == "user" else "助手: ") + text)
    return out


def random_dialogue(rng, n):
    numbers = rng.sample(range(10 * n + 1), n)
    return [
        (t, rng.choice(["user", "assistant", "assistant", "system", "tool"]), "x" * rng.choice([0, 1, 7, 30]))
        for t in numbers
    ]


def make(spark, dialogues_):
    rows = [(c, t, r, x) for c, turns in dialogues_.items() for t, r, x in turns]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def collect_turns(df):
    got = {}
    for r in df.collect():
        assert r.over_length == (r.prompt is None)
        got.setdefault(r.conv_id, []).append((r.turn, r.prompt, r.response))
    return {c: sorted(v, key=lambda x: x[0]) for c, v in got.items()}


@pytest.mark.parametrize("broadcast_rows", [100_000, 0])
def test_flat_expansion(spark, monkeypatch, broadcast_rows):
    """Dialogues beyond the head, with outliers in their numbering; joined both ways."""
    monkeypatch.setattr(joins, "BROADCAST_ROWS", broadcast_rows)
    monkeypatch.setattr(dialogues, "_RANGES", 8)
    rng = random.Random(5)
    data = {c: random_dialogue(rng, n) for c, n in enumerate([1, 2, 5, 40, 400, 700])}
    data[5] = [(t if t % 7 else t + 10**12, r, x) for t, r, x in data[5]]
    got = collect_turns(expand_turns(make(spark, data), max_chars=200))
    assert got == {c: b for c, t in data.items() if (b := brute(t, 200))}


@pytest.mark.parametrize("block", [1, 7, 64])
def test_whole_prompts(spark, monkeypatch, block):
    monkeypatch.setattr(dialogues, "_BLOCK", block)
    rng = random.Random(8)
    data = {c: random_dialogue(rng, n) for c, n in enumerate([1, 2, 5, 40, 200])}
    data[7] = [(0, "user", "y" * 20000), (1, "assistant", "a"), (-3, "system", "s"), (900, "assistant", "b")]
    want = {c: b for c, t in data.items() if (b := brute(t, 10**9))}
    assert collect_turns(expand_turns(make(spark, data))) == want
    rows = [(c, [(r, x) for _, r, x in sorted(t)]) for c, t in data.items()]
    df = spark.createDataFrame(rows, "conv_id long, m array<struct<role:string,content:string>>")
    got = {}
    for r in expand_dialogues(df, "m").orderBy("conv_id", "turn_pos").collect():
        got.setdefault(r.conv_id, []).append((r.prompt, r.response))
    assert got == {c: [x[1:] for x in b] for c, b in want.items()}


def test_nested_expansion(spark):
    rng = random.Random(6)
    data = {c: random_dialogue(rng, n) for c, n in enumerate([1, 2, 5, 40, 400])}
    data[9] = [(0, "user", "y" * 300), (1, "assistant", "a"), (2, "assistant", "b")]
    rows = [(c, [(r, x) for _, r, x in sorted(t)]) for c, t in data.items()]
    df = spark.createDataFrame(rows, "conv_id long, m array<struct<role:string,content:string>>")
    got = {}
    for r in expand_dialogues(df, "m", max_chars=200).orderBy("conv_id", "turn_pos").collect():
        assert r.over_length == (r.prompt is None)
        got.setdefault(r.conv_id, []).append((r.prompt, r.response))
    assert got == {c: [x[1:] for x in b] for c, t in data.items() if (b := brute(t, 200))}


def test_prompt_of_exactly_the_limit(spark):
    data = {1: [(0, "user", "x" * 196), (1, "assistant", "a"), (2, "assistant", "b")]}
    assert collect_turns(expand_turns(make(spark, data), max_chars=200))[1][0][1] is not None
    assert collect_turns(expand_turns(make(spark, data), max_chars=199))[1][0][1] is None


def test_labels(spark):
    data = {1: [(0, "user", "q"), (1, "assistant", "a")]}
    rows = expand_turns(make(spark, data), labels=("U ", "A ")).collect()
    assert [r.prompt for r in rows] == ["U q"]


def test_last_pair(spark):
    df = make(
        spark,
        {
            1: [(0, "user", "u"), (1, "assistant", "a"), (2, "user", "")],
            2: [(0, "system", "s")],
            3: [(0, "assistant", "a"), (1, "user", "v")],
        },
    )
    got = {r.conv_id: (r.prompt, r.response) for r in last_pair(df).collect()}
    assert got == {1: ("u", "a"), 2: ("", ""), 3: ("v", "a")}


def test_map_role(spark):
    df = spark.createDataFrame([("human",), ("gpt",), ("system",), ("tool",)], "r string")
    got = [r[0] for r in df.select(dialogues.map_role(F.col("r"))).collect()]
    assert got == ["user", "assistant", "system", "tool"]
