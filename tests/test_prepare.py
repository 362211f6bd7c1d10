import json

import pytest
from pyspark.sql import functions as F

from loomset import sinks
from loomset.operators.preview import preview
from loomset.plans.prepare import (
    PrepareConfig,
    format_label,
    judged,
    leading_format,
    prepare,
    prepare_documents,
    prepare_turns,
    record_examples,
    turn_examples,
)
from loomset.operators.quality import quality_report
from loomset.operators.tokens import pad_batches, token_columns
from loomset.sources import read_records

CFG = PrepareConfig(system_prompt="S", min_length=1, val_split=0.2)


def prepared(spark, folder, cfg=CFG):
    df, fmt = prepare(spark, folder, cfg)
    return df.collect(), fmt


def test_alpaca_folder(spark, write):
    rows = [{"instruction": f"q{i}", "input": "", "output": f"answer {i}"} for i in range(10)]
    folder = write("a.jsonl", rows + rows[:4] + [{"instruction": "q", "output": ""}, "odd"])
    got, fmt = prepared(spark, folder)
    assert fmt == "alpaca" and len(got) == 11
    assert sum(r.split == "val" for r in got) == 2
    texts = {r.text for r in got}
    assert (
        "<|im_start|>system\nS<|im_end|>\n<|im_start|>user\nq3<|im_end|>\n"
        "<|im_start|>assistant\nanswer 3<|im_end|>"
    ) in texts
    again, _ = prepared(spark, folder)
    assert {(r.text, r.split) for r in got} == {(r.text, r.split) for r in again}


def test_source_order(spark, write):
    write("b.txt", "\n\n".join(f"paragraph number {i}" for i in range(5)))
    folder = write("a.txt", "\n\n".join(f"text number {i}" for i in range(5)))
    cfg = PrepareConfig(shuffle=False, val_split=0.3)
    got, fmt = prepared(spark, folder, cfg)
    assert fmt == "plain_text"
    assert sorted(r.text for r in got if r.split == "val") == [f"text number {i}" for i in range(3)]


def dialogue(*said):
    return {"conversations": [{"from": f, "value": v} for f, v in said]}


def test_sharegpt_expansion(spark, write):
    folder = write(
        "s.jsonl",
        [
            dialogue(("human", "h1"), ("gpt", "g1"), ("system", "x"), ("human", "h2"), ("gpt", "g2")),
            dialogue(("gpt", "first"), ("gpt", "second")),
            {"conversations": []},
            {"text": "not a dialogue"},
            {"conversations": [{"from": "human", "value": "x"}, {"from": "gpt"}]},
            "no object",
        ],
    )
    got, fmt = prepared(spark, folder)
    assert fmt == "sharegpt"
    assert {(r.prompt, r.response) for r in got} == {
        ("用户: h1", "g1"), ("用户: h1\n助手: g1\n用户: h2", "g2"), ("助手: first", "second"),
    }
    examples, _ = record_examples(read_records(spark, folder), CFG)
    report = {r.reject_reason: r.n for r in quality_report(judged(examples, CFG)).collect()}
    assert report == {"kept": 3, "error": 2}


def test_sharegpt_without_any_expansion(spark, write):
    folder = write("s.jsonl", [dialogue(("human", "only asked")), dialogue(("gpt", "only said"))])
    got, _ = prepared(spark, folder)
    assert {r.text for r in got if not r.prompt} == {"only said"}
    assert {(r.prompt, r.response) for r in got} == {("only asked", ""), ("", "only said")}


def test_per_record_mode(spark, write):
    folder = write(
        "m.jsonl",
        [
            {"instruction": "i", "output": "o"},
            dialogue(("human", "h"), ("gpt", "g")),
            {"messages": [{"role": "user", "content": "u"}, {"role": "assistant", "content": "a"}]},
            {"text": "plain words"},
            {"question": "gq", "answer": "ga"},
        ],
    )
    cfg = PrepareConfig(system_prompt="S", min_length=1, format_mode="per_record")
    got, fmt = prepared(spark, folder, cfg)
    assert fmt is None
    assert {(r.fmt, r.prompt, r.response) for r in got} == {
        ("alpaca", "i", "o"), ("sharegpt", "用户: h", "g"), ("chatml", "u", "a"),
        ("plain_text", "", "plain words"), ("general_json", "gq", "ga"),
    }


def test_first_record_decides(spark, write):
    write("a.jsonl", "\n\n")
    write("b.jsonl", "")
    write("c.jsonl", [{"Question": "q", "Complex_CoT": "c", "Response": "r"}])
    folder = write("d.jsonl", [{"text": "t"}])
    assert leading_format(spark, folder) == "cot"
    got, fmt = prepared(spark, folder, PrepareConfig(task_type="cot", min_length=1, system_prompt="S"))
    assert fmt == "cot" and [r.text.split("assistant\n")[1] for r in got] == [
        "让我们一步步思考：c\nr<|im_end|>"
    ]
    assert format_label("cot").startswith("Chain") and format_label("x") == "x"


def test_dedup_on_text_or_pair(spark):
    system = "long system prompt " * 20
    rows = [(c, t, r, f"{r} {c}") for c in range(4) for t, r in enumerate(["user", "assistant"])]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    sizes = [
        prepare_turns(turns, PrepareConfig(system_prompt=system, **kw)).count()
        for kw in ({}, {"dedup_on": "pair"}, {"dedup": False}, {"dedup_key_len": 1000})
    ]
    assert sizes == [1, 4, 4, 4]


def test_turns_report_counts_every_assistant_turn(spark):
    rows = [(0, t, "user" if t % 2 == 0 else "assistant", "y" * 40) for t in range(600)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    cfg = PrepareConfig(system_prompt="S", max_length=500)
    report = {r.reject_reason: r.n for r in quality_report(judged(turn_examples(turns, cfg), cfg)).collect()}
    assert sum(report.values()) == 300 and set(report) == {"kept", "length"}


def test_config_is_checked():
    with pytest.raises(ValueError):
        PrepareConfig(format_mode="x")
    with pytest.raises(ValueError):
        PrepareConfig(dedup_on="x")


def test_config_from_sections():
    cfg = PrepareConfig.from_mapping(
        {"data": {"dataset_dir": "x", "val_split": 0.1, "min_length": 3}, "direction": {"task_type": "cot"}, "model": {}}
    )
    assert (cfg.val_split, cfg.min_length, cfg.task_type, cfg.dedup, cfg.seed) == (0.1, 3, "cot", False, 42)


def test_nothing_valid_is_an_error(spark, write):
    folder = write("a.jsonl", [{"text": "short"}])
    with pytest.raises(ValueError):
        prepare(spark, folder)


def test_preview(spark, write):
    write("a.jsonl", [{"text": "first " * 200, "k": 1}, {"text": "second"}])
    write("b.csv", "instruction,output\ni,o\n")
    write("c.txt", "x\n\ny")
    folder = write("d.txt", "not shown")
    got = {r.path.rsplit("/", 1)[1]: r for r in preview(spark, folder).collect()}
    assert set(got) == {"a.jsonl", "b.csv", "c.txt"}
    assert (got["a.jsonl"].n, got["a.jsonl"].fmt, got["a.jsonl"]["keys"]) == (2, "plain_text", "text,k")
    assert len(got["a.jsonl"].head) == 500 and got["b.csv"].fmt == "alpaca" and got["c.txt"].n == 2


def test_sinks(spark, tmp_path, write):
    folder = write("in/a.txt", "\n\n".join(f"paragraph number {i}" for i in range(30))) + "/in"
    df, fmt = prepare(spark, folder)
    out = str(tmp_path / "examples")
    sinks.write_examples(df, out)
    back = spark.read.parquet(out)
    assert back.groupBy("split").count().count() == 2 and back.count() == 30
    sinks.write_manifest(sinks.manifest(df, PrepareConfig(), fmt, "base", num_epochs=3), str(tmp_path / "m"))
    row = spark.read.json(str(tmp_path / "m")).first()
    assert (row.n_train, row.n_val, row.dataset_format, row.base_model) == (29, 1, "plain_text", "base")
    assert json.loads(row.settings)["num_epochs"] == "3"
    pairs = spark.createDataFrame([("1", "p", "r", "x")], "pair_id string, prompt string, reference string, prediction string")
    sinks.write_predictions(pairs, str(tmp_path / "p"))
    assert spark.read.json(str(tmp_path / "p")).count() == 1
    asked = pairs.select(F.col("pair_id").alias("request_id"), "prompt")
    perf = asked.select("request_id", F.lit(1.5).alias("first_token_latency"))
    sinks.write_samples(asked, perf, str(tmp_path / "s"))
    assert spark.read.json(str(tmp_path / "s")).first().performance.first_token_latency == 1.5
    sinks.write_report(spark.range(1).select(F.lit(0.5).alias("rouge_1"), F.lit(None).cast("double").alias("x")), str(tmp_path / "r"))
    assert spark.read.text(str(tmp_path / "r")).first()[0] == '{"rouge_1":0.5}'
    metrics = spark.createDataFrame([("a", "loss", 1, 0.5), ("a", "lr", 9000, 1.0)], "run_id string, tag string, step long, value double")
    from loomset.sources import read_metrics

    sinks.write_metrics(metrics, str(tmp_path / "rows"))
    sinks.write_metric_maps(metrics, str(tmp_path / "maps"))
    want = sorted(map(tuple, metrics.collect()))
    for layout in ("rows", "maps"):
        assert sorted(map(tuple, read_metrics(spark, str(tmp_path / layout), layout).collect())) == want


def test_long_prompt_is_kept_where_it_is_not_rendered(spark):
    turns = spark.createDataFrame(
        [(1, 0, "user", "q" * 9000), (1, 1, "assistant", "a short but valid answer")],
        "conv_id long, turn long, role string, text string",
    )
    kept = {
        task: prepare_turns(turns, PrepareConfig(task_type=task, dedup=False)).count()
        for task in ("instruction", "cot", "text_completion")
    }
    assert kept == {"instruction": 0, "cot": 1, "text_completion": 0}
    assert prepare_turns(turns, PrepareConfig(quality_check=False)).count() == 1


def test_malformed_first_line_decides_no_layout(spark, write):
    good = '{"instruction": "say something long", "input": "more", "output": "an answer of some length"}'
    folder = write("a.jsonl", "{broken\n\n" + good + "\n")
    rows, fmt = prepare(spark, folder, PrepareConfig(dedup=False))
    assert fmt == "alpaca" and "more" in rows.first()["prompt"]


def test_repeated_keys_keep_all_rows(spark):
    rows = spark.createDataFrame([(i, "same text") for i in range(10)], "id int, text string")
    keyed = rows.withColumn("order_key", F.md5("text"))
    padded = pad_batches(token_columns(keyed), 4, 0)
    assert sorted(r["batch"] for r in padded.collect()) == [0] * 4 + [1] * 4 + [2] * 2


def test_text_ids_keep_their_order(spark):
    ids = ["aaaaaaaaaa-2", "aaaaaaaaaa-10", "aaaaaaaaaa", "b", "aaaaaaaaaa-1", ""]
    docs = spark.createDataFrame([(i, f"text number {i} of some length") for i in ids], "doc_id string, text string")
    rows = prepare_documents(docs, PrepareConfig(shuffle=False, val_split=0.5)).collect()
    assert {r["doc_id"] for r in rows if r["split"] == "val"} == set(sorted(ids)[:3])
