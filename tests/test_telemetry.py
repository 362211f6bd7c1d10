import datetime as dt
import random
import time

import pytest
from pyspark.sql import functions as F

from loomset.functions.ratings import memory_grade, speed_rating, suggestions, utilisation_pct
from loomset.operators import telemetry
from loomset.operators.telemetry import (
    memory_analysis,
    request_performance,
    request_suggestions,
    resource_summary,
    session_summary,
    speeds,
    token_gaps,
)
from loomset.streaming.examples import stream_dedup, stream_examples
from loomset.streaming.run import drain
from loomset.streaming.telemetry import stream_requests, stream_resources, stream_snapshots

T0 = dt.datetime(2024, 5, 1, 12, 0, 0)
SAMPLE = (
    "request_id string, ts timestamp, cpu double, system_memory double, pytorch_allocated double, "
    "gpu_memory_allocated double, gpu_usage double, gpu_temp double, gpu_power double, gpu_memory_used double"
)


def at(seconds):
    return T0 + dt.timedelta(microseconds=round(seconds * 1e6))


def requests(spark, rows):
    return spark.createDataFrame(
        [(r, at(a), at(b), i, o) for r, a, b, i, o in rows],
        "request_id string, start_ts timestamp, end_ts timestamp, input_tokens long, output_tokens long",
    )


def tokens(spark, rows):
    return spark.createDataFrame([(r, at(t), "x") for r, t in rows], "request_id string, ts timestamp, chunk string")


def test_speeds(spark):
    reqs = requests(
        spark,
        [
            ("a", 0, 10, 5, None), ("none", 0, 4, 5, None), ("one", 0, 2, 5, None), ("same", 0, 2, 0, None),
            ("told", 0, 10, 5, 40), ("zero", 0, 10, None, 0), ("instant", 3, 3, 1, None),
        ],
    )
    toks = tokens(
        spark,
        [("a", 2), ("a", 3), ("a", 3), ("a", 6), ("one", 1), ("same", 1), ("same", 1), ("told", 2), ("told", 4), ("zero", 1), ("instant", 3)],
    )
    got = {r.request_id: r for r in speeds(reqs, toks).collect()}
    a = got["a"]
    assert (a.total_inference_time, a.first_token_latency, a.pure_generation_time) == (10, 2, 8)
    assert (a.output_tokens, a.total_tokens) == (4, 9)
    assert a.total_inference_speed == 0.4 and a.overall_processing_speed == 0.9
    assert a.pure_generation_speed == a.response_speed == 3 / 8
    assert a.real_time_avg_speed == pytest.approx(1 / ((1 + 3) / 2))
    none = got["none"]
    assert (none.first_token_latency, none.pure_generation_time, none.output_tokens) == (0, 4, 0)
    assert none.pure_generation_speed is None and none.real_time_avg_speed is None
    assert got["one"].pure_generation_speed is None and got["same"].real_time_avg_speed is None
    assert got["same"].pure_generation_speed == 1 and got["told"].output_tokens == 40
    assert got["zero"].output_tokens == 0 and got["zero"].input_tokens == 0
    assert got["instant"].total_inference_speed is None
    assert got["told"].rating == "Needs Optimization (<10)"


def test_gaps(spark):
    rng = random.Random(1)
    rows = [(r, rng.randint(0, 4000) / 37) for r in "ab" for _ in range(300)] + [("c", 1.0), ("d", 1.0), ("d", 1.0)]
    got = {}
    for r in token_gaps(tokens(spark, rows)).collect():
        got.setdefault(r.request_id, []).append(round(r.gap, 6))
    for name in "ab":
        times = sorted({round(t * 1e6) for r, t in rows if r == name})
        assert sorted(got[name]) == sorted(round((y - x) / 1e6, 6) for x, y in zip(times, times[1:]))
    assert set(got) == {"a", "b"}


def sample(spark, rows):
    fields = ("cpu", "system_memory", "pytorch_allocated", "gpu_memory_allocated", "gpu_usage", "gpu_temp", "gpu_power", "gpu_memory_used")
    return spark.createDataFrame([(r, at(t), *[v.get(f) for f in fields]) for r, t, v in rows], SAMPLE)


def g(cpu, system, **kw):
    return {"cpu": float(cpu), "system_memory": float(system), **{k: float(v) for k, v in kw.items()}}


def baseline(spark, rows):
    return spark.createDataFrame(
        rows,
        "request_id string, system_memory_used double, system_memory_percent double, "
        "gpu_memory_allocated double, gpu_memory_total double",
    )


def test_resources_and_memory(spark):
    df = sample(
        spark,
        [
            ("a", 0, g(10, 4, pytorch_allocated=1, gpu_memory_allocated=1, gpu_usage=50)),
            ("a", 2, g(30, 6, pytorch_allocated=7, gpu_temp=60, gpu_power=100)),
            ("a", 1, g(20, 9, gpu_memory_allocated=5, gpu_usage=70, gpu_memory_used=8)),
            ("cpu", 5, g(80, 4)),
            ("cpu", 6, g(80, 4)),
            ("once", 5, g(1, 1)),
        ],
    )
    base = baseline(spark, [("a", 3.0, 10.0, 1.0, 8.0), ("once", None, None, None, None)])
    got = {r.request_id: r for r in resource_summary(df, base).collect()}
    a = got["a"]
    assert (a.n_samples, a.duration, a.cpu_avg, a.cpu_max, a.cpu_min) == (3, 2, 20, 30, 10)
    assert (a.gpu_usage_avg, a.gpu_usage_max, a.gpu_usage_min) == (60, 70, 50)
    assert (a.gpu_temp_avg, a.gpu_power_max, a.gpu_memory_avg) == (60, 100, 2)
    assert (a.system_memory_peak, a.pytorch_memory_peak, a.gpu_memory_peak) == (9, 7, 8)
    assert (a.system_memory_growth, a.pytorch_memory_growth) == (6, 6)
    c = got["cpu"]
    assert c.gpu_memory_avg is None and c.gpu_usage_avg is None and c.pytorch_memory_peak == 0
    assert c.system_memory_growth == 4
    started = base.withColumn("start_ts", F.lit(at(-3)))
    assert {r.request_id: r.duration for r in resource_summary(df, started).collect()}["a"] == 5
    assert {r.request_id: r.duration for r in resource_summary(df).collect()}["once"] == 0

    mem = {r.request_id: r for r in memory_analysis(df, base).collect()}
    assert (mem["a"].system_memory_trend, mem["a"].system_memory_variance) == ("increasing", 5)
    assert (mem["a"].pytorch_memory_trend, mem["a"].pytorch_memory_variance) == ("increasing", 7)
    assert (mem["a"].model_memory_footprint, mem["a"].memory_efficiency) == (6, "high")
    assert mem["a"].memory_utilisation_pct == 87.5
    assert (mem["cpu"].system_memory_trend, mem["cpu"].system_memory_variance) == ("stable", 0)
    assert mem["cpu"].model_memory_footprint is None and mem["cpu"].memory_efficiency is None
    assert mem["once"].system_memory_trend is None and mem["once"].memory_utilisation_pct == 0
    assert "memory_efficiency" not in memory_analysis(df).columns

    reqs = requests(spark, [("a", 0, 10, 5, None), ("lost", 0, 1, 1, None)])
    toks = tokens(spark, [("a", 2), ("a", 3)])
    rows = {r.request_id: r for r in request_performance(reqs, toks, df).collect()}
    assert len(rows["a"]) == 11 and rows["a"].gpu_memory_peak == 7 and rows["lost"].gpu_usage_avg is None

    advice = request_suggestions(speeds(reqs, toks), resource_summary(df, base), memory_analysis(df, base))
    advice = {r.request_id: [s.split()[0] for s in r.suggestions] for r in advice.collect()}
    assert advice["a"] == ["Add", "Consider", "Low"]
    assert advice["cpu"] == ["Low", "High"] and advice["lost"] == ["Consider"]


def test_rating_bounds(spark):
    df = spark.createDataFrame([(x,) for x in (None, 10.0, 10.1, 15.0, 15.1, 20.0, 20.1, 30.0, 30.1)], "x double")
    got = [r[0].split(" (")[0] for r in df.select(speed_rating(F.col("x"))).collect()]
    assert got == ["Needs Optimization"] * 2 + ["Below Average"] * 2 + ["Average"] * 2 + ["Good"] * 2 + ["Excellent"]
    df = spark.createDataFrame([(x,) for x in (5.9, 6.0, 7.9, 8.0, None)], "x double")
    assert [r[0] for r in df.select(memory_grade(F.col("x"))).collect()] == ["good", "high", "high", "very_high", None]
    none = F.lit(None).cast("double")
    row = spark.range(1).select(
        utilisation_pct(F.lit(1.0), none).alias("u"),
        suggestions(none, none, none, none, F.lit("very_high"), F.lit(7.5)).alias("s"),
        suggestions(F.lit(2.0), F.lit(25.0), F.lit(80.0), F.lit(10.0), F.lit("good"), F.lit(7.0)).alias("t"),
    ).first()
    assert row.u == 0 and len(row.s) == 4 and len(row.t) == 1


def random_samples(spark):
    rng = random.Random(11)
    rows = [(r, rng.randint(0, 3000) + rng.choice([0, 0.25]), g(rng.randint(0, 99), rng.randint(1, 9))) for r in "abc" for _ in range(200)]
    rows += [("edge", 0, g(1, 1)), ("edge", 30, g(2, 2)), ("edge", 60.000001, g(3, 3))]
    rows = list({(r, t): (r, t, v) for r, t, v in rows}.values())
    return rows, sample(spark, rows)


def expected_sessions(rows, gap):
    out = []
    for request in {r for r, *_ in rows}:
        open_ = []
        for t, v in sorted((t, v["cpu"]) for r, t, v in rows if r == request):
            if open_ and t - open_[-1][0] > gap + 1e-9:
                out.append((request, open_))
                open_ = []
            open_.append((t, v))
        out.append((request, open_))
    return {(r, at(s[0][0]), at(s[-1][0] + gap), len(s), round(sum(v for _, v in s) / len(s), 6)) for r, s in out}


@pytest.mark.parametrize("block", [3, 4096])
def test_sessions_in_batch(spark, monkeypatch, block):
    monkeypatch.setattr(telemetry, "SLOT_BLOCK", block)
    rows, df = random_samples(spark)
    got = {(r.request_id, r.session_start, r.session_end, r.n_samples, round(r.cpu_avg, 6)) for r in session_summary(df, 30).collect()}
    assert got == expected_sessions(rows, 30)


def streamed(spark, df, tmp_path, files=1):
    path = str(tmp_path / "in")
    df.repartition(files).write.parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_stream_sessions_match_batch(spark, tmp_path):
    rows, df = random_samples(spark)
    out = drain(stream_resources(streamed(spark, df, tmp_path), "30 seconds", "10 seconds"), "t")
    got = {(r.request_id, r.session_start, r.session_end, r.n_samples, round(r.cpu_avg, 6)) for r in out.collect()}
    last = max(at(t) for _, t, _ in rows) - dt.timedelta(seconds=10)
    assert got == {s for s in expected_sessions(rows, 30) if s[2] <= last}


def test_stream_and_batch_sessions_have_the_same_columns(spark, tmp_path):
    rng = random.Random(13)
    names = ("pytorch_allocated", "gpu_memory_allocated", "gpu_usage", "gpu_temp", "gpu_power", "gpu_memory_used")
    rows = [
        (r, t / 4, g(rng.randint(0, 99), rng.randint(1, 9), **{n: rng.randint(1, 9) for n in names if rng.random() < 0.3}))
        for r in "ab"
        for t in rng.sample(range(20000), 250)
    ]
    df = sample(spark, rows)
    stream = drain(stream_resources(streamed(spark, df, tmp_path), "30 seconds", "10 seconds"), "t")
    batch = session_summary(df, 30)
    assert sorted(stream.columns) == sorted(batch.columns)
    last = max(at(t) for _, t, _ in rows) - dt.timedelta(seconds=10)

    def table(df):
        kept = df.where(F.col("session_end") <= F.lit(last)).select(*sorted(stream.columns))
        return sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in kept.collect()), key=repr)

    assert repr(table(stream)) == repr(table(batch)) and stream.count() > 50


def test_stream_over_several_batches(spark, tmp_path):
    """With a delay that covers the disorder, batch borders leave no trace."""
    rows, df = random_samples(spark)
    stream = streamed(spark, df, tmp_path, 3)
    time.sleep(1.1)  # files are taken in order of their modification time
    sample(spark, [("end", 20000, g(1, 1))]).write.mode("append").parquet(str(tmp_path / "in"))
    out = drain(stream_resources(stream, "30 seconds", "4000 seconds"), "t")
    got = {(r.request_id, r.session_start, r.session_end, r.n_samples) for r in out.collect()}
    assert got == {s[:4] for s in expected_sessions(rows, 30)}


def test_stream_snapshots(spark, tmp_path):
    rows, df = random_samples(spark)
    out = drain(stream_snapshots(streamed(spark, df, tmp_path), "1 second", "10 seconds"), "t")
    first = {}
    for r, t, v in sorted(rows, key=lambda x: x[1]):
        first.setdefault((r, int(t)), (at(t), v["cpu"]))
    limit = max(t for _, t, _ in rows) - 10
    want = {(r, at(s), *v) for (r, s), v in first.items() if s + 1 <= limit}
    assert {(r.request_id, r.window_start, r.ts, r.cpu) for r in out.collect()} == want


def test_stream_requests_match_batch(spark, tmp_path):
    rng = random.Random(12)
    rows = [(f"q{i}", 1000 * i + rng.randint(0, 200) / 10) for i in range(8) for _ in range(40)]
    starts = {f"q{i}": 1000 * i - 1 for i in range(9)}
    full = spark.createDataFrame(
        [(r, at(t), at(starts[r]), 7) for r, t in [*rows, ("q8", 9e5)]],
        "request_id string, ts timestamp, start_ts timestamp, input_tokens long",
    )
    out = drain(stream_requests(streamed(spark, full, tmp_path), "30 seconds", "10 seconds"), "t")
    ends = {r: max(t for q, t in rows if q == r) for r, _ in rows}
    batch = speeds(requests(spark, [(r, starts[r], e, 7, None) for r, e in ends.items()]), tokens(spark, rows))
    key = lambda r: r.request_id
    assert sorted(out.collect(), key=key) == sorted(batch.collect(), key=key)


def test_stream_examples_and_dedup(spark, tmp_path):
    rows = [(i, at(i), '{"instruction":"q","input":"","output":"%s"}' % ("same answer" if i % 2 else f"answer {i}")) for i in range(10)]
    df = spark.createDataFrame([*rows, (99, at(1), "broken")], "id long, ts timestamp, json string")
    records = streamed(spark, df, tmp_path).select("id", "ts", F.try_parse_json("json").alias("raw"))
    examples = stream_examples(records, fmt="alpaca")
    out = drain(stream_dedup(examples, delay="1 hour", key=F.col("text")), "t").collect()
    assert len(out) == 6 and {r.fmt for r in out} == {"alpaca"}
    assert sorted(r.response for r in out) == sorted([f"answer {i}" for i in range(0, 10, 2)] + ["same answer"])


def test_stream_of_mixed_records(spark, tmp_path):
    said = '{"conversations":[{"from":"human","value":"ask a"},{"from":"gpt","value":"say b"},{"from":"gpt","value":"say c"}]}'
    rows = [(1, said), (2, '{"text":"some plain text"}'), (3, '{"conversations":[{"from":"gpt"}]}')]
    df = spark.createDataFrame(rows, "id long, json string")
    for fmt, want in ((None, {(1, 1), (1, 2), (2, None)}), ("sharegpt", {(1, 1), (1, 2)})):
        records = streamed(spark, df, tmp_path / str(fmt)).select("id", F.try_parse_json("json").alias("raw"))
        out = drain(stream_examples(records, fmt=fmt), "t").collect()
        assert {(r.id, r.turn_pos) for r in out} == want
        assert all("say" in r.text or "plain" in r.text for r in out)
