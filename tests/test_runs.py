"""Runs with resets and dedup by order, as streams, against their batch twins."""

import datetime as dt
import random
import time

import pytest
from pyspark.sql import functions as F

from loomset.operators import telemetry
from loomset.operators.quality import dedup_prefix
from loomset.operators.telemetry import run_summary
from loomset.streaming import run as running
from loomset.streaming.examples import stream_dedup_first
from loomset.streaming.run import drain, drain_all
from loomset.streaming.runs import state_on_disk, stream_runs

T0 = dt.datetime(2024, 5, 1, 12, 0, 0)
SCHEMA = "request_id string, ts timestamp, reset boolean, cpu double, system_memory double"


def at(seconds):
    return T0 + dt.timedelta(microseconds=round(seconds * 1e6))


def random_rows(seed=4):
    rng = random.Random(seed)
    rows = []
    for request in "abc":
        for _ in range(120):
            t = rng.randrange(0, 3000) + rng.choice([0, 0.5])
            rows.append((request, at(t), rng.choice([False] * 12 + [True, None]), rng.choice([None, 1.0, 2.5, 7.0]), rng.choice([None, 1.0, 9.0])))
    rows += [("edge", at(0), False, 1.0, 1.0), ("edge", at(30), None, 2.0, 2.0), ("edge", at(60.000001), False, 3.0, 3.0)]
    rows += [("tie", at(5), True, 8.0, 8.0), ("tie", at(5), False, 1.0, 1.0), ("tie", at(4), False, 2.0, -2.0), ("only resets", at(4), True, 2.0, 2.0)]
    return rows + rows[:7]


def plain(rows, idle):
    """The runs of every request, row by row."""
    out = []
    for request in {r[0] for r in rows if r[0] is not None}:
        run = []
        own = sorted((r for r in rows if r[0] == request and r[1] is not None), key=lambda r: (r[1], not r[2]))
        for _, ts, reset, cpu, memory in own:
            if run and (reset or (ts - run[-1][0]).total_seconds() > idle):
                out.append((request, run))
                run = []
            if not reset:
                run.append((ts, cpu, memory))
        if run:
            out.append((request, run))
    got = set()
    for request, run in out:
        first, last, cpu = run[0][0], run[-1][0], [c for _, c, _ in run if c is not None]
        times = len({t for t, _, _ in run})
        got.add((
            request, first, last, len(run), round(sum(cpu) / len(cpu), 6) if cpu else None, max(cpu, default=None),
            max([0.0, *[m for _, _, m in run if m is not None]]), round((times - 1) / (last - first).total_seconds(), 6) if times > 1 else None,
        ))
    return got


def table(df):
    rows = df.select("request_id", "run_start", "run_end", "n_samples", F.round("cpu_avg", 6), "cpu_max", "system_memory_peak", F.round("sample_speed", 6))
    got = [tuple(r) for r in rows.collect()]
    assert len(got) == len(set(got))
    return set(got)


@pytest.mark.parametrize("block", [1, 4096])
def test_runs_in_batch(spark, monkeypatch, block):
    monkeypatch.setattr(telemetry, "SLOT_BLOCK", block)
    rows = [*random_rows(), (None, at(1), False, 1.0, 1.0), ("a", None, False, 1.0, 1.0)]
    assert table(run_summary(spark.createDataFrame(rows, SCHEMA), 30)) == plain(rows, 30)
    assert run_summary(spark.createDataFrame([], SCHEMA), 30).count() == 0


def streamed(spark, df, path, files):
    df.repartition(files).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_runs_as_a_stream_equal_the_batch(spark, tmp_path):
    """With a delay that covers the disorder, batch borders leave no trace; every run is emitted once."""
    rows = random_rows()
    df = spark.createDataFrame([*rows, (None, at(1), False, 1.0, 1.0)], SCHEMA)
    with state_on_disk(spark):
        out = drain_all(streamed(spark, df, str(tmp_path / "in"), 3), lambda s: stream_runs(s, 30, "4000 seconds"), "runs")
    assert table(out) == plain(rows, 30) == table(run_summary(df, 30))


def test_runs_go_on_after_a_restart(spark, tmp_path):
    """A run that is open when the query stops is ended by what comes after the restart from its checkpoint."""
    rows = sorted(random_rows(9), key=lambda r: r[1])
    cut = len(rows) // 2
    path, work = str(tmp_path / "in"), str(tmp_path / "work")
    with state_on_disk(spark):
        running._run(stream_runs(streamed(spark, spark.createDataFrame(rows[:cut], SCHEMA), path, 1), 30, "1 second"), work)
        time.sleep(1.1)  # files are taken in order of their modification time
        later = streamed(spark, spark.createDataFrame(rows[cut:], SCHEMA), path, 1)
        running._run(stream_runs(later, 30, "1 second"), work)
        time.sleep(1.1)
        end = streamed(spark, spark.createDataFrame([("end", at(10**6), False, 1.0, 1.0)], SCHEMA), path, 1)
        out = running._run(stream_runs(end, 30, "1 second"), work)
    assert table(out) == plain(rows, 30)


def test_first_by_order_in_any_order_of_arrival(spark, tmp_path):
    rng = random.Random(8)
    rows = [(i, at(rng.randrange(3000)), f"{rng.choice('abcde')} text", f"{rng.randrange(10**9):09d}-{i}") for i in range(200)]
    rows += [(1000, at(5), None, "x"), (1001, at(6), None, "w"), (1002, at(7), "", "y")]
    df = spark.createDataFrame(rows, "id long, ts timestamp, text string, order_key string")
    want = sorted(map(tuple, dedup_prefix(df, "order_key").collect()), key=repr)
    assert len(want) == 7
    for n, files in enumerate((1, 4)):
        stream = streamed(spark, df.orderBy(F.rand(n)), str(tmp_path / str(n)), files)
        got = drain_all(stream, lambda s: stream_dedup_first(s, "order_key", delay="2 hours"), "first")
        assert sorted(map(tuple, got.select(*df.columns).collect()), key=repr) == want
    still_open = drain(stream_dedup_first(streamed(spark, df, str(tmp_path / "open"), 1), "order_key", delay="2 hours"), "open")
    assert still_open.count() == 0
