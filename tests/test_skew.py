"""One key holds a third of all rows: no task may get them all."""

import pytest
from pyspark.sql import functions as F

from loomset.operators import curves, telemetry
from loomset.operators.dialogues import expand_turns
from loomset.operators.joins import lookup_join
from loomset.operators.ordering import order_key
from loomset.operators.quality import dedup_prefix
from loomset.operators.running import running_before

ROWS = 60_000


@pytest.fixture
def hot(spark):
    """Rows ``key, id``; small partitions are not merged, small tables not broadcast on their own."""
    settings = {
        "spark.sql.adaptive.enabled": "false",
        "spark.sql.shuffle.partitions": "32",
        "spark.sql.autoBroadcastJoinThreshold": "-1",
    }
    old = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    key = F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id") % 997)
    yield spark.range(ROWS).select(key.cast("bigint").alias("key"), "id")
    for k, v in old.items():
        spark.conf.set(k, v)


def largest_share(df):
    sizes = [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]
    return max(sizes) / sum(sizes)


def test_plain_shuffle_is_skewed(hot):
    assert largest_share(hot.repartition("key")) > 0.3


def test_lookup_join_spreads_a_hot_key(hot):
    table = hot.groupBy("key").agg(F.count("*").alias("n"))
    assert largest_share(lookup_join(hot, table, "key")) < 0.15


def test_running_values_spread_a_hot_key(hot):
    rows = running_before(hot, ["key"], F.floor(F.col("id") / 500), "id", prev=("max", F.col("id")))
    assert largest_share(rows) < 0.1
    assert rows.where("key = -1 and id - prev != 3").count() == 0


def test_gaps_and_sessions_spread_a_hot_request(hot, monkeypatch):
    tokens = hot.select(F.col("key").alias("request_id"), F.timestamp_seconds("id").alias("ts"), F.lit(1.0).alias("cpu"))
    for name in ("gpu_usage", "gpu_temp", "gpu_power", "gpu_memory_allocated", "gpu_memory_used", "system_memory", "pytorch_allocated"):
        tokens = tokens.withColumn(name, F.lit(None).cast("double"))
    gaps = telemetry.token_gaps(tokens)
    assert largest_share(gaps) < 0.1
    assert gaps.where("request_id = -1").agg(F.count("*"), F.max("gap")).first() == (ROWS // 3 - 1, 3.0)
    sessions = telemetry.session_summary(tokens, 5).where("request_id = -1").collect()
    assert [s.n_samples for s in sessions] == [ROWS // 3]


def test_early_stop_of_a_hot_run(hot):
    metrics = hot.select(
        F.col("key").alias("run_id"), F.lit("eval/loss").alias("tag"), F.col("id").alias("step"),
        (1.0 / (F.col("id") + 1)).alias("value"),
    )
    hot_run = curves.early_stop(metrics).where("run_id = -1").first()
    assert (hot_run.stop_step, hot_run.best_step, hot_run.n_evals) == (None, ROWS - 3, ROWS // 3)


def test_copies_are_cut_before_the_shuffle(hot):
    docs = hot.select(
        "id", F.concat(F.lit("x" * 200), F.when(F.col("key") >= 0, F.col("id"))).alias("t"), order_key(F.col("id")).alias("k")
    ).withColumn("text", F.coalesce("t", F.lit("copy")))
    kept = dedup_prefix(docs, "k")
    plan = kept._jdf.queryExecution().executedPlan().toString()
    before_shuffle = plan[plan.index("Exchange"):]
    assert "WindowGroupLimit" in before_shuffle and kept.count() == 2


def test_hot_dialogue_is_cut_before_grouping(hot):
    turns = hot.select(
        F.col("key").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"),
        F.col("id").cast("string").alias("text"),
    )
    examples = expand_turns(turns, max_chars=300)
    got = {r.over_length: r["count"] for r in examples.groupBy("over_length").count().collect()}
    firsts = turns.groupBy("conv_id").agg(F.min_by("role", "turn").alias("first")).where("first = 'assistant'").count()
    assert sum(got.values()) == turns.where("role = 'assistant'").count() - firsts
    assert examples.where("length(prompt) > 300").count() == 0
    # The windows see the heads only; the rest comes from a broadcast join.
    assert largest_share(examples) < 0.2
