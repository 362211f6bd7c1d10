"""Telemetry as Structured Streaming. ``ts`` is a TIMESTAMP column.

Rows later than the watermark (``delay``) are dropped; a window or session is
emitted once, when the watermark passes its end. State leaves with it, so a
new request needs no reset; ``streaming.runs`` is for requests whose running values are reset by rows of their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from loomset.operators.telemetry import spread, summary_aggregates, trend, with_speeds


def stream_snapshots(samples: DataFrame, every: str = "1 second", delay: str = "10 seconds") -> DataFrame:
    """The first sample of each request in each interval: at most one snapshot per ``every``."""
    fields = [c for c in samples.columns if c != "request_id"]
    return (
        samples.withWatermark("ts", delay)
        .groupBy("request_id", F.window("ts", every).alias("window"))
        .agg(F.min_by(F.struct(*fields), "ts").alias("first"))
        .select("request_id", F.col("window.start").alias("window_start"), "first.*")
    )


def stream_requests(tokens: DataFrame, gap: str = "30 seconds", delay: str = "10 seconds") -> DataFrame:
    """Latency and speed per request session from token arrivals.

    Tokens carry ``request_id, ts, start_ts, input_tokens``. Arrivals at one
    instant are merged by a first window of a microsecond, whose time is that
    instant; the session then counts instants without holding a set of them.
    """
    instants = (
        tokens.withWatermark("ts", delay)
        .groupBy("request_id", F.window("ts", "1 microsecond").alias("instant"))
        .agg(
            F.count("*").alias("n"),
            F.min("start_ts").alias("start_ts"),
            F.max("input_tokens").alias("input_tokens"),
        )
        .withColumn("at", F.window_time("instant"))
    )
    sessions = instants.groupBy("request_id", F.session_window("at", gap).alias("session")).agg(
        F.sum("n").alias("n_chunks"),
        F.count("*").alias("n_times"),
        F.min("at").alias("first_ts"),
        F.max("at").alias("last_ts"),
        F.min("start_ts").alias("start_ts"),
        F.max("input_tokens").alias("input_tokens"),
    )
    return with_speeds(
        sessions.withColumn("end_ts", F.col("last_ts")).withColumn(
            "output_tokens", F.lit(None).cast("bigint")
        )
    )


def stream_resources(samples: DataFrame, gap: str = "30 seconds", delay: str = "10 seconds") -> DataFrame:
    """Resource summary and memory trends per request session."""
    return (
        samples.withWatermark("ts", delay)
        .groupBy("request_id", F.session_window("ts", gap).alias("session"))
        .agg(
            *summary_aggregates(),
            trend(F.col("system_memory")).alias("system_memory_trend"),
            spread(F.col("system_memory")).alias("system_memory_variance"),
        )
        .withColumn("session_start", F.col("session.start"))
        .withColumn("session_end", F.col("session.end"))
        .drop("session", "first_sample_ts", "last_sample_ts")
    )
