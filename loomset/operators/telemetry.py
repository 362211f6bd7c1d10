"""Inference telemetry: latency, speed, resources and memory per request.

Tables: ``requests(request_id, start_ts, end_ts, input_tokens, output_tokens)``,
``tokens(request_id, ts, chunk)``, ``samples(request_id, ts, cpu, …)`` and
``baseline(request_id, …)``; all but ids may be NULL in ``samples``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, Window

from loomset.functions.ratings import memory_grade, speed_rating, suggestions, utilisation_pct
from loomset.operators.running import running_before

# Session slots per block.
SLOT_BLOCK = 4096

# Microseconds per block of token times: at most 10**7 distinct times each.
GAP_BLOCK = 10_000_000


def seconds_between(start: Column, end: Column) -> Column:
    return (F.unix_micros(end) - F.unix_micros(start)) / 1e6


def token_gaps(tokens: DataFrame) -> DataFrame:
    """Positive gaps between consecutive tokens of a request: ``request_id, ts, gap``.

    Equal times have no gap between them, so times are made distinct first,
    which spreads even one very long request over all tasks. The time before
    is a running maximum, taken in blocks of ten seconds.
    """
    times = tokens.groupBy("request_id", F.unix_micros("ts").alias("us")).agg(
        F.max("ts").alias("ts")
    )
    before = running_before(
        times, ["request_id"], F.floor(F.col("us") / GAP_BLOCK), "us", prev=("max", F.col("us"))
    )
    return before.where(F.col("prev").isNotNull()).select(
        "request_id", "ts", ((F.col("us") - F.col("prev")) / 1e6).alias("gap")
    )


def token_stats(tokens: DataFrame) -> DataFrame:
    """Per request: chunks, first and last time, and number of distinct times."""
    times = tokens.groupBy("request_id", "ts").agg(F.count("*").alias("n"))
    return times.groupBy("request_id").agg(
        F.sum("n").alias("n_chunks"),
        F.count("*").alias("n_times"),
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
    )


def real_time_speed(n_times: Column, first_ts: Column, last_ts: Column) -> Column:
    """1 / mean of the positive gaps: those of sorted times add up to last - first."""
    return F.when(n_times > 1, (n_times - 1) / seconds_between(first_ts, last_ts))


def with_speeds(df: DataFrame) -> DataFrame:
    """Times and speeds from ``start_ts, end_ts, first_ts, last_ts, n_times, n_chunks`` and counts."""
    total, generation = F.col("total_inference_time"), F.col("pure_generation_time")
    outputs, inputs = F.col("output_tokens"), F.col("input_tokens")
    pure = F.when((generation > 0) & (outputs > 1), (outputs - 1) / generation)
    timed = df.withColumn(
        "total_inference_time", seconds_between(F.col("start_ts"), F.col("end_ts"))
    ).withColumn(
        "first_token_latency",
        F.coalesce(seconds_between(F.col("start_ts"), F.col("first_ts")), F.lit(0.0)),
    ).withColumn(
        "pure_generation_time",
        F.coalesce(seconds_between(F.col("first_ts"), F.col("end_ts")), total),
    ).withColumn(
        "input_tokens", F.coalesce("input_tokens", F.lit(0).cast("bigint"))
    ).withColumn(
        "output_tokens", F.coalesce("output_tokens", "n_chunks", F.lit(0).cast("bigint"))
    )
    return timed.select(
        "request_id",
        "total_inference_time",
        "first_token_latency",
        "pure_generation_time",
        "input_tokens",
        "output_tokens",
        (inputs + outputs).alias("total_tokens"),
        F.when(total > 0, outputs / total).alias("total_inference_speed"),
        F.when(total > 0, (inputs + outputs) / total).alias("overall_processing_speed"),
        pure.alias("pure_generation_speed"),
        pure.alias("response_speed"),
        real_time_speed(F.col("n_times"), F.col("first_ts"), F.col("last_ts")).alias(
            "real_time_avg_speed"
        ),
        speed_rating(pure).alias("rating"),
    )


def speeds(requests: DataFrame, tokens: DataFrame) -> DataFrame:
    """Latency and speed of every request; both sides meet with one row per request."""
    return with_speeds(requests.join(token_stats(tokens), "request_id", "left"))


# Resource readings and the statistics kept of them.
READINGS = {
    "cpu": ("avg", "max", "min"),
    "gpu_usage": ("avg", "max", "min"),
    "gpu_temp": ("avg", "max"),
    "gpu_power": ("avg", "max"),
}
# Peaks: name → reading.
PEAKS = {
    "system_memory_peak": "system_memory",
    "pytorch_memory_peak": "pytorch_allocated",
    "gpu_memory_peak": "gpu_memory_used",
}

_STATISTICS = {"avg": F.avg, "max": F.max, "min": F.min}


def peak(value: str) -> Column:
    """A running maximum that starts at 0."""
    return F.greatest(F.max(value), F.lit(0.0))


def summary_aggregates() -> list[Column]:
    """Resource aggregates of one request's samples; all merge map-side."""
    gpu_seen = F.count("gpu_memory_allocated") > 0
    return [
        F.count("*").alias("n_samples"),
        F.min("ts").alias("first_sample_ts"),
        F.max("ts").alias("last_sample_ts"),
        *[_STATISTICS[k](r).alias(f"{r}_{k}") for r, kinds in READINGS.items() for k in kinds],
        F.when(gpu_seen, F.avg(F.coalesce("gpu_memory_allocated", F.lit(0.0)))).alias("gpu_memory_avg"),
        *[peak(reading).alias(name) for name, reading in PEAKS.items()],
    ]


def _over_baseline(value: str, base: str) -> Column:
    return F.col(value) - F.coalesce(base, F.lit(0.0))


def resource_summary(samples: DataFrame, baseline: DataFrame | None = None) -> DataFrame:
    """Per request: CPU, GPU and memory summary; growth over the baseline if there is one.

    ``duration`` is the time of the last sample after ``baseline.start_ts``, or
    after the first sample if the start is unknown.
    """
    summary = samples.groupBy("request_id").agg(*summary_aggregates())
    if baseline is None:
        return summary.withColumn(
            "duration", seconds_between(F.col("first_sample_ts"), F.col("last_sample_ts"))
        ).drop("first_sample_ts", "last_sample_ts")
    start = F.col("first_sample_ts")
    if "start_ts" in baseline.columns:
        start = F.coalesce("start_ts", start)
    joined = summary.join(baseline, "request_id", "left")
    return joined.select(
        *[c for c in summary.columns if c not in ("first_sample_ts", "last_sample_ts")],
        seconds_between(start, F.col("last_sample_ts")).alias("duration"),
        _over_baseline("system_memory_peak", "system_memory_used").alias("system_memory_growth"),
        _over_baseline("pytorch_memory_peak", "gpu_memory_allocated").alias("pytorch_memory_growth"),
    )


def trend(value: Column, ts: str = "ts") -> Column:
    """'increasing' if the last value exceeds the first, 'stable' if not; NULL for one sample."""
    rising = F.max_by(value, ts) > F.min_by(value, ts)
    return F.when(F.count("*") > 1, F.when(rising, "increasing").otherwise("stable"))


def spread(value: Column) -> Column:
    """Largest minus smallest value; NULL for one sample."""
    return F.when(F.count("*") > 1, F.max(value) - F.min(value))


def memory_analysis(samples: DataFrame, baseline: DataFrame | None = None) -> DataFrame:
    """Per request: memory peaks, trends, and the footprint grade over the baseline."""
    system, torch = F.col("system_memory"), F.coalesce("pytorch_allocated", F.lit(0.0))
    analysis = samples.groupBy("request_id").agg(
        F.count("*").alias("n_snapshots"),
        peak("system_memory").alias("system_memory_peak"),
        peak("pytorch_allocated").alias("pytorch_memory_peak"),
        peak("gpu_memory_used").alias("gpu_memory_peak"),
        trend(system).alias("system_memory_trend"),
        trend(torch).alias("pytorch_memory_trend"),
        spread(system).alias("system_memory_variance"),
        spread(torch).alias("pytorch_memory_variance"),
        (F.count("pytorch_allocated") > 0).alias("_gpu"),
    )
    if baseline is None:
        return analysis.drop("_gpu")
    footprint = F.when(
        F.col("_gpu"), _over_baseline("pytorch_memory_peak", "gpu_memory_allocated")
    )
    extra = [F.col("gpu_memory_total")] if "gpu_memory_total" in baseline.columns else []
    total = extra[0] if extra else F.lit(0.0)
    return analysis.join(baseline, "request_id", "left").select(
        *[c for c in analysis.columns if c != "_gpu"],
        footprint.alias("model_memory_footprint"),
        memory_grade(footprint).alias("memory_efficiency"),
        utilisation_pct(F.col("pytorch_memory_peak"), total).alias("memory_utilisation_pct"),
    )


def request_performance(
    requests: DataFrame, tokens: DataFrame, samples: DataFrame
) -> DataFrame:
    """The performance row of every request: speeds beside the resource summary."""
    resources = resource_summary(samples).select(
        "request_id",
        F.col("pytorch_memory_peak").alias("gpu_memory_peak"),
        "gpu_usage_avg",
        "gpu_temp_avg",
        "gpu_power_avg",
    )
    return (
        speeds(requests, tokens)
        .join(resources, "request_id", "left")
        .select(
            "request_id",
            "first_token_latency",
            "total_inference_time",
            "total_inference_speed",
            "pure_generation_speed",
            "input_tokens",
            "output_tokens",
            "gpu_memory_peak",
            "gpu_usage_avg",
            "gpu_temp_avg",
            "gpu_power_avg",
        )
    )


def request_suggestions(
    speed_rows: DataFrame, summary_rows: DataFrame, memory_rows: DataFrame
) -> DataFrame:
    """Advice per request from the three per-request tables."""
    s = speed_rows.select(
        "request_id", "first_token_latency", "pure_generation_speed", F.lit(True).alias("_s")
    )
    r = summary_rows.select("request_id", "gpu_usage_avg", "cpu_avg", F.lit(True).alias("_r"))
    m = memory_rows.select(
        "request_id", "memory_efficiency", "pytorch_memory_peak", F.lit(True).alias("_m")
    )
    joined = s.join(r, "request_id", "full").join(m, "request_id", "full")
    advice = suggestions(
        F.col("first_token_latency"),
        F.col("pure_generation_speed"),
        F.col("gpu_usage_avg"),
        F.col("cpu_avg"),
        F.col("memory_efficiency"),
        F.col("pytorch_memory_peak"),
        F.col("_s"),
        F.col("_r"),
        F.col("_m"),
    )
    return joined.select("request_id", advice.alias("suggestions"))


def session_summary(samples: DataFrame, gap_seconds: int) -> DataFrame:
    """Resource summary and memory trend per session, the batch twin of ``stream_resources``.

    A session ends after ``gap_seconds`` without a sample. Samples are reduced
    to one row per ``gap_seconds`` of a request first: two samples in one such
    slot always share a session. Only slots are ordered, within blocks of
    slots, and one row per block is ordered per request: neither a long request
    nor a dense one burdens a single task.
    """
    gap = gap_seconds * 1_000_000
    slots = samples.groupBy("request_id", F.floor(F.unix_micros("ts") / gap).alias("slot")).agg(
        F.count("*").alias("n"),
        F.min("ts").alias("from_ts"),
        F.max("ts").alias("to_ts"),
        *_partials(),
    )
    inside = Window.partitionBy("request_id", "block").orderBy("slot")
    opens = F.unix_micros("from_ts") - F.lag(F.unix_micros("to_ts")).over(inside) > gap
    # Whether the first slot of a block opens a session is not known inside the block.
    rows = slots.withColumn("block", F.floor(F.col("slot") / SLOT_BLOCK)).withColumn(
        "opens", F.coalesce(opens, F.lit(False)).cast("bigint")
    )
    earlier = Window.partitionBy("request_id").orderBy("block")
    first_opens = F.unix_micros("from_ts") - F.lag(F.unix_micros("to_ts")).over(earlier) > gap
    blocks = (
        rows.groupBy("request_id", "block")
        .agg(
            F.min("from_ts").alias("from_ts"),
            F.max("to_ts").alias("to_ts"),
            F.sum("opens").alias("opens"),
        )
        .withColumn("first", F.coalesce(first_opens, F.lit(True)).cast("bigint"))
        .withColumn("upto", F.sum(F.col("opens") + F.col("first")).over(earlier))
        .select("request_id", "block", (F.col("upto") - F.col("opens")).alias("offset"))
    )
    numbered = (
        rows.withColumn("number", F.sum("opens").over(inside))
        .join(blocks, ["request_id", "block"])
        .withColumn("session", F.col("offset") + F.col("number"))
    )
    sessions = numbered.groupBy("request_id", "session").agg(
        F.sum("n").alias("n_samples"),
        *_combined(),
        F.min("from_ts").alias("session_start"),
        F.timestamp_micros(F.max(F.unix_micros("to_ts")) + gap).alias("session_end"),
    )
    return sessions.drop("session")


def run_summary(samples: DataFrame, idle_seconds: int) -> DataFrame:
    """One row per run of samples (request_id, ts, reset, cpu, system_memory), the batch twin of ``stream_runs``.

    A row with ``reset`` true is no sample and ends the run before it, as do
    ``idle_seconds`` without a sample; a reset at the time of a sample comes
    before it. Rows without time or request take no part. Samples are reduced
    to one row per instant first, and these are numbered in blocks of time, so
    a request that holds a large part of the table is spread over many tasks.
    """
    idle = idle_seconds * 1_000_000
    reset = F.coalesce("reset", F.lit(False))
    instants = (
        samples.where("request_id IS NOT NULL AND ts IS NOT NULL")
        .groupBy("request_id", F.unix_micros("ts").alias("us"))
        .agg(
            F.max(reset).alias("reset"),
            F.count_if(~reset).alias("n"),
            F.sum(F.when(~reset, F.col("cpu"))).alias("cpu_sum"),
            F.count(F.when(~reset, F.col("cpu"))).alias("cpu_n"),
            F.max(F.when(~reset, F.col("cpu"))).alias("cpu_max"),
            F.max(F.when(~reset, F.col("system_memory"))).alias("memory_max"),
        )
    )
    block = F.floor(F.col("us") / (idle * SLOT_BLOCK))
    seen = running_before(
        instants, ["request_id"], block, "us", last_us=("max", F.when(F.col("n") > 0, F.col("us")))
    )
    paused = (F.col("n") > 0) & (F.col("us") - F.col("last_us") > idle)
    opened = seen.withColumn("opens", (F.col("reset") | F.coalesce(paused, F.lit(False))).cast("bigint"))
    numbered = running_before(opened, ["request_id"], block, "us", before=("sum", F.col("opens")))
    runs = (
        numbered.where("n > 0")
        .groupBy("request_id", (F.col("before") + F.col("opens")).alias("run"))
        .agg(
            F.timestamp_micros(F.min("us")).alias("run_start"),
            F.timestamp_micros(F.max("us")).alias("run_end"),
            F.sum("n").alias("n_samples"),
            F.try_divide(F.sum("cpu_sum"), F.sum("cpu_n")).alias("cpu_avg"),
            F.max("cpu_max").alias("cpu_max"),
            peak("memory_max").alias("system_memory_peak"),
            F.count("*").alias("n_times"),
        )
    )
    speed = real_time_speed(F.col("n_times"), F.col("run_start"), F.col("run_end"))
    return runs.withColumn("sample_speed", speed).drop("run", "n_times")


def _partials() -> list[Column]:
    """What a slot keeps of its samples so that ``_combined`` can finish the summary."""
    kept = [
        keep(reading).alias(f"{reading}_{name}")
        for reading, kinds in READINGS.items()
        for name, keep in (("sum", F.sum), ("count", F.count), ("max", F.max), ("min", F.min))
        if name in ("sum", "count", *kinds)
    ]
    memory = F.col("system_memory")
    return [
        *kept,
        F.sum("gpu_memory_allocated").alias("gpu_memory_sum"),
        F.max("pytorch_allocated").alias("pytorch_allocated_max"),
        F.max("gpu_memory_used").alias("gpu_memory_used_max"),
        F.max(memory).alias("system_memory_max"),
        F.min(memory).alias("system_memory_min"),
        F.min_by(memory, "ts").alias("system_memory_first"),
        F.max_by(memory, "ts").alias("system_memory_last"),
    ]


def _combined() -> list[Column]:
    """The columns of ``summary_aggregates`` and the trend, from slots."""

    def finish(reading: str, kind: str) -> Column:
        if kind == "avg":
            return F.try_divide(F.sum(f"{reading}_sum"), F.sum(f"{reading}_count"))
        return _STATISTICS[kind](f"{reading}_{kind}")

    several = F.sum("n") > 1
    first, last = F.min_by("system_memory_first", "from_ts"), F.max_by("system_memory_last", "to_ts")
    return [
        *[finish(r, k).alias(f"{r}_{k}") for r, kinds in READINGS.items() for k in kinds],
        # A missing reading counts as 0 here, so the mean is over all samples.
        (F.sum("gpu_memory_sum") / F.sum("n")).alias("gpu_memory_avg"),
        *[peak(f"{reading}_max").alias(name) for name, reading in PEAKS.items()],
        F.when(several, F.when(last > first, "increasing").otherwise("stable")).alias(
            "system_memory_trend"
        ),
        F.when(several, F.max("system_memory_max") - F.min("system_memory_min")).alias(
            "system_memory_variance"
        ),
    ]
