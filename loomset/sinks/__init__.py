"""Writers of the tables a run leaves behind."""

from __future__ import annotations

from dataclasses import asdict

from pyspark.sql import DataFrame, functions as F

from loomset.plans.prepare import PrepareConfig

# Steps of one run and tag that share a JSON line of a metric dump.
DUMP_BLOCK = 4096


def write_examples(examples: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists") -> None:
    """Train and validation examples, one folder per split."""
    examples.write.mode(mode).partitionBy("split").format(fmt).save(path)


def write_metrics(metrics: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Metric points as JSON lines."""
    metrics.select("run_id", "tag", "step", "value").write.mode(mode).json(path)


def write_metric_maps(metrics: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Metric points as JSON lines ``{"run_id", "metrics": {tag: [[step, value], …]}}``.

    A line holds one tag and at most ``DUMP_BLOCK`` step numbers, so that a long run
    becomes many lines instead of one huge one.
    """
    point = F.array(F.col("step").cast("double"), F.col("value"))
    lines = metrics.groupBy("run_id", "tag", F.floor(F.col("step") / DUMP_BLOCK).alias("block")).agg(
        F.array_sort(F.collect_list(point)).alias("points")
    )
    lines.select("run_id", F.create_map("tag", "points").alias("metrics")).write.mode(mode).json(path)


def write_report(report: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """A one-row report as JSON; measures that are NULL are left out."""
    report.write.mode(mode).json(path)


def write_predictions(pairs: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Prompt, reference and prediction as JSON lines, keyed by ``pair_id``."""
    pairs.select("pair_id", "prompt", "reference", "prediction").write.mode(mode).json(path)


def write_samples(pairs: DataFrame, performance: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Sample outputs with their performance row, both keyed by ``request_id``."""
    fields = [c for c in performance.columns if c != "request_id"]
    nested = performance.select("request_id", F.struct(*fields).alias("performance"))
    pairs.join(nested, "request_id", "left").write.mode(mode).json(path)


def manifest(
    examples: DataFrame, cfg: PrepareConfig, dataset_format: str | None, base_model: str = "", **extra
) -> DataFrame:
    """One row describing a prepared data set: format, counts, settings and the time."""
    settings = {**asdict(cfg), **extra}
    return examples.agg(
        F.count_if(F.col("split") == "train").alias("n_train"),
        F.count_if(F.col("split") == "val").alias("n_val"),
    ).select(
        F.lit(base_model).alias("base_model"),
        F.lit(cfg.task_type).alias("task_type"),
        F.lit(dataset_format).cast("string").alias("dataset_format"),
        "n_train",
        "n_val",
        F.to_json(F.struct(*[F.lit(str(v)).alias(k) for k, v in settings.items()])).alias("settings"),
        F.current_timestamp().alias("created_at"),
    )


def write_manifest(row: DataFrame, path: str, mode: str = "errorifexists") -> None:
    row.write.mode(mode).json(path)
