"""Training-curve tables: ``run_id, tag, step, value``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

METRICS_SCHEMA = "run_id STRING, tag STRING, step BIGINT, value DOUBLE"
_MAP = "MAP<STRING, ARRAY<ARRAY<DOUBLE>>>"


def read_metrics(spark: SparkSession, path: str | list[str], layout: str = "dump") -> DataFrame:
    """Read metric files and drop points that were logged twice.

    ``dump``: JSON files ``{tag: [[step, value], …]}``, one run per file, named
    by its path. ``maps``: JSON lines of such maps with their ``run_id``.
    ``rows``: JSON lines with the four columns.
    """
    if layout == "rows":
        return spark.read.schema(METRICS_SCHEMA).json(path).distinct()
    if layout == "maps":
        maps = spark.read.schema(f"run_id STRING, metrics {_MAP}").json(path)
        runs = maps.select("run_id", "metrics")
    elif layout == "dump":
        files = spark.read.text(path, wholetext=True)
        runs = files.select(
            F.col("_metadata.file_path").alias("run_id"),
            F.from_json("value", _MAP).alias("metrics"),
        )
    else:
        raise ValueError(f"layout must be 'dump', 'maps' or 'rows', not {layout!r}")
    tags = runs.select("run_id", F.explode("metrics").alias("tag", "points"))
    points = tags.select("run_id", "tag", F.explode("points").alias("p"))
    return points.select(
        "run_id",
        "tag",
        F.col("p")[0].cast("bigint").alias("step"),
        F.col("p")[1].alias("value"),
    ).distinct()
