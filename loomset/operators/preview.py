"""A first look at record files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from loomset.operators.formats import format_expr
from loomset.operators.joins import lookup_join
from loomset.sources.records import read_records, scan_files
from loomset.storage import materialise

HEAD_CHARS = 500


def preview_groups(df: DataFrame, group: str, order: Column, raw: Column, json: Column) -> DataFrame:
    """Per group: row count, and layout, keys and the beginning of its first valid record.

    ``order`` is one number, unique per group. Counting and finding the first
    place is a hash aggregation of narrow columns. Its result is counted, so
    that it can be broadcast if small: the records themselves do not move.
    """
    rows = df.withColumn("_order", order)
    firsts = materialise(
        rows.groupBy(group).agg(
            F.count("*").alias("n"),
            F.coalesce(F.min(F.when(raw.isNotNull(), F.col("_order"))), F.min("_order")).alias("_first"),
        ),
        "firsts",
    )
    found = lookup_join(rows, firsts, group, "inner", firsts.count())
    return found.where(F.col("_order") == F.col("_first")).select(
        group,
        "n",
        format_expr(raw).alias("fmt"),
        F.array_join(F.json_object_keys(json), ",").alias("keys"),
        F.left(json, F.lit(HEAD_CHARS)).alias("head"),
    )


def preview(spark: SparkSession, path: str, n_files: int = 3) -> DataFrame:
    """Preview of the first files by path; other files are not read."""
    records = read_records(spark, scan_files(spark, path)[:n_files])
    # Row numbers stay below 2**63: one decimal orders block starts, then rows.
    rows_per_block = F.lit(str(2**63)).cast("decimal(19,0)")
    place = F.col("block_start").cast("decimal(19,0)") * rows_per_block + F.col("rid")
    return preview_groups(records, "path", place, F.col("raw"), F.col("json"))
