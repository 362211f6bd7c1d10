"""Quality rules on rendered text, and first-of-its-prefix deduplication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, Window

from loomset.functions.text import is_solid

# Fixed value: the fewest characters that must remain besides blanks.
MIN_SOLID = 5


def reject_reason(
    text: Column,
    min_length: int = 10,
    max_length: int = 8192,
    error: Column | None = None,
    over_length: Column | None = None,
    check: bool = True,
) -> Column:
    """Why an example is left out, or NULL: 'error', 'empty', 'length' or 'blank'.

    ``text`` is stripped already; NULL text without another reason is an error.
    ``over_length`` marks examples known to be too long without being rendered.
    Without ``check`` only errors and empty texts go.
    """
    size = F.length(text)
    failed = text.isNull() if error is None else F.coalesce(error, F.lit(False)) | text.isNull()
    too_long = F.lit(False) if over_length is None else F.coalesce(over_length, F.lit(False))
    reason = F.when(too_long, "length").when(failed, "error").when(text == "", "empty")
    if not check:
        return reason
    return reason.when(~size.between(min_length, max_length), "length").when(
        ~is_solid(text, MIN_SOLID), "blank"
    )


def quality(
    df: DataFrame, min_length: int = 10, max_length: int = 8192, text: str = "text", check: bool = True
) -> DataFrame:
    """Add ``reject_reason`` to rows of stripped text."""
    return df.withColumn(
        "reject_reason", reject_reason(F.col(text), min_length, max_length, check=check)
    )


def quality_report(df: DataFrame) -> DataFrame:
    """Rows per reason; kept rows are counted under 'kept'."""
    reason = F.coalesce("reject_reason", F.lit("kept"))
    return df.groupBy(reason.alias("reject_reason")).agg(F.count("*").alias("n"))


def dedup_prefix(
    df: DataFrame, order: str, key_len: int = 200, key: Column | None = None
) -> DataFrame:
    """Keep, per key, the row that comes first by ``order`` (unique among equal keys' rows).

    The key defaults to the first ``key_len`` characters of ``text``. The rank
    filter is applied on the map side first, so a prefix shared by a large part
    of the table reaches its reducer as at most one row per input task.
    """
    key = F.substring("text", 1, key_len) if key is None else key
    first = Window.partitionBy("_dedup_key").orderBy(order)
    return (
        df.withColumn("_dedup_key", key)
        .withColumn("_place", F.row_number().over(first))
        .where(F.col("_place") == 1)
        .drop("_dedup_key", "_place")
    )
