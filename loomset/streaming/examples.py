"""Example preparation as Structured Streaming: the stateless steps and incremental dedup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from loomset.operators.formats import format_expr, to_pair
from loomset.plans.prepare import PrepareConfig, expanded_pairs, judged


def stream_examples(
    records: DataFrame, cfg: PrepareConfig = PrepareConfig(), fmt: str | None = None
) -> DataFrame:
    """Pairs, text and quality rules for a stream with a VARIANT column ``raw``.

    A stream has no first record to look at, so the layout is given or taken
    from each record. Dialogue records give one example per assistant turn,
    numbered by ``turn_pos``, which is NULL for other records.
    """
    typed = records.withColumn("fmt", format_expr(F.col("raw")) if fmt is None else F.lit(fmt))
    single = F.col("fmt") != "sharegpt"
    examples = (
        to_pair(typed.where(single), fmt, cfg.system_prompt, cfg.strict_pair)
        .withColumn("over_length", F.lit(False))
        .withColumn("turn_pos", F.lit(None).cast("int"))
    )
    if fmt in (None, "sharegpt"):
        expanded = expanded_pairs(typed.where(~single), cfg)
        examples = expanded if fmt else examples.unionByName(expanded)
    kept = judged(examples, cfg).where(F.col("reject_reason").isNull())
    return kept.drop("reject_reason", "error", "over_length")


def stream_dedup(
    examples: DataFrame, ts: str = "ts", delay: str = "1 hour", key: Column | None = None, key_len: int = 200
) -> DataFrame:
    """Drop repeats of a text prefix that arrive within ``delay``; the first arrival stays."""
    key = F.substring("text", 1, key_len) if key is None else key
    return (
        examples.withWatermark(ts, delay)
        .withColumn("_dedup_key", key)
        .dropDuplicatesWithinWatermark(["_dedup_key"])
        .drop("_dedup_key")
    )


def stream_dedup_first(
    examples: DataFrame, order: str, ts: str = "ts", delay: str = "1 hour", key: Column | None = None, key_len: int = 200
) -> DataFrame:
    """Of the rows that share a text prefix, the one that is first by ``order``, in whatever order they arrive.

    The state holds one row per prefix; it is emitted once the watermark is
    ``delay`` past the prefix's last row, so rows of a prefix are one group
    while less than ``delay`` lies between neighbours. Equal to ``dedup_prefix``
    on the same rows. ``order`` must not be NULL and is unique among the rows
    of a prefix; rows without time never leave the stream.
    """
    key = F.substring("text", 1, key_len) if key is None else key
    return (
        examples.withWatermark(ts, delay)
        .groupBy(key.alias("_dedup_key"), F.session_window(ts, delay).alias("_open"))
        .agg(F.min_by(F.struct(*examples.columns), order).alias("_first"))
        .select("_first.*")
    )
