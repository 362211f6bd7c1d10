"""Evaluate an expensive expression once per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def with_once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Like ``withColumn``, but filters on the column use its value.

    The optimizer moves a filter below a projection by repeating the projected
    expression in it. A rendered text tested by four rules would be rendered
    five times; a generator of one element keeps the two apart.
    """
    return df.select(*[c for c in df.columns if c != name], F.explode(F.array(value)).alias(name))
