"""Running aggregates over ordered rows of a key, computed in blocks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F, Window

# name → (aggregate over rows, how two partial values combine)
_KINDS: dict[str, tuple[Callable, Callable]] = {
    "min": (F.min, F.least),
    "max": (F.max, F.greatest),
    "sum": (F.sum, lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))),
}


def running_before(
    df: DataFrame, keys: list[str], block: Column, order: str, **values: tuple[str, Column]
) -> DataFrame:
    """Add columns with an aggregate over all earlier rows of the same keys.

    ``values`` maps a new column to ``(kind, expression)`` with kind 'min',
    'max' or 'sum'; the first row of a key gets NULL ('sum': 0).

    ``block`` must never decrease along ``order``. Rows are windowed per
    (keys, block) only; the totals of the blocks, one row each, are windowed
    per key and joined back. A key with very many rows is thus spread over as
    many tasks as it has blocks. NULL-skipping least/greatest join the parts.
    """
    rows = df.withColumn("_block", block)
    inside = (
        Window.partitionBy(*keys, "_block")
        .orderBy(order)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    earlier = (
        Window.partitionBy(*keys)
        .orderBy("_block")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    totals = rows.groupBy(*keys, "_block").agg(
        *[_KINDS[kind][0](expr).alias(f"_t_{name}") for name, (kind, expr) in values.items()]
    )
    offsets = totals.select(
        *keys,
        "_block",
        *[
            _KINDS[kind][0](f"_t_{name}").over(earlier).alias(f"_o_{name}")
            for name, (kind, _) in values.items()
        ],
    )
    local = rows.select(
        *rows.columns,
        *[
            _KINDS[kind][0](expr).over(inside).alias(f"_i_{name}")
            for name, (kind, expr) in values.items()
        ],
    )
    joined = local.join(offsets, [*keys, "_block"])
    return joined.select(
        *df.columns,
        *[
            _KINDS[kind][1](F.col(f"_o_{name}"), F.col(f"_i_{name}")).alias(name)
            for name, (kind, _) in values.items()
        ],
    )
