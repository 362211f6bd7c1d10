"""Seeded order, exact rank cuts and the train/validation split."""

from __future__ import annotations

from collections.abc import Callable
from os.path import commonprefix

from pyspark.sql import Column, DataFrame, functions as F, Window

from loomset.storage import materialise

# Hex digits looked at per counting pass: at most 16**4 counts reach the driver.
_DIGITS = 4


def order_key(identity: Column, seed: int = 42) -> Column:
    """A repeatable pseudo-random sort key: 32 hex digits from seed and identity."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), identity.cast("string")))


def source_key(path: Column, block_start: Column, rid: Column) -> Column:
    """A sort key of fixed-width hex digits that keeps the order of the source files."""

    def hex16(number: Column) -> Column:
        return F.lpad(F.hex(number), 16, "0")

    return F.concat(F.hex(F.encode(path, "UTF-8")), F.lit("/"), hex16(block_start), hex16(rid))


def key_of_rank(df: DataFrame, key: str, rank: Callable[[int], int]) -> tuple[str, int]:
    """Where to cut a table in order of ``key`` so that ``rank(n)`` of its n rows come first.

    Returns the shortest prefix ``p`` such that exactly that many rows have
    ``key[:len(p)] <= p``, and n. Works like a radix selection: each pass counts
    rows per next group of digits below the prefix found so far and steps into
    the group where the running count reaches the rank. Nothing is sorted, and
    a pass returns at most 65,536 counts however large the table is. Digits
    that all remaining keys share are skipped at once. Keys must be unique
    strings; give it a materialised table, its key column is read once per pass.
    """
    prefix, missing, total = "", None, 0
    while True:
        below = df.where(F.col(key).startswith(prefix)) if prefix else df
        digits = F.substring(F.col(key), len(prefix) + 1, _DIGITS)
        groups = below.groupBy(digits.alias("digits")).agg(F.count("*").alias("n")).collect()
        if missing is None:
            total = sum(row["n"] for row in groups)
            missing = rank(total)
            if not 0 < missing <= total:
                return "", total
        for digit, n in sorted((row["digits"], row["n"]) for row in groups):
            if missing <= n:
                break
            missing -= n
        prefix += digit
        if n == missing:
            return prefix, total
        if len(groups) == 1:
            ends = below.agg(F.min(key).alias("lo"), F.max(key).alias("hi")).first()
            prefix = max(prefix, commonprefix([ends["lo"], ends["hi"]]), key=len)
        if len(digit) < _DIGITS:
            raise ValueError(f"{key!r} is not unique")


def split_exact(df: DataFrame, key: str, frac: float = 0.05) -> DataFrame:
    """Add ``split``: the first ``max(1, int(n * frac))`` rows by ``key`` are 'val'.

    ``key`` holds strings of one fixed width. The rows are written once, with a
    tie-breaker behind equal keys, so that the counting passes and the final
    read see the same rows; the split itself is then one comparison per row.
    The tie-breaker stays part of ``key``, which is unique from then on.
    """
    tie = F.lpad(F.hex(F.monotonically_increasing_id()), 16, "0")
    fixed = materialise(df.withColumn("_cut_key", F.concat(F.col(key), tie)), "split")
    cut, _ = key_of_rank(fixed, "_cut_key", lambda n: max(1, int(n * frac)))
    in_val = F.substring("_cut_key", 1, len(cut)) <= cut
    split = fixed.withColumn("split", F.when(in_val, "val").otherwise("train"))
    return split.withColumn(key, F.col("_cut_key")).drop("_cut_key")


def test_set(df: DataFrame, key: str, frac: float = 0.1) -> DataFrame:
    """The validation rows, or, if there are none, the last ``max(1, int(n * frac))`` by ``key``.

    ``df`` carries ``split``; keys are unique.
    """
    val = df.where(F.col("split") == "val")
    if not val.limit(1).isEmpty():
        return val
    train = df.where(F.col("split") == "train")
    cut, total = key_of_rank(train, key, lambda n: n - max(1, int(n * frac)))
    return train.where(F.substring(key, 1, len(cut)) > cut) if cut else train


def ranked(df: DataFrame, key: str) -> DataFrame:
    """Add ``rank`` (0, 1, …) over the whole table in order of a unique hex ``key``.

    Rows are ranked inside key ranges, which are even because the key is a
    hash, and shifted by the number of rows in the ranges before; that offset
    table has at most 65,536 rows, whatever the size of ``df``.
    """
    rows = df.withColumn("_range", F.substring(key, 1, _DIGITS))
    sizes = rows.groupBy("_range").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(F.lit(0)).orderBy("_range").rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = sizes.select(
        "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset")
    )
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(key)) - 1
    return (
        rows.withColumn("_inside", inside)
        .join(F.broadcast(offsets), "_range")
        .withColumn("rank", F.col("_offset") + F.col("_inside"))
        .drop("_range", "_inside", "_offset")
    )


def head(df: DataFrame, n: int, *order: Column | str) -> DataFrame:
    """The first ``n`` rows in an order: a top-n, never a full sort."""
    return df.orderBy(*order).limit(n)
