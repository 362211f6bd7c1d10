"""Joins of a large table with one row per key, safe for keys that hold many rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import VariantType

BROADCAST_ROWS = 100_000
LEAST_SALTS = 16


def lookup_join(
    rows: DataFrame,
    table: DataFrame,
    on: str,
    how: str = "inner",
    table_rows: int | None = None,
) -> DataFrame:
    """Join ``rows`` to a narrow ``table`` holding at most one row per ``on`` value.

    With ``table_rows``, a count taken by the caller, of at most
    ``BROADCAST_ROWS`` the table is broadcast and ``rows`` do not move.
    Otherwise both sides are shuffled on the key and a salt, so that no task
    receives all rows of one key; the table is repeated once per salt, of which
    there are more on sessions with more shuffle partitions. As the
    result is not partitioned by the key, nothing behind the join can rely on
    that, which leaves adaptive execution free to split parts still too large.
    """
    if how not in ("inner", "left"):
        raise ValueError("lookup_join knows inner and left")
    if table_rows is not None and table_rows <= BROADCAST_ROWS:
        return rows.join(F.broadcast(table), on, how)
    # A variant cannot be hashed; any other columns spread the rows.
    others = [f.name for f in rows.schema if f.name != on and not isinstance(f.dataType, VariantType)]
    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salts = max(LEAST_SALTS, partitions // 8)
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*others), F.lit(salts)))
    repeated = table.withColumn(
        "_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint")))
    )
    return salted.join(repeated, [on, "_salt"], how).drop("_salt")
