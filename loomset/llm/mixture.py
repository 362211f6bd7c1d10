"""Mixing sources to target weights.

Sizes are summed per source (map-side first), the targets of the sources follow
from their weights, and every document is emitted ``floor(rate)`` times plus
once more with the probability of the fraction, decided by a hash of its id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, Window

from loomset.llm.words import count_words
from loomset.operators.joins import lookup_join
from loomset.storage import materialise

WEIGHTS = (5.0, 2.0, 1.0)
TOTAL_SHARE = 1.5
MAX_RATE = 2.0
SEED = 42

# A source table within both bounds is broadcast, any other is joined salted.
_BROADCAST_ROWS = 100_000
_BROADCAST_CHARS = 4_000_000


def _key(source: Column) -> Column:
    """A join key that never is NULL and tells NULL from every string."""
    return F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit("n"))


def targets(
    sizes: DataFrame,
    source: str = "source",
    size: str = "size",
    weights: tuple[float, ...] = WEIGHTS,
    total_share: float = TOTAL_SHARE,
    max_rate: float = MAX_RATE,
) -> DataFrame:
    """One row per source: ``_source`` (a join key, see ``_key``), ``source_size``, ``target``.

    Sources in order of their code points (NULL last) weigh ``weights`` in
    turn and share ``total_share`` of all sizes. A target stops at
    ``max_rate`` times the size of its source; what is cut off is shared by the
    others by weight until no target is above. An empty table has no sources;
    a source without words has target 0.

    The table of sources is written in sorted order and numbered from the
    counts of its parts, so that no single task needs all sources. Each round
    of the sharing is one aggregate of two numbers.
    """
    total = (
        sizes.groupBy(F.col(source).cast("string").alias("_name"))
        .agg(F.coalesce(F.sum(size), F.lit(0)).cast("bigint").alias("source_size"))
        .orderBy(F.col("_name").asc_nulls_last())
        .withColumn("_id", F.monotonically_increasing_id())
    )
    table = materialise(total, "sources")
    part = F.shiftright("_id", 33)
    parts = table.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    # One row per part of the sorted table, so at most as many as there are shuffle partitions.
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select("_part", F.sum("_n").over(before).alias("_before"))
    rank = F.coalesce("_before", F.lit(0)) + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    turn = F.array(*[F.lit(float(w)) for w in weights])
    weighed = materialise(
        table.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part", "left")
        .select("_name", "source_size", F.get(turn, (rank % len(weights)).cast("int")).alias("_weight")),
        "weighed-sources",
    )
    cap = F.col("source_size") * F.lit(float(max_rate))
    everything = weighed.agg(F.sum("source_size")).first()[0] or 0
    capped_sum, free_weight, level, settled = 0.0, None, 0.0, None
    while True:
        capped = cap <= F.lit(level) * F.col("_weight")
        n, capped_sum, free_weight = weighed.agg(
            F.count_if(capped), F.sum(F.when(capped, cap)), F.sum(F.when(~capped, F.col("_weight")))
        ).first()
        if n == settled or not free_weight:
            break
        settled = n
        level = (total_share * everything - (capped_sum or 0.0)) / free_weight
    target = F.least(cap, F.lit(level) * F.col("_weight"))
    return weighed.select(_key(F.col("_name")).alias("_source"), "source_size", target.alias("target"))


def uniform(key: Column, seed: int = SEED) -> Column:
    """A repeatable number in [0, 1) from the first 52 bits of md5('seed:key'); NULL keys count as ''."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def plan(
    docs: DataFrame, sizes: DataFrame, doc_id: str = "doc_id", source: str = "source", seed: int = SEED, **how
) -> DataFrame:
    """Add ``source_size``, ``target`` and ``copies`` to every row of ``docs``.

    ``sizes`` holds (source, size) of all documents. ``copies`` is
    ``floor(rate)`` plus one with the probability of the fraction, rate being
    target / source_size. Rows with equal ids take the same decision, NULL ids
    that of the empty string; reruns agree. Columns of ``docs`` that carry one
    of the three names are replaced; rows stay one to one.
    """
    kept = [c for c in docs.columns if c not in ("source_size", "target", "copies")]
    table = materialise(targets(sizes, source, **how), "targets")
    n, chars = table.agg(F.count("*"), F.sum(F.length("_source"))).first()
    small = n <= _BROADCAST_ROWS and (chars or 0) <= _BROADCAST_CHARS
    rows = docs.select(*kept, _key(F.col(source)).alias("_source"))
    joined = lookup_join(rows, table, "_source", table_rows=n if small else None)
    rate = F.coalesce(F.try_divide(F.col("target"), F.col("source_size")), F.lit(0.0))
    copies = F.floor(rate) + (uniform(F.col(doc_id), seed) < rate - F.floor(rate)).cast("bigint")
    return joined.select(*kept, "source_size", "target", copies.alias("copies"))


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", **how) -> DataFrame:
    """Every row of ``docs`` as often as ``plan`` says, with its columns; sizes are words of ``text`` (NULL: 0)."""
    names = {c: f"_doc_{i}" for i, c in enumerate(docs.columns)}
    rows = docs.withColumnsRenamed(names)
    sizes = rows.select(names[source], count_words(F.col(names[text])).alias("size"))
    planned = plan(rows, sizes, names[doc_id], names[source], **how)
    copies = planned.withColumn("_copy", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))))
    return copies.select(*[F.col(new).alias(old) for old, new in names.items()])
