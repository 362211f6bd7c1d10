"""Embedding-based matching score of predictions and references."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructType

from loomset.operators.joins import lookup_join
from loomset.storage import materialise

# Token vectors packed into one row; positions are unique per pair and side.
PACK = 128
# Packs of one side that one task compares with as many of the other side.
GROUP = 16


_BEST = StructType().add("p", ArrayType(DoubleType())).add("r", ArrayType(DoubleType()))


def _unit(vectors: np.ndarray) -> np.ndarray:
    matrix = np.stack([np.asarray(v, dtype=np.float64) for v in vectors])
    norm = np.linalg.norm(matrix, axis=1, keepdims=True)
    return matrix / np.where(norm > 0, norm, 1.0)


@F.pandas_udf(_BEST)
def _best_matches(prediction: pd.Series, reference: pd.Series) -> pd.DataFrame:
    """Best cosine of every prediction vector and of every reference vector of two packs."""
    best_p, best_r = [], []
    for p, r in zip(prediction, reference):
        cosine = _unit(p) @ _unit(r).T
        best_p.append(cosine.max(axis=1))
        best_r.append(cosine.max(axis=0))
    return pd.DataFrame({"p": best_p, "r": best_r})


def bertscore(token_vectors: DataFrame) -> DataFrame:
    """Per pair: precision, recall and F1 of greedy token matching (Zhang et al. 2020).

    Input: ``pair_id, side ('pred' | 'ref'), pos, vec``. Every prediction token
    takes its most similar reference token and the other way round. Vectors are
    packed ``PACK`` to a row, packs of a pair meet by an equi-join, and only
    the best similarity per token leaves a pack pair, not the similarities of all
    token pairs. A text of more than ``PACK * GROUP`` tokens is cut into groups
    of packs that meet in separate tasks. A pair with one side only scores 0.
    """
    group = PACK * GROUP

    def groups(side: str) -> Column:
        last = F.max(F.when(F.col("side") == side, F.col("pos")))
        return F.floor(F.coalesce(last, F.lit(0)) / group) + 1

    pairs = token_vectors.groupBy("pair_id").agg(
        groups("pred").alias("p_groups"), groups("ref").alias("r_groups")
    )
    large = materialise(
        pairs.where((F.col("p_groups") > 1) | (F.col("r_groups") > 1)), "large-pairs"
    )
    n_large = large.count()
    packs = (
        token_vectors.withColumn("pack", F.floor(F.col("pos") / PACK))
        .groupBy("pair_id", "side", "pack")
        .agg(F.collect_list(F.struct("pos", "vec")).alias("tokens"))
    )
    meet = ["pair_id"]
    if n_large:
        packs = lookup_join(packs, large, "pair_id", "left", n_large)
        meet += ["p_group", "r_group"]

    def side(name: str, tag: str, other: str) -> DataFrame:
        rows = packs.where(F.col("side") == name)
        if n_large:
            # One copy per group of the other side.
            copies = F.coalesce(f"{other}_groups", F.lit(1).cast("bigint"))
            rows = rows.withColumn(f"{tag}_group", F.floor(F.col("pack") / GROUP)).withColumn(
                f"{other}_group", F.explode(F.sequence(F.lit(0).cast("bigint"), copies - 1))
            )
        return rows.select(
            *meet,
            F.col("tokens.pos").alias(f"{tag}_places"),
            F.col("tokens.vec").alias(f"{tag}_vectors"),
        )

    met = side("pred", "p", "r").join(side("ref", "r", "p"), meet)
    best = met.select(
        "pair_id", "p_places", "r_places", _best_matches("p_vectors", "r_vectors").alias("best")
    )
    both = F.array(
        F.struct(F.lit("p").alias("side"), F.arrays_zip(
            F.col("p_places").alias("pos"), F.col("best.p").alias("best")).alias("t")),
        F.struct(F.lit("r").alias("side"), F.arrays_zip(
            F.col("r_places").alias("pos"), F.col("best.r").alias("best")).alias("t")),
    )
    tokens = (
        best.select("pair_id", F.explode(both).alias("s"))
        .select("pair_id", "s.side", F.inline("s.t").alias("pos", "best"))
        .groupBy("pair_id", "side", "pos")
        .agg(F.max("best").alias("best"))
    )
    means = tokens.groupBy("pair_id").agg(
        F.avg(F.when(F.col("side") == "p", F.col("best"))).alias("p"),
        F.avg(F.when(F.col("side") == "r", F.col("best"))).alias("r"),
    )
    p, r = F.coalesce("p", F.lit(0.0)), F.coalesce("r", F.lit(0.0))
    return pairs.join(means, "pair_id", "left").select(
        "pair_id",
        p.alias("bertscore_precision"),
        r.alias("bertscore_recall"),
        F.when(p + r != 0, 2 * p * r / (p + r)).otherwise(0.0).alias("bertscore_f1"),
    )
