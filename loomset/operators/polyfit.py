"""Polynomial least squares per run, from power sums."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, DoubleType

from loomset.operators.joins import lookup_join

MAX_DEGREE = 5


def _scaled(step: Column, middle: Column, half: Column) -> Column:
    return (step - middle) / half


@F.pandas_udf(ArrayType(DoubleType()))
def _solve(degree: pd.Series, powers: pd.Series, moments: pd.Series) -> pd.Series:
    """Coefficients (lowest power first) of the normal equations, one run per row."""
    solved = []
    for d, s, b in zip(degree, powers, moments):
        size = int(d) + 1
        lines = np.arange(size)
        gram = np.asarray(s)[lines[:, None] + lines[None, :]]
        # A pseudo-inverse: repeated steps leave fewer equations than unknowns.
        solved.append(np.linalg.pinv(gram, rcond=1e-13, hermitian=True) @ np.asarray(b)[:size])
    return pd.Series(solved)


def poly_fit(
    points: DataFrame, degree: int | None = None, table_rows: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """Fit ``value`` over ``step`` for every ``run_id``.

    Returns ``(points with fitted, fits)``; ``fits`` has one row per run with
    ``degree, n_points, r2, middle, half, coefficients`` where the fitted value is
    ``sum(coefficients[k] * ((step - middle) / half) ** k)``. R² is 0 for a
    constant series. A run of fewer than ``degree + 1`` points gets degree
    ``max(1, n - 1)``; without ``degree`` runs of more than four points get
    ``min(5, n - 1)`` and shorter ones 3, lowered alike.

    Steps are scaled to [-1, 1] and values centred per run before sums of
    powers are taken, so the equations stay well conditioned; a run is reduced
    to 17 numbers by map-side aggregation before anything is solved.
    ``table_rows`` is a known bound for the number of runs (see ``lookup_join``).
    """
    if degree is not None and not 1 <= degree <= MAX_DEGREE:
        raise ValueError(f"degree must lie between 1 and {MAX_DEGREE}")
    low, high = F.min("step"), F.max("step")
    spans = points.groupBy("run_id").agg(
        F.count("*").alias("n_points"),
        ((low + high) / 2).alias("middle"),
        F.greatest((high - low) / 2, F.lit(1.0)).alias("half"),
        F.avg("value").alias("mean"),
        (F.min("value") == F.max("value")).alias("flat"),
    )
    centred = lookup_join(points, spans, "run_id", "inner", table_rows).select(
        "run_id",
        "n_points",
        "middle",
        "half",
        "mean",
        "flat",
        _scaled(F.col("step"), F.col("middle"), F.col("half")).alias("t"),
        (F.col("value") - F.col("mean")).alias("v"),
    )
    t, v = F.col("t"), F.col("v")
    powers = [F.lit(1.0)]
    for _ in range(2 * MAX_DEGREE):
        powers.append(powers[-1] * t)
    wanted = F.lit(degree) if degree else F.when(F.col("n_points") > 4, 5).otherwise(3)
    usable = F.greatest(F.lit(1), F.col("n_points") - 1)
    sums = (
        centred.groupBy("run_id", "n_points", "middle", "half", "mean", "flat")
        .agg(
            *[F.sum(p).alias(f"s{k}") for k, p in enumerate(powers)],
            *[F.sum(powers[k] * v).alias(f"b{k}") for k in range(MAX_DEGREE + 1)],
            F.sum(v * v).alias("total"),
        )
        .withColumn("degree", F.least(wanted, usable).cast("int"))
        .withColumn("moments", F.array(*[f"b{k}" for k in range(MAX_DEGREE + 1)]))
        .withColumn("powers", F.array(*[f"s{k}" for k in range(2 * MAX_DEGREE + 1)]))
    )
    solved = sums.withColumn("c", _solve("degree", "powers", "moments"))
    # At the solution the explained part is the product of moments and coefficients.
    explained = F.aggregate(
        F.zip_with(
            "c", F.slice("moments", F.lit(1), F.size("c")), lambda c, b: c * b
        ),
        F.lit(0.0),
        lambda acc, x: acc + x,
    )
    fits = solved.select(
        "run_id",
        "degree",
        "n_points",
        F.when(F.col("flat"), 0.0).otherwise(explained / F.col("total")).alias("r2"),
        "middle",
        "half",
        F.transform(
            "c", lambda c, k: F.when(k == 0, c + F.col("mean")).otherwise(c)
        ).alias("coefficients"),
    )
    with_fit = lookup_join(
        points, fits.select("run_id", "middle", "half", "coefficients"), "run_id", "inner", table_rows
    )
    at = _scaled(F.col("step"), F.col("middle"), F.col("half"))
    fitted = F.aggregate(
        F.reverse("coefficients"), F.lit(0.0), lambda acc, c: acc * at + c
    )
    return with_fit.select(*points.columns, fitted.alias("fitted")), fits


def step_coefficients(fits: DataFrame) -> DataFrame:
    """Add ``step_coefficients``: the same polynomials in powers of the step, highest first."""

    @F.pandas_udf(ArrayType(DoubleType()))
    def expand(coefficients: pd.Series, middle: pd.Series, half: pd.Series) -> pd.Series:
        inner = [np.poly1d([1.0 / h, -m / h]) for m, h in zip(middle, half)]
        return pd.Series(
            [
                np.pad(p.coeffs, (len(c) - len(p.coeffs), 0))
                for c, p in (
                    (c, np.poly1d(np.asarray(c)[::-1])(q)) for c, q in zip(coefficients, inner)
                )
            ]
        )

    return fits.withColumn("step_coefficients", expand("coefficients", "middle", "half"))
