"""Training curves: summary, series, early stop. Input: ``run_id, tag, step, value``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, Window

# Metric names.
TRAIN_LOSS = "train/loss"
TRAIN_LOSS_FALLBACK = "loss"
EVAL_LOSS = "eval/loss"
LEARNING_RATE = "train/learning_rate"

# Steps per block of a series; steps are unique per run and tag.
STEP_BLOCK = 4096


# Metric name → curve of a report.
CURVES = {TRAIN_LOSS: "train_loss", EVAL_LOSS: "eval_loss", LEARNING_RATE: "learning_rate"}


def curves(metrics: DataFrame) -> DataFrame:
    """The three curves of a report as one table ``run_id, curve, step, value``.

    Runs without ``train/loss`` show ``loss`` as their training loss.
    """
    name = F.col("tag")
    for tag, curve in CURVES.items():
        name = F.when(F.col("tag") == tag, curve).otherwise(name)
    direct = metrics.where(F.col("tag").isin(*CURVES))
    named_runs = metrics.where(F.col("tag") == TRAIN_LOSS).select("run_id").distinct()
    fallback = metrics.where(F.col("tag") == TRAIN_LOSS_FALLBACK).join(
        named_runs, "run_id", "left_anti"
    )
    return direct.select("run_id", name.alias("curve"), "step", "value").unionByName(
        fallback.select("run_id", F.lit(CURVES[TRAIN_LOSS]).alias("curve"), "step", "value")
    )


def series(metrics: DataFrame, curve: str) -> DataFrame:
    """One curve, ready for ``poly_fit``: ``run_id, step, value``."""
    return curves(metrics).where(F.col("curve") == curve).drop("curve")


def loss_summary(metrics: DataFrame) -> DataFrame:
    """Per run: first, last and best training loss, reduction, counts, best eval loss.

    One pass: both candidate tags are aggregated side by side and the fallback
    is chosen afterwards, one row per run. The best step is the earliest one.
    """

    def at(tag: str, value: Column) -> Column:
        return F.when(F.col("tag") == tag, value)

    value, step = F.col("value"), F.col("step")
    per_tag = []
    for prefix, tag in (("a", TRAIN_LOSS), ("b", TRAIN_LOSS_FALLBACK)):
        per_tag += [
            F.count(at(tag, step)).alias(f"{prefix}_n"),
            F.min_by("value", at(tag, step)).alias(f"{prefix}_initial"),
            F.max_by("value", at(tag, step)).alias(f"{prefix}_final"),
            F.min(at(tag, F.struct("value", "step"))).alias(f"{prefix}_best"),
            F.max(at(tag, step)).alias(f"{prefix}_last"),
        ]
    sums = metrics.groupBy("run_id").agg(*per_tag, F.min(at(EVAL_LOSS, value)).alias("best_eval_loss"))

    def pick(name: str) -> Column:
        return F.when(F.col("a_n") > 0, F.col(f"a_{name}")).otherwise(F.col(f"b_{name}"))

    summary = sums.select(
        "run_id",
        pick("initial").alias("initial_loss"),
        pick("final").alias("final_loss"),
        pick("best")["value"].alias("best_loss"),
        pick("best")["step"].alias("best_step"),
        pick("last").alias("total_steps"),
        pick("n").alias("n_points"),
        "best_eval_loss",
    ).where(F.col("n_points") > 0)
    drop = F.col("initial_loss") - F.col("final_loss")
    return summary.withColumn(
        "reduction_pct",
        F.when(F.col("initial_loss") != 0, drop / F.col("initial_loss") * 100),
    )


def early_stop(metrics: DataFrame, patience: int = 3) -> DataFrame:
    """Per run: best evaluation and the step at which training would have stopped.

    An evaluation improves if it is strictly below all earlier ones; training
    stops at the first evaluation that is the ``patience``-th in a row without
    improvement. ``stop_step`` is NULL if that never happens, and the best
    evaluation is then the best of the whole series; else the best up to the stop.

    The last improvement before an evaluation is the least (value, step) before
    it. It is looked for within blocks of steps, one row per block is ordered
    per run, and the two are joined: a long run is spread over its blocks.
    """
    evals = metrics.where(F.col("tag") == EVAL_LOSS).withColumn("block", F.floor(F.col("step") / STEP_BLOCK))
    inside = Window.partitionBy("run_id", "block").orderBy("step")
    mark = F.struct("value", "step", "place")
    rows = evals.withColumn("place", F.row_number().over(inside).cast("bigint")).withColumn(
        "near", F.min(mark).over(inside.rowsBetween(Window.unboundedPreceding, -1))
    )
    earlier = (
        Window.partitionBy("run_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    )
    blocks = (
        rows.groupBy("run_id", "block")
        .agg(F.count("*").alias("n"), F.min(mark).alias("least"))
        .withColumn("offset", F.coalesce(F.sum("n").over(earlier), F.lit(0).cast("bigint")))
        .select(
            "run_id",
            "block",
            "offset",
            F.min(_moved("least", "offset")).over(earlier).alias("far"),
        )
    )
    best = F.least("far", _moved("near", "offset"))
    seen = rows.join(blocks, ["run_id", "block"]).select(
        "run_id", "step", "value", (F.col("offset") + F.col("place")).alias("place"), best.alias("best")
    )
    improved = F.col("best").isNull() | (F.col("value") < F.col("best.value"))
    waited = F.when(~improved, F.col("place") - F.col("best.place"))
    runs = seen.groupBy("run_id").agg(
        F.min(F.when(waited >= patience, F.struct("step", "best"))).alias("stop"),
        F.min(F.struct("value", "step")).alias("least"),
        F.count("*").alias("n_evals"),
    )
    return runs.select(
        "run_id",
        F.col("stop.step").alias("stop_step"),
        F.coalesce("stop.best.step", "least.step").alias("best_step"),
        F.coalesce("stop.best.value", "least.value").alias("best_value"),
        "n_evals",
    )


def _moved(mark: str, offset: str) -> Column:
    """A mark whose place counts from the first block instead of its own; NULL stays NULL."""
    m = F.col(mark)
    moved = F.struct(
        m["value"].alias("value"), m["step"].alias("step"), (m["place"] + F.col(offset)).alias("place")
    )
    return F.when(m.isNotNull(), moved)
