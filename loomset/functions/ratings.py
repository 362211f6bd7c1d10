"""Ratings and suggestions on telemetry values."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Lower bound (exclusive) in tokens per second, and rating.
SPEED_RATINGS = (
    (30, "Excellent (>30)"),
    (20, "Good (20-30)"),
    (15, "Average (15-20)"),
    (10, "Below Average (10-15)"),
)
SLOWEST_RATING = "Needs Optimization (<10)"

# Upper bound (exclusive) of the model footprint in GB, and grade.
FOOTPRINT_GRADES = ((6, "good"), (8, "high"))
LARGEST_GRADE = "very_high"

# Advice texts.
ADVICE = {
    "latency": "Add model warmup to reduce first token latency",
    "speed": "Consider FP16 instead of 4bit if VRAM allows (check CPU-GPU transfer bottleneck)",
    "gpu": "Low GPU utilization - check batch size or input preprocessing",
    "cpu": "High CPU usage - optimize data preprocessing pipeline",
    "memory": "High memory usage - consider more aggressive quantization",
    "vram": "VRAM near limit - reduce max_new_tokens or batch size",
}


def speed_rating(speed: Column) -> Column:
    """Rating of a generation speed; a missing speed counts as 0."""
    speed = F.coalesce(speed, F.lit(0.0))
    rating = F.lit(SLOWEST_RATING)
    for bound, name in reversed(SPEED_RATINGS):
        rating = F.when(speed > bound, name).otherwise(rating)
    return rating


def memory_grade(footprint: Column) -> Column:
    """Grade of a model footprint in GB; NULL stays NULL."""
    grade = F.lit(LARGEST_GRADE)
    for bound, name in reversed(FOOTPRINT_GRADES):
        grade = F.when(footprint < bound, name).otherwise(grade)
    return F.when(footprint.isNotNull(), grade)


def utilisation_pct(peak: Column, total: Column) -> Column:
    """Peak as a percentage of the total; 0 if the total is 0 or unknown."""
    return F.when(total > 0, peak / total * 100).otherwise(0.0)


def suggestions(
    first_token_latency: Column,
    pure_speed: Column,
    gpu_usage_avg: Column,
    cpu_avg: Column,
    memory_efficiency: Column,
    pytorch_peak: Column,
    has_speeds: Column | None = None,
    has_summary: Column | None = None,
    has_memory: Column | None = None,
) -> Column:
    """Array of advice. A missing metric counts as 0 if its family was measured at all."""

    def zero(value: Column) -> Column:
        return F.coalesce(value, F.lit(0.0))

    def measured(flag: Column | None) -> Column:
        return F.lit(True) if flag is None else F.coalesce(flag, F.lit(False))

    speeds, summary, memory = measured(has_speeds), measured(has_summary), measured(has_memory)
    checks = (
        (speeds & (zero(first_token_latency) > 1.5), "latency"),
        (speeds & (zero(pure_speed) < 20), "speed"),
        (summary & (zero(gpu_usage_avg) < 70), "gpu"),
        (summary & (zero(cpu_avg) > 70), "cpu"),
        (memory & (F.coalesce(memory_efficiency, F.lit("")) == LARGEST_GRADE), "memory"),
        (memory & (zero(pytorch_peak) > 7), "vram"),
    )
    return F.array_compact(F.array(*[F.when(test, ADVICE[name]) for test, name in checks]))
