import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomset.operators import joins
from loomset.operators.curves import curves, early_stop, loss_summary, series
from loomset.operators.polyfit import poly_fit, step_coefficients

SCHEMA = "run_id string, tag string, step long, value double"


def test_summary_and_fallback(spark):
    rows = [("a", "train/loss", s, v) for s, v in [(10, 2.0), (20, 1.0), (30, 1.0), (40, 1.5)]]
    rows += [("a", "loss", 1, 99.0), ("a", "eval/loss", 10, 0.7), ("a", "eval/loss", 20, 0.6)]
    rows += [("b", "loss", 5, 4.0), ("b", "loss", 6, 5.0), ("c", "eval/loss", 1, 1.0), ("d", "loss", 1, 0.0)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.run_id: r for r in loss_summary(df).collect()}
    assert set(got) == {"a", "b", "d"}
    a = got["a"]
    assert (a.initial_loss, a.final_loss, a.best_loss, a.best_step, a.total_steps, a.n_points) == (2, 1.5, 1, 20, 40, 4)
    assert a.reduction_pct == 25 and a.best_eval_loss == 0.6
    assert got["b"].reduction_pct == -25 and got["b"].best_eval_loss is None
    assert got["d"].reduction_pct is None
    found = {(r.run_id, r.curve) for r in curves(df).collect()}
    assert found == {("a", "train_loss"), ("a", "eval_loss"), ("b", "train_loss"), ("c", "eval_loss"), ("d", "train_loss")}
    assert series(df, "train_loss").where("run_id = 'a'").count() == 4


def replay(values, patience):
    """Steps a stopping loop would see: (stop step or None, best step, best value)."""
    best, waited = None, 0
    for step, value in values:
        if best is None or value < best[1]:
            best, waited = (step, value), 0
        else:
            waited += 1
            if waited >= patience:
                return (step, *best)
    return (None, *best)


def test_early_stop(spark):
    rng = random.Random(8)
    runs = {
        "tie": [(1, 1.0), (2, 1.0), (3, 1.0), (4, 1.0)],
        "falling": [(i * 5000, 1.0 / (i + 1)) for i in range(20)],
        "short": [(1, 1.0)],
        "later better": [(1, 1.0), (2, 2.0), (3, 2.0), (4, 2.0), (5, 0.5)],
    }
    for i in range(30):
        steps = sorted(rng.sample(range(40000), rng.randint(1, 60)))
        runs[f"r{i}"] = [(s, rng.choice([0.1, 0.2, 0.3, 0.5]) + 10 / (s + 10)) for s in steps]
    rows = [(r, "eval/loss", s, v) for r, points in runs.items() for s, v in points]
    df = spark.createDataFrame(rows, SCHEMA)
    for patience in (1, 3):
        got = {r.run_id: (r.stop_step, r.best_step, r.best_value) for r in early_stop(df, patience).collect()}
        assert got == {r: replay(p, patience) for r, p in runs.items()}


def expected_fit(steps, values, degree):
    x, y = np.array(steps, float), np.array(values)
    n = len(x)
    degree = degree or (min(5, n - 1) if n > 4 else 3)
    degree = min(degree, max(1, n - 1))
    t = (x - x.mean()) / max(1.0, np.ptp(x) / 2)
    fitted = np.poly1d(np.polyfit(t, y, degree))(t) if n > 1 else y
    total = ((y - y.mean()) ** 2).sum()
    r2 = 1 - ((y - fitted) ** 2).sum() / total if np.ptp(y) > 0 else 0
    return degree, fitted, r2


@pytest.mark.filterwarnings("ignore")
@pytest.mark.parametrize("degree,table_rows", [(None, None), (1, 100), (3, None)])
def test_poly_fit(spark, degree, table_rows):
    rng = np.random.default_rng(1)
    runs = {f"n{n}": (list(range(0, 7 * n, 7)), rng.normal(size=n).tolist()) for n in range(1, 9)}
    runs["long"] = ((10**6 + np.arange(500) * 13).tolist(), (1 / (1 + np.arange(500)) + rng.normal(size=500) / 50).tolist())
    runs["flat"] = (list(range(10)), [0.1] * 10)
    rows = [(r, s, float(v)) for r, (steps, values) in runs.items() for s, v in zip(steps, values)]
    df = spark.createDataFrame(rows, "run_id string, step long, value double")
    points, fits = poly_fit(df, degree, table_rows)
    fits = {r.run_id: r for r in step_coefficients(fits).collect()}
    fitted = {}
    for r in points.orderBy("step").collect():
        fitted.setdefault(r.run_id, []).append(r.fitted)
    for run, (steps, values) in runs.items():
        want_degree, want, r2 = expected_fit(steps, values, degree)
        assert fits[run].degree == want_degree and fits[run].n_points == len(steps)
        np.testing.assert_allclose(fitted[run], want, atol=1e-8)
        assert abs(fits[run].r2 - r2) < 1e-8
        if len(steps) > 1 and want_degree == 1:
            np.testing.assert_allclose(fits[run].step_coefficients, np.polyfit(np.array(steps, float), values, 1), rtol=1e-6, atol=1e-8)


def test_repeated_steps_do_not_break_the_fit(spark):
    df = spark.createDataFrame([("r", 1, 1.0), ("r", 1, 3.0), ("r", 2, 5.0), ("r", 2, 5.0), ("r", 2, 5.0), ("r", 1, 2.0)], "run_id string, step long, value double")
    points, _ = poly_fit(df)
    got = {r.step: r.fitted for r in points.collect()}
    assert abs(got[1] - 2) < 1e-6 and abs(got[2] - 5) < 1e-6


def test_fit_degree_is_checked(spark):
    with pytest.raises(ValueError):
        poly_fit(spark.createDataFrame([], "run_id string, step long, value double"), 6)
    assert joins.LEAST_SALTS > 1
