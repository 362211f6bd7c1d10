import hashlib
import random

import pytest
from pyspark.sql import functions as F

from loomset.operators.ordering import (
    head,
    key_of_rank,
    order_key,
    ranked,
    source_key,
    split_exact,
    test_set as held_out,
)
from loomset.operators.quality import dedup_prefix, quality, quality_report


def md5(i, seed=42):
    return hashlib.md5(f"{seed}:{i}".encode()).hexdigest()


@pytest.mark.parametrize("n,frac", [(1, 0.05), (2, 0.05), (19, 0.05), (40, 0.05), (1000, 0.137), (10, 1.0)])
def test_split_sizes(spark, n, frac):
    df = spark.range(n).select("id", order_key(F.col("id")).alias("k"))
    rows = split_exact(df, "k", frac).collect()
    size = min(n, max(1, int(n * frac)))
    expected = set(sorted(range(n), key=md5)[:size])
    assert {r.id for r in rows if r.split == "val"} == expected
    assert len(rows) == n and {r.split for r in rows} <= {"train", "val"}


def test_split_with_equal_keys(spark):
    """Most rows share one key; the split is exact all the same, however they are partitioned."""
    df = spark.range(900).select(
        "id", order_key(F.when(F.col("id") % 3 > 0, -1).otherwise(F.col("id"))).alias("k")
    )
    for parts in (1, 7):
        rows = split_exact(df.repartition(parts), "k", 0.5).collect()
        assert sum(r.split == "val" for r in rows) == 450 and len({r.id for r in rows}) == 900


def test_split_of_nothing(spark):
    assert split_exact(spark.range(0).select(order_key(F.col("id")).alias("k")), "k").count() == 0


def test_key_of_rank(spark):
    rng = random.Random(2)
    keys = sorted({"".join(rng.choices("ab", k=12)) for _ in range(500)})
    df = spark.createDataFrame([(k,) for k in keys], "k string")
    for rank in (1, 2, len(keys) // 2, len(keys)):
        cut, total = key_of_rank(df, "k", lambda n: rank)
        assert total == len(keys) and sum(k[: len(cut)] <= cut for k in keys) == rank
    long = df.withColumn("k", F.concat(F.lit("shared/" * 40), F.col("k"), F.lit("/tail" * 9)))
    cut, _ = key_of_rank(long, "k", lambda n: 7)
    assert long.where(F.substring("k", 1, len(cut)) <= cut).count() == 7
    with pytest.raises(ValueError):
        key_of_rank(df.union(df), "k", lambda n: 1)


def test_held_out_tail(spark):
    df = spark.range(57).select("id", order_key(F.col("id")).alias("k"), F.lit("train").alias("split"))
    got = {r.id for r in held_out(df, "k").collect()}
    assert got == set(sorted(range(57), key=md5)[-5:])
    assert held_out(df.limit(1), "k").count() == 1
    mixed = df.withColumn("split", F.when(F.col("id") < 3, "val").otherwise("train"))
    assert {r.id for r in held_out(mixed, "k").collect()} == {0, 1, 2}


def test_ranks(spark):
    df = spark.range(3000).select("id", order_key(F.col("id"), 7).alias("k"))
    expected = {i: n for n, i in enumerate(sorted(range(3000), key=lambda i: md5(i, 7)))}
    assert {r.id: r["rank"] for r in ranked(df, "k").collect()} == expected
    assert [r.id for r in head(df, 3, "k").collect()] == sorted(expected, key=expected.get)[:3]


def test_source_key_keeps_file_order(spark):
    rows = [("b", 0, 5), ("a", 128, 1), ("a", 0, 2**40), ("a", 0, 3), ("ab", 0, 0)]
    df = spark.createDataFrame(rows, "p string, b long, r long")
    got = df.orderBy(source_key(F.col("p"), F.col("b"), F.col("r"))).collect()
    assert [tuple(r) for r in got] == sorted(rows)


def test_dedup_keeps_the_first_and_is_idempotent(spark):
    rows = [(i, "p" * 200 + str(i) if i % 3 else f"t{i % 5}") for i in range(200)]
    df = spark.createDataFrame(rows, "id long, text string").withColumn("k", order_key(F.col("id")))
    first = {}
    for i, text in sorted(rows, key=lambda r: md5(r[0])):
        first.setdefault(text[:200], i)
    for parts in (1, 9):
        once = dedup_prefix(df.repartition(parts), "k")
        assert {r.id for r in once.collect()} == set(first.values())
        assert dedup_prefix(once, "k").count() == len(first)


def test_quality_rules(spark):
    cases = {
        "": "empty", "x" * 9: "length", "x" * 10: None, "x" * 8192: None, "x" * 8193: "length",
        "a" + " " * 9 + "b": "blank", "a\tb\nc d" + " " * 5 + "e": None, "😀" * 10: None, None: "error",
    }
    df = spark.createDataFrame([(t,) for t in cases], "text string")
    judged = quality(df)
    assert {r.text: r.reject_reason for r in judged.collect()} == cases
    report = {r.reject_reason: r.n for r in quality_report(judged).collect()}
    assert report == {"empty": 1, "length": 2, "blank": 1, "kept": 4, "error": 1}
    lax = {r.text: r.reject_reason for r in quality(df, check=False).collect()}
    assert lax["x" * 9] is None and lax["x" * 8193] is None and lax[""] == "empty"
