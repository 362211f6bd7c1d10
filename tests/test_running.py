import random

import pytest
from pyspark.sql import functions as F

from loomset.operators.joins import lookup_join
from loomset.operators.running import running_before


def test_running_before(spark):
    rng = random.Random(4)
    rows = [
        (k, i, rng.choice([None, rng.randint(-50, 50)]))
        for k in "ab"
        for i in rng.sample(range(1000), 200)
    ]
    df = spark.createDataFrame(rows, "k string, i long, v long")
    got = running_before(
        df, ["k"], F.floor(F.col("i") / 64), "i",
        lo=("min", F.col("v")), hi=("max", F.col("v")), total=("sum", F.col("v")),
    ).collect()
    assert len(got) == len(rows)
    for r in got:
        seen = [v for k, i, v in rows if k == r.k and i < r.i and v is not None]
        assert (r.lo, r.hi, r.total) == (min(seen, default=None), max(seen, default=None), sum(seen))


@pytest.mark.parametrize("how,table_rows", [("inner", None), ("left", None), ("inner", 2), ("left", 2), ("left", 10**9)])
def test_lookup_join(spark, how, table_rows):
    rows = spark.range(500).select(F.when(F.col("id") < 400, 1).otherwise(F.col("id") % 5).alias("k"), "id")
    table = spark.createDataFrame([(1, "one"), (3, "three")], "k long, name string")
    got = sorted((r.id, r.k, r.name) for r in lookup_join(rows, table, "k", how, table_rows).collect())
    want = sorted((r.id, r.k, r.name) for r in rows.join(table, "k", how).collect())
    assert got == want and len(got) >= 400
