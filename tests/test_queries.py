"""Every registered query against its SQL, and the shape of its plan."""

import math

import duckdb
import pytest

import __spark_entry__ as registry
from loomset.catalog import oracle
from loomset.catalog.queries import QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "documents conversations events labels embeddings pages benchmark".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def cell(value):
    if isinstance(value, float):
        return 0.0 if value == 0 else ("nan" if math.isnan(value) else value)
    return value


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(cell(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, duck, name):
    got = QUERIES[name](spark, SF)
    result = duck.execute(oracle.oracle_sql()[name])
    columns = [c[0] for c in result.description]
    assert sorted(got.columns) == sorted(columns)
    want = canonical(columns, result.fetchall())
    assert canonical(got.columns, [tuple(r) for r in got.collect()]) == want
    assert want


def test_entry(spark):
    df = registry.entry(spark)
    assert {"text", "split"} <= set(df.columns) and df.count() > 0


# Windows over one partition are allowed over tables whose size is bounded by design only.
BOUNDED = {"seeded_rank", "padded_batches"}


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if not n.startswith("stream")))
def test_no_single_partition_window_or_product(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "BatchEvalPython" not in plan
    lines = plan.splitlines()
    windows = [i for i, line in enumerate(lines) if " Window " in line or "+- Window" in line]
    single = any("Exchange SinglePartition" in line for i in windows for line in lines[i : i + 4])
    assert not single or name in BOUNDED


def test_scans_are_pruned(spark):
    query = QUERIES["loss_summary"](spark, SF)
    plan = query._jdf.queryExecution().executedPlan().toString()
    assert "props" not in plan and "ts" not in plan.split("ReadSchema")[1].split("\n")[0].replace("events", "").split("value")[0].split(",")
    plan = QUERIES["chatml_pair"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<conv_id:bigint,turn:bigint,role:string,text:string>" in plan
