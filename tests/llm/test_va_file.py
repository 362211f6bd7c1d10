"""Clustering over packed cells, against plain arithmetic and SQL."""

import hashlib
import random

import numpy as np
import pytest

from loomset.llm import catalog, oracle, va_file
from tests.llm.helpers import duck, equal_to_sql

SF = "/root/testdata/sf0.001"


def plain(rows, k=16, rounds=3, scale=64, dimensions=64):
    """The same by full vectors and Python's whole numbers."""
    kept = [(i, [int(np.floor(float(x) * scale)) for x in v]) for i, v in rows if v is not None and len(v) == dimensions and all(x is not None and np.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centroids = [list(v) for _, v in order[:k]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    for last in range(rounds + 1):
        found = [(min(range(len(centroids)), key=lambda c: (far(v, centroids[c]), c)), i, v) for i, v in kept]
        if last < rounds:
            for c in range(len(centroids)):
                own = [v for g, _, v in found if g == c]
                if own:
                    centroids[c] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    return [(i, c, far(v, centroids[c])) for c, i, v in found], centroids


def test_intervals_hold():
    rng = np.random.default_rng(0)
    vectors = rng.integers(-50, 50, (500, 8))
    vectors[:5] = 10**6
    centroids = np.concatenate([vectors[7:12], vectors[7:9]])  # two of them twice
    for bits in (1, 2, 4, 8):
        cells = va_file.Cells.of(vectors[5:60], bits)
        packed = cells.pack(vectors)
        assert all(len(p) == bits for p in packed)
        import pyarrow as pa

        numbers = cells.unpack(pa.array(packed, pa.binary()))
        low, high = cells.bounds(vectors.min(0), vectors.max(0))
        d = np.arange(8)
        assert (low[d, numbers] <= vectors).all() and (vectors <= high[d, numbers]).all()
        lookup = va_file.Lookup(low, high, centroids)
        true = ((vectors[:, None] - centroids) ** 2).sum(2)
        assert (lookup._sum(lookup.near, numbers) <= true).all() and (true <= lookup._sum(lookup.far, numbers)).all()
        assert lookup.candidates(numbers)[np.arange(500), true.argmin(1)].all()
        assert (lookup.assign(numbers, vectors) == true.argmin(1)).all()


@pytest.mark.parametrize("bits", [1, 3, 6])
def test_like_plain_arithmetic(spark, bits, monkeypatch):
    monkeypatch.setattr(va_file, "BROADCAST_ROWS", 10)
    rng = random.Random(4)
    rows = []
    for i in range(300):
        centre = rng.choice([-3.0, 0.0, 0.5, 4.0])
        rows.append((rng.choice([i, i % 50]), [rng.gauss(centre, 0.3) for _ in range(4)]))
    rows += [(None, [0.0] * 4), (1, None), (2, []), (3, [1.0, None, 2.0, 3.0]), (4, [float("nan")] * 4), (5, [float("inf")] + [0.0] * 3), (6, [1.0] * 3)]
    rows += [(7, [1.0] * 4)] * 20
    table = spark.createDataFrame(rows, "vec_id int, embedding array<double>").repartition(5)
    table = table.selectExpr("*", "'x' AS cluster", "1 AS rid", "2 AS distance")
    found, centroids = va_file.cluster(table, k=7, dimensions=4, bits=bits)
    want, goal = plain(rows, k=7, dimensions=4)
    assert centroids == goal
    key = repr
    assert sorted([tuple(r) for r in found.collect()], key=key) == sorted(want, key=key)


def test_few_or_no_vectors(spark):
    rows = [(1, [0.5, -0.01]), (1, [0.5, -0.01]), (2, [1e30, -1e30])]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    found, centroids = va_file.cluster(table, dimensions=2)
    assert len(centroids) == 3 and found.count() == 3
    assert {r["distance"] for r in found.collect()} == {0}
    facts = va_file.with_inertia(found, centroids).collect()
    assert len(facts) == 3 and {r["inertia"] for r in facts} == {0}
    found, centroids = va_file.cluster(table.limit(0), dimensions=2)
    assert centroids == [] and va_file.with_inertia(found, centroids).count() == 0


def test_one_hot_vector(spark):
    rows = [(i, [1.0, 2.0]) for i in range(200)] + [(1000 + i, [float(i), 0.0]) for i in range(50)]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").repartition(4)
    found, centroids = va_file.cluster(table, k=3, dimensions=2, bits=2)
    want, goal = plain(rows, k=3, dimensions=2)
    assert centroids == goal and sorted(map(tuple, found.collect())) == sorted(want)


def test_embeddings(spark):
    assert equal_to_sql(catalog.QUERIES["op12_va_file"](spark, SF), oracle.SQL["op12_va_file"], duck(SF)) == 500
