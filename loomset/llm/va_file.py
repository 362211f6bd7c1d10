"""Centroid clustering over a vector-approximation file.

Vectors are whole numbers, ``floor(scale * x)``. The file holds for each a few
bits per dimension, the number of the cell its component lies in, beside the
vector itself; cells have equal shares of a sample, and their outer bounds are
those of all vectors. From tables of cell and centroid a pass over the cells
alone adds up, for every vector, an interval of its squared distance to each
centroid; a centroid whose interval lies above that of another is out. What is
left is compared once more by the interval of the *difference* of two
distances, which is far narrower, as the square of the vector cancels.

A round reads the full vectors of those rows only whose intervals still overlap
or whose cluster changed: the sums of clusters are kept, and changed by what
moved. The first assignment, which needs all sums, and the last, which needs
all distances, read every vector. All arithmetic is in whole numbers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from loomset.operators.joins import BROADCAST_ROWS
from loomset.storage import materialise

DIMENSIONS = 64
SCALE = 64
CENTROIDS = 16
ROUNDS = 3
BITS = 6
SAMPLE = 4096  # vectors whose quantiles set the cells; they decide speed, not results
BOUND = 1 << 27  # components are held within this, so that squared distances fit 64 bits
_ROWS = 1 << 13  # vectors looked at together


def usable(vector: Column, dimensions: int = DIMENSIONS) -> Column:
    """Whether a vector has all its components, none NULL or not finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(vector) == dimensions) & ~bad, F.lit(False))


def whole(values: np.ndarray, scale: int = SCALE) -> np.ndarray:
    return np.clip(np.floor(values.astype(np.float64) * scale), -BOUND, BOUND).astype(np.int64)


def _matrix(column: pa.ListArray, dimensions: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dimensions)


@dataclass
class Cells:
    """The cells of each dimension: ``low[d, c]`` to ``high[d, c]``, both inside; a centroid table is built on them."""

    edges: np.ndarray  # (dimensions, 2**bits - 1), ascending: first values of all cells but the lowest
    bits: int

    @classmethod
    def of(cls, sample: np.ndarray, bits: int) -> Cells:
        shares = np.arange(1, 1 << bits) / (1 << bits)
        return cls(np.quantile(sample, shares, axis=0, method="higher").T.astype(np.int64), bits)

    def pack(self, vectors: np.ndarray) -> list[bytes]:
        cells = np.stack([np.searchsorted(e, v, "right") for e, v in zip(self.edges, vectors.T, strict=True)], axis=1)
        bits = cells[:, :, None] >> np.arange(self.bits) & 1
        return [row.tobytes() for row in np.packbits(bits.reshape(len(vectors), -1).astype(np.uint8), axis=1)]

    def unpack(self, packed: pa.Array) -> np.ndarray:
        dimensions = self.edges.shape[0]
        rows = np.frombuffer(b"".join(packed.to_pylist()), np.uint8).reshape(len(packed), -1)
        bits = np.unpackbits(rows, axis=1, count=dimensions * self.bits).reshape(len(packed), dimensions, self.bits)
        return bits @ (1 << np.arange(self.bits))

    def bounds(self, least: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The least and greatest value of each cell, given those of each dimension. Empty cells have any."""
        low = np.concatenate([least[:, None], self.edges], axis=1)
        high = np.concatenate([self.edges - 1, most[:, None]], axis=1)
        return low, np.maximum(low, high)


class Lookup:
    """Tables from which the intervals of a centroid set are added up."""

    def __init__(self, low: np.ndarray, high: np.ndarray, centroids: np.ndarray):
        c = centroids.T[:, None, :]  # (dimensions, 1, k), against (dimensions, cells, 1)
        low, high = low[:, :, None], high[:, :, None]
        self.near = np.maximum(np.maximum(low - c, c - high), 0) ** 2
        self.far = np.maximum(np.abs(low - c), np.abs(high - c)) ** 2
        self.low, self.high, self.c = low, high, c
        self.centroids = centroids
        self._less: dict[int, np.ndarray] = {}

    def _against(self, b: int) -> np.ndarray:
        """The least that distances to other centroids may exceed that to ``b``, by dimension and cell."""
        if b not in self._less:
            own = self.c[:, :, b : b + 1]
            step = self.c - own
            self._less[b] = np.minimum(step * (self.c + own - 2 * self.low), step * (self.c + own - 2 * self.high))
        return self._less[b]

    @staticmethod
    def _sum(table: np.ndarray, cells: np.ndarray) -> np.ndarray:
        out = np.zeros((len(cells), table.shape[2]), np.int64)
        for d in range(cells.shape[1]):
            out += table[d, cells[:, d]]
        return out

    def candidates(self, cells: np.ndarray) -> np.ndarray:
        """Which centroids may be the nearest (of equally near ones the first), by row."""
        far = self._sum(self.far, cells)
        best = far.argmin(1)
        maybe = self._sum(self.near, cells) <= far.min(1)[:, None]
        open_ = maybe.sum(1) > 1
        for b in np.unique(best[open_]):
            rows = np.flatnonzero(open_ & (best == b))
            more = self._sum(self._against(b), cells[rows])
            later = np.arange(maybe.shape[1]) > b
            out = (more > 0) | ((more == 0) & later)
            out[:, b] = False
            maybe[rows] &= ~out
        return maybe

    def nearest(self, vectors: np.ndarray, maybe: np.ndarray) -> np.ndarray:
        """The nearest centroid of full vectors, among the candidates of each."""
        distance = np.stack([((vectors - c) ** 2).sum(1) for c in self.centroids], axis=1)
        return np.where(maybe, distance, np.iinfo(np.int64).max).argmin(1)

    def assign(self, cells: np.ndarray, vectors: np.ndarray) -> np.ndarray:
        maybe = self.candidates(cells)
        found = maybe.argmax(1)
        open_ = np.flatnonzero(maybe.sum(1) > 1)
        if open_.size:
            found[open_] = self.nearest(vectors[open_], maybe[open_])
        return found


def _sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, _ROWS):
            yield batch.slice(at, _ROWS)


def _lists(rows: np.ndarray) -> pa.ListArray:
    rows = np.ascontiguousarray(rows)
    return pa.ListArray.from_arrays(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1], pa.array(rows.ravel(), pa.int64()))


def build(rows: DataFrame, cells: Cells, dimensions: int, scale: int) -> DataFrame:
    """Write the file: (rid, id, cells, vector); each task adds two rows without rid, its least and greatest components."""
    schema = T.StructType(
        [
            T.StructField("rid", T.LongType()),
            rows.schema["id"],
            T.StructField("cells", T.BinaryType()),
            T.StructField("vector", T.ArrayType(T.LongType())),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends, kind = None, pa.null()
        for batch in _sliced(batches):
            vectors = whole(_matrix(batch.column("vector"), dimensions), scale)
            both = np.stack([vectors.min(0), vectors.max(0)])
            ends = both if ends is None else np.stack([np.minimum(ends[0], both[0]), np.maximum(ends[1], both[1])])
            kind = batch.column("id").type
            columns = [batch.column("rid"), batch.column("id"), pa.array(cells.pack(vectors), pa.binary()), _lists(vectors)]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)
        if ends is not None:
            none = [pa.nulls(2, pa.int64()), pa.nulls(2, kind), pa.nulls(2, pa.binary())]
            yield pa.RecordBatch.from_arrays([*none, _lists(ends)], names=schema.names)

    numbered = rows.select(F.monotonically_increasing_id().alias("rid"), "id", "vector")
    return materialise(numbered.mapInArrow(run, schema), "va-file")


_ASSIGNED = "rid bigint, cells binary, cluster int, count bigint, sums array<bigint>"


def _changes(old: np.ndarray, new: np.ndarray, vectors: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """By how much the counts and sums of ``k`` clusters change; old clusters under 0 held nothing."""
    count, sums = np.zeros(k, np.int64), np.zeros((k, vectors.shape[1]), np.int64)
    moved = np.flatnonzero(old != new)
    for cluster, sign in ((new[moved], 1), (old[moved], -1)):
        held = cluster >= 0
        np.add.at(count, cluster[held], sign)
        np.add.at(sums, cluster[held], sign * vectors[moved][held])
    return count, sums


def _assign(rows: DataFrame, cells: Cells, lookup: Lookup) -> DataFrame:
    """New clusters of rows (rid, cells, old, vector); each task adds a row without rid for each cluster, with its changes."""
    k, dimensions = lookup.centroids.shape
    names = ["rid", "cells", "cluster", "count", "sums"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, sums = np.zeros(k, np.int64), np.zeros((k, dimensions), np.int64)
        for batch in _sliced(batches):
            vectors = _matrix(batch.column("vector"), dimensions)
            new = lookup.assign(cells.unpack(batch.column("cells")), vectors)
            more = _changes(batch.column("old").to_numpy(), new, vectors, k)
            count += more[0]
            sums += more[1]
            none = [pa.nulls(len(new), pa.int64()), pa.nulls(len(new), pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column("rid"), batch.column("cells"), pa.array(new, pa.int32()), *none], names=names)
        touched = np.flatnonzero(count.astype(bool) | sums.any(1))
        none = [pa.nulls(touched.size, pa.int64()), pa.nulls(touched.size, pa.binary())]
        yield pa.RecordBatch.from_arrays([*none, pa.array(touched, pa.int32()), pa.array(count[touched]), _lists(sums[touched])], names=names)

    return rows.select("rid", "cells", "old", "vector").mapInArrow(run, _ASSIGNED)


def _marks(assigned: DataFrame, cells: Cells, lookup: Lookup) -> DataFrame:
    """By the cells alone: the old cluster of each row, and whether it has to be looked at in full."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _sliced(batches):
            maybe = lookup.candidates(cells.unpack(batch.column("cells")))
            old = batch.column("cluster")
            need = (maybe.sum(1) > 1) | (maybe.argmax(1) != old.to_numpy())
            yield pa.RecordBatch.from_arrays([batch.column("rid"), batch.column("cells"), old, pa.array(need)], names=["rid", "cells", "old", "need"])

    rows = assigned.where("rid IS NOT NULL").select("rid", "cells", "cluster")
    return rows.mapInArrow(run, "rid bigint, cells binary, old int, need boolean")


def _totals(assigned: DataFrame) -> dict[int, tuple[int, list[int]]]:
    """What the tasks added: count and sums by cluster."""
    parts = assigned.where("rid IS NULL").select("cluster", "count", F.posexplode("sums").alias("d", "x"))
    rows = parts.groupBy("cluster", "d").agg(F.sum("x").alias("x"), F.sum("count").alias("n")).collect()
    out: dict[int, tuple[int, list[int]]] = {}
    for r in sorted(rows, key=lambda r: (r["cluster"], r["d"])):
        out.setdefault(r["cluster"], (r["n"], []))[1].append(r["x"])
    return out


def cluster(
    table: DataFrame,
    id: str = "vec_id",
    vector: str = "embedding",
    k: int = CENTROIDS,
    rounds: int = ROUNDS,
    dimensions: int = DIMENSIONS,
    scale: int = SCALE,
    bits: int = BITS,
) -> tuple[DataFrame, list[list[int]]]:
    """``(rows, centroids)``: every usable vector as (id, cluster, distance), and the final centroids.

    Vectors that are NULL, of another size, or hold a NULL or a component that
    is not finite are left out. Centroids start as the ``k`` vectors whose
    ``1:<id>`` has the smallest SHA-256 (NULL ids read as nothing; equal
    hashes: by vector), fewer if there are fewer. Repeated rows are vectors of
    their own; other columns are not looked at. An empty table gives no rows
    and no centroids. Components beyond 2**27 after scaling count as that:
    squared distances of greater ones would not fit a long.
    """
    rows = table.select(F.col(id).alias("id"), F.col(vector).alias("vector")).where(usable(F.col("vector"), dimensions))
    order = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    first = rows.orderBy(order, "vector").select("vector").limit(max(SAMPLE, k)).collect()
    if not first:
        empty = rows.select(F.col("id").alias(id), F.lit(0).alias("cluster"), F.lit(0).cast("bigint").alias("distance"))
        return empty.limit(0), []
    sample = whole(np.array([r["vector"] for r in first]), scale)
    centroids = sample[:k].copy()
    cells = Cells.of(sample, bits)
    file = build(rows, cells, dimensions, scale)
    ends = file.where("rid IS NULL").select(F.posexplode("vector").alias("d", "x"))
    ends = ends.groupBy("d").agg(F.min("x").alias("least"), F.max("x").alias("most")).orderBy("d").collect()
    low, high = cells.bounds(np.array([r["least"] for r in ends]), np.array([r["most"] for r in ends]))
    held = file.where("rid IS NOT NULL")

    totals = [(0, [0] * dimensions) for _ in centroids]
    assigned = None
    for number in range(rounds):
        lookup = Lookup(low, high, centroids)
        if assigned is None:
            assigned = _assign(held.withColumn("old", F.lit(-1)), cells, lookup)
        else:
            marks = materialise(_marks(assigned, cells, lookup), "marks")
            wanted = marks.where("need").select("rid", "cells", "old")
            few = wanted.count() <= BROADCAST_ROWS
            fetched = held.select("rid", "vector").join(F.broadcast(wanted) if few else wanted, "rid")
            null = F.lit(None)
            settled = marks.where("NOT need").select(
                "rid", "cells", F.col("old").alias("cluster"), null.cast("bigint").alias("count"), null.cast("array<bigint>").alias("sums")
            )
            assigned = settled.union(_assign(fetched, cells, lookup))
        assigned = materialise(assigned, f"assigned-{number + 1}")
        for c, (n, sums) in _totals(assigned).items():
            totals[c] = totals[c][0] + n, [a + b for a, b in zip(totals[c][1], sums, strict=True)]
        centroids = np.array([[x // n for x in sums] if n else old for (n, sums), old in zip(totals, centroids.tolist(), strict=True)])

    lookup = Lookup(low, high, centroids)

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _sliced(batches):
            vectors = _matrix(batch.column("vector"), dimensions)
            found = lookup.assign(cells.unpack(batch.column("cells")), vectors)
            distance = ((vectors - lookup.centroids[found]) ** 2).sum(1)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(found, pa.int32()), pa.array(distance)], names=["id", "cluster", "distance"])

    schema = T.StructType([file.schema["id"], T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())])
    found = held.select("id", "cells", "vector").mapInArrow(last, schema)
    return found.withColumnRenamed("id", id), centroids.tolist()


def with_inertia(found: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """Add ``cluster_inertia`` and ``inertia``, the distances summed over the cluster and over all, and ``centroid_sha256``.

    Sums beyond a long are NULL. The digest is of the centroid's components in
    decimal, joined by commas.
    """
    found = materialise(found, "clusters")
    sums = {r["cluster"]: int(r["s"]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    fits = lambda x: x if x < 1 << 63 else None
    rows = [
        (c, fits(sums[c]), fits(sum(sums.values())), hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for c in sums
    ]
    facts = found.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return found.join(F.broadcast(facts), "cluster")  # a row for each centroid
