"""Nearest neighbours by multi-index hashing over learned rotated binary codes.

A rotation learned on a bounded sample turns a vector into a code of signs. A
code is cut into substrings, each of which is an index of its own. Two codes
within ``radius`` differ in at most ``radius // substrings`` bits of one
substring (pigeonhole), so probing the buckets within that distance in every
index finds all codes within the radius; these are ranked by their floats.

Every row is indexed. Rows are dealt evenly to blocks by a hash of their row
number, so copies of one vector spread over all blocks, and each block holds
the indexes of its rows. The query set meets all blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, Window

from loomset.storage import materialise

BITS = 64
SUBSTRINGS = 4
SAMPLE = 10_000  # rows the rotation and the radius are learned on, those of smallest hash
SAMPLE_QUERIES = 300
COVERED = 0.97  # share of the sample's true neighbours that the radius must reach
BLOCK_ROWS = 8192
TURNS = 30


def usable(vector: Column) -> Column:
    """True for vectors with finite components that are not all zero; NULL vectors and components are not usable."""
    finite = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


class Codes:
    """Signs of a rotated vector, packed into one 64-bit number.

    Rows are scaled into the unit ball and given one more component that makes
    their length 1, so the largest inner product is the smallest angle. The
    rotation is that of iterative quantisation on the leading principal axes.
    """

    def __init__(self, sample: np.ndarray, longest: float, largest: float = 1.0):
        # the greatest length, in units of the component of greatest size: squares of doubles may be beyond any double
        self.longest, self.largest = longest, largest
        rows = self.lifted(sample)
        self.mean = rows.mean(axis=0)
        self.bits = min(BITS, rows.shape[1])
        _, _, axes = np.linalg.svd(rows - self.mean, full_matrices=False)
        axes = axes[: self.bits].T
        self.bits = axes.shape[1]
        flat = (rows - self.mean) @ axes
        turn = np.linalg.qr(np.random.default_rng(42).normal(size=(self.bits, self.bits)))[0]
        for _ in range(TURNS):
            left, _, right = np.linalg.svd(flat.T @ np.where(flat @ turn >= 0, 1.0, -1.0))
            turn = left @ right
        self.axes = axes @ turn
        self.parts = [p for p in np.array_split(np.arange(self.bits), SUBSTRINGS) if p.size]

    def lifted(self, rows: np.ndarray, queries: bool = False) -> np.ndarray:
        rows = rows / self.largest
        if queries:
            own = np.abs(rows).max(axis=1, keepdims=True, initial=0)
            rows = rows / np.where(own > 0, own, 1)
            return np.column_stack([rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-300), np.zeros(len(rows))])
        rows = rows / self.longest
        return np.column_stack([rows, np.sqrt(np.maximum(1 - (rows**2).sum(axis=1), 0))])

    def of(self, rows: np.ndarray, queries: bool = False) -> np.ndarray:
        signs = (self.lifted(rows, queries) - self.mean) @ self.axes >= 0
        return (signs.astype(np.uint64) << np.arange(self.bits, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)

    def substring(self, codes: np.ndarray, part: int) -> np.ndarray:
        places = self.parts[part]
        return (codes >> np.uint64(places[0])) & np.uint64((1 << places.size) - 1)


def scores(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products in double precision, beyond it infinite; equal rows have equal scores."""
    with np.errstate(over="ignore", invalid="ignore"):
        return (rows.astype(np.float64) * query.astype(np.float64)).sum(axis=1)


def pick_radius(codes: Codes, sample: np.ndarray, total: int, k: int) -> int:
    """The distance within which ``COVERED`` of the nearest rows of sample queries lie.

    In a sample of one row in x the nearest k / x rows stand for the nearest k of all.
    """
    sample = sample / codes.largest
    queries = sample[:: max(1, len(sample) // SAMPLE_QUERIES)]
    near = max(1, min(round(k * len(sample) / max(total, 1)), len(sample) - 1))
    product = queries @ sample.T
    product[np.arange(len(queries)), np.arange(len(queries)) * max(1, len(sample) // SAMPLE_QUERIES)] = -np.inf
    best = np.argpartition(-product, near - 1, axis=1)[:, :near]
    own, theirs = codes.of(queries * codes.largest, True), codes.of(sample * codes.largest)
    apart = np.bitwise_count(own[:, None] ^ theirs[best])
    return int(np.quantile(apart, COVERED, method="higher"))


class Block:
    """The indexes of one block: per substring its buckets, and the rows in each."""

    def __init__(self, codes: Codes, numbers: np.ndarray, ids: list[int | None], rows: np.ndarray):
        self.codes, self.numbers, self.ids, self.rows = codes, numbers, ids, rows
        # by id, NULL last, so that equal scores are already in order
        order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0, int(numbers[i])))
        self.numbers, self.rows = numbers[order], rows[order]
        self.ids = [ids[i] for i in order]
        self.code = codes.of(self.rows)
        self.exact = self.rows.astype(np.float64)
        # per substring its buckets, and the bucket of every row
        self.index = [np.unique(codes.substring(self.code, part), return_inverse=True) for part in range(len(codes.parts))]

    def within(self, code: np.uint64, radius: int) -> np.ndarray:
        """All rows whose code differs in at most ``radius`` bits."""
        seen = np.zeros(self.numbers.size, bool)
        for part, (buckets, bucket) in enumerate(self.index):
            close = np.bitwise_count(buckets ^ self.codes.substring(code, part)) <= radius // len(self.index)
            seen |= close[bucket]
        found = np.flatnonzero(seen)
        return found[np.bitwise_count(self.code[found] ^ code) <= radius]

    def search(self, number: int, query: np.ndarray, code: np.uint64, radius: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(rows, scores) of the best ``k`` within the radius, which grows until it holds ``k`` or the whole block."""
        while True:
            found = self.within(code, radius)
            found = found[self.numbers[found] != number]
            if found.size >= k or radius >= self.codes.bits:
                break
            radius = min(radius + self.codes.bits // 8 + 1, self.codes.bits)
        if found.size > k:  # a fast product leaves those that can be among the best, whose scores are then exact
            with np.errstate(over="ignore", invalid="ignore"):
                rough = self.exact[found] @ query.astype(np.float64)
                bar = np.partition(rough, -k)[-k]
                found = found[~(rough < bar - 1e-6 * (1 + abs(bar)))]
        value = scores(self.exact[found], query)
        best = np.argsort(-value, kind="stable")[:k]
        return found[best], value[best]


def _ask(batches: Iterator[pa.RecordBatch], codes: Codes, radius: int, k: int) -> Iterator[pa.RecordBatch]:
    """Answers of blocks, whose rows arrive sorted by (block, query or not)."""
    at, parts, block = None, [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        blocks, asked = batch.column("block").to_numpy(), batch.column("asks").to_numpy()
        numbers = batch.column("number").to_numpy()
        rows = batch.column("vector").flatten().to_numpy().reshape(batch.num_rows, -1)
        ids = batch.column("vec_id")
        key = blocks * 2 + asked
        cuts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        for lo, hi in zip(cuts, np.append(cuts[1:], key.size), strict=True):
            if blocks[lo] != at:
                at, parts, block = blocks[lo], [], None
            if not asked[lo]:
                parts.append((numbers[lo:hi], ids[lo:hi].to_pylist(), rows[lo:hi].copy()))
                continue
            if block is None:
                if not parts:
                    continue
                block = Block(
                    codes, np.concatenate([p[0] for p in parts]), [i for p in parts for i in p[1]], np.concatenate([p[2] for p in parts])
                )
                parts = []
            own = codes.of(rows[lo:hi].astype(np.float64), True)
            out: tuple[list, list, list, list] = ([], [], [], [])
            for i in range(lo, hi):
                found, value = block.search(int(numbers[i]), rows[i], own[i - lo], radius, k)
                out[0].extend([int(numbers[i])] * found.size)
                out[1].extend([ids[i].as_py()] * found.size)
                out[2].extend(block.ids[j] for j in found)
                out[3].extend(value.tolist())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.float64()), strict=True)],
                names=["number", "query_id", "vec_id", "score"],
            )


def nearest(
    vectors: DataFrame, queries: Column, k: int = 20, vec_id: str = "vec_id", vector: str = "embedding", block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` rows of largest inner product found for every query row.

    ``queries`` is a condition on ``vectors``; a query's own row is no
    candidate, other rows with its id are. Ranks start at 1; equal scores go by
    the smaller id, NULL ids last; products beyond the range of doubles are
    infinite, and those that are none (infinite both ways) come last. Vectors that are not ``usable``, or whose
    length is not that of most of the sample, take no part. With fewer than
    ``k`` candidates all are returned; an empty table gives an empty one.
    """
    names = {vec_id: "vec_id", vector: "vector"}
    rows = vectors.withColumn("_asks", F.coalesce(queries, F.lit(False)).cast("bigint")).where(usable(F.col(vector)))
    rows = rows.select(*[F.col(c).cast("bigint" if n == "vec_id" else "array<double>").alias(n) for c, n in names.items()], F.col("_asks").alias("asks"))
    table = materialise(rows.withColumn("number", F.monotonically_increasing_id()), "vectors")
    sample = table.orderBy(F.xxhash64("number"), "number").limit(SAMPLE).select("vector").toArrow().column("vector").to_pylist()
    schema = "number bigint, query_id bigint, vec_id bigint, score double"
    if not sample:
        found = table.sparkSession.createDataFrame([], schema)
    else:
        sizes = np.array([len(v) for v in sample])
        width = int(np.bincount(sizes).argmax())
        table = table.where(F.size("vector") == width)
        known = np.array([v for v in sample if len(v) == width], np.float64)
        n, largest = table.agg(F.count("*"), F.max(F.array_max(F.transform("vector", F.abs)))).first()
        squares = F.aggregate("vector", F.lit(0.0), lambda a, x: a + (x / F.lit(largest)) * (x / F.lit(largest)))
        codes = Codes(known, table.agg(F.sqrt(F.max(squares))).first()[0], largest)
        radius = pick_radius(codes, known, n, k)
        blocks = max(1, -(-n // block_rows))
        members = table.select(F.pmod(F.xxhash64("number"), F.lit(blocks)).alias("block"), F.lit(0).cast("bigint").alias("asks"), "number", "vec_id", "vector")
        every = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint")))
        asking = table.where("asks = 1").select(every.alias("block"), "asks", "number", "vec_id", "vector")
        found = (
            members.union(asking)
            .repartition(blocks, "block")
            .sortWithinPartitions("block", "asks")
            .mapInArrow(lambda b: _ask(b, codes, radius, k), schema)
        )
    order = Window.partitionBy("number").orderBy(F.desc_nulls_last(F.when(~F.isnan("score"), F.col("score"))), F.asc_nulls_last("vec_id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
