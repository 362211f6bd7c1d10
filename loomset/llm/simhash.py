"""SimHash near-duplicates, found with vantage-point trees.

Fingerprints within ``radius`` = 4 differing bits link. The 64 bits are cut
into three parts; a linked pair differs in at most one bit in one of them. For
each part a vantage-point tree over a bounded sample deals the fingerprints to
shards by their Hamming distance from the vantage points. A fingerprint is a
member of one shard, and a query to every shard that its ball of radius 1 may
overlap by the triangle inequality, so every linked pair meets in a shard,
where the whole distance is computed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from loomset.llm.graph import components
from loomset.storage import materialise

SHINGLE = 4
SEED = 42
RADIUS = 4
PARTS = (0x1FFFFF, 0x1FFFFF << 21, 0x3FFFFF << 42)

# The tree is grown on at most this many fingerprints and never has more shards.
SAMPLE = 1 << 15
MAX_SHARDS = 1 << 12
SHARD_ROWS = 2000
_BLOCK = 1 << 17  # shingles of a long text counted at once

_IS_BLANK = np.zeros(256, bool)
_IS_BLANK[[9, 10, 11, 12, 13, 32]] = True


# --- fingerprints -------------------------------------------------------------


def normal_words(text: str | None) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The words of a text in lower-case ASCII letters joined by one blank, and where each begins and ends."""
    raw = np.frombuffer((text or "").encode("utf-8", "replace").lower(), np.uint8)
    blank = _IS_BLANK[raw]
    keep = ~blank
    keep[1:] |= ~blank[:-1]  # one blank behind every word
    out = np.where(blank, np.uint8(32), raw)[keep]
    if out.size and out[-1] == 32:
        out = out[:-1]
    if out.size and out[0] == 32:
        out = out[1:]
    if not out.size:
        return b"", np.zeros(0, np.int64), np.zeros(0, np.int64)
    gaps = np.flatnonzero(out == 32)
    return out.tobytes(), np.append(0, gaps + 1), np.append(gaps, out.size)


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The SimHash of a text's word shingles, repeats counted; 0 for a text without words."""
    joined, starts, ends = normal_words(text)
    if not starts.size:
        return 0
    if starts.size > shingle:
        starts, ends = starts[: 1 - shingle], ends[shingle - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest, n = xxhash.xxh64_intdigest, starts.size
    ones = np.zeros(64, np.int64)
    for k in range(0, n, _BLOCK):
        spans = zip(starts[k : k + _BLOCK].tolist(), ends[k : k + _BLOCK].tolist(), strict=True)
        hashes = np.fromiter((digest(joined[a:b], seed) for a, b in spans), np.uint64)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def add_fingerprints(docs: DataFrame, text: str = "text", name: str = "fingerprint") -> DataFrame:
    """Add the fingerprint as a signed 64-bit number; one row per row, other columns kept (``name`` replaced)."""
    kept = [c for c in docs.columns if c != name]
    rows = docs.select(*kept)
    schema = rows.select(*rows.columns, F.lit(0).cast("bigint").alias(name)).schema

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(text)
            found = np.fromiter((fingerprint(t.as_py()) for t in texts), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(found.view(np.int64))], names=[*batch.schema.names, name]
            )

    return rows.mapInArrow(add, schema)


# --- vantage-point trees --------------------------------------------------------


def _distance(values: np.ndarray, point: int, mask: int) -> np.ndarray:
    return np.bitwise_count((values ^ np.uint64(point)) & np.uint64(mask)).astype(np.int64)


@dataclass
class Split:
    """Members at most ``cut`` from ``point`` go to ``near``, the others to ``far``."""

    point: int
    cut: int
    near: Split | int
    far: Split | int


class Tree:
    """A vantage-point tree over one part of the bits; its leaves are shards 0, 1, …"""

    def __init__(self, sample: np.ndarray, mask: int, target: float, radius: int):
        self.mask, self.radius, self.leaves = mask, radius, 0
        self.root = self._grow(np.asarray(sample, np.uint64), target, np.random.default_rng(SEED), 0)

    def _leaf(self) -> int:
        self.leaves += 1
        return self.leaves - 1

    def _grow(self, sample: np.ndarray, target: float, rng: np.random.Generator, depth: int) -> Split | int:
        best = None
        if sample.size > max(target, 1) and depth < 40:
            # Of a few vantage points and cuts take the one that sends the fewest rows on, over both sides.
            for point in rng.choice(sample, min(sample.size, 12), replace=False).tolist():
                counts = np.bincount(_distance(sample, point, self.mask), minlength=66)
                below = np.cumsum(counts)
                for cut in range(64):
                    inside = below[cut] / sample.size
                    if not 0.2 <= inside <= 0.8:
                        continue
                    near = below[min(cut + self.radius, 65)] / sample.size
                    far = 1 - (below[cut - self.radius] / sample.size if cut >= self.radius else 0)
                    cost = inside * near + (1 - inside) * far
                    if best is None or cost < best[0]:
                        best = (cost, point, cut)
        if best is None or best[0] > 0.95:
            return self._leaf()
        _, point, cut = best
        inside = _distance(sample, point, self.mask) <= cut
        near = self._grow(sample[inside], target, rng, depth + 1)
        far = self._grow(sample[~inside], target, rng, depth + 1)
        return Split(point, cut, near, far)

    def home(self, values: np.ndarray) -> np.ndarray:
        """The shard each value is a member of."""
        out = np.zeros(values.size, np.int64)
        todo = [(self.root, np.arange(values.size))]
        while todo:
            node, rows = todo.pop()
            if not rows.size:
                continue
            if not isinstance(node, Split):
                out[rows] = node
                continue
            inside = _distance(values[rows], node.point, self.mask) <= node.cut
            todo += [(node.near, rows[inside]), (node.far, rows[~inside])]
        return out

    def overlaps(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, shard) for every shard that the ball around a value may reach."""
        rows_out, shards = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        todo = [(self.root, np.arange(values.size))]
        while todo:
            node, rows = todo.pop()
            if not rows.size:
                continue
            if not isinstance(node, Split):
                rows_out.append(rows)
                shards.append(np.full(rows.size, node))
                continue
            d = _distance(values[rows], node.point, self.mask)
            todo += [
                (node.near, rows[d - self.radius <= node.cut]),
                (node.far, rows[d + self.radius > node.cut]),
            ]
        return np.concatenate(rows_out), np.concatenate(shards)


def grow_trees(fingerprints: DataFrame, name: str, n: int, shard_rows: int, radius: int) -> list[Tree]:
    """One tree per part, grown on the at most ``SAMPLE`` fingerprints of smallest hash."""
    picked = fingerprints.orderBy(F.xxhash64(name), name).limit(SAMPLE)
    sample = np.array([r[0] for r in picked.select(name).collect()], np.int64).view(np.uint64)
    shards = min(max(n / shard_rows, 1), MAX_SHARDS)
    return [Tree(sample, mask, sample.size / shards, radius // len(PARTS)) for mask in PARTS]


# --- shards ---------------------------------------------------------------------


def _union(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Join the classes of ``a[i]`` and ``b[i]``; ``parent`` points straight at roots before and after."""
    while True:
        ra, rb = parent[a], parent[b]
        apart = ra != rb
        if not apart.any():
            return parent
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        np.minimum.at(parent, np.maximum(ra, rb), np.minimum(ra, rb))
        while not np.array_equal(higher := parent[parent], parent):
            parent = higher


class Shard:
    """The members of one shard, and the links found around them.

    Members are compared by a tree of their own once there are too many for
    one block. Of the links found only a spanning set is kept: one per query,
    and one per member to the root of its class. Memory is some 40 bytes a
    member, whatever the number of queries or links.
    """

    def __init__(self, members: np.ndarray, mask: int, radius: int, rows: int = 4 * SHARD_ROWS):
        self.radius, self.members = radius, members
        self.parent = np.arange(members.size)
        self.tree = None
        self.blocks = [np.arange(members.size)]
        if members.size > rows:
            sample = members[:: max(1, members.size // SAMPLE)]
            self.tree = Tree(sample, mask, sample.size * rows / members.size, radius // len(PARTS))
            shard = self.tree.home(members)
            order = np.argsort(shard, kind="stable")
            self.blocks = np.split(order, np.searchsorted(shard[order], np.arange(1, self.tree.leaves)))

    def ask(self, queries: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (query, member) that link the queries; members linked by one query join one class."""
        rows, shards = np.arange(queries.size), np.zeros(queries.size, np.int64)
        if self.tree:
            rows, shards = self.tree.overlaps(queries)
        order = np.argsort(shards, kind="stable")
        rows, shards = rows[order], shards[order]
        for leaf, block in enumerate(self.blocks):
            lo, hi = np.searchsorted(shards, [leaf, leaf + 1])
            step = max(1, (1 << 20) // max(block.size, 1))
            for k in range(lo, hi if block.size else lo, step):
                asked = rows[k : min(k + step, hi)]
                apart = np.bitwise_count(queries[asked][:, None] ^ self.members[block][None, :])
                q, m = np.nonzero(apart <= self.radius)
                if not q.size:
                    continue
                m = block[m]
                first = np.flatnonzero(np.append(True, q[1:] != q[:-1]))
                lead = m[np.repeat(first, np.diff(np.append(first, q.size)))]
                self.parent = _union(self.parent, lead, m)
                yield queries[asked][q[first]], self.members[m[first]]

    def joined(self) -> tuple[np.ndarray, np.ndarray]:
        moved = np.flatnonzero(self.parent != np.arange(self.parent.size))
        return self.members[moved], self.members[self.parent[moved]]


def _links_in_shards(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Links from rows sorted by (shard, guest): a shard's members come before its guests."""
    names = ["a", "b"]

    def out(a: np.ndarray, b: np.ndarray) -> Iterator[pa.RecordBatch]:
        real = a != b
        if real.any():
            yield pa.RecordBatch.from_arrays([pa.array(x[real].view(np.int64)) for x in (a, b)], names=names)

    current, gathered, shard = None, [], None

    def close() -> Iterator[pa.RecordBatch]:
        nonlocal shard
        yield from settle()
        if shard is not None:
            yield from out(*shard.joined())
        shard = None

    def settle() -> Iterator[pa.RecordBatch]:
        """All members of the shard have come: compare them with each other."""
        nonlocal shard, gathered
        if gathered:
            shard = Shard(np.concatenate(gathered), PARTS[current % len(PARTS)], radius)
            gathered = []
            for a, b in shard.ask(shard.members):
                yield from out(a, b)

    for batch in batches:
        if not batch.num_rows:
            continue
        shards, guests = (batch.column(k).to_numpy() for k in (0, 1))
        values = batch.column(2).to_numpy().view(np.uint64)
        key = shards * 2 + guests
        cuts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        for lo, hi in zip(cuts, np.append(cuts[1:], key.size), strict=True):
            if shards[lo] != current:
                yield from close()
                current = shards[lo]
            if not guests[lo]:
                gathered.append(values[lo:hi].copy())
                continue
            yield from settle()
            if shard is not None:
                for a, b in shard.ask(values[lo:hi]):
                    yield from out(a, b)
    yield from close()


def links(fingerprints: DataFrame, name: str = "fingerprint", radius: int = RADIUS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Links ``(a, b)`` that connect all distinct fingerprints within ``radius`` bits of each other.

    Not every close pair is listed, but exactly those fingerprints that a chain
    of close pairs joins are joined by listed ones. Guests visit only shards behind their
    own, as the other half of their pairs is found from the other side.
    """
    distinct = materialise(fingerprints.select(name).distinct(), "fingerprints")
    n = distinct.count()
    trees = grow_trees(distinct, name, n, shard_rows, radius)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(0).to_numpy().view(np.uint64)
            for part, tree in enumerate(trees):
                home = tree.home(values)
                rows, shards = tree.overlaps(values)
                go = shards >= home[rows]
                rows, shards = rows[go], shards[go]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(shards * len(PARTS) + part),
                        pa.array((shards != home[rows]).astype(np.int64)),
                        pa.array(values[rows].view(np.int64)),
                    ],
                    names=["shard", "guest", "value"],
                )

    dealt = distinct.mapInArrow(deal, "shard bigint, guest bigint, value bigint")
    shards = sum(tree.leaves for tree in trees)
    spark = fingerprints.sparkSession
    tasks = max(min(shards, 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))), 1)
    return (
        dealt.repartition(tasks, "shard")
        .sortWithinPartitions("shard", "guest")
        .mapInArrow(lambda batches: _links_in_shards(batches, radius), "a bigint, b bigint")
    )


# --- documents -------------------------------------------------------------------


def classes(prints: DataFrame, doc_id: str = "doc_id", name: str = "fingerprint", **how) -> DataFrame:
    """``(fingerprint, root, component_id)``: the class of every distinct fingerprint and its smallest id.

    ``prints`` is a written table of (doc_id, fingerprint). Copies are one
    fingerprint; NULL ids count as larger than all others, so a class has a
    NULL id only if none of its rows has one. Fingerprint 0 links like others.
    """
    least = prints.groupBy(name).agg(F.min(doc_id).alias("_least"))
    roots = materialise(components(links(prints, name, **how)), "roots")
    rooted = least.join(roots, F.col(name) == F.col("node"), "left").select(
        name, "_least", F.coalesce("root", name).alias("_root")
    )
    rooted = materialise(rooted, "rooted")
    best = rooted.groupBy("_root").agg(F.min("_least").alias("component_id"))
    return rooted.join(best, "_root").select(name, F.col("_root").alias("root"), "component_id")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` for every row; fingerprint as 16 hexadecimal digits.

    NULL, empty and blank texts have fingerprint 0 and so are one class.
    Repeated rows are returned as often as they come. An empty table gives an
    empty one.
    """
    prints = add_fingerprints(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")))
    prints = materialise(prints.select("doc_id", "fingerprint"), "prints")
    found = prints.join(classes(prints, **how), "fingerprint")
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """One row of every class, that of its smallest id, with the columns of ``docs``."""
    names = {c: f"_doc_{i}" for i, c in enumerate(docs.columns)}
    key = names[doc_id]
    printed = add_fingerprints(docs.withColumnsRenamed(names), names[text])
    rows = materialise(printed.withColumn("_row", F.monotonically_increasing_id()), "printed")
    prints = rows.select(F.col(key).alias("doc_id"), "fingerprint", "_row")
    found = prints.join(classes(prints, **how), "fingerprint")
    # Least by id, NULL ids last; repeated ids are told apart by the row number written with them.
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row"))
    stay = found.groupBy("root").agg(least.alias("first")).select(F.col("first._row").alias("_row"))
    kept = rows.join(stay, "_row", "left_semi")
    return kept.select(*[F.col(new).alias(old) for old, new in names.items()])
