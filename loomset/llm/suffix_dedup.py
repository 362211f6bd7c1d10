"""Removal of repeated byte strings, by blockwise suffix sorting with a difference cover.

A byte goes if a string of ``length`` bytes that covers it also starts
elsewhere, in any text. Three steps, none of which holds a corpus-wide index:

1. Windows are dealt to buckets by a content-defined anchor (``anchors``); only
   buckets with two runs of windows or more can hold equal windows.
2. Where all runs of a bucket are the same bytes they are repeated as a whole.
   The others have their suffixes sorted, one block of buckets at a time, with
   ties resolved by the ranks of a difference-cover sample (``cover``).
3. Spans of repeated windows go back to the texts by equi-joins.

A bucket of more than ``MAX_RUNS`` different runs would not fit a block; its
windows are compared as rows of their own instead, by 128-bit hash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from loomset.llm.anchors import segments
from loomset.llm.cover import repeated_windows
from loomset.llm.packed import squeezed, unsqueezed
from loomset.operators.joins import lookup_join
from loomset.storage import materialise

LENGTH = 400
GRAM = 96
MAX_RUNS = 2000
BLOCK_BYTES = 1 << 20
_COUNT_BITS = 16  # a run has at most length - gram + 1 windows
_RUN = "anchor bigint, seg bigint, k1 bigint, k2 bigint, place bigint"


def _pack(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    return (start.astype(np.int64) << _COUNT_BITS) | count


def _start(place: Column) -> Column:
    return F.shiftright(place, _COUNT_BITS)


def _count(place: Column) -> Column:
    return place.bitwiseAND(F.lit((1 << _COUNT_BITS) - 1))


def _runs(keyed: DataFrame, length: int, gram: int) -> DataFrame:
    """The runs of windows of all texts; equal texts, which share their key, give equal rows."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k1, k2 = (batch.column(k).to_numpy() for k in (0, 1))
            texts = [(t.as_py() or "").encode("utf-8", "replace") for t in batch.column(2)]
            for number, start, count, anchor, seg in segments(texts, length, gram):
                columns = [anchor.view(np.int64), seg.view(np.int64), k1[number], k2[number], _pack(start, count)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["anchor", "seg", "k1", "k2", "place"])

    return keyed.select("k1", "k2", "text").mapInArrow(cut, _RUN)


def _extract(wanted: DataFrame, length: int) -> DataFrame:
    """The bytes of runs: rows (z, runs) to rows (anchor, seg, wide, n, bytes)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for z, runs in zip(batch.column("z"), batch.column("runs"), strict=True):
                data = unsqueezed(z.as_py())
                rows = runs.as_py()
                for k in range(0, len(rows), 1000):
                    part = rows[k : k + 1000]
                    spans = [(r["place"] >> _COUNT_BITS, r["place"] & ((1 << _COUNT_BITS) - 1)) for r in part]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([r["anchor"] for r in part], pa.int64()),
                            pa.array([r["seg"] for r in part], pa.int64()),
                            pa.array([r["wide"] for r in part], pa.bool_()),
                            pa.array([n for _, n in spans], pa.int32()),
                            pa.array([data[s : s + n - 1 + length] for s, n in spans], pa.binary()),
                        ],
                        names=["anchor", "seg", "wide", "n", "bytes"],
                    )

    return wanted.select("z", "runs").mapInArrow(
        read, "anchor bigint, seg bigint, wide boolean, n int, bytes binary"
    )


def _spans_of(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last+1 of the runs of True."""
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _sorted_blocks(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Spans of repeated windows inside runs that arrive sorted by bucket.

    A block takes whole buckets up to ``BLOCK_BYTES``; with at most
    ``MAX_RUNS`` runs a bucket, a task holds some 3 MB of text and the arrays
    for it, however many rows it reads.
    """

    def solve(block: list[tuple[int, int, int, bytes]]) -> Iterator[pa.RecordBatch]:
        sizes = np.array([len(row[3]) for row in block])
        counts = np.array([row[2] for row in block])
        begins = np.cumsum(sizes) - sizes
        first = np.cumsum(counts) - counts
        places = np.repeat(begins - first, counts) + np.arange(counts.sum())
        anchors = np.array([row[0] for row in block])
        bucket = np.repeat(np.cumsum(np.append(True, anchors[1:] != anchors[:-1])), counts)
        found = repeated_windows(b"".join(row[3] for row in block), places, bucket, length)
        out: tuple[list, list, list, list] = ([], [], [], [])
        for (anchor, seg, n, _), at in zip(block, first.tolist(), strict=True):
            for lo, hi in zip(*_spans_of(found[at : at + n]), strict=True):
                for column, value in zip(out, (anchor, seg, int(lo), int(hi)), strict=True):
                    column.append(value)
        if out[0]:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["anchor", "seg", "lo", "hi"])

    block, size = [], 0
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("anchor", "seg", "n", "bytes")]
        for row in zip(*columns, strict=True):
            if size >= BLOCK_BYTES and row[0] != block[-1][0]:
                yield from solve(block)
                block, size = [], 0
            block.append(row)
            size += len(row[3])
    if block:
        yield from solve(block)


def _wide_spans(wide: DataFrame, length: int) -> DataFrame:
    """The same for buckets too wide for a block: equal windows are found as rows with equal hashes."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for anchor, seg, n, data in zip(*[batch.column(c).to_pylist() for c in ("anchor", "seg", "n", "bytes")], strict=True):
                digests = b"".join(xxhash.xxh3_128_digest(data[i : i + length]) for i in range(n))
                halves = np.frombuffer(digests, "<i8").reshape(-1, 2)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(n, anchor)),
                        pa.array(np.full(n, seg)),
                        pa.array(np.arange(n)),
                        pa.array(halves[:, 0].copy()),
                        pa.array(halves[:, 1].copy()),
                    ],
                    names=["anchor", "seg", "at", "h1", "h2"],
                )

    windows = wide.select("anchor", "seg", "n", "bytes").mapInArrow(
        split, "anchor bigint, seg bigint, at bigint, h1 bigint, h2 bigint"
    )
    often = windows.groupBy("h1", "h2").count().where("count >= 2").select("h1", "h2")
    return windows.join(often, ["h1", "h2"]).select("anchor", "seg", F.col("at").alias("lo"), (F.col("at") + 1).alias("hi"))


def _with_keys(docs: DataFrame, text: str) -> DataFrame:
    """Add ``k1`` and ``k2``, two independent hashes of the text, and replace NULL texts by empty ones."""
    whole = F.coalesce(F.col(text), F.lit(""))
    return docs.withColumns({text: whole, "k1": F.xxhash64(whole), "k2": F.xxhash64(F.lit(LENGTH), whole)})


def repeated_spans(keyed: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """``(k1, k2, spans)``: for every text key the spans (lo, hi) of bytes that repeat, unmerged and unsorted.

    ``keyed`` has (k1, k2, text), the keys being hashes of the text, so equal
    texts have equal spans. Texts without repeated bytes are not returned.
    """
    if not 0 < length - gram + 1 < 1 << _COUNT_BITS:
        raise ValueError("gram must be shorter than length")
    long = keyed.select("k1", "k2", "text").where(F.octet_length("text") >= length)
    # Buckets with several runs, and whether these are all the same bytes; counted before the shuffle.
    buckets = (
        _runs(long, length, gram)
        .groupBy("anchor")
        .agg(F.count("*").alias("n"), F.min("seg").alias("least"), F.max("seg").alias("most"))
        .where("n >= 2")
        .select("anchor", (F.col("least") == F.col("most")).alias("uniform"))
    )
    # Written, so that the join shuffles both sides itself and may split the tasks of an anchor that many texts hold.
    buckets = materialise(buckets, "buckets")
    hits = materialise(_runs(long, length, gram).join(buckets, "anchor"), "hits")
    runs = hits.where(~F.col("uniform")).groupBy("anchor", "seg").agg(
        F.count("*").alias("copies"), F.min(F.struct("k1", "k2", "place")).alias("at")
    )
    runs = materialise(runs.select("anchor", "seg", "copies", "at.*"), "runs")
    broad = runs.groupBy("anchor").count().where(F.col("count") > MAX_RUNS).select("anchor", F.lit(True).alias("wide"))
    broad = materialise(broad, "wide-buckets")
    tagged = lookup_join(runs, broad, "anchor", "left", table_rows=broad.count())
    run = F.struct("anchor", "seg", "place", F.coalesce("wide", F.lit(False)).alias("wide"))
    asked = materialise(tagged.groupBy("k1", "k2").agg(F.collect_list(run).alias("runs")), "asked")
    cut = materialise(_extract(squeezed(long).dropDuplicates(["k1", "k2"]).join(asked, ["k1", "k2"]), length), "run-bytes")
    blocks = (
        cut.where(~F.col("wide"))
        .select("anchor", "seg", "n", "bytes")
        .repartition("anchor")
        .sortWithinPartitions("anchor", "seg")
        .mapInArrow(lambda b: _sorted_blocks(b, length), "anchor bigint, seg bigint, lo bigint, hi bigint")
    )
    inside = materialise(blocks.union(_wide_spans(cut.where("wide"), length)), "inside")

    start = _start(F.col("place"))
    whole_run = hits.where("uniform").select("k1", "k2", "place").union(
        hits.where(~F.col("uniform")).join(runs.where("copies >= 2").select("anchor", "seg"), ["anchor", "seg"]).select("k1", "k2", "place")
    )
    # A run without a copy stands in one place only: that of its representative.
    part_run = runs.where("copies = 1").join(inside, ["anchor", "seg"])
    copied = long.groupBy("k1", "k2").count().where("count >= 2")
    spans = (
        whole_run.select("k1", "k2", start.alias("lo"), (start + _count(F.col("place")) + (length - 1)).alias("hi"))
        .union(part_run.select("k1", "k2", (start + F.col("lo")).alias("lo"), (start + F.col("hi") + (length - 1)).alias("hi")))
        .union(copied.select("k1", "k2", F.lit(0).cast("bigint"), F.lit(1 << 62)))
    )
    # Written, so that a join with all copies of a text shuffles both sides itself and may split them.
    return materialise(spans.groupBy("k1", "k2").agg(F.collect_set(F.struct("lo", "hi")).alias("spans")), "spans")


def _merged(spans: list[dict], size: int) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for lo, hi in sorted((s["lo"], min(s["hi"], size)) for s in spans):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], hi))
        else:
            out.append((lo, hi))
    return out


def remove_repeats(docs: DataFrame, text: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """Add ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256`` and ``kept`` (the bytes left) to every row.

    Texts are judged as UTF-8 bytes on the input: every byte inside a string of
    ``length`` bytes that starts at least twice goes, in all its places. NULL
    and empty texts have no bytes, texts under ``length`` bytes stay whole, and
    of texts that come twice nothing is left. Rows stay one to one whatever
    their ids; other columns are kept but for those with one of the new names.
    """
    new = ("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")
    others = [c for c in docs.columns if c != text and c not in new]
    names = {c: f"_doc_{i}" for i, c in enumerate(others)}
    keyed = _with_keys(docs.select(*[F.col(o).alias(n) for o, n in names.items()], F.col(text).alias("text")), "text")
    found = squeezed(keyed).join(repeated_spans(keyed, length, gram), ["k1", "k2"], "left").drop("k1", "k2")
    schema = found.selectExpr(
        *names.values(), "0L n_bytes", "0L n_removed", "0L n_spans", "'' kept_sha256", "z AS kept"
    ).schema

    def strike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, gone, counts, digests, left = [], [], [], [], []
            for z, spans in zip(batch.column("z"), batch.column("spans"), strict=True):
                data = unsqueezed(z.as_py())
                cuts = _merged(spans.as_py() or [], len(data))
                edges = [0, *[x for cut in cuts for x in cut], len(data)]
                kept = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                sizes.append(len(data))
                gone.append(len(data) - len(kept))
                counts.append(len(cuts))
                digests.append(hashlib.sha256(kept).hexdigest())
                left.append(kept)
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(c) for c in names.values()],
                    *[pa.array(c, pa.int64()) for c in (sizes, gone, counts)],
                    pa.array(digests, pa.string()),
                    pa.array(left, pa.binary()),
                ],
                names=[*names.values(), *new],
            )

    struck = found.select(*names.values(), "z", "spans").mapInArrow(strike, schema)
    return struck.select(*[F.col(n).alias(o) for o, n in names.items()], *new)


def drop_repeats(docs: DataFrame, text: str = "text", **how) -> DataFrame:
    """``docs`` without the repeated bytes, and without the texts of which nothing is left.

    Characters of which only some bytes are left go too. Texts that were NULL
    or empty before stay, as empty texts. All other columns are kept, whatever
    their names; rows of equal texts all go, and an empty table stays empty.
    """
    names = {c: f"_own_{i}" for i, c in enumerate(docs.columns) if c != text}
    renamed = docs.select(text, *[F.col(c).alias(n) for c, n in names.items()])
    rows = remove_repeats(renamed, text, **how).where("n_bytes = 0 OR n_removed < n_bytes")
    left = F.try_validate_utf8(F.col("kept").cast("string"))
    whole = F.coalesce(left, F.make_valid_utf8(F.col("kept").cast("string")))
    return rows.select(*[whole.alias(c) if c == text else F.col(names[c]).alias(c) for c in docs.columns])
