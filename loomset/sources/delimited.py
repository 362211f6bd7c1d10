"""Delimited files (CSV, TSV) read by as many tasks as they have splits.

A line of such a file begins either outside quotes or inside a cell that goes
on, and so acts on that state as a function of it. A first scan, of files large
enough to be split, composes these functions to one per split. Carried over the
splits of a file in order, they tell in which state each begins, and every
split is then cut into records by its own task. A record that reaches into
later splits is put together from its pieces.

Cells belong to the header's names by position, so names may repeat (the last
cell of a name counts) and differ in case only.
"""

from __future__ import annotations

import csv
import re
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

_UNITS = {"": 1, "b": 1, "k": 1 << 10, "kb": 1 << 10, "m": 1 << 20, "mb": 1 << 20, "g": 1 << 30, "gb": 1 << 30}
_ROWS = 2000
_LAST = (1 << 62) - 1  # number of a record that ends in a later split: behind all others of its own

Split = tuple[str, int]


def ends_inside(line: str, inside: bool, sep: str) -> bool:
    """Whether a quoted cell is open at the end of a line that begins inside such a cell, or outside.

    A quote opens a cell only as its first sign; in a cell that is open two
    quotes are one sign of it.
    """
    at = 0
    while True:
        if inside:
            at = line.find('"', at)
            if at < 0:
                return True
            if line.startswith('"', at + 1):
                at += 2
                continue
            inside = False
            at = line.find(sep, at)
        elif line.startswith('"', at):
            inside, at = True, at + 1
            continue
        else:
            at = line.find(sep + '"', at)
        if at < 0:
            return False
        at += len(sep)


def _parse(records: list[str], sep: str) -> list[list[str]]:
    """The cells of every record that is not blank; an open cell ends with its record."""
    csv.field_size_limit(sys.maxsize)
    return [next(csv.reader([r], delimiter=sep), []) for r in records]


def header_names(cells: list[str]) -> tuple[list[str], list[int]]:
    """The names of a header, each once, and the place of the last cell of each."""
    last = {name: place for place, name in enumerate(cells)}
    return list(last), list(last.values())


def _size(setting: str) -> int:
    number, unit = re.match(r"(\d+)\s*([a-z]*)$", setting.strip().lower()).groups()
    return int(number) * _UNITS[unit]


def never_split(spark: SparkSession) -> int:
    """Bytes up to which Spark reads a file as one split."""
    names = ("spark.sql.files.openCostInBytes", "spark.sql.files.maxPartitionBytes")
    return min(_size(spark.conf.get(n)) for n in names)


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, str]]:
    for batch in batches:
        for path, start, line in zip(*[batch.column(c).to_pylist() for c in ("path", "block_start", "value")], strict=True):
            yield path, start, line or ""


def measure(lines: DataFrame, sep: str) -> DataFrame:
    """For each split ``after_out`` and ``after_in``: whether a cell is open behind it, by how it begins; and the header of the first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[Split, list[bool]] = {}
        heads: dict[Split, list[str]] = {}
        headed: set[Split] = set()
        for path, start, line in _lines(batches):
            split = (path, start)
            after = found.setdefault(split, [False, True])
            if start == 0 and split not in headed:
                head = heads.setdefault(split, [])
                if head or line.strip():
                    head.append(line)
                    if not ends_inside(line, after[0], sep):
                        headed.add(split)
            if '"' in line:
                after[:] = [ends_inside(line, state, sep) for state in after]
        for path, _ in heads.keys() - headed:
            if heads[path, 0] and found[path, 0][0]:
                raise ValueError(f"the header of {path} reaches over a split")
        names = ["path", "block_start", "after_out", "after_in", "header"]
        heads_of = [_parse(["\n".join(heads[s])], sep)[0] if s in heads else None for s in found]
        if found:
            columns = [[s[0] for s in found], [s[1] for s in found], [a[0] for a in found.values()], [a[1] for a in found.values()], heads_of]
            kinds = [pa.string(), pa.int64(), pa.bool_(), pa.bool_(), pa.list_(pa.string())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    schema = "path string, block_start bigint, after_out boolean, after_in boolean, header array<string>"
    return lines.select("path", "block_start", "value").mapInArrow(run, schema)


def beginnings(measured: DataFrame) -> DataFrame:
    """Add ``inside``: whether a split begins in a cell that goes on.

    A split either fixes the state behind it, keeps it, or turns it round. So
    the state is that of the last split that fixes it, turned as often as
    splits since then turn it. One row per split, in order within its file.
    """
    before = Window.partitionBy("path").orderBy("block_start").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("path").orderBy("block_start").rowsBetween(Window.unboundedPreceding, 0)
    turns = F.when(F.col("after_out") & ~F.col("after_in"), 1).otherwise(0)
    fixes = F.when(F.col("after_out") == F.col("after_in"), F.struct(F.col("after_out").alias("state"), F.col("_turns").alias("turns")))
    fixed = F.last(fixes, ignorenulls=True).over(before)
    so_far = F.coalesce(F.sum(turns).over(before), F.lit(0))
    return (
        measured.withColumn("_turns", F.sum(turns).over(upto))
        .withColumn("_fixed", fixed)
        .withColumn("_odd", F.pmod(so_far - F.coalesce("_fixed.turns", F.lit(0)), F.lit(2)) == 1)
        .withColumn("inside", F.coalesce("_fixed.state", F.lit(False)) != F.col("_odd"))
        .drop("_turns", "_fixed", "_odd")
    )


_RECORDS = "path string, block_start bigint, rid bigint, names array<string>, cells array<string>"
_PIECES = "path string, block_start bigint, opens boolean, piece string"


def _cells_of(cells: list[str], places: list[int]) -> list[str]:
    return [cells[p] if p < len(cells) else "" for p in places]


def _walk(
    batches: Iterator[pa.RecordBatch], sep: str, inside: frozenset[Split]
) -> Iterator[tuple[Split, str, bool, bool]]:
    """(split, text, opens, closes) of every record, and of the pieces of those that reach over the ends of a split."""
    split, held, opens, state = None, [], True, False
    for path, start, line in _lines(batches):
        if split != (path, start):
            if held:
                yield split, "\n".join(held), opens, False
            split, held = (path, start), []
            state = split in inside
            opens = not state
        held.append(line)
        state = ends_inside(line, state, sep) if state or '"' in line else False
        if not state:
            yield split, "\n".join(held), opens, True
            held, opens = [], True
    if held:
        yield split, "\n".join(held), opens, False


def cut(lines: DataFrame, sep: str, inside: frozenset[Split], headers: dict[str, list[str]]) -> DataFrame:
    """The records that lie in one split.

    ``headers`` are those of files of several splits; any other begins with its own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        split, number, names, places = None, 0, [], []

        def full() -> pa.RecordBatch:
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.string())]
            columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
            rows.clear()
            return pa.RecordBatch.from_arrays(columns, names=["path", "block_start", "rid", "names", "cells"])

        csv.field_size_limit(sys.maxsize)
        for here, text, opens, closes in _walk(batches, sep, inside):
            if here != split:
                split, number = here, 0
                known = headers.get(here[0])
                headed = here[1] != 0
                names, places = header_names(known) if known is not None else ([], [])
            # A record open at the end of a file of one split ends there.
            if not opens or not (closes or here[0] not in headers):
                continue
            cells = next(csv.reader([text], delimiter=sep), [])
            if not cells:
                continue
            if not headed:
                headed = True
                names, places = header_names(cells)
                continue
            rows.append((here[0], here[1], number, names, _cells_of(cells, places)))
            number += 1
            if len(rows) >= _ROWS:
                yield full()
        if rows:
            yield full()

    return lines.select("path", "block_start", "value").mapInArrow(run, _RECORDS)


def joined(lines: DataFrame, sep: str, inside: frozenset[Split], headers: dict[str, list[str]]) -> DataFrame:
    """The records that reach over the end of a split, under the split they begin in."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (path, start), text, opens, closes in _walk(batches, sep, inside):
            if not (opens and closes):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([path]), pa.array([start], pa.int64()), pa.array([opens]), pa.array([text])],
                    names=["path", "block_start", "opens", "piece"],
                )

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start, texts in zip(*[batch.column(c).to_pylist() for c in ("path", "block_start", "texts")], strict=True):
                cells = _parse(["\n".join(t["piece"] for t in texts)], sep)[0]
                names, places = header_names(headers[path])
                columns = [[path], [start], [_LAST], [names], [_cells_of(cells, places)]]
                kinds = [pa.string(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.string())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                    names=["path", "block_start", "rid", "names", "cells"],
                )

    found = lines.select("path", "block_start", "value").mapInArrow(pieces, _PIECES)
    # A piece that closes a record comes before one that opens the next in the same split.
    order = Window.partitionBy("path").orderBy("block_start", "opens").rowsBetween(Window.unboundedPreceding, 0)
    begun = F.max(F.when(F.col("opens"), F.col("block_start"))).over(order)
    texts = (
        found.withColumn("_begun", begun)
        .groupBy("path", "_begun")
        .agg(F.array_sort(F.collect_list(F.struct("block_start", "opens", "piece"))).alias("texts"))
    )
    return texts.select("path", F.col("_begun").alias("block_start"), "texts").mapInArrow(parse, _RECORDS)


def read_delimited(spark: SparkSession, lines: DataFrame, sep: str) -> DataFrame:
    """``path, block_start, rid, names, cells`` of every record below its header.

    ``lines`` are those of the files, ``path, block_start, value`` and the
    file's size in ``size``. The driver gets, of files that Spark may split, the
    header and the splits that begin inside a cell; it holds every split of
    the scan anyway.
    """
    large = lines.where(F.col("size") > never_split(spark))
    states = beginnings(measure(large, sep)).where(F.col("inside") | F.col("header").isNotNull())
    inside, headers = set(), {}
    for row in states.select("path", "block_start", "inside", "header").collect():
        if row["inside"]:
            inside.add((row["path"], row["block_start"]))
        if row["header"] is not None:
            headers[row["path"]] = row["header"]
    records = cut(lines, sep, frozenset(inside), headers)
    if inside:
        records = records.unionByName(joined(large, sep, frozenset(inside), headers))
    return records
