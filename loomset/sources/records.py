"""Scans of record files: JSONL, JSON, text, CSV and TSV to one table of VARIANT records.

Every scan returns ``path, block_start, rid, json, raw``: ``json`` is the
record's JSON text, ``raw`` the same as VARIANT (NULL if the text is no valid
JSON), and ``(path, block_start, rid)`` sorts records as they stand in the
files. Unused columns are pruned by the optimizer.
"""

from __future__ import annotations

import re
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from loomset.functions.once import with_once
from loomset.functions.text import py_strip
from loomset.operators.joins import lookup_join
from loomset.sources.delimited import read_delimited

# File name endings that are read.
SUFFIXES = ("json", "jsonl", "txt", "csv", "tsv")

# A little below the largest VARIANT, 128 MiB.
_VARIANT_BYTES = 128 * 2**20 - 2**16


def _any_case(suffix: str) -> str:
    return "*." + "".join(f"[{c}{c.upper()}]" for c in suffix)


def _place() -> list[Column]:
    return [
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("block_start"),
    ]


def _variant(record: Column, *texts: Column) -> Column:
    """A struct of texts as VARIANT, NULL if it is larger than a VARIANT can be."""
    size = sum((F.octet_length(t).cast("bigint") for t in texts), F.lit(0).cast("bigint"))
    return F.when(size < _VARIANT_BYTES, F.to_variant_object(record))


def _records(df: DataFrame, parsed: Column | None = None) -> DataFrame:
    """Number the rows of ``path, block_start, json`` and parse the text."""
    raw = F.try_parse_json("json") if parsed is None else parsed
    return df.select(
        "path", "block_start", F.monotonically_increasing_id().alias("rid"), "json", raw.alias("raw")
    )


def scan_files(spark: SparkSession, path: str | list[str]) -> list[str]:
    """All readable files below a folder, in path order; none at all is an error.

    Only the listing is used, which a scan needs on the driver anyway; no file
    content is read.
    """
    pattern = "*.{" + ",".join(_any_case(s)[2:] for s in SUFFIXES) + "}"
    listing = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", pattern)
        .load(path)
    )
    files = sorted(unquote(f) for f in listing.inputFiles())
    if not files:
        raise ValueError(f"no file ending in {SUFFIXES} below {path}")
    return files


def read_jsonl(
    spark: SparkSession, path: str | list[str], suffix: str = "jsonl"
) -> DataFrame:
    """One record per non-blank line. Malformed lines stay, with a NULL ``raw``.

    Spark itself names files of JSON lines ``.json``: read those with that ``suffix``.
    """
    lines = _text(spark, path, suffix).select(*_place(), py_strip(F.col("value")).alias("json"))
    return _records(lines.where(F.col("json") != ""))


def read_json(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """The elements of a JSON array or of an object's ``data`` array, else the one value.

    A JSON document cannot be cut into splits; each file is read by one task.
    A malformed file makes the job fail.
    """
    files = _text(spark, path, "json", wholetext=True).select(
        *_place(), py_strip(F.col("value")).alias("body")
    )
    listed = F.from_json("body", "array<string>", {"mode": "FAILFAST"})
    data = F.when(
        F.col("body").startswith("{"), F.from_json("body", "struct<data: array<string>>")["data"]
    )
    found = F.when(F.col("body").startswith("["), listed).otherwise(data)
    # The document does not go through the explode, which would copy it beside every record.
    rows = (
        with_once(files, "_found", found)
        .withColumn("_single", F.col("_found").isNull())
        .select(
            "path",
            "block_start",
            "_single",
            F.explode(F.coalesce("_found", F.array("body"))).alias("json"),
        )
    )
    # A single value was not parsed yet: parse it strictly, so that a malformed file fails.
    raw = F.when(F.col("_single"), F.parse_json("json")).otherwise(F.try_parse_json("json"))
    return _records(rows, raw)


def read_txt(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """One ``{"text": …}`` record per paragraph; a file that is one paragraph gives its lines.

    Paragraphs end at an empty line. A first pass over the lines tells which
    files have an empty line between texts; these are cut at two line feeds
    while reading, and what Windows line ends hide from that cut is cut
    afterwards. The others are read line by line. Either way a large file is
    shared by many tasks. The driver gets one row per file.
    """
    lines = _text(spark, path, "txt").select(
        *_place(),
        (py_strip(F.col("value")) == "").alias("blank"),
        F.monotonically_increasing_id().alias("rid"),
        "value",
    )
    place = F.struct("block_start", "rid")
    texts = lines.where(~F.col("blank")).groupBy("path").agg(
        F.min(place).alias("first"), F.max(place).alias("last")
    )
    gaps = (
        lookup_join(lines.where("value = ''").select("path", place.alias("at")), texts, "path", "inner", len(lines.inputFiles()))
        .groupBy("path")
        .agg(F.max((F.col("at") > F.col("first")) & (F.col("at") < F.col("last"))).alias("cut"))
    )
    cut = {_one_slash(unquote(row["path"])) for row in gaps.where("cut").select("path").collect()}
    every = sorted(unquote(f) for f in lines.inputFiles())
    cut_files = [f for f in every if _one_slash(f) in cut]
    whole = [f for f in every if _one_slash(f) not in cut]
    parts = []
    if cut_files:
        parts.append(_paragraphs(spark, cut_files))
    if whole or not cut_files:
        rest = _text(spark, whole, "txt").select(*_place(), "value") if cut_files else lines
        parts.append(rest.select("path", "block_start", py_strip(F.col("value")).alias("text")).where("text <> ''"))
    record = F.struct("text")
    return reduce(DataFrame.unionByName, parts).select(
        "path",
        "block_start",
        F.monotonically_increasing_id().alias("rid"),
        F.to_json(record).alias("json"),
        _variant(record, F.col("text")).alias("raw"),
    )


def _one_slash(file: str) -> str:
    """A file's address with one slash behind the scheme: listings and scans write it differently."""
    return re.sub(r"^(\w+):/+", r"\1:/", file)


def _paragraphs(spark: SparkSession, files: list[str]) -> DataFrame:
    """``path, block_start, text`` of the paragraphs of text files."""
    chunks = spark.read.option("lineSep", "\n\n").text(files).select(*_place(), "value")
    # Most chunks are one paragraph already; a byte search tells which are not.
    uncut = F.contains("value", F.lit("\n\n")) | F.contains("value", F.lit("\r"))
    cut = F.split(F.regexp_replace("value", "\r\n?", "\n"), "\n\n")
    pieces = F.when(uncut, cut).otherwise(F.array("value"))
    return (
        chunks.select("path", "block_start", F.explode(pieces).alias("text"))
        .withColumn("text", py_strip(F.col("text")))
        .where(F.col("text") != "")
    )


def read_csv(
    spark: SparkSession, path: str | list[str], suffix: str = "csv", sep: str = ","
) -> DataFrame:
    """One record per row below the header; every cell is a string, missing cells are ''.

    Cells have their own file's names by position: of a name that comes twice
    the last cell counts, and surplus cells are dropped. A file is read by as
    many tasks as it has splits, also where quoted cells hold line breaks (see
    ``delimited``); line breaks of any kind read as one line feed.
    """
    text = _text(spark, path, suffix)
    if not text.inputFiles():
        raise ValueError(f"no .{suffix} file below {path}")
    lines = text.select(*_place(), F.col("_metadata.file_size").alias("size"), "value")
    rows = read_delimited(spark, lines, sep)
    record = F.map_from_arrays("names", "cells")
    size = F.aggregate("cells", F.lit(0).cast("bigint"), lambda n, c: n + F.octet_length(c))
    raw = F.when(size < _VARIANT_BYTES, F.to_variant_object(record))
    return rows.select("path", "block_start", "rid", F.to_json(record).alias("json"), raw.alias("raw"))


def read_tsv(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return read_csv(spark, path, "tsv", "\t")


_READERS = {
    "json": read_json,
    "jsonl": read_jsonl,
    "txt": read_txt,
    "csv": read_csv,
    "tsv": read_tsv,
}


def file_counts(records: DataFrame) -> DataFrame:
    """Records per file."""
    return records.groupBy("path").agg(F.count("*").alias("n"))


def read_records(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """All records below a folder: one scan per kind of file, put together."""
    found = {f.rsplit(".", 1)[-1].lower() for f in scan_files(spark, path)}
    return reduce(
        DataFrame.unionByName, [_READERS[suffix](spark, path) for suffix in sorted(found)]
    )


def _text(spark: SparkSession, path: str | list[str], suffix: str, wholetext: bool = False) -> DataFrame:
    reader = spark.read.option("recursiveFileLookup", True).option(
        "pathGlobFilter", _any_case(suffix)
    )
    return reader.text(path, wholetext=wholetext)
