"""Texts as compressed bytes, for tables that are about to be shuffled."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F


def squeezed(keyed: DataFrame) -> DataFrame:
    """Replace ``text`` by ``z``, its compressed UTF-8 bytes (NULL: those of the empty text); other columns are kept."""
    others = [c for c in keyed.columns if c != "text"]
    schema = keyed.select(*others, F.lit(b"").alias("z")).schema

    def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            z = [packer.compress((t.as_py() or "").encode("utf-8", "replace")) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in others], pa.array(z, pa.binary())], names=[*others, "z"]
            )

    return keyed.select(*others, "text").mapInArrow(squeeze, schema)


def unsqueezed(z: bytes | None) -> bytes:
    """The bytes of the text."""
    return zstandard.decompress(z) if z else b""
