"""Column expressions on text: trimming, measuring, splitting."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, functions as F
from pyspark.sql.types import ArrayType, IntegerType

# The 29 characters a Python str.strip() removes.
WHITESPACE = (
    "\t\n\v\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# The same characters as a pattern; \\s with the (?U) flag knows all but four of them.
_BLANKS = r"(?U)[\s\x1c-\x1f]+"

# Blocks of scripts written without blanks between words.
_CJK = r"([\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uac00-\ud7a3\uf900-\ufaff])"

TOKENIZERS = ("whitespace", "cjk_char")

# Characters of which a task holds the ids at a time.
GROUP_CHARS = 1 << 18


def py_strip(text: Column) -> Column:
    """Trim Unicode whitespace on both ends (Spark's own trim knows only U+0020)."""
    return F.btrim(text, F.lit(WHITESPACE))


def solid_length(text: Column) -> Column:
    """Characters left after removing newlines, blanks and tabs."""
    return F.length(F.translate(text, "\n \t", ""))


def is_solid(text: Column, at_least: int) -> Column:
    """Whether ``solid_length`` reaches a small number; stops reading once it does."""
    return text.rlike(r"(?:[^\n \t][\n \t]*+){%d}" % at_least)


def words(text: Column, tokenizer: str = "whitespace") -> Column:
    """Split text to an array of words; blank text gives an empty array.

    ``cjk_char`` also makes every CJK character a word of its own.
    """
    if tokenizer not in TOKENIZERS:
        raise ValueError(f"tokenizer must be one of {TOKENIZERS}, not {tokenizer!r}")
    if tokenizer == "cjk_char":
        text = F.regexp_replace(text, _CJK, " $1 ")
    return F.filter(F.split(text, _BLANKS), lambda w: w != "")


def text_groups(sizes: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """(first row, rows) of groups of about ``limit`` in size; a larger row is in one group with those before it."""
    begin, ends = 0, np.cumsum(sizes, dtype=np.int64)
    while begin < ends.size:
        before = ends[begin - 1] if begin else 0
        stop = min(int(np.searchsorted(ends, before + limit)) + 1, ends.size)
        yield begin, stop - begin
        begin = stop


@F.arrow_udf(ArrayType(IntegerType()))
def _byte_ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """The bytes of binary values as integers, a group at a time: the Arrow buffers are only relabelled."""
    for batch in batches:
        values = batch.cast(pa.large_binary())
        _, offsets, data = values.buffers()
        ends = np.frombuffer(offsets, dtype=np.int64)[values.offset : values.offset + len(values) + 1]
        used = np.frombuffer(data or b"", dtype=np.uint8)
        for begin, rows in text_groups(np.diff(ends), GROUP_CHARS):
            part = ends[begin : begin + rows + 1]
            yield pa.ListArray.from_arrays(
                pa.array((part - part[0]).astype(np.int32)),
                pa.array(used[part[0] : part[-1]].astype(np.int32)),
                mask=values.slice(begin, rows).is_null() if values.null_count else None,
            )


def utf8_ids(text: Column, limit: int) -> Column:
    """The first ``limit`` UTF-8 bytes of the text as integer token ids."""
    return _byte_ids(F.substring(F.encode(text, "UTF-8"), 1, limit))
