"""Words of a text as Column expressions.

A word is a run of characters other than the six ASCII blanks (space, tab, line
feed, vertical tab, form feed, carriage return). NULL texts have no words.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

BLANKS = " \t\n\x0b\x0c\r"
BLANK_RUN = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """The words in order, as an array; empty for a NULL or blank text."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(F.length(bare) == 0, F.array().cast("array<string>")).otherwise(F.split(bare, BLANK_RUN))


def count_words(text: Column) -> Column:
    """How many words a text has (0 for NULL), without building them.

    Every run of blanks becomes one blank, so the trimmed text has one blank
    less than it has words.
    """
    bare = F.btrim(F.regexp_replace(F.coalesce(text, F.lit("")), BLANK_RUN, " "), F.lit(" "))
    blanks = F.length(bare) - F.length(F.replace(bare, F.lit(" "), F.lit("")))
    return F.when(F.length(bare) == 0, F.lit(0)).otherwise(blanks + 1).cast("bigint")
