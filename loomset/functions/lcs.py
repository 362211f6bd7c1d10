"""Length of the longest common subsequence of two word lists."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType


def lcs_length(left: Sequence[str], right: Sequence[str]) -> int:
    """Bit-parallel LCS (Hyyrö 2004): one integer holds a whole row of the table."""
    places: dict[str, int] = {}
    for i, word in enumerate(left):
        places[word] = places.get(word, 0) | (1 << i)
    full = (1 << len(left)) - 1
    row = full
    for word in right:
        hit = row & places.get(word, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(left) - row.bit_count()


@F.pandas_udf(IntegerType())
def lcs(left: pd.Series, right: pd.Series) -> pd.Series:
    """Arrow-batched ``lcs_length`` of two array<string> columns."""
    return pd.Series([lcs_length(a, b) for a, b in zip(left, right)], dtype="int32")
