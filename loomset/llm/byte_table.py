"""Byte strings by number, put together for many numbers at once."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa

BLOCK_IDS = 1 << 16


class ByteTable:
    """The byte string of each id, as one buffer and its offsets."""

    def __init__(self, strings: Sequence[bytes]):
        self.bytes = np.frombuffer(b"".join(strings), np.uint8)
        self.sizes = np.array([len(s) for s in strings], np.int32)
        self.begins = (np.cumsum(self.sizes) - self.sizes).astype(np.int32)

    def known(self, ids: np.ndarray) -> np.ndarray:
        return (ids >= 0) & (ids < self.sizes.size)

    def gather(self, ids: np.ndarray) -> bytes:
        """The bytes of known ids, in turn."""
        if not ids.size:
            return b""
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes, dtype=np.int64)
        places = np.repeat(self.begins[ids] - (ends - sizes), sizes) + np.arange(ends[-1])
        return self.bytes[places].tobytes()

    def gather_lists(self, lists: pa.ListArray) -> Iterator[bytes]:
        """The bytes of every row of a column of lists (NULL: none); unknown ids stand for nothing.

        Rows are looked up together, about ``BLOCK_IDS`` ids at a time.
        """
        values, offsets = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy().astype(np.int64)
        here = lists.is_valid().to_numpy(zero_copy_only=False)
        row = 0
        while row < len(lists):
            stop = max(int(np.searchsorted(offsets, offsets[row] + BLOCK_IDS, "right")) - 1, row + 1)
            ids = values[offsets[row] : offsets[stop]]
            real = self.known(ids)
            lengths = np.where(real, self.sizes[np.where(real, ids, 0)], 0)
            ends = np.append(0, np.cumsum(lengths, dtype=np.int64))[offsets[row : stop + 1] - offsets[row]]
            data = self.gather(ids[real])
            for k in range(stop - row):
                yield data[ends[k] : ends[k + 1]] if here[row + k] else b""
            row = stop
