"""Content-defined anchors of byte strings (winnowing), for many texts at once.

Every window of ``length`` bytes picks the leftmost smallest hash of the
``gram``-byte strings inside it. Equal windows pick the same place inside,
wherever they stand, so two windows can be equal only if their anchors are.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE_VALUES = np.random.default_rng(1).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE_BITS = 22
PIECE = 1 << 19  # bytes looked at together; a longer text is cut into overlapping pieces

_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base**0 … base**(n-1) modulo 2**64; kept, as every piece needs the same."""
    if base not in _powers or _powers[base].size < n:
        out = np.full(n, base, np.uint64)
        out[:1] = 1
        _powers[base] = np.multiply.accumulate(out)
    return _powers[base][:n]


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


class RollingHash:
    """64-bit hashes of any substring of a buffer, from sums of powers modulo 2**64."""

    def __init__(self, buffer: np.ndarray):
        self.sums = np.zeros(buffer.size + 1, np.uint64)
        np.cumsum(_BYTE_VALUES[buffer] * _power(_BASE, buffer.size), out=self.sums[1:])
        self.shift = _power(_INVERSE, buffer.size + 1)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((self.sums[end] - self.sums[start]) * self.shift[start])

    def grams(self, length: int) -> np.ndarray:
        """The hash of the ``length`` bytes from every place that has them."""
        m = self.sums.size - length
        return _mix((self.sums[length:] - self.sums[:m]) * self.shift[:m])


def _smallest(grams: np.ndarray, width: int) -> np.ndarray:
    """For every window of ``width`` hashes the place of its leftmost smallest one."""
    low = np.uint64((1 << _PLACE_BITS) - 1)
    keys = (grams & ~low) | np.arange(grams.size, dtype=np.uint64)
    n = grams.size - width + 1
    rows = np.append(keys, np.full(-grams.size % width, np.iinfo(np.uint64).max, np.uint64)).reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return (np.minimum(behind[:n], ahead[width - 1 : width - 1 + n]) & low).astype(np.int64)


def _pieces(texts: Sequence[bytes], length: int) -> Iterator[tuple[list[int], list[int], list[bytes]]]:
    """Groups of (text number, offset, bytes) of about ``PIECE`` bytes; all windows are inside exactly one."""
    numbers, offsets, parts, size = [], [], [], 0
    for number, text in enumerate(texts):
        for at in range(0, max(len(text) - length + 1, 0), PIECE):
            part = text[at : at + PIECE + length - 1]
            numbers.append(number)
            offsets.append(at)
            parts.append(part)
            size += len(part)
            if size >= PIECE:
                yield numbers, offsets, parts
                numbers, offsets, parts, size = [], [], [], 0
    if parts:
        yield numbers, offsets, parts


def segments(texts: Sequence[bytes], length: int, gram: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Runs of neighbouring windows that share an anchor.

    Yields arrays (text number, first window start, number of windows, anchor
    hash, hash of all bytes the windows cover). Every window of every text is
    in one run. Texts shorter than ``length`` have none.
    """
    width = length - gram + 1
    for numbers, offsets, parts in _pieces(texts, length):
        buffer = np.frombuffer(b"".join(parts), np.uint8)
        sizes = np.array([len(p) for p in parts])
        ends = np.cumsum(sizes)
        rolling = RollingHash(buffer)
        grams = rolling.grams(gram)
        place = _smallest(grams, width)
        owner = np.repeat(np.arange(sizes.size), sizes)[: place.size]
        inside = np.arange(place.size) + length <= ends[owner]
        change = (place[1:] != place[:-1]) | (owner[1:] != owner[:-1]) | (inside[1:] != inside[:-1])
        first = np.flatnonzero(np.append(True, change))
        last = np.append(first[1:], place.size)
        real = inside[first]
        first, last = first[real], last[real]
        own = owner[first]
        yield (
            np.array(numbers)[own],
            np.array(offsets)[own] + first - (ends - sizes)[own],
            last - first,
            grams[place[first]],
            rolling.of(first, last - 1 + length),
        )
