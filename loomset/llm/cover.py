"""Order of suffixes by a difference cover: one bucket at a time, in bounded memory.

A set D of residues modulo ``PERIOD`` is a difference cover if every
difference modulo ``PERIOD`` is one between two of its members. Then for any
two places i and j there is a distance d < PERIOD such that i + d and j + d are
both sample places, those with a residue in D. With the ranks of the sample
suffixes known, two suffixes with ``PERIOD`` bytes in common are compared by
one look at two ranks, however long their tie is.
"""

from __future__ import annotations

import numpy as np

PERIOD = 32


def difference_cover(period: int) -> list[int]:
    """A small difference cover, each member chosen for the most differences it adds."""
    cover, seen = [0], {0}
    while len(seen) < period:

        def gain(c: int) -> int:
            return len({x for d in cover for x in ((c - d) % period, (d - c) % period)} - seen)

        best = max((c for c in range(period) if c not in cover), key=gain)
        seen |= {x for d in cover for x in ((best - d) % period, (d - best) % period)}
        cover.append(best)
    return sorted(cover)


_COVER = np.array(difference_cover(PERIOD))
_SLOT = np.full(PERIOD, -1)
_SLOT[_COVER] = np.arange(_COVER.size)
_IN_COVER = _SLOT >= 0
# _STEP[r, s]: the least distance that takes residues r and s into the cover together.
_STEP = np.array(
    [
        [next(d for d in range(PERIOD) if _IN_COVER[(r + d) % PERIOD] and _IN_COVER[(s + d) % PERIOD]) for s in range(PERIOD)]
        for r in range(PERIOD)
    ]
)


def _ranks(*columns: np.ndarray) -> np.ndarray:
    """Dense ranks of rows by their columns, the first one most significant."""
    order = np.lexsort(columns[::-1])
    new = np.zeros(order.size, bool)
    for column in columns:
        sorted_column = column[order]
        new[1:] |= sorted_column[1:] != sorted_column[:-1]
    out = np.empty(order.size, np.int64)
    out[order] = np.cumsum(new)
    return out


class Text:
    """Bytes of one block with the ranks of its cover sample; ``depth`` bytes may be read from any place."""

    def __init__(self, data: bytes, depth: int):
        self.size = len(data)
        tail = -self.size % PERIOD + depth + 2 * PERIOD
        padded = np.frombuffer(data + bytes(tail + 8), np.uint8)
        # words[i]: the eight bytes from i, as a number that sorts as they do
        self.words = np.lib.stride_tricks.sliding_window_view(padded, 8).copy().view(">u8").ravel().astype(np.uint64)
        periods = (self.size + PERIOD - 1) // PERIOD + 2
        places = (np.arange(periods)[:, None] * PERIOD + _COVER[None, :]).ravel()
        heads = [self.words[np.minimum(places + 8 * k, self.words.size - 1)] for k in range(PERIOD // 8)]
        rank = _ranks(*heads, np.maximum(places, self.size - 1))  # places behind the end never tie
        reach = PERIOD
        while rank.max() < rank.size - 1:  # until no two sample suffixes tie
            ahead = reach // PERIOD * _COVER.size
            later = np.append(rank[ahead:], np.full(min(ahead, rank.size), -1))[: rank.size]
            rank = _ranks(rank, later)
            reach *= 2
        self.rank = rank

    def sample_rank(self, places: np.ndarray) -> np.ndarray:
        return self.rank[places // PERIOD * _COVER.size + _SLOT[places % PERIOD]]

    def sort(self, places: np.ndarray, bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions into ``places`` in order of (bucket, suffix), and where a suffix shares PERIOD bytes with the one before.

        Buckets are sorted by their first ``PERIOD`` bytes; ties go by the
        sample: suffixes of one residue by one rank each, then runs of
        different residues are merged pairwise.
        """
        heads = [self.words[places + 8 * k] for k in range(PERIOD // 8)]
        order = np.lexsort([*heads[::-1], bucket])
        same = np.zeros(order.size, bool)
        same[1:] = bucket[order][1:] == bucket[order][:-1]
        for head in heads:
            same[1:] &= head[order][1:] == head[order][:-1]
        tied = same.copy()
        tied[:-1] |= same[1:]
        group = np.cumsum(~same)
        at = np.flatnonzero(tied)
        if at.size:
            order[at] = order[at][self._by_sample(places[order[at]], group[at])]
        return order, same

    def _by_sample(self, places: np.ndarray, group: np.ndarray) -> np.ndarray:
        residue = places % PERIOD
        own = self.sample_rank(places + _STEP[residue, residue])
        order = np.lexsort([own, residue, group])
        g, r = group[order], residue[order]
        run = np.cumsum(np.append(True, (g[1:] != g[:-1]) | (r[1:] != r[:-1]))) - 1
        while True:
            # Runs of a group are numbered 0, 1, … and merged as pairs (0, 1), (2, 3), …
            starts = np.flatnonzero(np.append(True, run[1:] != run[:-1]))
            ends = np.append(starts[1:], run.size)
            run = np.repeat(np.arange(starts.size), ends - starts)
            owner = g[starts]
            head = np.append(True, owner[1:] != owner[:-1])
            number = np.arange(starts.size) - np.flatnonzero(head)[np.cumsum(head) - 1]
            left = number % 2 == 0
            mate = np.where(left, np.arange(starts.size) + 1, np.arange(starts.size) - 1)
            paired = ~left | np.append(left[:-1] & (owner[1:] == owner[:-1]), False)
            if not paired.any():
                return order
            moving = np.flatnonzero(paired[run])
            mine, other = run[moving], mate[run[moving]]
            lo, hi, goes_left = starts[other], ends[other], left[mine]
            x = places[order[moving]]
            while True:
                open_ = np.flatnonzero(lo < hi)
                if not open_.size:
                    break
                mid = (lo[open_] + hi[open_]) // 2
                y = places[order[mid]]
                step = _STEP[x[open_] % PERIOD, y % PERIOD]
                rx, ry = self.sample_rank(x[open_] + step), self.sample_rank(y + step)
                before = (ry < rx) | ((ry == rx) & ~goes_left[open_])
                lo[open_] = np.where(before, mid + 1, lo[open_])
                hi[open_] = np.where(before, hi[open_], mid)
            target = np.arange(run.size)
            base = np.minimum(starts[mine], starts[other])
            target[moving] = base + (moving - starts[mine]) + (lo - starts[other])
            merged = np.empty_like(order)
            merged[target] = order
            order = merged
            run = np.where(paired[run] & ~left[run], mate[run], run)

    def equal(self, a: np.ndarray, b: np.ndarray, length: int) -> np.ndarray:
        """Whether the ``length`` bytes from a[i] and from b[i] are the same, read byte for byte."""
        out = np.ones(a.size, bool)
        offsets = [*range(0, length - 7, 8), *([length - 8] if length % 8 else [])]
        alive = np.arange(a.size)
        for k in offsets:
            alive = alive[self.words[a[alive] + k] == self.words[b[alive] + k]]
            if not alive.size:
                break
        out[:] = False
        out[alive] = True
        return out


def repeated_windows(data: bytes, places: np.ndarray, bucket: np.ndarray, length: int) -> np.ndarray:
    """Whether each place's window of ``length`` bytes equals that of another place of its bucket.

    The suffixes are sorted bucket by bucket; equal windows are then
    neighbours, which are compared in full.
    """
    text = Text(data, length)
    order, same = text.sort(places, bucket)
    later = np.flatnonzero(same)
    twins = later[text.equal(places[order[later - 1]], places[order[later]], length)]
    out = np.zeros(places.size, bool)
    out[order[twins]] = True
    out[order[twins - 1]] = True
    return out
