"""Runs of periodic words, by seeds on diagonals and their extension.

Words i and i + q that are equal lie on the diagonal of lag q. A run of
smallest period q and length L is a stretch of L - q equal pairs on it, and
with L >= max(``least``, 2 q) that stretch has at least max(``least`` - q, q)
pairs: the overlap every run of that lag is sure to have.

*Seeds.* Lags are taken in octaves. In the octave from m to 2 m every stretch
has m pairs, so it holds a whole gram of m / 2 words that begins at a multiple
of m / 2. Only these are looked up in the index of all grams of their length,
and only occurrences in the same text whose lag is in the octave are paired:
at most 2 n pairs in each octave of a text of n words, however periodic it is.
Grams have exact numbers, not hashes: those of twice the length are numbered by
the pair of their halves. A gram that occurs once has number 0 and takes no
further part, nor does anything longer.

*Extension.* Neighbouring grams on one diagonal belong to one stretch, of which
only the first is extended; a table of how far each lag is covered carries this
over from one block of pairs to the next. An extension compares numbers of ever
shorter grams, so it takes logarithmic time.

A stretch long enough is a run of some period; of those with the same words the
smallest period is kept.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from loomset.llm.words import WORD, words

LEAST = 12
BATCH_WORDS = 1 << 18
BLOCK_PAIRS = 1 << 20
_WORD = re.compile(WORD)


def split_words(text: str | None) -> list[str]:
    """The words of a text: what stands between the six ASCII blanks."""
    return _WORD.findall(text or "")


def number_words(texts: list[list[str]]) -> np.ndarray:
    """A number above 0 for each word of all texts in turn; equal only for equal words of one text."""
    out: list[int] = []
    base = 0
    for text in texts:
        known: dict[str, int] = {}
        out += [known.setdefault(w, base + len(known)) for w in text]
        base += len(known)
    return np.array(out, np.int64) + 1


def _repeated(keys: np.ndarray, size: int, at: np.ndarray) -> np.ndarray:
    """Numbers of equal keys at the places ``at``; 0 where a key occurs once, and elsewhere."""
    names = np.zeros(size, np.int32)
    if not keys.size:
        return names
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    change = np.append(True, ranked[1:] != ranked[:-1])
    often = ~(change & np.append(change[1:], True))
    number = np.cumsum(change)
    names[at[order[often]]] = number[often]
    return names


def _numbered(left: np.ndarray, right: np.ndarray, shift: int) -> np.ndarray:
    """Numbers of the grams made of one in ``left`` and, ``shift`` words on, one in ``right``."""
    if left.size <= shift:
        return np.zeros(left.size, np.int32)
    at = np.flatnonzero((left[:-shift] != 0) & (right[shift:] != 0))
    keys = left[at].astype(np.int64) << 32 | right[at + shift]
    return _repeated(keys, left.size, at)


class Grams:
    """The numbers of all grams of 3, 6, 12, ... words, as far as any occurs twice."""

    def __init__(self, numbers: np.ndarray):
        if numbers.size >= 1 << 31:
            raise ValueError("too many words in one text")
        self.words = numbers
        self.levels: list[np.ndarray] = []
        self.sizes: list[int] = []
        single = _repeated(numbers, numbers.size, np.arange(numbers.size))
        names, size = _numbered(_numbered(single, single, 1), single, 2), 3
        while names.any():
            self.levels.append(names)
            self.sizes.append(size)
            names, size = _numbered(names, names, size), 2 * size

    def forward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words from i on equal those from j on (i < j)."""
        n, gone = self.words.size, np.zeros(i.size, np.int64)
        for names, size in [*zip(self.levels[::-1], self.sizes[::-1], strict=True), (self.words, 1), (self.words, 1)]:
            a, b = i + gone, j + gone
            inside = b < n
            b = np.where(inside, b, 0)
            same = inside & (names[np.where(inside, a, 0)] == names[b]) & (names[b] != 0)
            gone += size * same
        return gone

    def backward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words before i equal those before j (i < j)."""
        gone = np.zeros(i.size, np.int64)
        for names, size in [*zip(self.levels[::-1], self.sizes[::-1], strict=True), (self.words, 1), (self.words, 1)]:
            a, b = i - gone - size, j - gone - size
            inside = a >= 0
            a, b = np.where(inside, a, 0), np.where(inside, b, 0)
            same = inside & (names[a] == names[b]) & (names[b] != 0)
            gone += size * same
        return gone


def _pairs(names: np.ndarray, size: int, low: int, high: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(place, lag) of equal grams, the first at a multiple of ``size``, the lag in [low, high); in order of place."""
    held = np.flatnonzero(names)
    span = np.int64(names.size + 1)
    index = np.sort(names[held] * span + held)
    seeds = held[held % size == 0]
    key = names[seeds] * span + seeds
    begin, end = np.searchsorted(index, key + low), np.searchsorted(index, key + np.minimum(high, span - 1 - seeds))
    counts = np.maximum(end - begin, 0)
    total = np.cumsum(counts)
    cut = 0
    while cut < seeds.size:
        done = total[cut - 1] if cut else 0
        stop = max(int(np.searchsorted(total, done + BLOCK_PAIRS, "right")), cut + 1)
        many = counts[cut:stop]
        if many.any():
            i = np.repeat(seeds[cut:stop], many)
            inner = np.arange(i.size) - np.repeat(np.cumsum(many) - many, many)
            j = index[np.repeat(begin[cut:stop], many) + inner] % span
            yield i, j - i
        cut = stop


def find_runs(numbers: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of every run, by start and period.

    ``numbers`` are those of ``number_words``, of one text or several.
    ``least`` must be 12 or more: with less, a run need not hold a whole seed.
    """
    if least < 12:
        raise ValueError("runs of under 12 words may have no seed")
    grams = Grams(numbers)
    found: list[np.ndarray] = []
    for level, (names, size) in enumerate(zip(grams.levels, grams.sizes, strict=True)):
        low, high = (2 * size if level else 1), 4 * size
        covered = np.zeros(high - low, np.int64)
        for i, lag in _pairs(names, size, low, high):
            new = i >= covered[lag - low]
            i, lag = i[new], lag[new]
            order = np.lexsort((i, lag))
            i, lag = i[order], lag[order]
            first = np.append(True, (lag[1:] != lag[:-1]) | (i[1:] != i[:-1] + size))[: i.size]
            i, lag = i[first], lag[first]
            ahead, behind = grams.forward(i, i + lag), grams.backward(i, i + lag)
            np.maximum.at(covered, lag - low, i + ahead)
            length = ahead + behind + lag
            long = length >= np.maximum(least, 2 * lag)
            found.append(np.stack([(i - behind)[long], length[long], lag[long]]))
    if not found:
        return tuple(np.zeros((3, 0), np.int64))
    start, length, period = np.concatenate(found, axis=1)
    order = np.lexsort((period, length, start))
    start, length, period = start[order], length[order], period[order]
    best = np.append(True, (start[1:] != start[:-1]) | (length[1:] != length[:-1]))[: start.size]
    start, length, period = start[best], length[best], period[best]
    order = np.lexsort((period, start))
    return start[order], length[order], period[order]


def _kept(size: int, start: np.ndarray, length: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Which of ``size`` words are in no run behind its first period."""
    edges = np.zeros(size + 1, np.int64)
    np.add.at(edges, start + period, 1)
    np.add.at(edges, start + length, -1)
    return np.cumsum(edges)[:size] == 0


def _groups(texts: pa.Array) -> Iterator[tuple[int, list[list[str]]]]:
    begin, group, size = 0, [], 0
    for row, text in enumerate(texts):
        found = split_words(text.as_py())
        group.append(found)
        size += len(found)
        if size >= BATCH_WORDS:
            yield begin, group
            begin, group, size = row + 1, [], 0
    if group:
        yield begin, group


_ARRAYS = ("run_start", "run_length", "run_period")


def collapse_runs(docs: DataFrame, text: str = "text", least: int = LEAST) -> DataFrame:
    """Add the runs of every text, and the text without their repetitions.

    ``run_start``, ``run_length`` and ``run_period`` are arrays, in order of
    start and period; words are numbered from 0. ``collapsed`` has the words
    that no run holds behind its first period, joined by one space. NULL, empty
    and blank texts have no runs and collapse to the empty text; equal texts
    have equal runs; an empty table gives an empty one. Rows stay one to one;
    other columns are kept, but for those with one of the new names.

    A task looks at texts of about 260,000 words together (a longer text by
    itself), with some 100 bytes of arrays per word of texts that repeat much.
    """
    new = (*_ARRAYS, "collapsed")
    kept = [c for c in docs.columns if c not in new]
    rows = docs.select(*kept)
    runs = [F.array().cast("array<bigint>").alias(c) for c in _ARRAYS]
    schema = rows.select(*kept, *runs, F.lit("").alias("collapsed")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, group in _groups(batch.column(text)):
                sizes = np.array([len(g) for g in group])
                ends = np.cumsum(sizes)
                found = find_runs(number_words(group), least)
                keep = _kept(int(ends[-1]), *found)
                owner = np.searchsorted(ends, found[0], "right")
                offsets = pa.array(np.searchsorted(owner, np.arange(len(group) + 1)).astype(np.int32))
                start = found[0] - (ends - sizes)[owner]
                lists = [pa.ListArray.from_arrays(offsets, pa.array(c)) for c in (start, *found[1:])]
                left = []
                for end, text_words in zip(ends, group, strict=True):
                    mask = keep[end - len(text_words) : end]
                    left.append(" ".join(text_words if mask.all() else [text_words[k] for k in np.flatnonzero(mask)]))
                part = batch.slice(begin, len(group))
                yield pa.RecordBatch.from_arrays([*part.columns, *lists, pa.array(left, pa.string())], names=[*kept, *new])

    return rows.mapInArrow(run, schema)


def longest_run() -> Column:
    """The run of greatest length, then smallest start, then period, as (start, length, period); NULL without runs."""
    runs = F.arrays_zip(*_ARRAYS)
    keyed = F.transform(
        runs,
        lambda r: F.struct(
            (-r["run_length"]).alias("less"), r["run_start"].alias("start"), r["run_period"].alias("period"), r["run_length"].alias("length")
        ),
    )
    return F.array_min(keyed)


def listed() -> Column:
    """All runs as lines ``start,length,period``, each ended by a line feed."""
    line = F.transform(
        F.arrays_zip(*_ARRAYS), lambda r: F.concat_ws(",", r["run_start"], r["run_length"], r["run_period"])
    )
    return F.when(F.size("run_start") == 0, F.lit("")).otherwise(F.concat(F.array_join(line, "\n"), F.lit("\n")))


def with_planted_period(text: Column, doc_id: Column) -> Column:
    """The text, or for a tenth of all ids its words with a periodic tail; texts of NULL ids stay.

    With h the CRC-32 of the decimal id and g = floor(h / 10), words from g mod
    n on repeat with period 1 + floor((n - g mod n) / (3 + g mod 8)) where 10
    divides h.
    """
    h = F.crc32(doc_id.cast("string"))
    g = F.floor(h / 10).cast("bigint")
    all_words = words(text)

    def planted(ws: Column) -> Column:
        n = F.size(ws).cast("bigint")
        a = F.pmod(g, n)
        p = F.lit(1) + F.floor((n - a) / (F.lit(3) + F.pmod(g, F.lit(8)))).cast("bigint")
        place = lambda i: F.when(i < a, i).otherwise(a + F.pmod(i - a, p))
        return F.array_join(F.transform(ws, lambda w, i: F.get(ws, place(i.cast("bigint")).cast("int"))), " ")

    # A text is cut once: the words are a lambda's variable, and the lambda runs over one array of them.
    tail = F.get(F.transform(F.array(all_words), planted), F.lit(0))
    return F.when((F.pmod(h, F.lit(10)) == 0) & (F.size(all_words) > 0), tail).otherwise(text)
