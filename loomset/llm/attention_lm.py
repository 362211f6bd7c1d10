"""Language-model scores: a causal self-attention model on subword ids, trained in numpy.

A text is its words in lower-case ASCII letters; every word becomes the ids of
a public byte-level vocabulary, and one end sign closes the text. The chance of
the next id is that of its class, times that of the id within its class after
the id before it:

* ids are counted in pairs over all training texts, and the counts smoothed.
  The ``ACTIVE`` commonest ids are dealt to ``CLASSES`` classes, all others are
  in class 0, within which they are told apart by their pairs as well;
* the class is predicted by causal self-attention over the window,
  added to the log of the counted chances, so an untrained model is exactly the
  counted one.

Long texts are scored in overlapping windows; a window's first ids are context
only, so every id is scored once, after at least ``WINDOW - STRIDE`` others.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import Column, DataFrame, functions as F

from loomset.storage import materialise

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
END = 50256  # free in that vocabulary
IDS = END + 1
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

ACTIVE = 1024
CLASSES = 64
HEADS = 2
WIDTH = 24
WINDOW = 32
STRIDE = 24
FOLDS = 10
SEED = 42
# Training: windows that tile all training texts, so every id is learned in every pass. A trainer takes about
# ``TRAINER_WINDOWS`` of them; in a round it makes ``STEPS`` steps or up to ``MOST_PASSES`` passes, at least one whole
# pass, then all are averaged.
TRAINER_WINDOWS = 20_000
STEPS = 300
MOST_PASSES = 4
ROUNDS = 2
BATCH = 64
RATE = 0.02

# Words whose counts go to every task: the commonest, of bounded number and length. Others are joined.
COMMON_WORDS = 100_000
COMMON_BYTES = 40
# Counts of pairs with an id that is not active that go to every task, the commonest. Others are joined.
COMMON_PAIRS = 1_000_000
_MOST_WORDS = 300_000  # words a task numbers before it starts anew
_MOST_PAIRS = 600_000
_GROUP_BYTES = 1 << 21
CODEC = "zstd"  # of scratch tables: packed ids take a quarter less than by Spark's usual one
_ALPHA = 0.1
_PRIOR = 20.0  # pairs of an id count that much less than the ids alone


def fold(doc_id: Column, folds: int = FOLDS) -> Column:
    """crc32 of the id as text modulo ``folds``; a NULL id counts as the empty text (fold 0)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % folds


# --- words and ids -----------------------------------------------------------------


class _Numbers(dict):
    """Numbers of words; one not seen before gets the next."""

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        return number


class Words:
    """Words of texts by number, and their ids. Number 0 is the empty word, the end sign."""

    def __init__(self, vocabulary: bytes):
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, vocabulary.splitlines())}
        self.encoding = tiktoken.Encoding("words", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        (self.line_feed,) = self.encoding.encode_ordinary("\n")
        self.clear()

    def clear(self) -> None:
        self.number = _Numbers({b"": 0})
        self.words: list[bytes] = [b""]
        self.parts = [np.array([END], np.int64)]
        self.flat = self.parts[0]
        self.ends = np.array([1], np.int64)

    def full(self) -> bool:
        return len(self.words) > _MOST_WORDS

    @staticmethod
    def split(text: str | None) -> list[bytes]:
        """Words between ASCII blanks, A-Z lower-cased."""
        return (text or "").encode("utf-8", "replace").lower().split()

    def numbers(self, texts: list[list[bytes]]) -> np.ndarray:
        """The numbers of all words of all texts in a row; words not seen before get the next ones."""
        flat = list(chain.from_iterable(texts))
        out = np.fromiter(map(self.number.__getitem__, flat), np.int64, len(flat))
        if len(self.number) > len(self.words):
            new = [*islice(reversed(self.number), len(self.number) - len(self.words))][::-1]
            self.words += new
            # One call for all new words: a line feed is an id of its own and in no word.
            lines = "".join(f" {w.decode('utf-8', 'replace')}\n" for w in new)
            ids = np.array(self.encoding.encode_ordinary(lines), np.int64)
            breaks = ids == self.line_feed
            closes = np.flatnonzero(breaks) - np.arange(len(new))
            self.ends = np.append(self.ends, self.flat.size + closes)
            self.flat = np.append(self.flat, ids[~breaks])
        return out

    def ids(self, numbers: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per text of ``sizes`` words its ids between two end signs: all in a row, and how many each has."""
        ends = np.cumsum(sizes)
        with_signs = np.zeros(numbers.size + 2 * sizes.size, np.int64)
        with_signs[np.arange(numbers.size) + np.repeat(2 * np.arange(sizes.size) + 1, sizes)] = numbers
        stop = self.ends[with_signs]
        lengths = stop - np.append(0, self.ends[:-1])[with_signs]
        total = np.cumsum(lengths)
        places = np.arange(total[-1] if total.size else 0) + np.repeat(stop - total, lengths)
        counts = np.diff(np.append(0, total[ends + 2 * np.arange(1, sizes.size + 1) - 1]))
        return self.flat[places], counts


def _groups(texts: pa.Array) -> Iterator[tuple[int, list[list[bytes]]]]:
    """(first row, words of texts) of about ``_GROUP_BYTES`` each."""
    begin, group, size = 0, [], 0
    for row, text in enumerate(texts):
        value = text.as_py()
        group.append(Words.split(value))
        size += len(value or "")
        if size >= _GROUP_BYTES:
            yield begin, group
            begin, group, size = row + 1, [], 0
    if group:
        yield begin, group


# --- the model ---------------------------------------------------------------------


@dataclass
class Counted:
    """What the counts say: ``place`` of every id among the active ones (0: none of them), and log chances.

    ``of_class[i, c]``: of class c after active id i; ``within[i, j]``: of
    active id j in its class after i; ``others[id]``: of an id among those
    without a place.
    """

    place: np.ndarray
    of_class: np.ndarray
    within: np.ndarray
    others: np.ndarray

    @classmethod
    def from_pairs(cls, singles: np.ndarray, pairs: np.ndarray, active: np.ndarray) -> Counted:
        """``singles``: how often each id occurs; ``pairs``: counts over the places of ``active`` (place 0: all others)."""
        place = np.zeros(IDS, np.int32)
        place[active] = np.arange(1, active.size + 1)
        n = ACTIVE + 1
        common = pairs.sum(axis=0) + 0.5
        common /= common.sum()
        rows = pairs + _PRIOR * common[None, :]  # after a rare id the next is like any
        rows /= rows.sum(axis=1, keepdims=True)
        member = np.arange(n) % CLASSES
        by_class = np.zeros((n, CLASSES))
        np.add.at(by_class.T, member, rows.T)
        within = np.log(rows) - np.log(by_class[:, member])
        outside = place == 0
        rest = np.where(outside, singles + 0.5, 0.0)
        others = np.log(np.where(outside, rest / rest.sum(), 1.0))
        return cls(place, np.log(by_class).astype(np.float32), within.astype(np.float32), others.astype(np.float32))


@dataclass
class Loose:
    """What the counts say of pairs in which an id is not active, by id.

    ``of_class[a]``: log chances of the class after any id; ``inner[a]``: of
    the ids without a place in class 0. The chance of b after a in its class is
    ``n(a, b) + prior[b]`` over ``exp(bottom)``: that of ids without a place
    among these (``lump``), that of an active id after one without a place in
    its class (``rest``). ``keys`` and ``n`` are counts of pairs, ``complete``
    if these are all.
    """

    of_class: np.ndarray
    inner: np.ndarray
    lump: np.ndarray
    rest: np.ndarray
    prior: np.ndarray
    keys: np.ndarray
    n: np.ndarray
    complete: bool

    @classmethod
    def from_counts(
        cls, counted: Counted, pairs: np.ndarray, by_class: np.ndarray, lump: np.ndarray, keys: np.ndarray, n: np.ndarray, complete: bool
    ) -> Loose:
        """``pairs``: as for ``Counted``; ``by_class``: (IDS, CLASSES) counts of what follows the ids without a place; ``lump``: how often another of them."""
        place = counted.place
        common = pairs.sum(axis=0) + 0.5
        common /= common.sum()
        of_class = by_class + _PRIOR * np.bincount(np.arange(ACTIVE + 1) % CLASSES, common, CLASSES)
        total = of_class.sum(axis=1)
        of_class = np.log(of_class / total[:, None]).astype(np.float32)
        inner = np.log((lump + _PRIOR * common[0]) / total) - of_class[:, 0]
        active = np.flatnonzero(place)
        of_class[active] = counted.of_class[place[active]]
        inner[active] = counted.within[place[active], 0]
        lump = np.where(place > 0, pairs[place, 0], lump)
        prior = _PRIOR * np.where(place > 0, common[place], np.exp(counted.others.astype(np.float64)))
        order = np.argsort(keys)
        return cls(of_class, inner, np.log(lump + _PRIOR), np.log(total), prior, keys[order], n[order].astype(np.float32), complete)

    def within(self, ids: np.ndarray, counted: Counted) -> tuple[np.ndarray, np.ndarray]:
        """Log chances of all ids but the first within their class after the id before, and which pairs lack the log of their count and prior."""
        a, b = ids[:-1], ids[1:]
        pa, pb = counted.place[a], counted.place[b]
        out = counted.within[pa, pb].astype(np.float64)
        which = np.flatnonzero((pa == 0) | (pb == 0))
        a, b, target = a[which], b[which], pb[which]
        key = a * IDS + b
        n, known = np.zeros(key.size), np.full(key.size, self.complete)
        if self.keys.size:
            at = np.minimum(np.searchsorted(self.keys, key), self.keys.size - 1)
            hit = self.keys[at] == key
            n, known = np.where(hit, self.n[at], 0.0), known | hit
        value = np.where(target == 0, self.inner[a] - self.lump[a], -self.rest[a] - self.of_class[a, target % CLASSES])
        out[which] = value + np.where(known, np.log(n + self.prior[b]), 0.0)
        return out, which[~known]


_ROOT = np.sqrt(WIDTH // HEADS)
_LARGEST = np.float32(60)  # attention scores stop here on both sides, so that their exponentials stay finite and above zero
_SAFE = 20  # moves of class log chances up to this need no largest one subtracted before their exponentials


class Room(dict):
    """Arrays by name that are used again step after step, as fresh ones of this size cost more than what is done in them."""

    def of(self, name: str, *shape: int, kind: type = np.float32) -> np.ndarray:
        size = int(np.prod(shape))
        if name not in self or self[name].size < size:
            self[name] = np.empty(size, kind)
        return self[name][:size].reshape(shape)


_OWN = WIDTH // HEADS
_WIDE = WIDTH + HEADS  # values and heads have a column more each, in which the values hold ones
_ONES = np.arange(1, HEADS + 1) * (_OWN + 1) - 1  # these columns
_VALUES = np.setdiff1d(np.arange(_WIDE), _ONES)
_OF_HEAD = np.repeat(np.eye(HEADS, dtype=np.float32), _OWN + 1, axis=0)  # which columns are of a head


def _heads(x: np.ndarray) -> np.ndarray:
    """(windows, places, width) to (windows, heads, places, width of a head)"""
    return x.reshape(*x.shape[:2], HEADS, -1).transpose(0, 2, 1, 3)


def _flat(x: np.ndarray) -> np.ndarray:
    return x.reshape(-1, x.shape[-1])


def _parts(joint: np.ndarray) -> list[np.ndarray]:
    """Queries, keys and values by head."""
    return [_heads(x) for x in np.split(joint, [WIDTH, 2 * WIDTH], axis=2)]


class Attention:
    """Causal self-attention over places, ``HEADS`` heads; ``theta`` holds all parameters in one row."""

    shapes = {
        "embed": (ACTIVE + 1, WIDTH),
        "at": (WINDOW, WIDTH),
        "query": (WIDTH, WIDTH),
        "key": (WIDTH, WIDTH),
        "value": (WIDTH, WIDTH),
        "out": (WIDTH, CLASSES),
    }
    size = sum(int(np.prod(s)) for s in shapes.values())
    seen = np.tri(WINDOW, dtype=np.float32)

    def __init__(self, theta: np.ndarray | None = None):
        if theta is None:
            rng = np.random.default_rng(SEED)
            theta = np.concatenate(
                [np.zeros(int(np.prod(s))) if k == "out" else rng.normal(0, 0.3, int(np.prod(s))) for k, s in self.shapes.items()]
            )
        self.theta = np.asarray(theta, np.float32)
        for name, part in self.split(self.theta).items():
            setattr(self, name, part)
        # Queries, keys and values side by side; what the columns of ones get here is nothing.
        self.joint = np.zeros((WIDTH, 2 * WIDTH + _WIDE), np.float32)
        self.joint[:, :WIDTH] = self.query / np.float32(_ROOT)
        self.joint[:, WIDTH : 2 * WIDTH] = self.key
        self.joint[:, 2 * WIDTH + _VALUES] = self.value
        self.wide_out = np.zeros((_WIDE, CLASSES), np.float32)
        self.wide_out[_VALUES] = self.out

    @classmethod
    def split(cls, theta: np.ndarray) -> dict[str, np.ndarray]:
        out, at = {}, 0
        for name, shape in cls.shapes.items():
            n = int(np.prod(shape))
            out[name] = theta[at : at + n].reshape(shape)
            at += n
        return out

    @cached_property
    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        """What an id brings to a query, a key and a value, and what a place in the window adds."""
        return self.embed @ self.joint, self.at @ self.joint

    def _attend(self, joint: np.ndarray, first: int, room: Room) -> tuple[np.ndarray, ...]:
        """Of queries, keys and values side by side, for the places ``first`` and later: the exponentials of the
        scores, one over their sums for each column of a head, and the heads, a column of ones behind each."""
        n = len(joint)
        joint[:, :, 2 * WIDTH + _ONES] = 1
        q, k, v = _parts(joint)
        weight = np.matmul(q[:, :, first:], k.transpose(0, 1, 3, 2), out=room.of("weight", n, HEADS, WINDOW - first, WINDOW))
        np.clip(weight, -_LARGEST, _LARGEST, out=weight)
        np.exp(weight, out=weight)
        weight *= self.seen[first:]
        head = room.of("head", n, WINDOW - first, _WIDE)
        np.matmul(weight, v, out=_heads(head))
        scale = np.matmul(1 / head[:, :, _ONES], _OF_HEAD.T, out=room.of("scale", *head.shape))
        head *= scale
        return weight, scale, head

    def class_log_chances(
        self, windows: np.ndarray, counted: Counted, first: int, rows: np.ndarray | None = None, room: Room | None = None
    ) -> np.ndarray:
        """Log chances of the next class behind the places ``first`` and later of each window, up to one number per place.

        That number is the log of the sum of their exponentials. ``rows`` are
        the counted log chances behind these places, those of the active ids if
        not given. What is returned lies in ``room`` until the next call.
        """
        room = Room() if room is None else room
        by_id, by_place = self.tables
        joint = room.of("joint", *windows.shape, by_id.shape[1])
        np.take(by_id, windows, axis=0, out=joint, mode="clip")
        joint += by_place
        head = self._attend(joint, first, room)[-1]
        logits = room.of("logits", *head.shape[:2], CLASSES)
        np.matmul(_flat(head), self.wide_out, out=_flat(logits))
        logits += counted.of_class[windows[:, first:]] if rows is None else rows
        return logits

    def gradient(
        self, windows: np.ndarray, targets: np.ndarray, counted: Counted, counts: np.ndarray | None = None, room: Room | None = None
    ) -> tuple[float, np.ndarray]:
        """Mean loss of the next classes over whole windows, and its gradient; targets below 0 do not count."""
        room = Room() if room is None else room
        n = len(windows)
        x = np.take(self.embed, windows, axis=0, out=room.of("x", n, WINDOW, WIDTH), mode="clip")
        x += self.at
        joint = room.of("joint", n, WINDOW, self.joint.shape[1])
        np.matmul(_flat(x), self.joint, out=_flat(joint))
        weight, scale, head = self._attend(joint, 0, room)
        p = np.matmul(_flat(head), self.wide_out, out=room.of("logits", n * WINDOW, CLASSES))
        near = max(-p.min(), p.max()) <= _SAFE
        p += _flat(counted.of_class[windows] if counts is None else counts)
        if not near:
            p -= p.max(axis=1, keepdims=True)
        np.exp(p, out=p)
        sums = p @ np.ones(CLASSES, np.float32)
        goal = targets.ravel()
        real = np.flatnonzero(goal >= 0)
        share = np.float32(1 / max(real.size, 1))
        chosen = real * CLASSES + goal[real]
        loss = float(-np.log(np.maximum(p.ravel()[chosen] / sums[real], 1e-30)).sum() * share)
        part = np.zeros(goal.size, np.float32)
        part[real] = share / sums[real]
        p *= part[:, None]
        p.ravel()[chosen] -= share
        grad = {"out": (_flat(head).T @ p)[_VALUES]}
        d_head = room.of("d_head", n, WINDOW, _WIDE)
        np.matmul(p, self.wide_out.T, out=_flat(d_head))
        # The columns of ones take off what all scores of a place share.
        shared = np.multiply(d_head, head, out=head) @ _OF_HEAD
        d_head[:, :, _ONES] = -shared
        d_head *= scale
        d_head = _heads(d_head)
        d_joint = room.of("d_joint", *joint.shape)
        (q, k, v), (d_q, d_k, d_v) = _parts(joint), _parts(d_joint)
        d_score = np.matmul(d_head, v.transpose(0, 1, 3, 2), out=room.of("d_score", *weight.shape))
        d_score *= weight
        np.matmul(weight.transpose(0, 1, 3, 2), d_head, out=d_v)
        np.matmul(d_score, k, out=d_q)
        np.matmul(d_score.transpose(0, 1, 3, 2), q, out=d_k)
        d_all = _flat(x).T @ _flat(d_joint)
        grad["query"], grad["key"] = d_all[:, :WIDTH] / np.float32(_ROOT), d_all[:, WIDTH : 2 * WIDTH]
        grad["value"] = d_all[:, 2 * WIDTH + _VALUES]
        d_x = np.matmul(_flat(d_joint), self.joint.T, out=room.of("d_x", n * WINDOW, WIDTH))
        grad["at"] = d_x.reshape(n, -1).sum(axis=0)
        cells = np.add(windows.reshape(-1, 1) * WIDTH, np.arange(WIDTH), out=room.of("cells", n * WINDOW, WIDTH, kind=np.intp))
        weights = room.of("weights", n * WINDOW, WIDTH, kind=np.float64)
        weights[:] = d_x
        grad["embed"] = np.bincount(cells.ravel(), weights.ravel(), self.embed.size)
        return loss, np.concatenate([grad[name].ravel() for name in self.shapes], dtype=np.float32, casting="same_kind")


def improve(theta: np.ndarray, ids: np.ndarray, counted: Counted, of_class: np.ndarray, seed: int, rate: float) -> np.ndarray:
    """Adam over rows of ``WINDOW + 1`` ids (below 0: behind the end): whole passes, for ``STEPS`` steps or up to ``MOST_PASSES`` passes."""
    theta = np.array(theta, np.float32)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    rng = np.random.default_rng(seed)
    # What is behind the end does not count: any id will do there.
    inputs = np.maximum(ids[:, :-1], 0)
    windows = counted.place[inputs]
    targets = np.where(ids[:, 1:] < 0, -1, counted.place[ids[:, 1:]] % CLASSES)
    room = Room()
    step, passes = 0, min(-(-STEPS * BATCH // max(len(windows), BATCH)), MOST_PASSES)
    for _ in range(passes):
        order = rng.permutation(len(windows))
        for at in range(0, len(order), BATCH):
            step += 1
            rows = order[at : at + BATCH]
            counts = room.of("counts", len(rows), WINDOW, CLASSES)
            np.take(of_class, inputs[rows], axis=0, out=counts, mode="clip")
            _, g = Attention(theta).gradient(windows[rows], targets[rows], counted, counts, room)
            m *= 0.9
            m += 0.1 * g
            np.square(g, out=g)
            v *= 0.99
            v += 0.01 * g
            np.sqrt(v / (1 - 0.99**step), out=g)
            g += 1e-6
            theta -= np.divide(m, g, out=g) * (rate / (1 - 0.9**step))
    return theta


class Scorer:
    """Natural log chances of whole texts by one model."""

    def __init__(self, theta: np.ndarray, counted: Counted, loose: Loose | None = None):
        self.attention, self.counted, self.loose = Attention(theta), counted, loose

    def gains(self, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The log chance of every id of texts of ``sizes`` ids in a row; 0 for the first of each, the sign before it."""
        return self.parts(ids, sizes)[0]

    def parts(self, ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The gains, and the places of those that lack the log of the count and prior of their pair."""
        ends = np.cumsum(sizes)
        padded = np.append(ids, np.full(WINDOW + 1, END))
        places = np.append(self.counted.place[ids], np.zeros(WINDOW + 1, np.int32))
        # Windows begin every STRIDE ids; inputs are all ids but a text's last.
        inputs = sizes - 1
        counts = np.maximum(-(-(inputs - WINDOW) // STRIDE), 0) + 1
        number = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        owner = np.repeat(np.arange(sizes.size), counts)
        begin = (ends - sizes)[owner] + number * STRIDE
        gain = np.zeros(ids.size, np.float64)
        room = Room()
        for first, chosen in ((0, number == 0), (WINDOW - STRIDE, number > 0)):
            which = np.flatnonzero(chosen)
            for at in range(0, which.size, 128):
                part = which[at : at + 128]
                here = begin[part][:, None] + np.arange(WINDOW)
                behind = here[:, first:]
                counts = None
                if self.loose is not None:
                    counts = room.of("counts", *behind.shape, CLASSES)
                    np.take(self.loose.of_class, padded[behind], axis=0, out=counts, mode="clip")
                rows = _flat(self.attention.class_log_chances(places[here], self.counted, first, counts, room))
                real = np.flatnonzero(behind < ends[owner[part]][:, None] - 1)
                after = behind.ravel()[real] + 1
                picked = rows.ravel()[real * CLASSES + places[after] % CLASSES]
                np.exp(rows, out=rows)
                gain[after] = picked - np.log((rows @ np.ones(CLASSES, np.float32))[real])
        if self.loose is None:
            place, lacking = self.counted.place[ids], np.zeros(0, np.int64)
            gain[1:] += self.counted.within[place[:-1], place[1:]] + np.where(place[1:] == 0, self.counted.others[ids[1:]], 0.0)
        else:
            within, lacking = self.loose.within(ids, self.counted)
            gain[1:] += within
        gain[ends - sizes] = 0.0
        return gain, np.setdiff1d(lacking + 1, ends - sizes, assume_unique=True)


# --- counts over the corpus -----------------------------------------------------------

_COUNTS = "kind int, word binary, a int, b int, n bigint, doc bigint, ids binary"
_PACKED = np.dtype("<u2")  # of an id in a window
_MOST_WINDOWS = 50_000  # in one batch


def _tiles(ids: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, pa.Array]]:
    """Windows over texts of ``sizes`` ids in a row: (text, number in the text, packed ids).

    A window has ``WINDOW`` ids and the one behind them, with which the next
    begins: every id but a text's first is the target of exactly one window.
    """
    ends = np.cumsum(sizes)
    counts = -(-(sizes - 1) // WINDOW)
    number = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    owner = np.repeat(np.arange(sizes.size), counts)
    start = (ends - sizes)[owner] + number * WINDOW
    stop = np.minimum(start + WINDOW + 1, ends[owner])
    for at in range(0, owner.size, _MOST_WINDOWS):
        part = slice(at, at + _MOST_WINDOWS)
        size = stop[part] - start[part]
        offsets = np.append(0, np.cumsum(size))
        flat = ids[np.arange(offsets[-1]) + np.repeat(start[part] - offsets[:-1], size)].astype(_PACKED)
        buffers = [None, pa.py_buffer((offsets * _PACKED.itemsize).astype(np.int32)), pa.py_buffer(flat)]
        yield owner[part], number[part], pa.Array.from_buffers(pa.binary(), size.size, buffers)


def _unpacked(windows: pa.Array) -> np.ndarray:
    """The ids of windows, one row of ``WINDOW + 1`` each; -1 fills up behind a short one."""
    rows = windows.to_pylist()
    sizes = np.array([len(x) for x in rows], np.int64) // _PACKED.itemsize
    full = np.full((len(rows), WINDOW + 1), -1, np.int32)
    full[np.arange(WINDOW + 1) < sizes[:, None]] = np.frombuffer(b"".join(rows), _PACKED)
    return full


def _count(batches: Iterator[pa.RecordBatch], vocabulary: bytes) -> Iterator[pa.RecordBatch]:
    """Word counts (kind 0), counts of id pairs (kind 1) and the training windows (kind 2), number ``a`` of text ``doc``.

    Counts are summed in tables of bounded size, which are passed on whenever
    they are full, and summed up again behind the shuffle.
    """
    names = ["kind", "word", "a", "b", "n", "doc", "ids"]
    words_in = Words(vocabulary)
    counts = np.zeros(0, np.int64)
    keys, numbers = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def rows(kind: int, size: int, **given: pa.Array) -> pa.RecordBatch:
        types = [pa.int32(), pa.binary(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
        columns = [given.get(c, pa.nulls(size, t)) for c, t in zip(names, types, strict=True)]
        columns[0] = pa.array(np.full(size, kind, np.int32))
        return pa.RecordBatch.from_arrays(columns, names=names)

    def pass_words() -> pa.RecordBatch:
        used = np.flatnonzero(counts)
        return rows(0, used.size, word=pa.array([words_in.words[k] for k in used.tolist()], pa.binary()), n=pa.array(counts[used]))

    def pass_pairs() -> pa.RecordBatch:
        a, b = (keys // IDS).astype(np.int32), (keys % IDS).astype(np.int32)
        return rows(1, keys.size, a=pa.array(a), b=pa.array(b), n=pa.array(numbers))

    for batch in batches:
        docs = batch.column("doc").to_numpy()
        for begin, group in _groups(batch.column("text")):
            if words_in.full():
                yield pass_words()
                words_in.clear()
                counts = np.zeros(0, np.int64)
            sizes = np.array([len(t) for t in group], np.int64)
            found = words_in.numbers(group)
            new = np.bincount(found, minlength=len(words_in.words))
            new[0] += len(group)  # the end signs
            new[: counts.size] += counts
            counts = new
            ids, lengths = words_in.ids(found, sizes)
            ends = np.cumsum(lengths)
            inner = np.ones(ids.size - 1, bool)
            inner[ends[:-1] - 1] = False  # no pair goes from a text to the next
            near, n = np.unique((ids[:-1] * IDS + ids[1:])[inner], return_counts=True)
            merged, where = np.unique(np.append(keys, near), return_inverse=True)
            numbers = np.bincount(where, np.append(numbers, n), merged.size).astype(np.int64)
            keys = merged
            here = docs[begin : begin + len(group)]
            for owner, number, windows in _tiles(ids, lengths):
                yield rows(2, owner.size, doc=pa.array(here[owner]), a=pa.array(number.astype(np.int32)), ids=windows)
            if keys.size > _MOST_PAIRS:
                yield pass_pairs()
                keys, numbers = np.zeros(0, np.int64), np.zeros(0, np.int64)
    yield pass_words()
    yield pass_pairs()


@dataclass
class Model:
    """What scoring needs: the network and its counts, word counts as a table, and their totals."""

    theta: np.ndarray
    counted: Counted
    loose: Loose
    pairs: DataFrame  # (pair, n) of those with an id that is not active
    words: DataFrame  # (word, n), the empty word being the end sign
    total: int
    distinct: int


def _train(windows: DataFrame, counted: Counted, of_class: np.ndarray) -> np.ndarray:
    """Parameters after ``ROUNDS`` rounds; in each every trainer works on its own windows and all results are averaged.

    A trainer holds its windows only, some 3 MB; there are as many trainers as
    the windows need, and one that gets too many (of repeated rows) is several. The average is taken by Spark, one row per parameter, so
    the driver gets one set of parameters a round.
    """
    theta = Attention().theta
    for turn in range(ROUNDS):
        current, rate = theta, RATE * 0.4**turn

        def run(batches: Iterator[pa.RecordBatch], current=current, rate=rate, turn=turn) -> Iterator[pa.RecordBatch]:
            def learn(trainer: int, parts: list[np.ndarray]) -> pa.RecordBatch:
                rows = np.concatenate(parts)
                new = improve(current, rows, counted, of_class, SEED + 1000 * turn + trainer, rate)
                return pa.RecordBatch.from_arrays(
                    [pa.array(np.array([len(rows)], np.int64)), pa.array([new], pa.list_(pa.float32()))], names=["n", "theta"]
                )

            at, parts = None, []
            for batch in batches:
                trainer = batch.column("trainer").to_numpy()
                rows = _unpacked(batch.column("ids"))
                cuts = np.flatnonzero(np.append(True, trainer[1:] != trainer[:-1])) if trainer.size else []
                for lo, hi in zip(cuts, np.append(cuts[1:], trainer.size), strict=True):
                    if parts and (trainer[lo] != at or sum(map(len, parts)) >= 2 * TRAINER_WINDOWS):
                        yield learn(at, parts)
                        parts = []
                    at = int(trainer[lo])
                    parts.append(rows[lo:hi].copy())
            if parts:
                yield learn(at, parts)

        learned = windows.mapInArrow(run, "n bigint, theta array<float>")
        weighed = learned.select("n", F.posexplode("theta").alias("at", "value"))
        mean = weighed.groupBy("at").agg((F.sum(F.col("value") * F.col("n")) / F.sum("n")).alias("value")).toArrow()
        if mean.num_rows:
            new = np.empty(Attention.size, np.float32)
            new[mean.column("at").to_numpy()] = mean.column("value").to_numpy()
            theta = new
    return theta


def train(docs: DataFrame, vocabulary: str = VOCABULARY, folds: int = FOLDS) -> Model:
    """Learn from the rows of ``docs`` (doc_id, text) outside fold 0.

    All training texts are counted, whole. The driver receives the counts of
    ids (at most 50,257), those of pairs of active ids (at most 1,025 squared),
    those of classes after an id (at most 50,257 times 64), the parameters of
    the network, all of sizes fixed by the vocabulary, and the counts of the
    ``COMMON_PAIRS`` commonest other pairs. All pairs stay a table.
    """
    content = _read(vocabulary)
    rows = docs.where(fold(F.col("doc_id"), folds) != 0).select(F.xxhash64("doc_id", "text").alias("doc"), "text")
    counts = materialise(rows.mapInArrow(lambda b: _count(b, content), _COUNTS), "lm-counts", CODEC)
    words = counts.where("kind = 0").groupBy("word").agg(F.sum("n").alias("n"))
    words = materialise(words, "lm-words", CODEC)
    total, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()

    pairs = materialise(counts.where("kind = 1").groupBy("a", "b").agg(F.sum("n").alias("n")), "lm-pairs", CODEC)
    each = pairs.groupBy("b").agg(F.sum("n").alias("n")).toArrow()
    singles = np.zeros(IDS)
    singles[each.column("b").to_numpy()] = each.column("n").to_numpy()
    active = np.argsort(-singles, kind="stable")[:ACTIVE]
    place = np.zeros(IDS, np.int32)
    place[active] = np.arange(1, ACTIVE + 1)
    places = F.broadcast(docs.sparkSession.createDataFrame([(int(i), int(p)) for i, p in enumerate(place) if p], "id int, p int"))
    placed = (
        pairs.join(places.select(F.col("id").alias("a"), F.col("p").alias("pa")), "a", "left")
        .join(places.select(F.col("id").alias("b"), F.col("p").alias("pb")), "b", "left")
        .select("a", "b", "n", F.coalesce("pa", F.lit(0)).alias("pa"), F.coalesce("pb", F.lit(0)).alias("pb"))
    )
    near = placed.groupBy("pa", "pb").agg(F.sum("n").alias("n")).toArrow()
    table = np.zeros((ACTIVE + 1, ACTIVE + 1))
    table[near.column("pa").to_numpy(), near.column("pb").to_numpy()] = near.column("n").to_numpy()
    counted = Counted.from_pairs(singles, table, active)
    after = placed.where("pa = 0").groupBy("a", F.when(F.col("pb") == 0, -1).otherwise(F.col("pb") % CLASSES).alias("c")).agg(F.sum("n").alias("n")).toArrow()
    a, c, n = (after.column(x).to_numpy() for x in ("a", "c", "n"))
    by_class, lump = np.zeros((IDS, CLASSES)), np.zeros(IDS)
    lump[a[c < 0]] = n[c < 0]
    np.add.at(by_class, (a, np.maximum(c, 0)), n)
    level = F.floor(F.log2("n") * 4).cast("int")
    pairs = placed.where("pa = 0 or pb = 0").select((F.col("a").cast("bigint") * IDS + F.col("b")).alias("pair"), "n")
    levels = sorted(map(tuple, pairs.groupBy(level.alias("level")).count().collect()), reverse=True)
    sums = np.cumsum([size for _, size in levels])
    chosen = int(np.searchsorted(sums, COMMON_PAIRS, side="right"))  # levels that fit
    common = pairs.where(level >= levels[chosen - 1][0] if chosen else F.lit(False)).toArrow()
    keys, n = (common.column(x).to_numpy() for x in ("pair", "n"))
    loose = Loose.from_counts(counted, table, by_class, lump, keys, n, chosen == len(levels))

    every = counts.where("kind = 2").select("doc", "a", "ids")
    trainers = max(1, -(-every.count() // TRAINER_WINDOWS))
    # dealt by text and number, so that the windows of a long text go to many trainers
    dealt = every.select(F.pmod(F.xxhash64("doc", "a"), F.lit(trainers)).cast("int").alias("trainer"), "doc", "a", "ids")
    dealt = dealt.repartition(trainers, "trainer").sortWithinPartitions("trainer", "doc", "a")
    theta = _train(materialise(dealt.select("trainer", "ids"), "lm-windows", CODEC), counted, loose.of_class)
    return Model(theta, counted, loose, pairs, words, int(total), int(distinct))


def _read(path: str) -> bytes:
    with open(path, "rb") as file:
        return file.read()


def score(docs: DataFrame, model: Model, vocabulary: str = VOCABULARY) -> DataFrame:
    """Rows (doc_id, n_tokens, n_known, base_score, score) for every row of ``docs`` (doc_id, text).

    ``score`` is the model's log10 chance of the text, ``base_score`` that of
    its words by their smoothed counts. NULL and blank texts are the end sign
    alone. Counts of the commonest words go to the tasks (bounded in number and
    length), as do those of the commonest pairs; all other words and pairs of a
    text are joined to theirs as rows of their own, by a row number that is written with the scores, so repeated and NULL
    ids stay apart.
    """
    content = _read(vocabulary)
    bottom = float(np.log10(model.total + _ALPHA * (model.distinct + 1)))
    common = model.words.where(F.octet_length("word") <= COMMON_BYTES).orderBy(F.desc("n"), "word").limit(COMMON_WORDS).toArrow()
    table = {
        word: float(np.log10(n + _ALPHA) - bottom)
        for word, n in zip(common.column("word").to_pylist(), common.column("n").to_pylist(), strict=True)
    }
    unknown = float(np.log10(_ALPHA) - bottom)
    end = table.get(b"", unknown)
    theta, counted, loose = model.theta, model.counted, model.loose
    rare, lacking = "array<struct<word:binary,n:bigint>>", "array<struct<pair:bigint,prior:double,n:bigint>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words_in, scorer = Words(content), Scorer(theta, counted, loose)
        values = np.zeros(0)  # of words by number; NaN where the table has none
        pair = pa.struct([("word", pa.binary()), ("n", pa.int64())])
        lack = pa.struct([("pair", pa.int64()), ("prior", pa.float64()), ("n", pa.int64())])
        for batch in batches:
            for begin, group in _groups(batch.column("text")):
                if words_in.full():
                    words_in.clear()
                    values = np.zeros(0)
                sizes = np.array([len(t) for t in group], np.int64)
                ends = np.cumsum(sizes)
                numbers = words_in.numbers(group)
                fresh = words_in.words[values.size :]
                values = np.append(values, [table.get(w, np.nan) for w in fresh])
                ids, lengths = words_in.ids(numbers, sizes)
                gains, open_at = scorer.parts(ids, lengths)
                logs = np.add.reduceat(gains, np.cumsum(lengths) - lengths) / np.log(10)
                text = np.searchsorted(np.cumsum(lengths), open_at, side="right")
                open_pairs, times = np.unique((text * IDS + ids[open_at - 1]) * IDS + ids[open_at], return_counts=True)
                open_texts, open_pairs = np.divmod(open_pairs, IDS * IDS)
                open_values = [pa.array(open_pairs), pa.array(loose.prior[open_pairs % IDS]), pa.array(times.astype(np.int64))]
                open_starts = np.searchsorted(open_texts, np.arange(sizes.size + 1)).astype(np.int32)
                open_lists = pa.ListArray.from_arrays(pa.array(open_starts), pa.StructArray.from_arrays(open_values, fields=list(lack)))
                value = values[numbers]
                rare = np.isnan(value)
                sums = np.append(0.0, np.cumsum(np.where(rare, 0.0, value)))
                known = np.append(0, np.cumsum(~rare))
                owner = np.repeat(np.arange(sizes.size), sizes)[rare]
                left, times = np.unique(owner * len(words_in.words) + numbers[rare], return_counts=True)
                owner = left // len(words_in.words)
                others = pa.StructArray.from_arrays(
                    [pa.array([words_in.words[k] for k in (left % len(words_in.words)).tolist()], pa.binary()), pa.array(times.astype(np.int64))],
                    fields=list(pair),
                )
                offsets = np.searchsorted(owner, np.arange(sizes.size + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc").slice(begin, len(group)),
                        batch.column("doc_id").slice(begin, len(group)),
                        pa.array(sizes + 1),
                        pa.array(known[ends] - known[ends - sizes] + int(b"" in table)),
                        pa.array(sums[ends] - sums[ends - sizes] + end),
                        pa.array(logs),
                        pa.ListArray.from_arrays(pa.array(offsets), others),
                        open_lists,
                    ],
                    names=["doc", "doc_id", "n_tokens", "n_known", "base", "score", "rare", "lacking"],
                )

    numbered = docs.select(F.monotonically_increasing_id().alias("doc"), "doc_id", "text")
    kind = numbered.schema["doc_id"].dataType.simpleString()
    schema = f"doc bigint, doc_id {kind}, n_tokens bigint, n_known bigint, base double, score double, rare {rare}, lacking {lacking}"
    scored = materialise(numbered.mapInArrow(run, schema), "lm-scores", CODEC)
    others = scored.select("doc", F.explode("rare").alias("w")).select("doc", "w.word", F.col("w.n").alias("times"))
    joined = others.join(model.words, "word", "left").groupBy("doc").agg(
        F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)).alias("more"),
        F.sum(F.col("times") * (F.log10(F.coalesce("n", F.lit(0)) + F.lit(_ALPHA)) - F.lit(bottom))).alias("rest"),
    )
    zero = F.lit(0)
    if not loose.complete:
        left = scored.select("doc", F.explode("lacking").alias("p")).select("doc", "p.pair", "p.prior", F.col("p.n").alias("times"))
        left = left.join(model.pairs, "pair", "left").groupBy("doc")
        joined = joined.join(left.agg(F.sum(F.col("times") * F.log10(F.coalesce("n", zero) + F.col("prior"))).alias("gain")), "doc", "full")
    else:
        joined = joined.withColumn("gain", F.lit(0.0))
    return scored.join(joined, "doc", "left").select(
        "doc_id",
        "n_tokens",
        (F.col("n_known") + F.coalesce("more", zero)).alias("n_known"),
        (F.col("base") + F.coalesce("rest", F.lit(0.0))).alias("base_score"),
        (F.col("score") + F.coalesce("gain", F.lit(0.0))).alias("score"),
    )


def log_chances(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """Train on ``docs`` outside fold 0 and score all of them.

    One row (doc_id, held_out, n_tokens, n_known, train_tokens, base_score,
    score) each, repeated rows included. An empty table gives an empty one;
    without training texts all counts are 0 and the network is untrained.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    model = train(rows, vocabulary)
    return score(rows, model, vocabulary).select(
        "doc_id",
        (fold(F.col("doc_id")) == 0).alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(model.total).cast("bigint").alias("train_tokens"),
        "base_score",
        "score",
    )
