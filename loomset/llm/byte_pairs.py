"""Byte-level BPE by a lazily determinised transducer, and streaming decoding.

The merges are compiled into a nondeterministic transducer. A path of it is a
place in the trie of all tokens, the token before that place, and the tokens it
has not yet written. A path that ends a token goes back to the root if the two
tokens *meet*: merging the bytes of both in order of rank leaves them as they
are. A prefix of a match has exactly one such path, which is its encoding.

Subsets of paths that can be alive together become states of a deterministic
transducer, made when they are first reached. A step writes the tokens that all
living paths agree on, so a token is written as soon as no byte that may follow
can change it: the lookahead is bounded by the longest token. Its states and
moves are forgotten together once there are ``MAX_STATES``; a word of any
length takes time in proportion to its length.

A match of the pattern is encoded once per group of texts: the new ones of a
group are sorted, and a match goes on from the state its neighbour had behind
the bytes they share. About ``MEMO`` of those used last stay for the next group.

Decoding gathers the bytes of ids from one table, and a machine over the last
bytes of every block holds back a character whose bytes are not all there yet.
"""

from __future__ import annotations

import base64
import gc
import hashlib
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

import public_tokenizers
from loomset.llm.byte_table import ByteTable

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
MAX_STATES = 1 << 17
MEMO = 200_000
BATCH_CHARS = 1 << 21
BLOCK_IDS = 1 << 16

_ROOT = 0
_FEW = 8
_NEVER = float("inf")


def read_ranks(content: bytes) -> dict[bytes, int]:
    """Token bytes and ids of a rank file: a line each, the bytes in base 64."""
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in content.splitlines() if line)}


class Merges:
    """What the ranks say about tokens: of which two each is made, and which may stand side by side."""

    def __init__(self, ranks: dict[bytes, int]):
        if any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError("a byte has no rank")
        self.ranks = ranks
        self.text = {rank: token for token, rank in ranks.items()}
        self.born = {rank: -1 if len(token) == 1 else rank for token, rank in ranks.items()}
        self.parts: dict[int, tuple[int, int]] = {}
        self.unmade: set[int] = set()  # tokens no merge makes; they stand for whole matches only
        for rank in sorted(self.text):
            token = self.text[rank]
            if len(token) > 1:
                parts = next(self._ways(token, rank), None)
                if parts:
                    self.parts[rank] = parts
                else:
                    self.unmade.add(rank)

    def _ways(self, token: bytes, rank: int) -> Iterator[tuple[int, int]]:
        for cut in range(1, len(token)):
            a, b = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
            if a is None or b is None or {a, b} & self.unmade or max(self.born[a], self.born[b]) >= rank:
                continue
            if self.meet(a, b, rank):
                yield a, b

    def meet(self, a: int, b: int, limit: float = _NEVER) -> bool:
        """Whether ``a`` and ``b`` side by side stay as they are under all merges of a rank below ``limit``.

        Merges are undone from the last to the first on both sides of the
        border. While two parts lie at the border, a merge of the two would
        have come before the one that uses up either (of equal ranks the one
        further left comes first).
        """
        end_a = end_b = limit
        while True:
            across = self.ranks.get(self.text[a] + self.text[b])
            if across is not None and across < end_a and across <= end_b:
                return False
            if self.born[a] > self.born[b]:
                end_a, a = a, self.parts[a][1]
            elif self.born[b] >= 0:
                end_b, b = b, self.parts[b][0]
            else:
                return True

    def first_merge(self, rank: int) -> float:
        """The rank of the merge that uses up the first byte of a token."""
        used = _NEVER
        while rank in self.parts:
            used, rank = rank, self.parts[rank][0]
        return used

    def claimed(self, a: int, byte: int, soonest: float) -> bool:
        """Whether ``a``, or an end of it, is merged with a byte behind it before any merge from rank ``soonest`` on."""
        end = _NEVER
        while True:
            across = self.ranks.get(self.text[a] + bytes((byte,)))
            if across is not None and across < end and across <= soonest:
                return True
            if a not in self.parts:
                return False
            end, a = a, self.parts[a][1]


class Transducer:
    """Encodes matches of the pattern; states are made as they are reached."""

    def __init__(self, ranks: dict[bytes, int], max_states: int = MAX_STATES):
        self.merges = Merges(ranks)
        self.ranks = ranks
        self.max_states = max_states
        self.child: dict[int, int] = {}
        self.token = [-1]
        self.below: list[list[int]] = [[]]  # up to _FEW + 1 tokens that go on behind each node
        self.soonest = [_NEVER]  # the rank of the first merge that uses up the first byte, in any token behind the node
        for token, rank in ranks.items():
            if rank in self.merges.unmade:
                continue
            node, used = _ROOT, self.merges.first_merge(rank)
            for byte in token:
                self.soonest[node] = min(self.soonest[node], used)
                if len(self.below[node]) <= _FEW:
                    self.below[node].append(rank)
                key = node << 8 | byte
                node = self.child.setdefault(key, len(self.token))
                if node == len(self.token):
                    self.token.append(-1)
                    self.below.append([])
                    self.soonest.append(_NEVER)
            self.token[node] = rank
        self.age = 0
        # A path is the number of (last token, place in the trie); steps: path << 8 | byte -> (path or -1, token or -1).
        self.paths: dict[int, int] = {}
        self.ends_at: list[tuple[int, int]] = []
        self.steps: dict[int, tuple[int, int]] = {}
        # States are tuples of (path, tokens not yet written); moves: state << 8 | byte -> (state, tokens written).
        self.states: list[tuple] = []
        self.numbers: dict[tuple, int] = {}
        self.rest: list[tuple[int, ...]] = []
        self.moves: dict[int, tuple[int, tuple[int, ...]]] = {}
        self._forget()

    def _forget(self) -> None:
        self.age += 1
        for table in (self.paths, self.ends_at, self.steps, self.states, self.numbers, self.rest, self.moves):
            table.clear()
        self._number(((self._path(-1, _ROOT), ()),))

    def _number(self, state: tuple) -> int:
        number = self.numbers.setdefault(state, len(self.states))
        if number == len(self.states):
            self.states.append(state)
            self.rest.append(state[-1][1])
        return number

    def _path(self, last: int, node: int) -> int:
        number = self.paths.setdefault((last + 1) << 32 | node, len(self.ends_at))
        if number == len(self.ends_at):
            self.ends_at.append((last, node))
        return number

    def _alive(self, last: int, node: int, first: int) -> bool:
        """Whether a token behind the node may meet the one before; ``first`` is its first byte, if just read."""
        below = self.below[node]
        if last < 0 or not below:
            return bool(below)
        if len(below) <= _FEW:
            return any(self.merges.meet(last, token) for token in below)
        return first < 0 or not self.merges.claimed(last, first, self.soonest[node])

    def _step(self, path: int, byte: int) -> tuple[int, int]:
        """The path that goes on behind a byte, and the token that ends there if it meets the one before."""
        last, node = self.ends_at[path]
        child = self.child.get(node << 8 | byte)
        if child is None:
            step = -1, -1
        else:
            token = self.token[child]
            if token >= 0 and last >= 0 and not self.merges.meet(last, token):
                token = -1
            step = self._path(last, child) if self._alive(last, child, byte if node == _ROOT else -1) else -1, token
        self.steps[path << 8 | byte] = step
        return step

    def _move(self, number: int, byte: int) -> tuple[int, tuple[int, ...]]:
        """The state behind a byte and the tokens written; the last path of a state is the one at the root."""
        if len(self.states) >= self.max_states or len(self.steps) >= 4 * self.max_states:
            state = [(*self.ends_at[path], pending) for path, pending in self.states[number]]
            self._forget()
            number = self._number(tuple((self._path(last, node), pending) for last, node, pending in state))
        going, written, known = [], None, self.steps
        for path, pending in self.states[number]:
            on, token = known.get(path << 8 | byte) or self._step(path, byte)
            if on >= 0:
                going.append((on, pending))
            if token >= 0:
                written = (*pending, token)
        if written is None:
            raise ValueError("the ranks are not those of a trained vocabulary")
        ended = self._path(written[-1], _ROOT)
        agreed = len(written) if not going or going[0][1] else 0
        for _, pending in going if agreed else ():
            agreed = min(agreed, len(pending))
            if pending[:agreed] != written[:agreed]:
                agreed = next(i for i in range(agreed) if pending[i] != written[i])
        if agreed:
            going = [(path, pending[agreed:]) for path, pending in going]
        going.append((ended, written[agreed:]))
        move = self.moves[number << 8 | byte] = self._number(tuple(going)), written[:agreed]
        return move

    def encode(self, matches: Iterable[bytes]) -> Iterator[list[int]]:
        """The ids of every match; fastest if they come sorted. A match that is itself a token is written as that."""
        states, counts, out, last, age = [0], [0], [], b"", self.age
        known = self.moves.get
        for match in matches:
            whole = self.ranks.get(match)
            if whole is not None:
                yield [whole]
                continue
            shared = 0
            if age == self.age:
                for a, b in zip(last, match, strict=False):
                    if a != b:
                        break
                    shared += 1
            else:
                states, counts, age = [0], [0], self.age
            del states[shared + 1 :], counts[shared + 1 :]
            del out[counts[-1] :]
            state = states[-1]
            for byte in match[shared:]:
                state, written = known(state << 8 | byte) or self._move(state, byte)
                if written:
                    out += written
                states.append(state)
                counts.append(len(out))
            last = match
            yield [*out, *self.rest[state]]


class Encoder:
    """Encodes groups of texts; ids of up to ``memo`` matches stay for the next group."""

    def __init__(self, transducer: Transducer, pattern: str = public_tokenizers.PATTERN, memo: int = MEMO):
        self.transducer = transducer
        space = r"\p{White_Space}"  # what \s stands for in the pattern
        self.matches = regex.compile(pattern.replace(r"\s", space).replace(r"\S", f"[^{space}]"))
        self.memo = memo
        self.known: dict[str, list[int]] = {}
        self.before: dict[str, list[int]] = {}  # those of earlier groups; what is used again moves to known

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        split = [self.matches.findall(t) for t in texts]
        every = set().union(*split)
        if len(self.known) > self.memo // 2:
            self.known, self.before = {}, self.known
        new = []
        for match in every.difference(self.known):
            ids = self.before.get(match)
            if ids is None:
                new.append(match)
            else:
                self.known[match] = ids
        new.sort()
        self.known.update(zip(new, self.transducer.encode(m.encode("utf-8", "replace") for m in new), strict=True))
        return [np.fromiter(chain.from_iterable(map(self.known.__getitem__, matches)), np.int32) for matches in split]


# The machine that reads UTF-8: ranges of the first byte, those the second byte may have, and how many follow the first.
_LEADS = (
    (0xC2, 0xDF, 0x80, 0xBF, 1),
    (0xE0, 0xE0, 0xA0, 0xBF, 2),
    (0xE1, 0xEC, 0x80, 0xBF, 2),
    (0xED, 0xED, 0x80, 0x9F, 2),
    (0xEE, 0xEF, 0x80, 0xBF, 2),
    (0xF0, 0xF0, 0x90, 0xBF, 3),
    (0xF1, 0xF3, 0x80, 0xBF, 3),
    (0xF4, 0xF4, 0x80, 0x8F, 3),
)
_DONE = (0, 0x80, 0xBF)  # a state: bytes still to come, and the range of the next
_AFTER_LEAD = {b: (n, low, high) for first, last, low, high, n in _LEADS for b in range(first, last + 1)}


class Utf8Stream:
    """Text from bytes that come in blocks; a block may end inside a character."""

    def __init__(self) -> None:
        self.held = b""

    @staticmethod
    def _unfinished(tail: bytes) -> int:
        """How many of the last bytes begin a character that can still become whole."""
        (left, low, high), begun = _DONE, 0
        for at, byte in enumerate(tail):
            if left and low <= byte <= high:
                left, low, high = left - 1, 0x80, 0xBF
            else:
                (left, low, high), begun = _AFTER_LEAD.get(byte, _DONE), at
        return len(tail) - begun if left else 0

    def feed(self, block: bytes) -> str:
        """The characters that are whole now; bytes that are no UTF-8 become U+FFFD."""
        data = self.held + block
        end = len(data) - self._unfinished(data[-3:])
        self.held = data[end:]
        return data[:end].decode("utf-8", "replace")

    def close(self) -> str:
        data, self.held = self.held, b""
        return data.decode("utf-8", "replace")


class Decoder:
    """Text of ids, whose bytes are gathered from one table."""

    def __init__(self, ranks: dict[bytes, int]):
        tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            tokens[rank] = token
        self.table = ByteTable(tokens)

    def text(self, ids: np.ndarray) -> str:
        """The text of an array of ids, a block of them at a time; unknown ids stand for nothing."""
        ids = ids[self.table.known(ids)]
        stream = Utf8Stream()
        parts = [stream.feed(self.table.gather(ids[i : i + BLOCK_IDS])) for i in range(0, ids.size, BLOCK_IDS)]
        return "".join([*parts, stream.close()])


def _content(path: str) -> bytes:
    with open(path, "rb") as file:
        return file.read()


def _groups(texts: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) of about ``BATCH_CHARS`` characters each."""
    begin, group, size = 0, [], 0
    for row, text in enumerate(texts):
        value = text.as_py() or ""
        group.append(value)
        size += len(value)
        if size >= BATCH_CHARS:
            yield begin, group
            begin, group, size = row + 1, [], 0
    if group:
        yield begin, group


_encoders: dict[int, Encoder] = {}


def _encoder(content: bytes) -> Encoder:
    """The encoder of a rank file; a worker keeps the one it used last."""
    key = hash(content)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(Transducer(read_ranks(content)))
    return _encoders[key]


def encode(
    docs: DataFrame, text: str = "text", ranks: str = RANKS, decoded: str | None = None, digest: str | None = None
) -> DataFrame:
    """Add ``ids`` (array of token ids) and ``n_tokens`` to every row, without special tokens.

    NULL and empty texts have no tokens; equal texts have equal ids, and rows
    stay one to one. An empty table gives an empty one. With ``decoded`` a
    column of that name replaces the text: what the ids, decoded in the same
    pass, stand for. With ``digest`` a column of that name replaces the ids,
    as in ``decode``. The rank file is read on the driver; its content, under a
    megabyte, goes to the tasks. A task holds a group of texts of about 2
    million characters (a longer text is a group of its own) and tables of
    bounded size. Other columns are kept, but for those with one of the new
    names.
    """
    content = _content(ranks)
    kept = [c for c in docs.columns if c == text or c not in ("ids", "n_tokens", digest, decoded)]
    rows = docs.select(*kept)
    left = [c for c in kept if decoded is None or c != text]
    new = {digest: F.lit("")} if digest else {"ids": F.array().cast("array<int>")}
    new |= {"n_tokens": F.lit(0).cast("bigint")} | ({decoded: F.lit("")} if decoded else {})
    schema = rows.select(*left, *[value.alias(name) for name, value in new.items()]).schema
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.collect()  # tables of an earlier task
        encoder = _encoder(content)
        decoder = Decoder(encoder.transducer.ranks) if decoded else None
        try:
            for batch in batches:
                others = batch.select(left)
                for begin, group in _groups(batch.column(text)):
                    gc.disable()  # the tables have millions of parts, none in a cycle
                    ids = encoder.encode(group)
                    gc.freeze()  # nor are they to be looked through after the group
                    gc.enable()
                    sizes = np.array([x.size for x in ids], np.int64)
                    if digest:
                        written = pa.array([id_digest(x) for x in ids], pa.string())
                    else:
                        offsets = np.append(0, np.cumsum(sizes)).astype(np.int32)
                        written = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids)))
                    columns = [*others.slice(begin, len(group)).columns, written, pa.array(sizes)]
                    if decoder:
                        columns.append(pa.array([decoder.text(x) for x in ids], pa.string()))
                    yield pa.RecordBatch.from_arrays(columns, names=names)
        finally:
            gc.unfreeze()  # else a worker keeps the tables of every task it has run

    return rows.mapInArrow(run, schema)


def id_digest(ids: np.ndarray) -> str:
    """The lowercase hex SHA-256 of ids as little-endian 32-bit integers."""
    return hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest()


def _each(lists: pa.ListArray) -> Iterator[np.ndarray]:
    """The arrays of a column of lists (NULL: empty)."""
    values, offsets = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
    for row, here in enumerate(lists.is_valid().to_pylist()):
        yield values[offsets[row] : offsets[row + 1]] if here else values[:0]


def decode(rows: DataFrame, ids: str = "ids", name: str = "decoded", digest: str | None = None, ranks: str = RANKS) -> DataFrame:
    """Add the text of a column of ids; NULL or no ids give the empty text, ids without a token nothing.

    Bytes that are no UTF-8 become U+FFFD. With ``digest`` a column of that
    name replaces the ids: the lowercase hex SHA-256 of them as little-endian
    32-bit integers (NULL: of none). Other columns are kept (``name`` is
    replaced); rows stay one to one.
    """
    content = _content(ranks)
    kept = [c for c in rows.columns if c not in (name, digest)]
    table = rows.select(*kept)
    left = [c for c in kept if digest is None or c != ids]
    new = [name] if digest is None else [name, digest]
    schema = table.select(*left, *[F.lit("").alias(c) for c in new]).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(read_ranks(content))
        for batch in batches:
            texts, digests = [], []
            for x in _each(batch.column(ids)):
                texts.append(decoder.text(x))
                if digest is not None:
                    digests.append(id_digest(x))
            columns = [pa.array(c, pa.string()) for c in (texts, digests)[: len(new)]]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in left], *columns], names=[*left, *new])

    return table.mapInArrow(run, schema)
