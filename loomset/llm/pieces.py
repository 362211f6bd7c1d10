"""SentencePiece encoding by shared-prefix Viterbi, and decoding.

A text is marked as the model marks it: one blank before it, every blank the
sign U+2581. No piece has a blank behind another sign, so a text is cut, without
changing its best path, into marked words: blanks and what follows them. The
distinct words of a batch are sorted, which is the order of a depth-first walk
through their trie; forward scores of a prefix are computed once for all words
that begin with it.

Among all ways to write a word as pieces the one of the highest sum of the
model's scores is taken (of equal sums the one that ends in the longer piece).
For a model trained by merging, whose scores are ranks, this need not be the
segmentation its merges would give. A character without a piece is written as
the byte pieces of its UTF-8 form, and so is a literal U+2581, which makes
decoding exact.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, functions as F

from loomset.llm.byte_table import ByteTable

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
CACHE_WORDS = 200_000
BATCH_CHARS = 1 << 21
_WORDS = re.compile(" +[^ ]*")
_END = ""  # key of a trie node's own piece


class Pieces:
    """The pieces of a model: a trie of those that may be used, their texts, and their scores."""

    def __init__(self, model: bytes):
        processor = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.root: dict = {}
        self.texts: list[str | None] = []
        self.byte_ids = [-1] * 256
        lowest = 0.0
        for i in range(processor.get_piece_size()):
            piece = processor.id_to_piece(i)
            plain = not (processor.is_control(i) or processor.is_unknown(i) or processor.is_byte(i) or processor.is_unused(i))
            self.texts.append(piece.replace(MARK, " ") if plain else None)
            if processor.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
            elif plain:
                if " " in self.texts[i].lstrip(" "):
                    raise ValueError(f"piece {piece!r} has a blank behind another sign")
                node = self.root
                for c in self.texts[i]:
                    node = node.setdefault(c, {})
                node[_END] = (i, processor.get_score(i))
                if len(piece) == 1:
                    lowest = min(lowest, processor.get_score(i))
        if -1 in self.byte_ids:
            raise ValueError("the model has no byte pieces")
        self.unknown = lowest - 10.0  # score of a character written as bytes
        byte_of = {i: bytes([b]) for b, i in enumerate(self.byte_ids)}
        self.bytes = ByteTable([byte_of.get(i) or (t or "").encode("utf-8") for i, t in enumerate(self.texts)])

    def encode_words(self, words: Iterable[str]) -> Iterator[tuple[str, tuple[int, ...]]]:
        """(word, ids) for every word; fastest if the words come sorted.

        ``score[i]``, ``start[i]`` and ``piece[i]`` describe the best path to
        the i-th character, ``open_[i]`` the pieces begun before it that may go
        on. All four are kept for the prefix shared with the next word.
        """
        score, start, piece = [0.0], [0], [-1]
        open_: list[list[tuple[int, dict]]] = [[(0, self.root)]]
        last = ""
        for word in words:
            shared = 0
            for a, b in zip(last, word, strict=False):
                if a != b:
                    break
                shared += 1
            for row in (score, start, piece, open_):
                del row[shared + 1 :]
            for i in range(shared, len(word)):
                c = word[i]
                best, begin, found = -1e300, i, -1
                going = []
                for begun, node in open_[i]:
                    child = node.get(c)
                    if child is not None:
                        going.append((begun, child))
                        own = child.get(_END)
                        if own is not None and score[begun] + own[1] > best:
                            best, begin, found = score[begun] + own[1], begun, own[0]
                alone = self.root.get(c)
                if (alone is None or _END not in alone) and score[i] + self.unknown > best:
                    best, begin, found = score[i] + self.unknown, i, -1
                going.append((i + 1, self.root))
                score.append(best)
                start.append(begin)
                piece.append(found)
                open_.append(going)
            last = word
            ids: list[int] = []
            at = len(word)
            while at:
                if piece[at] >= 0:
                    ids.append(piece[at])
                else:
                    ids += [self.byte_ids[b] for b in reversed(word[at - 1].encode("utf-8", "surrogatepass"))]
                at = start[at]
            yield word, tuple(reversed(ids))

    def decode(self, lists: pa.ListArray) -> Iterator[str]:
        """The text of every list of ids; bytes that are no UTF-8 become U+FFFD, control pieces nothing."""
        for data in self.bytes.gather_lists(lists):
            yield data.decode("utf-8", "replace").removeprefix(" ")


class Encoder:
    """Encodes groups of texts; ids of about ``CACHE_WORDS`` words, those used last, stay for the next group."""

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self.known: dict[str, tuple[int, ...]] = {}
        self.before: dict[str, tuple[int, ...]] = {}  # those of earlier groups; what is used again moves to known

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        split = [_WORDS.findall(" " + t) if t else [] for t in texts]
        if len(self.known) > CACHE_WORDS // 2:
            self.known, self.before = {}, self.known
        new = []
        for word in set().union(*split).difference(self.known):
            ids = self.before.get(word)
            if ids is None:
                new.append(word)
            else:
                self.known[word] = ids
        self.known.update(self.pieces.encode_words(sorted(new)))
        return [np.fromiter(chain.from_iterable(map(self.known.__getitem__, words)), np.int32) for words in split]


def _model_bytes(model: str) -> bytes:
    with open(model, "rb") as file:
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


def encode(docs: DataFrame, text: str = "text", model: str = MODEL, exact: str | None = None) -> DataFrame:
    """Add ``ids`` (array of piece ids) and ``n_pieces`` to every row.

    NULL and empty texts have no pieces; repeated rows get the same ids each,
    and an empty table gives an empty one. With ``exact`` a column of that name
    replaces the text: whether the ids, decoded in the same pass, give it back
    (NULL: the empty text). The model's path is read on the driver; its content,
    some hundred kilobytes, goes to the tasks. A task holds one group of texts
    of about 2 million characters and a bounded cache of words; a longer text is
    a group of its own. Other columns are kept, but for those with one of the
    new names.
    """
    content = _model_bytes(model)
    kept = [c for c in docs.columns if c == text or c not in ("ids", "n_pieces", exact)]
    rows = docs.select(*kept)
    left = [c for c in kept if exact is None or c != text]
    new = {"ids": F.array().cast("array<int>"), "n_pieces": F.lit(0).cast("bigint")} | ({exact: F.lit(True)} if exact else {})
    schema = rows.select(*left, *[value.alias(name) for name, value in new.items()]).schema
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(Pieces(content))
        for batch in batches:
            others = batch.select(left)
            for begin, group in _groups(batch.column(text)):
                ids = encoder.encode(group)
                sizes = np.array([x.size for x in ids], np.int64)
                offsets = np.append(0, np.cumsum(sizes)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids)))
                columns = [*others.slice(begin, len(group)).columns, lists, pa.array(sizes)]
                if exact:
                    columns.append(pa.array([d == t for d, t in zip(encoder.pieces.decode(lists), group, strict=True)], pa.bool_()))
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return rows.mapInArrow(run, schema)


def decode(rows: DataFrame, ids: str = "ids", name: str = "decoded", model: str = MODEL) -> DataFrame:
    """Add the text of a column of ids (NULL ids: empty text); other columns are kept (``name`` replaced)."""
    content = _model_bytes(model)
    kept = [c for c in rows.columns if c != name]
    table = rows.select(*kept)
    schema = table.select(*kept, F.lit("").alias(name)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(content)
        for batch in batches:
            texts = list(pieces.decode(batch.column(ids)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*kept, name])

    return table.mapInArrow(run, schema)
