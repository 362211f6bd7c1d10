"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

A text is the set of its hashed n-grams. The log ratio of how often an n-gram
occurs in toxic and in other texts is counted over all labelled training rows;
a logistic regression on a bounded sample of these rows then weighs the scaled
features, and every text is scored by one pass over its bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from loomset.llm.packed import squeezed, unsqueezed
from loomset.storage import materialise

BITS = 18
ORDERS = (3, 6)
# The regression is fitted on at most this many labelled ids of each class, those of smallest hash, one row of each.
SAMPLE_TOXIC = 1500
SAMPLE_OTHER = 3000
FOLDS = 5
# Features rarer than this, or as common among other texts up to this log ratio, get no weight.
LEAST_TEXTS = 3
LEAST_RATIO = 1.5
_PIECE = 1 << 20  # characters of a long text looked at together


def fold(doc_id: Column, folds: int = FOLDS) -> Column:
    """crc32 of the id as text modulo ``folds``; a NULL id counts as the empty text (fold 0)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % folds


def _hashes(chars: np.ndarray, order: int) -> np.ndarray:
    """The bucket of the n-gram that begins at every place."""
    n = max(chars.size - order + 1, 0)
    h = np.full(n, order, np.uint64)
    for k in range(order):
        h = (h ^ chars[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
    return (h * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - BITS)


class Features:
    """Buckets of the n-grams of a text, each once and in order.

    Texts are lower-cased, stand between blanks, and every blank counts as a
    space, so that n-grams tell the beginning and the end of a word. Memory is
    bounded by 2**BITS and ``_PIECE``, besides the text.
    """

    def __init__(self) -> None:
        self.seen = np.zeros(1 << BITS, bool)

    def of(self, text: str | None) -> np.ndarray:
        raw = f" {(text or '').lower()} ".encode("utf-32-le", "replace") if text else b""
        chars = np.frombuffer(raw, np.uint32)
        for at in range(0, chars.size, _PIECE):
            part = chars[at : at + _PIECE + max(ORDERS) - 1].astype(np.uint64)
            part[(part >= 9) & (part <= 13)] = 32
            for order in ORDERS:
                self.seen[_hashes(part[: _PIECE + order - 1], order)] = True
        found = np.flatnonzero(self.seen)
        self.seen[found] = False
        return found.astype(np.int32)


@dataclass
class Model:
    """score = 1 / (1 + exp(-(bias + sum of weights over the features / sqrt of their number)))"""

    weights: np.ndarray
    bias: float

    def score(self, features: np.ndarray) -> float:
        total = float(self.weights[features].sum(dtype=np.float64)) / max(np.sqrt(features.size), 1.0)
        return float(1.0 / (1.0 + np.exp(-np.clip(self.bias + total, -700, 700))))


def log_ratios(toxic: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Smoothed log of how much commoner a feature is among toxic texts; 0 for features that tell nothing."""
    p, q = toxic + 1.0, other + 1.0
    ratio = np.log(p / p.sum()) - np.log(q / q.sum())
    return np.where((toxic + other >= LEAST_TEXTS) & (np.abs(ratio) >= LEAST_RATIO), ratio, 0.0)


def fit(ratios: np.ndarray, rows: list[np.ndarray], labels: np.ndarray, shares: dict[int, float], rounds: int = 1000, penalty: float = 1e-6) -> Model:
    """Logistic regression on ``ratios``-scaled features by Nesterov's accelerated gradient.

    ``shares`` gives, per class, its share of all labelled rows; the rows of
    the sample are weighed so that the classes count as often as there.
    With one class only, or none, every text scores that class's share.
    """
    if not rows or len(set(labels.tolist())) < 2:
        share = min(max(shares.get(1, 0.0), 1e-6), 1 - 1e-6)
        return Model(np.zeros(ratios.size, np.float32), float(np.log(share / (1 - share))))
    sizes = np.array([r.size for r in rows])
    index = np.concatenate(rows)
    owner = np.repeat(np.arange(len(rows)), sizes).astype(np.int32)
    telling = ratios[index] != 0
    index, owner = index[telling], owner[telling]
    scale = 1.0 / np.maximum(np.sqrt(sizes), 1.0)
    y = labels.astype(np.float64)
    weigh = np.where(y == 1, shares[1] / (y == 1).sum(), shares[0] / (y == 0).sum())
    w, bias = np.zeros(ratios.size), float(np.log(shares[1] / shares[0]))
    ahead, bias_ahead = w.copy(), bias
    rate = 4.0 / max(float(np.max(np.bincount(owner, (ratios[index] ** 2), len(rows)) * scale**2)), 1e-9)
    for step in range(rounds):
        z = np.bincount(owner, (ahead * ratios)[index], len(rows)) * scale + bias_ahead
        error = (1.0 / (1.0 + np.exp(-z)) - y) * weigh
        gradient = np.bincount(index, (error * scale)[owner], ratios.size) * ratios + penalty * ahead
        new, new_bias = ahead - rate * gradient, bias_ahead - min(rate, 4.0) * error.sum()
        pull = step / (step + 3.0)
        ahead, bias_ahead = new + pull * (new - w), new_bias + pull * (new_bias - bias)
        w, bias = new, new_bias
    return Model((w * ratios).astype(np.float32), float(bias))


def train(docs: DataFrame, labels: DataFrame, folds: int = FOLDS) -> Model:
    """Learn from the labelled rows outside fold 0.

    ``labels`` has (doc_id, toxic); rows with a NULL in either are no labels,
    and an id labelled twice counts as toxic if any of its labels says so.
    Counts cover all training rows, however many. They are summed in arrays of
    2**BITS numbers per task before the shuffle; the same number of rows comes
    to the driver, besides the features of the bounded sample: of an id that
    comes repeatedly, the row whose features have the smallest digest. Rows of
    ``docs`` with a NULL id are not labelled; tables without rows, or with rows
    of one class only, give a model that scores the share of that class.
    """
    known = (
        labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL")
        .where(fold(F.col("doc_id"), folds) != 0)
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
    )
    known = materialise(known, "labels")
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    picked = known.where("toxic = 1").orderBy(*order).limit(SAMPLE_TOXIC).union(
        known.where("toxic <> 1").orderBy(*order).limit(SAMPLE_OTHER)
    )
    marked = known.join(F.broadcast(picked.select("doc_id", F.lit(True).alias("picked"))), "doc_id", "left")
    texts = squeezed(docs.select("doc_id", "text").where(F.col("doc_id").isNotNull() & (fold(F.col("doc_id"), folds) != 0)))
    rows = texts.join(marked, "doc_id").select(
        "z", (F.col("toxic") == 1).alias("toxic"), F.when(F.col("picked"), F.col("doc_id").cast("string")).alias("picked")
    )

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["bucket", "toxic", "other", "picked", "digest", "features"]
        features = Features()
        least: dict[str, bytes] = {}  # of the picked ids, whose number is bounded
        counts = np.zeros((2, 1 << BITS), np.int64)
        texts = [0, 0]
        for batch in batches:
            for z, toxic, kept in zip(*[batch.column(c) for c in ("z", "toxic", "picked")], strict=True):
                found, label = features.of(unsqueezed(z.as_py()).decode()), int(toxic.as_py())
                counts[label, found] += 1
                texts[label] += 1
                if (doc := kept.as_py()) is not None:
                    raw = found.tobytes()
                    digest = hashlib.blake2b(raw, digest_size=16).digest()
                    if doc not in least or digest < least[doc]:
                        least[doc] = digest
                        values = (None, label, 1 - label, doc, digest, raw)
                        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types, strict=True)], names=names)
        used = np.flatnonzero(counts.any(axis=0))
        used = np.append(used, -1)  # the last row counts texts
        columns = [used, np.append(counts[1, used[:-1]], texts[1]), np.append(counts[0, used[:-1]], texts[0])]
        yield pa.RecordBatch.from_arrays([*[pa.array(c) for c in columns], *[pa.nulls(used.size, t) for t in types[3:]]], names=names)

    types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.binary()]
    schema = "bucket bigint, toxic bigint, other bigint, picked string, digest binary, features binary"
    found = materialise(rows.mapInArrow(read, schema), "ngrams")
    sums = found.where("bucket IS NOT NULL").groupBy("bucket").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other")).toArrow()
    bucket, toxic, other = (sums.column(c).to_numpy() for c in ("bucket", "toxic", "other"))
    totals = np.zeros((2, 1 << BITS))
    real = bucket >= 0
    totals[0, bucket[real]], totals[1, bucket[real]] = toxic[real], other[real]
    texts = np.array([max(toxic[~real].sum(), 0), max(other[~real].sum(), 0)], np.float64)
    shares = {1: texts[0] / max(texts.sum(), 1), 0: texts[1] / max(texts.sum(), 1)}
    one = found.where("bucket IS NULL").groupBy("picked").agg(F.min(F.struct("digest", "toxic", "features")).alias("one"))
    sample = sorted((r["toxic"], bytes(r["features"])) for r in one.select("one.*").collect())
    return fit(
        log_ratios(*totals), [np.frombuffer(b, np.int32) for _, b in sample], np.array([t for t, _ in sample]), shares
    )


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Add ``score`` (0 to 1) and ``predicted`` (1 from 0.5) to every row; NULL and empty texts score as texts without n-grams."""
    kept = [c for c in docs.columns if c not in ("score", "predicted")]
    rows = docs.select(*kept)
    schema = rows.select(*kept, F.lit(0.0).alias("score"), F.lit(0).alias("predicted")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for batch in batches:
            scores = np.array([model.score(features.of(t.as_py())) for t in batch.column(text)], np.float64)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))],
                names=[*kept, "score", "predicted"],
            )

    return rows.mapInArrow(run, schema)
