"""The language model: gradients, normalised chances, windows, and counts against plain ones."""

import math
import os
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from loomset import storage
from loomset.llm import attention_lm as lm, catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def counted():
    rng = np.random.default_rng(0)
    singles = rng.integers(0, 50, lm.IDS).astype(float)
    active = np.argsort(-singles, kind="stable")[: lm.ACTIVE]
    pairs = rng.integers(0, 5, (lm.ACTIVE + 1, lm.ACTIVE + 1)).astype(float)
    return lm.Counted.from_pairs(singles, pairs, active)


@pytest.fixture(scope="module")
def theta():
    start = lm.Attention().theta
    return start + np.random.default_rng(1).normal(0, 0.2, start.size).astype(np.float32)


def test_gradient(counted, theta):
    rng = np.random.default_rng(2)
    windows = rng.integers(0, lm.ACTIVE, (3, lm.WINDOW))
    targets = rng.integers(-1, lm.CLASSES, (3, lm.WINDOW))
    _, gradient = lm.Attention(theta).gradient(windows, targets, counted)
    parts = np.cumsum([int(np.prod(s)) for s in lm.Attention.shapes.values()])
    for end in parts:
        at = end - 1 - int(np.argmax(np.abs(gradient[:end][::-1][: 200])))
        moved = [theta.copy(), theta.copy()]
        moved[0][at] += 0.01
        moved[1][at] -= 0.01
        up, down = (lm.Attention(m).gradient(windows, targets, counted)[0] for m in moved)
        assert (up - down) / 0.02 == pytest.approx(gradient[at], rel=0.05, abs=1e-5)


def test_scores_of_any_size(counted, theta):
    """Attention scores far below zero leave chances and gradients finite."""
    rng = np.random.default_rng(8)
    windows = rng.integers(0, lm.ACTIVE, (5, lm.WINDOW))
    targets = rng.integers(0, lm.CLASSES, (5, lm.WINDOW))
    large = lm.Attention(theta * 12)
    assert np.isfinite(large.class_log_chances(windows, counted, 0)).all()
    loss, gradient = large.gradient(windows, targets, counted)
    assert np.isfinite(loss) and np.isfinite(gradient).all()


def test_steps_use_their_arrays_again(counted, theta):
    """A step in a room used before, also for more windows, gives the same and takes little memory of its own."""
    rng = np.random.default_rng(9)
    room, peaks = lm.Room(), []
    for size in (lm.BATCH, 7, lm.BATCH):
        windows = rng.integers(0, lm.ACTIVE, (size, lm.WINDOW))
        targets = rng.integers(-1, lm.CLASSES, (size, lm.WINDOW))
        alone = lm.Attention(theta).gradient(windows, targets, counted, counted.of_class[windows])
        counts = counted.of_class[windows]
        attention = lm.Attention(theta)
        tracemalloc.start()
        shared = attention.gradient(windows, targets, counted, counts, room)
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        assert shared[0] == alone[0] and np.array_equal(shared[1], alone[1])
    assert peaks[2] < min(peaks[0] / 2, 2e6)


def test_chances_sum_to_one(counted, theta):
    """Of every id behind a context."""
    windows = np.random.default_rng(3).integers(0, lm.ACTIVE, (1, lm.WINDOW))
    chances = np.exp(lm.Attention(theta).class_log_chances(windows, counted, 0)[0, -1].astype(float))
    chances /= chances.sum()
    member = np.arange(lm.ACTIVE + 1) % lm.CLASSES
    active = chances[member] * np.exp(counted.within[windows[0, -1]].astype(float))
    others = np.exp(counted.others[counted.place == 0].astype(float))
    assert active.sum() == pytest.approx(1, abs=1e-4) and others.sum() == pytest.approx(1, abs=1e-4)


def test_windows_score_each_id_once(counted, theta):
    rng = np.random.default_rng(4)
    texts = [np.concatenate([[lm.END], rng.integers(0, 2000, n), [lm.END]]) for n in (0, 1, 29, 30, 31, 32, 54, 55, 200)]
    scorer = lm.Scorer(theta, counted)
    gains = scorer.gains(np.concatenate(texts), np.array([t.size for t in texts]))
    attention, at = lm.Attention(theta), 0
    for text in texts:
        places = counted.place[text]
        assert gains[at] == 0
        for i in range(1, text.size):
            number = max(-(-(i - lm.WINDOW) // lm.STRIDE), 0)  # the first window whose own places reach i - 1
            begin = number * lm.STRIDE
            window = np.zeros((1, lm.WINDOW), int)
            context = places[begin:i]
            window[0, : context.size] = context
            logits = attention.class_log_chances(window, counted, 0)[0, context.size - 1]
            chance = logits[places[i] % lm.CLASSES] - np.log(np.exp(logits).sum())
            want = chance + counted.within[places[i - 1], places[i]]
            if places[i] == 0:
                want += counted.others[text[i]]
            assert gains[at + i] == pytest.approx(want, abs=1e-3)
        at += text.size


def plain_base(rows):
    train = Counter()
    for doc, text in rows:
        if zlib.crc32(("" if doc is None else str(doc)).encode()) % 10:
            train.update([*(text or "").encode().lower().split(), b""])
    total, distinct = sum(train.values()), len(train)
    out = []
    for doc, text in rows:
        words = [*(text or "").encode().lower().split(), b""]
        base = sum(math.log10((train[w] + 0.1) / (total + 0.1 * (distinct + 1))) for w in words)
        held = zlib.crc32(("" if doc is None else str(doc)).encode()) % 10 == 0
        out.append((str(doc), held, len(words), sum(train[w] > 0 for w in words), total, base))
    return out


def compare(got, rows):
    key = lambda r: (r[0], r[2], round(r[5], 5))
    got = sorted(([str(r["doc_id"]), *(r[c] for c in ("held_out", "n_tokens", "n_known", "train_tokens", "base_score"))] for r in got), key=key)
    want = sorted((list(r) for r in plain_base(rows)), key=key)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert [g[5] for g in got] == pytest.approx([w[5] for w in want])


@pytest.mark.parametrize("common", [100_000, 50])
def test_base_equals_plain_counts(spark, monkeypatch, common):
    monkeypatch.setattr(lm, "COMMON_WORDS", common)
    monkeypatch.setattr(lm, "_MOST_WORDS", 1000)
    monkeypatch.setattr(lm, "_GROUP_BYTES", 5000)
    monkeypatch.setattr(lm, "STEPS", 1)
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows += [(None, "null id"), (None, "null id"), (7, None), (8, ""), (8, ""), (9, " \n"), (10, "x" * 30000 + " " + "the " * 5000), (11, "É Ä 😀 A")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    docs = docs.withColumn("score", docs["text"]).withColumn("doc", docs["doc_id"])
    got = lm.log_chances(docs).collect()
    compare(got, rows)
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in got)


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert lm.log_chances(docs).count() == 0
    only_held = spark.createDataFrame([(None, "a b")], "doc_id bigint, text string")
    row = lm.log_chances(only_held).first()
    assert row["train_tokens"] == 0 and row["base_score"] == pytest.approx(0)


def test_better_than_word_counts_on_held_out_texts(spark):
    rows = [r for r in catalog.QUERIES["op10_attention_lm"](spark, "/root/testdata/sf0.1").collect() if r["held_out"]]
    assert len(rows) == 996
    assert sum(r["score"] for r in rows) > sum(r["base_score"] for r in rows)


def test_ids_of_words():
    words = lm.Words(lm._read(lm.VOCABULARY))
    texts = [lm.Words.split(t) for t in ("The the thonhand", "", None, "é😀 x\x00y don't 123 thonhand", "the")]
    for _ in range(2):
        numbers = words.numbers(texts)
        ids, sizes = words.ids(numbers, np.array([len(t) for t in texts]))
        at = 0
        for text, size in zip(texts, sizes, strict=True):
            want = [lm.END, *(i for w in text for i in words.encoding.encode_ordinary(" " + w.decode())), lm.END]
            assert ids[at : at + size].tolist() == want
            at += size
        words.clear()


def test_training_windows_tile_all_ids():
    """Every id but the first of a text is learned once a pass, behind the ids before it."""
    vocabulary = lm._read(lm.VOCABULARY)
    texts = ["", "the", "a " * 31, "b " * 32, "c " * 33, " ".join(f"w{i}" for i in range(9000)), None]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], names=["doc", "text"])
    found = defaultdict(list)
    for out in lm._count(iter([batch]), vocabulary):
        if out.num_rows and out.column("kind")[0].as_py() == 2:
            for doc, a, row in zip(out.column("doc").to_pylist(), out.column("a").to_pylist(), lm._unpacked(out.column("ids")), strict=True):
                found[doc].append((a, row[row >= 0].tolist()))
    words = lm.Words(vocabulary)
    for doc, text in enumerate(texts):
        split = [lm.Words.split(text)]
        ids, _ = words.ids(words.numbers(split), np.array([len(split[0])]))
        windows = [row for _, row in sorted(found[doc])]
        assert [i for row in windows for i in row[1:]] == ids[1:].tolist()
        assert windows[0][0] == lm.END and all(a[-1] == b[0] for a, b in zip(windows, windows[1:]))


def test_context_behind_the_first_window():
    assert lm.WINDOW - lm.STRIDE >= 8


def test_pairs_of_rare_ids(theta):
    """After any id the chances of all ids add up to one, and those of rare ids depend on the id before."""
    rng = np.random.default_rng(5)
    pairs = Counter({(40_000, 45_000): 5000, (41_000, 45_001): 5000})
    for a, b in rng.integers(0, 1500, (60_000, 2)).tolist():
        pairs[a, b] += 1
    singles, table = np.zeros(lm.IDS), np.zeros((lm.ACTIVE + 1, lm.ACTIVE + 1))
    active = np.arange(lm.ACTIVE)
    place = np.append(active + 1, np.zeros(lm.IDS - lm.ACTIVE, int))
    by_class, lump, loose = np.zeros((lm.IDS, lm.CLASSES)), np.zeros(lm.IDS), []
    for (a, b), n in pairs.items():
        singles[b] += n
        table[place[a], place[b]] += n
        if place[a] == 0:
            by_class[a, place[b] % lm.CLASSES] += n
            lump[a] += n * (place[b] == 0)
        if place[a] == 0 or place[b] == 0:
            loose.append((a * lm.IDS + b, n))
    counted = lm.Counted.from_pairs(singles, table, active)
    keys, n = np.array(loose).T
    scorer = lm.Scorer(theta, counted, lm.Loose.from_counts(counted, table, by_class, lump, keys, n, True))
    chances = {}
    for a in (3, 1200, 40_000, 41_000):
        ids = np.stack([np.full(lm.IDS, a), np.arange(lm.IDS)], axis=1).ravel()
        chances[a] = np.exp(scorer.gains(ids, np.full(lm.IDS, 2))[1::2])
        assert chances[a].sum() == pytest.approx(1, abs=1e-3)
    assert chances[40_000][45_000] > 100 * chances[41_000][45_000] and chances[41_000][45_001] > 100 * chances[40_000][45_001]


def test_joined_pairs_score_like_those_sent_to_the_tasks(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").limit(60)
    docs = spark.createDataFrame([*map(tuple, docs.collect()), (None, None), (None, "zyx 😀 qqqq")], "doc_id bigint, text string")
    model = lm.train(docs)
    assert model.loose.complete and model.loose.keys.size > 100
    want = sorted((str(r["doc_id"]), r["n_tokens"], r["score"]) for r in lm.score(docs, model).collect())
    for kept in (0, model.loose.keys.size // 2):
        model.loose.keys, model.loose.n, model.loose.complete = model.loose.keys[:kept], model.loose.n[:kept], False
        got = sorted((str(r["doc_id"]), r["n_tokens"], r["score"]) for r in lm.score(docs, model).collect())
        assert [g[:2] for g in got] == [w[:2] for w in want] and [g[2] for g in got] == pytest.approx([w[2] for w in want], rel=1e-4)


def test_scratch_tables_are_small(spark, tmp_path, monkeypatch):
    """All scratch tables of a job take less than 2.8 times their input; packed ids by Spark's usual codec alone take more."""
    monkeypatch.setattr(storage, "shared_dir", lambda spark: str(tmp_path))
    monkeypatch.setattr(lm, "STEPS", 1)
    file = "/root/testdata/sf0.01/documents.parquet"
    lm.log_chances(spark.read.parquet(file)).write.parquet(str(tmp_path / "out"))
    tables = sum(f.stat().st_size for f in (tmp_path / "loomset").rglob("*.parquet"))
    assert tables < 2.8 * os.path.getsize(file)
