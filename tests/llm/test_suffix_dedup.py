"""Suffix order and removal of repeats against plain counting."""

import hashlib
import random

import numpy as np
import pytest

from loomset.llm import anchors, catalog, cover, suffix_dedup

SF = "/root/testdata/sf0.001"


def plain(texts, length):
    """Per text (n_bytes, n_removed, n_spans, sha256) by counting every string of ``length`` bytes."""
    data = [(t or "").encode() for t in texts]
    count = {}
    for d in data:
        for i in range(len(d) - length + 1):
            count[d[i : i + length]] = count.get(d[i : i + length], 0) + 1
    out = []
    for d in data:
        gone = np.zeros(len(d) + 1, bool)
        for i in range(len(d) - length + 1):
            if count[d[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = bytes(b for b, g in zip(d, gone, strict=False) if not g)
        spans = int((np.diff(np.append(0, gone.astype(int))) == 1).sum())
        out.append((len(d), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("period", [2, 7, 16, 32, 64])
def test_cover_has_every_difference(period):
    found = cover.difference_cover(period)
    assert {(a - b) % period for a in found for b in found} == set(range(period))
    assert len(found) ** 2 <= 4 * period


@pytest.mark.parametrize("seed", range(24))
def test_order_and_repeats(seed):
    rng = random.Random(seed)
    words = [bytes(rng.choices(b"ab", k=rng.randint(1, 60))) for _ in range(4)]
    data = b"".join(rng.choice(words) for _ in range(rng.randint(20, 120))) + b"a" * rng.randint(40, 300)
    length = rng.choice([33, 40, 64, 70])
    places = np.array(rng.sample(range(len(data) - length + 1), (len(data) - length) // rng.choice([1, 2])))
    bucket = np.array([rng.randint(0, seed % 3) for _ in places])
    order, _ = cover.Text(data, length).sort(places, bucket)
    keys = [(bucket[i], data[places[i] : places[i] + length]) for i in order]
    assert keys == sorted(keys)
    count = {}
    for k in keys:
        count[k] = count.get(k, 0) + 1
    want = [count[b, data[p : p + length]] > 1 for p, b in zip(places, bucket, strict=True)]
    assert cover.repeated_windows(data, places, bucket, length).tolist() == want


def test_runs_cover_every_window_once(monkeypatch):
    monkeypatch.setattr(anchors, "PIECE", 700)
    rng = random.Random(1)
    texts = [bytes(rng.choices(b"abcd \n", k=n)) for n in (0, 5, 49, 50, 51, 400, 3000, 777)] + [b"a" * 500]
    seen = [set() for _ in texts]
    pick = {}
    for number, start, count, anchor, _ in anchors.segments(texts, 50, 12):
        for t, s, c, a in zip(number, start, count, anchor, strict=True):
            for i in range(s, s + c):
                assert i not in seen[t]
                seen[t].add(i)
                assert pick.setdefault(texts[t][i : i + 50], a) == a
    assert [len(s) for s in seen] == [max(len(t) - 49, 0) for t in texts]


def documents():
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdeé😀", k=rng.randint(1, 9)))
    shared = " ".join(word() for _ in range(30))
    texts = [None, "", "short", "x" * 300, "x" * 49, "y" * 50, "ab" * 200]
    for i in range(60):
        own = [word() for _ in range(rng.randint(1, 80))]
        if i % 2:
            cut = rng.randint(0, 60)
            own.insert(rng.randint(0, len(own)), shared[cut : cut + rng.randint(20, 200)])
        texts.append(" ".join(own))
        if i % 5 == 0:
            at = rng.randrange(len(texts[-1]))
            texts.append(texts[-1][:at] + "#" + texts[-1][at + 1 :])
        if i % 11 == 0:
            texts += [texts[-1]] * 3
    return texts


@pytest.mark.parametrize("max_runs", [2000, 2])
def test_equal_to_counting(spark, monkeypatch, max_runs):
    monkeypatch.setattr(suffix_dedup, "MAX_RUNS", max_runs)
    texts = documents()
    rows = [(i if i % 7 else None, t, i) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, n_bytes int").repartition(5)
    docs = docs.withColumn("k1", docs["n_bytes"])
    got = suffix_dedup.remove_repeats(docs, length=50, gram=12).collect()
    want = plain(texts, 50)
    assert sorted((r["k1"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got) == sorted(
        (i, *w[1:]) for i, w in enumerate(want)
    )
    assert all(hashlib.sha256(r["kept"]).hexdigest() == r["kept_sha256"] for r in got)
    left = suffix_dedup.drop_repeats(docs, length=50, gram=12)
    assert left.columns == docs.columns
    assert left.count() == sum(1 for n, gone, *_ in want if not n or gone < n)


def test_documents_equal_counting(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    want = sorted(zip((r["doc_id"] for r in docs), plain([r["text"] for r in docs], 400), strict=True))
    got = catalog.QUERIES["op7_suffix_dedup"](spark, SF).collect()
    assert sorted((r[0], tuple(r[1:])) for r in got) == want
    assert sum(w[1] for _, w in want) > 0


def test_clashing_columns_are_kept(spark):
    shared = "a passage that comes twice in the table " * 3
    rows = [(1, shared + "one", "mine", 77, "x", "y"), (2, shared + "two", None, 78, "x", None), (3, None, "mine", None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, kept string, n_bytes int, kept_sha256 string, k1 string")
    left = suffix_dedup.drop_repeats(docs, length=50, gram=12)
    assert left.columns == docs.columns
    got = {r["doc_id"]: r for r in left.collect()}
    assert [got[1]["kept"], got[1]["n_bytes"], got[1]["k1"], got[1]["text"]] == ["mine", 77, "y", "one"]
    assert [got[2]["kept"], got[2]["n_bytes"], got[2]["text"], got[3]["text"]] == [None, 78, "two", ""]


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert suffix_dedup.remove_repeats(docs).count() == 0 == suffix_dedup.drop_repeats(docs).count()
