"""Runs of periodic words: against a search over all periods."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from loomset.llm import catalog, periods

SF = "/root/testdata/sf0.001"


def all_runs(words, least=12):
    """Every run as (start, length, period), by a look at every period."""
    found = {}
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, 2 * q):
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def random_text(rng):
    out, size = [], rng.randint(0, 90)
    while len(out) < size:
        root = rng.choices("abc", k=rng.randint(1, 25))
        out += (root * rng.randint(1, 6))[: rng.randint(1, 60)]
        if rng.random() < 0.3:
            out += rng.choices("abcdefgh", k=rng.randint(0, 5))
    return out


def test_random_texts(monkeypatch):
    rng = random.Random(7)
    for k in range(600):
        monkeypatch.setattr(periods, "BLOCK_PAIRS", rng.choice([1, 5, 1 << 20]))
        texts = [random_text(rng) for _ in range(rng.randint(1, 4))]
        texts += texts[:1] * (k % 3)  # copies side by side are no run
        least = rng.choice([12, 12, 17])
        want, base = [], 0
        for text in texts:
            want += [(s + base, n, q) for s, n, q in all_runs(text, least)]
            base += len(text)
        got = periods.find_runs(periods.number_words(texts), least)
        assert list(zip(*[c.tolist() for c in got], strict=True)) == want


def test_very_periodic_texts():
    texts = [["a"] * 60_000, ["x", "y", "z"] * 9_000 + ["q"] + ["x", "y"] * 9_000, (["a"] * 3000 + ["b"]) * 5]
    pairs = []
    inner = periods._pairs

    def counted(names, size, low, high):
        for i, lag in inner(names, size, low, high):
            pairs.append(i.size)
            yield i, lag

    periods._pairs = counted
    try:
        got = [list(zip(*[c.tolist() for c in periods.find_runs(periods.number_words([t]))], strict=True)) for t in texts]
    finally:
        periods._pairs = inner
    assert got[0] == [(0, 60_000, 1)]
    assert got[1] == [(0, 27_000, 3), (27_001, 18_000, 2)]
    assert got[2] == [*[(3001 * k, 3000, 1) for k in range(1)], (0, 15_005, 3001), *[(3001 * k, 3000, 1) for k in range(1, 5)]]
    assert sum(pairs) < 40 * sum(map(len, texts))  # all equal pairs would be some 2e9


def test_least_has_a_floor():
    with pytest.raises(ValueError):
        periods.find_runs(np.array([1, 1]), 4)


LINE = "one two three four five six "
TEXTS = [None, "", " \n\t", "a", "a " * 12, "a " * 11, LINE * 2, LINE + LINE[:-5], "x\x0by\x0cz " * 4, "b a a a a a a a a a a a a c", "a " * 100_000]


def test_tables(spark):
    rows = [(i, t, "mine", 3) for i, t in enumerate(TEXTS)] + [(None, LINE * 3, None, None)] * 2
    docs = spark.createDataFrame(rows, "doc_id int, text string, collapsed string, run_start int").repartition(3)
    got = periods.collapse_runs(docs).collect()
    assert len(got) == len(rows) and "run_start" in got[0].asDict()
    for r in got:
        words = re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")
        runs = list(zip(r["run_start"], r["run_length"], r["run_period"], strict=True))
        want = [(0, 100_000, 1)] if len(words) == 100_000 else all_runs(words)
        assert runs == want
        gone = {k for s, n, q in runs for k in range(s + q, s + n)}
        assert r["collapsed"] == " ".join(w for k, w in enumerate(words) if k not in gone)
    assert periods.collapse_runs(docs.limit(0)).count() == 0


def expected(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n and doc_id is not None:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = all_runs(words)
    gone = {k for s, m, q in runs for k in range(s + q, s + m)}
    top = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return {
        "doc_id": doc_id,
        "n_runs": len(runs),
        "start": top[0],
        "length": top[1],
        "period": top[2],
        "exponent_milli": 1000 * top[1] // top[2] if runs else None,
        "runs_sha256": sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)),
        "collapsed_sha256": sha(" ".join(w for k, w in enumerate(words) if k not in gone)),
    }


def test_documents(spark, tmp_path):
    rows = [r for r in spark.read.parquet(f"{SF}/documents.parquet").collect() if len(r["text"] or "") < 6000]
    extra = [(k, " ".join(f"w{i % 7}" for i in range(40)), None, None, None) for k in range(-30, 0)] + [(None, None, None, None, None), (None, "a b " * 9, None, None, None)]
    docs = spark.createDataFrame([tuple(r) for r in rows] + extra, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = [r.asDict() for r in catalog.QUERIES["op13_periods"](spark, str(tmp_path)).collect()]
    want = [expected(r["doc_id"], r["text"]) for r in docs.collect()]
    key = lambda r: repr(sorted(r.items()))
    assert sorted(got, key=key) == sorted(want, key=key)
    assert sum(w["n_runs"] > 0 for w in want) > 10
