"""Held-out accuracy of the toxicity classifier, and edge cases."""

import zlib

import numpy as np
import pytest

from loomset.llm import catalog, toxicity

SF = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    rows = catalog.QUERIES["op6_toxicity"](spark, SF).collect()
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    toxic = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    held = [r for r in rows if r["held_out"]]
    assert {r["doc_id"] for r in held} == {r["doc_id"] for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0}
    tested = [(r["predicted"], toxic[r["doc_id"]], r["score"]) for r in held if r["doc_id"] in toxic]
    found = sum(p and t for p, t, _ in tested)
    assert found / sum(t for _, t, _ in tested) > 0.65  # half of the toxic stems occur in a few training texts only
    assert found / sum(p for p, _, _ in tested) > 0.95
    assert all((s >= 0.5) == (p == 1) and 0 <= s <= 1 for p, _, s in tested)


def test_features_are_a_set_of_all_places(monkeypatch):
    text = "Äbcdefghij" * 50 + "xyz"
    whole = toxicity.Features().of(text)
    monkeypatch.setattr(toxicity, "_PIECE", 17)
    assert np.array_equal(toxicity.Features().of(text.upper()), whole)
    features = toxicity.Features()
    assert [features.of(t).size for t in (None, "", "abc", "abcd", "abcde")] == [0, 0, 3, 5, 7]


def test_edges(spark):
    bad, good = "you utter blorgface and snarkling ", "a calm and friendly sentence here "
    rows = [(i, (bad if i % 2 else good) * (i % 3 + 1) + str(i), 0.5, "x") for i in range(400)]
    rows += [(None, bad, 0.1, "x"), (401, None, None, None), (402, "", 0.0, ""), (7, bad, 0.0, ""), (403, bad * 3000, 0.0, "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, score double, predicted string")
    marks = [(i, i % 2) for i in range(400)] + [(None, 1), (3, None), (5, 1), (5, 1), (999, 1)]
    labels = spark.createDataFrame(marks, "doc_id bigint, toxic int").repartition(3)
    got = toxicity.score(docs, toxicity.train(docs, labels)).collect()
    assert len(got) == len(rows)
    for r in got:
        if r["text"]:
            assert r["predicted"] == int("blorgface" in r["text"])
        else:  # no n-grams: the share of toxic labels alone
            assert r["score"] == pytest.approx(0.5, abs=0.1)
    again = toxicity.score(docs.repartition(7), toxicity.train(docs.repartition(2), labels)).collect()
    assert sorted((str(r["doc_id"]), r["score"]) for r in got) == sorted((str(r["doc_id"]), r["score"]) for r in again)


def test_no_labels(spark):
    docs = spark.createDataFrame([(1, "a text")], "doc_id bigint, text string")
    labels = spark.createDataFrame([], "doc_id bigint, toxic int")
    assert toxicity.score(docs, toxicity.train(docs, labels)).first()["predicted"] == 0
    assert toxicity.score(docs.limit(0), toxicity.train(docs.limit(0), labels)).count() == 0
    one = spark.createDataFrame([(1, 1)], "doc_id bigint, toxic int")
    assert toxicity.score(docs, toxicity.train(docs, one)).first()["predicted"] == 1


def test_an_id_that_comes_thousands_of_times(spark, monkeypatch):
    """It gives one row to the regression, and all of its rows to the counts."""
    rows = [(i, f"{'you blorgface' if i % 2 else 'a calm day'} {i}") for i in range(200)]
    rows += [(2, f"a calm day once more {k % 7}") for k in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id bigint, toxic int")
    seen = {}
    monkeypatch.setattr(toxicity, "fit", lambda ratios, found, marks, shares: seen.update(rows=found, marks=marks, shares=shares))
    toxicity.train(docs, labels)
    learned = [i for i in range(200) if zlib.crc32(str(i).encode()) % 5]
    assert 2 in learned and len(seen["rows"]) == len(learned) and seen["marks"].sum() == sum(i % 2 for i in learned)
    assert seen["shares"][0] == pytest.approx(1 - sum(i % 2 for i in learned) / (len(learned) + 6000))


def plain_grams(text):
    """Distinct n-grams of a lower-cased text between blanks."""
    text = "".join(" " if c in "\t\n\v\f\r" else c for c in f" {text.lower()} ")
    return {text[i : i + n] for n in toxicity.ORDERS for i in range(len(text) - n + 1)}


def test_counts_ratios_and_scores_equal_a_plain_computation(spark, monkeypatch):
    rng = np.random.default_rng(5)
    words = "calm day blorgface snark friend tea walk utter river stone".split()
    rows = [(i, " ".join(rng.choice(words, 6)) + (" blorgface" if i % 3 == 0 else "")) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(120)], "doc_id bigint, toxic int")
    seen = {}
    real = toxicity.fit
    monkeypatch.setattr(toxicity, "fit", lambda ratios, *rest: (seen.update(ratios=ratios), real(ratios, *rest))[1])
    model = toxicity.train(docs, labels)

    def bucket(gram):
        h = len(gram)
        for c in gram:
            h = (h ^ ord(c)) * 0x9E3779B97F4A7C15 % 2**64
            h ^= h >> 32
        return h * 0xBF58476D1CE4E5B9 % 2**64 >> 64 - toxicity.BITS

    counts = {0: {}, 1: {}}
    for i, text in rows:
        if zlib.crc32(str(i).encode()) % 5:
            for b in {bucket(g) for g in plain_grams(text)}:
                counts[int(i % 3 == 0)][b] = counts[int(i % 3 == 0)].get(b, 0) + 1
    size = 2**toxicity.BITS
    totals = {k: sum(v.values()) + size for k, v in counts.items()}
    want = {}
    for b in {*counts[0], *counts[1]}:
        p, q = counts[1].get(b, 0), counts[0].get(b, 0)
        ratio = np.log((p + 1) / totals[1]) - np.log((q + 1) / totals[0])
        if p + q >= toxicity.LEAST_TEXTS and abs(ratio) >= toxicity.LEAST_RATIO:
            want[b] = ratio
    assert set(np.flatnonzero(seen["ratios"]).tolist()) == set(want)
    assert all(seen["ratios"][b] == pytest.approx(r) for b, r in want.items())
    for r in toxicity.score(docs, model).collect():
        found = {bucket(g) for g in plain_grams(r["text"])}
        total = model.bias + sum(float(model.weights[b]) for b in found) / max(len(found), 1) ** 0.5
        assert r["score"] == pytest.approx(1 / (1 + np.exp(-total)), abs=1e-6)
