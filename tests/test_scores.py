import collections
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomset.functions.lcs import lcs_length
from loomset.operators import bertscore as matching, joins
from loomset.operators.bertscore import bertscore
from loomset.operators.textscore import corpus_mean, eval_loss, pair_up, rouge, scoreable
from loomset.operators.tokens import bucket_batches, model_tokenizer, pad_batches, padding_report, token_columns
from loomset.plans.evaluate import evaluate


def lcs_table(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_lcs_against_the_table():
    rng = random.Random(1)
    for _ in range(300):
        a, b = (rng.choices("abcde", k=rng.randint(0, 90)) for _ in range(2))
        assert lcs_length(a, b) == lcs_table(a, b)


def f(shared, n, m):
    return 2 * shared / (n + m) if shared else 0.0


def grams(words, n):
    return [tuple(words[i : i + n]) for i in range(len(words) - n + 1)]


def random_pairs():
    rng = random.Random(9)

    def text():
        return " ".join(rng.choices("a b c dd é".split(), k=rng.randint(0, 25)))

    return [(i, text(), text()) for i in range(60)] + [(98, " ", "."), (99, "x", "y")]


@pytest.mark.parametrize("distinct", [True, False])
def test_rouge(spark, distinct):
    rows = random_pairs()
    df = spark.createDataFrame(rows, "pair_id long, prediction string, reference string")
    got = {r.pair_id: (r.rouge_1, r.rouge_2, r.rouge_l) for r in rouge(df, distinct_ngrams=distinct).collect()}
    assert len(got) == len(rows)
    for i, p, r in rows:
        p, r = (p.split() or ["."]), (r.split() or ["."])
        want = []
        for n in (1, 2):
            a, b = grams(p, n), grams(r, n)
            if distinct:
                want.append(f(len(set(a) & set(b)), len(set(a)), len(set(b))))
            else:
                shared = (collections.Counter(a) & collections.Counter(b)).total()
                want.append(f(shared, len(a), len(b)))
        want.append(f(lcs_table(p, r), len(p), len(r)))
        assert got[i] == pytest.approx(tuple(want))


def test_rouge_tokenizers(spark):
    df = spark.createDataFrame([(1, "你好吗", "你好")], "pair_id long, prediction string, reference string")
    assert rouge(df).first().rouge_1 == 0
    assert rouge(df, "cjk_char").first().rouge_1 == pytest.approx(0.8)
    assert rouge(df, lambda t: F.split(t, "好")).first().rouge_1 == pytest.approx(0.5)


def test_pairs(spark):
    df = spark.createDataFrame([(1, "p", "r"), (2, "", "r"), (3, "p", None)], "pair_id long, instruction string, output string")
    assert [(r.pair_id, r.prompt, r.reference) for r in scoreable(df).collect()] == [(1, "p", "r")]
    predictions = spark.createDataFrame([(3, "x"), (1, "y")], "pair_id long, prediction string")
    got = {(r.pair_id, r.prediction) for r in pair_up(predictions, df).collect()}
    assert got == {(3, "x"), (1, "y")}
    assert corpus_mean(spark.createDataFrame([(0.00004,), (0.0001,)], "s double"), "s").first().s == 0.0001


@pytest.mark.parametrize("group,broadcast_rows", [(16, 10), (1, 10), (1, 0)])
def test_bertscore(spark, monkeypatch, group, broadcast_rows):
    """Small groups make every pair a large one; both ways of joining them."""
    monkeypatch.setattr(matching, "PACK", 3)
    monkeypatch.setattr(matching, "GROUP", group)
    monkeypatch.setattr(joins, "BROADCAST_ROWS", broadcast_rows)
    rng = np.random.default_rng(2)
    sizes = {1: (4, 17), 2: (9, 2), 3: (1, 1), 4: (3, 0)}
    data = {p: [rng.normal(size=(n, 5)) for n in ns] for p, ns in sizes.items()}
    rows = [
        (p, side, i, v.tolist())
        for p, sides in data.items()
        for side, m in zip(("pred", "ref"), sides)
        for i, v in enumerate(m)
    ]
    df = spark.createDataFrame(rows, "pair_id long, side string, pos int, vec array<double>")
    got = {r.pair_id: tuple(r)[1:] for r in bertscore(df).collect()}
    for p, (a, b) in data.items():
        want = (0.0, 0.0, 0.0)
        if len(a) and len(b):
            c = (a / np.linalg.norm(a, axis=1)[:, None]) @ (b / np.linalg.norm(b, axis=1)[:, None]).T
            x, y = c.max(axis=1).mean(), c.max(axis=0).mean()
            want = (x, y, 2 * x * y / (x + y))
        assert got[p] == pytest.approx(want, abs=1e-9)


def test_eval_loss_and_report(spark):
    rows = [(1, 0, 1, -9.0), (1, 1, 1, -1.0), (1, 2, 1, -2.0), (2, 0, 0, -0.5)]
    logprobs = spark.createDataFrame(rows, "pair_id long, pos int, prompt_len int, logprob double")
    assert tuple(eval_loss(logprobs).first()) == (1.0, 2)
    pairs = spark.createDataFrame([(1, "a b", "a b")], "pair_id long, prediction string, reference string")
    report = evaluate(pairs)
    assert report.columns == ["num_samples", "rouge_1", "rouge_2", "rouge_l"]
    assert tuple(report.first()) == (1, 1.0, 1.0, 1.0)
    assert evaluate(pairs, token_logprobs=logprobs).first().eval_loss == 1.5  # pair 2 is not scored


def test_token_columns(spark):
    df = spark.createDataFrame([(1, "aé", 1), (2, "", 0), (3, "wxyz", 9)], "id long, text string, p int")
    got = {r.id: r for r in token_columns(df, 3, prompt_len="p").collect()}
    assert "text" not in token_columns(df).columns
    assert list(got[1].input_ids) == [97, 195, 169] and list(got[1].labels) == [-100, 195, 169]
    assert (got[2].n_tokens, got[2].truncated, list(got[2].input_ids)) == (0, False, [])
    assert got[3].truncated and got[3].n_tokens == 4 and list(got[3].labels) == [-100] * 3
    by_word = model_tokenizer(lambda texts: [[len(w) for w in t.split()] for t in texts])
    rows = token_columns(spark.createDataFrame([("aa b ccc",)], "text string"), 2, by_word).first()
    assert list(rows.input_ids) == [2, 1] and rows.n_tokens == 3 and rows.truncated


def test_pad_batches(spark):
    rows = [(f"{i:032x}", "x" * (i % 7)) for i in range(50)]
    df = token_columns(spark.createDataFrame(rows, "order_key string, text string"))
    got = {r.order_key: r for r in pad_batches(df, 8, 0).collect()}
    for i, (key, text) in enumerate(rows):
        batch = [len(t) for _, t in rows[i // 8 * 8 : i // 8 * 8 + 8]]
        r = got[key]
        pad = max(batch) - len(text)
        assert r.batch == i // 8
        assert list(r.input_ids) == [120] * len(text) + [0] * pad
        assert list(r.labels) == [120] * len(text) + [-100] * pad
        assert list(r.attention_mask) == [1] * len(text) + [0] * pad


def test_bucket_batches(spark, monkeypatch):
    rows = [(i, "x" * (i * 7 % 60), "mine") for i in range(200)] + [(None, None, None), (5, "", None), (5, "", None)]
    df = token_columns(spark.createDataFrame(rows, "doc_id int, text string, width string").repartition(3))
    for most in (256, 2):
        monkeypatch.setattr("loomset.operators.tokens._HELD", most)
        batched = bucket_batches(df, 8, 0, step=10)
        got = batched.collect()
        assert sorted((r.doc_id or -1, sum(r.attention_mask)) for r in got) == sorted((i or -1, len(t or "")) for i, t, _ in rows)
        batches = {}
        for r in got:
            n = sum(r.attention_mask)
            assert r.width == max(-(-n // 10), 1) * 10 == len(r.input_ids) == len(r.labels) == len(r.attention_mask)
            assert list(r.input_ids) == [120] * n + [0] * (r.width - n) and list(r.labels) == [120] * n + [-100] * (r.width - n)
            batches.setdefault(r.batch, []).append(r.width)
        assert all(len(w) <= 8 and len(set(w)) == 1 for w in batches.values())
        if most == 256:
            assert sum(len(w) < 8 for w in batches.values()) <= 3 * 6  # one of each width and partition at most
    report = {r["width"]: r for r in padding_report(bucket_batches(df, 8, 0, step=10)).collect()}
    assert sum(r["n_rows"] for r in report.values()) == len(rows)
    padding = sum(r["n_padding"] for r in report.values())
    named = df.where("doc_id IS NOT NULL")
    by_hash = pad_batches(named.withColumn("order_key", F.md5(F.col("doc_id").cast("string"))), 8, 0)
    assert padding < sum(r["n_padding"] for r in padding_report(by_hash).collect()) / 3
    assert bucket_batches(df.limit(0), 8, 0).count() == 0
    assert bucket_batches(df.select("input_ids", "labels"), 8, 0).count() == len(rows)


def test_rows_that_wait_keep_no_table(spark, monkeypatch):
    monkeypatch.setattr("pyspark.TaskContext.get", lambda: type("Task", (), {"partitionId": lambda self: 0})())
    run = []
    frame = token_columns(spark.createDataFrame([(1, "x")], "doc_id int, text string"))
    monkeypatch.setattr(type(frame), "mapInArrow", lambda self, f, schema: run.append((self.schema.names, f)))
    bucket_batches(frame, 8, 0, step=10)
    names, fill = run[0]
    ids = pa.array([[1] * 5000] * 15 + [[2] * 3], pa.list_(pa.int32()))
    columns = {"doc_id": pa.array(range(16)), "n_tokens": pa.array([0] * 16), "truncated": pa.array([False] * 16), "input_ids": ids}
    columns |= {"labels": pa.nulls(16, ids.type), "_same": pa.array([True] * 16)}
    table = pa.RecordBatch.from_pydict({n: columns[n] for n in names})
    copies = (pa.RecordBatch.from_arrays([pa.concat_arrays([c, c.slice(0, 0)]) for c in table.columns], names=names) for _ in range(20))
    before, out = pa.total_allocated_bytes(), fill(copies)
    held = [pa.total_allocated_bytes() - before for _ in zip(range(30), out)]
    assert max(held) < 3 * 16 * 5000 * 4
    assert sum(b.num_rows for b in out) == 20 * 16 - 30 * 8


def test_encoders_get_groups_of_bounded_size(spark, monkeypatch):
    monkeypatch.setattr("loomset.operators.tokens.GROUP_CHARS", 100, raising=False)

    def encode(texts):
        assert len(texts) == 1 or sum(map(len, texts[:-1])) < 100
        return [[len(texts), *map(ord, t)] for t in texts]

    rows = [(i, None if i == 3 else "ab" * (i % 9)) for i in range(400)] + [(400, "z" * 900)]
    df = spark.createDataFrame(rows, "i int, text string").coalesce(1)
    got = {r.i: list(r.input_ids) for r in token_columns(df, 2000, model_tokenizer(encode)).collect()}
    assert {i: ids[1:] for i, ids in got.items()} == {i: [ord(c) for c in t or ""] for i, t in rows}
    assert max(ids[0] for ids in got.values()) < 60


def test_missing_texts_and_keys_are_taken_record_by_record(spark):
    rows = [(1, None, "do", "a b", None, None), (2, "say", None, None, "c d", "c d"), (3, None, None, "x", "x", "x")]
    pairs = spark.createDataFrame(
        rows, "pair_id long, prompt string, instruction string, output string, reference string, prediction string"
    )
    scored = {r["pair_id"]: r["reference"] for r in scoreable(pairs).collect()}
    assert scored == {1: "a b", 2: "c d"}
    for distinct in (True, False):
        got = {r["pair_id"]: (r["rouge_1"], r["rouge_l"]) for r in rouge(scoreable(pairs), distinct_ngrams=distinct).collect()}
        assert got == {1: (0.0, 0.0), 2: (1.0, 1.0)}
    vectors = spark.createDataFrame(
        [(p, side, 0, [1.0, float(p)]) for p in (2, 3) for side in ("pred", "ref")],
        "pair_id long, side string, pos int, vec array<float>",
    )
    losses = spark.createDataFrame([(2, 0, 0, -1.0), (3, 0, 0, -9.0)], "pair_id long, pos int, prompt_len int, logprob double")
    report = evaluate(pairs, vectors, losses).first()
    assert (report["num_samples"], report["rouge_1"], report["eval_loss"], report["bertscore_f1"]) == (2, 0.5, 1.0, 1.0)
