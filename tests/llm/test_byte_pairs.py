"""The transducer against the library's merges, and streaming decoding."""

import gc
import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings, strategies as st

import public_tokenizers
from loomset.llm import byte_pairs, catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def ranks():
    return byte_pairs.read_ranks(byte_pairs._content(byte_pairs.RANKS))


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def encoder(ranks):
    return byte_pairs.Encoder(byte_pairs.Transducer(ranks))


def merged(text, ranks, limit=1 << 60):
    """Merges of the lowest rank first, of equal ranks the one furthest left."""
    parts = [text[i : i + 1] for i in range(len(text))]
    while True:
        found = [(r, i) for i in range(len(parts) - 1) if (r := ranks.get(parts[i] + parts[i + 1])) is not None and r < limit]
        if not found:
            return [ranks[p] for p in parts]
        i = min(found)[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


def test_meeting_and_parts(encoder, ranks):
    rng, tokens, merges = random.Random(3), list(ranks), encoder.transducer.merges
    for _ in range(3000):
        a, b = rng.choice(tokens), rng.choice(tokens)
        assert merges.meet(ranks[a], ranks[b]) == (merged(a + b, ranks) == [ranks[a], ranks[b]])
    for token in rng.sample(tokens[256:], 500):
        assert list(merges.parts[ranks[token]]) == merged(token, ranks, ranks[token])


SIGNS = ["a", "b", " ", "  ", "\n", "\t", "\r", "'", "'s", "'LL", "the", "ing", "12", ".", "!?", "é", "ß", "中文", "😀", "\x1c", "\x85", "　", "\x00", "▁"]


def test_like_the_library(encoder, library):
    rng = random.Random(5)
    texts = ["".join(rng.choices(SIGNS, k=rng.randint(0, 25))) for _ in range(4000)]
    texts += [f"a{chr(c)}b {chr(c)}{chr(c)}" for c in range(0x3100) if not 0xD800 <= c < 0xE000]
    texts += ["a" * 30000, "ab" * 9000, " " * 5000, "\n" * 999 + "x", "é" * 5000, "", "0" * 3000]
    for text, ids in zip(texts, encoder.encode(texts), strict=True):
        assert ids.tolist() == library.encode_ordinary(text), text[:80]


def test_few_states_give_the_same(ranks, library):
    small = byte_pairs.Encoder(byte_pairs.Transducer(ranks, max_states=20), memo=10)
    texts = ["internationalisation of the thonhand, 1234!! " * 3, "x" * 500, "Grüße aus München"]
    for _ in range(3):
        assert [x.tolist() for x in small.encode(texts)] == [library.encode_ordinary(t) for t in texts]
    assert len(small.transducer.states) <= 22


def test_writes_before_the_end(ranks):
    transducer = byte_pairs.Transducer(ranks)
    state, written = 0, 0
    for byte in b"zq" * 200:
        state, out = transducer._move(state, byte)
        written += len(out)
    assert written > 150 and len(transducer.rest[state]) < 20


def test_vocabulary_of_many_languages():
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = byte_pairs.read_ranks(byte_pairs._content(path))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = ["Привет, мир! 你好 世界 the end", "ñandú über cœur " * 4]
    got = byte_pairs.Encoder(byte_pairs.Transducer(ranks)).encode(texts)
    assert [x.tolist() for x in got] == [library.encode_ordinary(t) for t in texts]


def test_a_byte_without_rank():
    with pytest.raises(ValueError):
        byte_pairs.Merges({b"a": 0})


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.binary(max_size=6), st.text(max_size=4).map(lambda t: t.encode("utf-8", "replace"))), max_size=8))
def test_stream_of_bytes(blocks):
    stream = byte_pairs.Utf8Stream()
    got = "".join(stream.feed(b) for b in blocks) + stream.close()
    assert got == b"".join(blocks).decode("utf-8", "replace")


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=20))
def test_stream_byte_by_byte(text):
    stream = byte_pairs.Utf8Stream()
    data = text.encode("utf-8", "replace")
    parts = [stream.feed(data[i : i + 1]) for i in range(len(data))]
    assert "".join(parts) == data.decode() and stream.held == b""


TEXTS = [None, "", " ", "a", "the cat's  hat\n", "é😀\U0010ffff\x00", "x" * 60000, "the " * 30000, "<|endoftext|>", "�"]


def test_round_trip(spark, library, monkeypatch):
    monkeypatch.setattr(byte_pairs, "BLOCK_IDS", 3)
    rows = [(i, t, "mine", 5) for i, t in enumerate(TEXTS)] + [(None, "repeat me", None, None)] * 3
    docs = spark.createDataFrame(rows, "doc_id int, text string, ids string, n_tokens int").repartition(2)
    got = byte_pairs.decode(byte_pairs.encode(docs.withColumn("decoded", docs["text"]))).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["ids"] == library.encode_ordinary(r["text"] or "") and r["n_tokens"] == len(r["ids"])
        assert r["decoded"] == (r["text"] or "")
    empty = byte_pairs.decode(byte_pairs.encode(docs.limit(0)), digest="x")
    assert empty.count() == 0


def test_null_and_unknown_ids(spark):
    rows = spark.createDataFrame([(1, None), (2, []), (3, [64, -1, 70000, 65])], "n int, ids array<int>")
    got = {r["n"]: r["decoded"] for r in byte_pairs.decode(rows).collect()}
    assert got[1] == got[2] == "" and len(got[3]) == 2
    digests = {r["n"]: r["ids_sha256"] for r in byte_pairs.decode(rows.where("n < 3"), digest="ids_sha256").collect()}
    assert set(digests.values()) == {hashlib.sha256(b"").hexdigest()}


def test_documents(spark, library):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = catalog.QUERIES["op11_byte_pairs"](spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode_ordinary(texts[r["doc_id"]])
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


def test_decoded_in_the_same_pass(spark):
    plan = catalog.QUERIES["op11_byte_pairs"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1  # one Python worker a task
    texts = [None, "", " a\u3000b  ", "\U0001f600 x" * 50, "it's\r\n123456"]
    docs = spark.createDataFrame([(i, t, "mine") for i, t in enumerate(texts)], "doc_id int, text string, other string")
    two = byte_pairs.decode(byte_pairs.encode(docs), digest="hex").select("doc_id", "other", "hex", "n_tokens", "decoded")
    one = byte_pairs.encode(docs, decoded="decoded", digest="hex")
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, two.collect()))
    assert {r["doc_id"]: r["decoded"] for r in byte_pairs.encode(docs, decoded="text").withColumnRenamed("text", "decoded").collect()} == {i: t or "" for i, t in enumerate(texts)}


def test_nothing_of_a_task_stays_frozen(spark, monkeypatch):
    docs, run = spark.createDataFrame([(1, "a")], "doc_id int, text string"), []
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, f, schema: run.append(f))
    byte_pairs.encode(docs)
    gc.unfreeze()
    before = gc.get_freeze_count()
    table = pa.RecordBatch.from_pydict({"doc_id": [1, 2], "text": ["a b", None]})
    assert [b.num_rows for b in run[0](iter([table]))] == [2]
    assert gc.get_freeze_count() == before
