"""Viterbi over pieces: against a plain search, and exact round trips."""

import random

import pyarrow as pa
import pytest
import sentencepiece

from loomset.llm import catalog, pieces

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def model():
    return pieces.Pieces(pieces._model_bytes(pieces.MODEL))


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)


def best_score(word, library, unknown):
    """The highest score of any segmentation of a marked word, by the library's pieces and scores."""
    marked = word.replace(" ", pieces.MARK)
    score = [0.0] + [-1e300] * len(marked)
    single = {}
    for j in range(1, len(marked) + 1):
        for i in range(max(0, j - 16), j):
            k = library.piece_to_id(marked[i:j])
            if k and not library.is_byte(k):
                score[j] = max(score[j], score[i] + library.get_score(k))
                single[i, j] = True
        if (j - 1, j) not in single:
            score[j] = max(score[j], score[j - 1] + unknown)
    return score[-1]


WORDS = [" the", " thonhand", "  x", " " * 40, " ", " é😀\x00", " internationalisation", " a\r\nb;\r", " " + "ab" * 300, " 中文\U00020000"]


def test_best_path(model, library):
    rng = random.Random(0)
    words = sorted({*WORDS, *(" " + "".join(rng.choices("thesinoar é", k=rng.randint(0, 12))) for _ in range(400))})
    for word, ids in model.encode_words(words):
        total = sum(model.unknown if i in model.byte_ids else library.get_score(i) for i in ids)
        # a character written as several bytes scores once
        extra = sum(len(c.encode()) - 1 for c in word if not library.piece_to_id(c.replace(" ", pieces.MARK)))
        used = sum(i in model.byte_ids for i in ids)
        if used:
            total -= model.unknown * extra
        assert total == pytest.approx(best_score(word, library, model.unknown)), word
    assert dict(model.encode_words(words)) == {w: i for x in words for w, i in model.encode_words([x])}


TEXTS = [None, "", " ", "   ", "a", " a", "a ", "a  b\tc\nd", "é😀\U0010ffff\x00", "▁x ▁", "x" * 50000, "the " * 20000, "�"]


def test_round_trip(spark, library, monkeypatch):
    monkeypatch.setattr(pieces, "CACHE_WORDS", 50)
    rows = [(i, t, "x", 5) for i, t in enumerate(TEXTS)] + [(0, "repeat me", None, None)] * 3
    docs = spark.createDataFrame(rows, "doc_id int, text string, ids string, n_pieces int").repartition(2)
    got = pieces.decode(pieces.encode(docs.withColumn("decoded", docs["text"]))).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["decoded"] == (r["text"] or "") and r["n_pieces"] == len(r["ids"])
        if r["text"] and pieces.MARK not in r["text"]:
            assert library.decode(r["ids"]) == r["text"]
    assert pieces.encode(docs.limit(0)).count() == 0


def test_decoded_in_the_same_pass(spark, monkeypatch):
    assert plan_of(catalog.QUERIES["op4_pieces"](spark, SF)).count("MapInArrow") == 1  # one Python worker a task
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)], "doc_id int, text string, ok string")
    plain = {r["doc_id"]: r["ids"] for r in pieces.encode(docs).collect()}
    got = pieces.encode(docs, exact="ok")
    assert got.columns == ["doc_id", "ids", "n_pieces", "ok"]
    assert all(r["ok"] is True and r["ids"] == plain[r["doc_id"]] for r in got.collect())
    monkeypatch.setattr(pieces.Pieces, "decode", lambda self, lists: ["a"] * len(lists))
    table = pa.RecordBatch.from_pydict({"doc_id": [1, 2], "text": ["a", "b"]})
    run = []
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, f, schema: run.append(f))
    pieces.encode(docs.drop("ok"), exact="ok")
    assert [b.column("ok").to_pylist() for b in run[0](iter([table]))] == [[True, False]]


def plan_of(frame):
    return frame._jdf.queryExecution().optimizedPlan().toString()


def test_decode_any_ids(model):
    import pyarrow as pa

    b = model.byte_ids
    rows = [None, [], [b[0xE2], b[0x82]], [b[0xE2], b[0x82], b[0xAC]], [1, 2, -5, 10**6], [b[0xFF], *next(iter(model.encode_words([" a"])))[1]]]
    assert list(model.decode(pa.array(rows, pa.list_(pa.int32())))) == ["", "", "\ufffd", "€", "", "\ufffd a"]


def test_documents(spark):
    rows = catalog.QUERIES["op4_pieces"](spark, SF).collect()
    assert len(rows) == 200 and all(r["exact"] for r in rows)
