"""The pipeline against its stages done plainly, one text at a time."""

import hashlib
import re

import pyarrow as pa
import pytest

import corpus_pipeline
from loomset.llm import pieces
from loomset.llm.quality_rules import STOP_WORDS, SYMBOLS
from tests.llm.test_simhash import plain_classes, plain_print
from tests.llm.test_suffix_dedup import plain

SF = "/root/testdata/sf0.001"


def good(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    if n < 20:
        return False
    seen = {}
    for i in range(n - 7):
        seen.setdefault(tuple(words[i : i + 8]), []).append(i)
    twice = {i + k for at in seen.values() if len(at) > 1 for i in at for k in range(8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (
        100 * len(twice) <= 30 * n
        and 1.5 * n <= sum(map(len, words)) <= 25 * n
        and sum(text.count(s) for s in SYMBOLS) <= 0.25 * n
        and len(lines) - len(set(lines)) <= 0.5 * len(lines)
        and sum(bool(re.match(r"[\x20\x09-\x0D]*[-*•|]", x)) for x in lines) <= 0.9 * len(lines)
        and sum(a == b for a, b in zip(words, words[1:], strict=False)) <= 0.4 * n
        and (n < 40 or sum(w.lower() in STOP_WORDS for w in words) >= 0.01 * n)
    )


def mixed(docs):
    size, weight = {}, {}
    count = [len(re.findall(r"[^\x20\x09-\x0D]+", t)) for _, t, _ in docs]
    for (_, _, s), n in zip(docs, count, strict=True):
        size[s] = size.get(s, 0) + n
    for i, s in enumerate(sorted(size)):
        weight[s] = (5.0, 2.0, 1.0)[i % 3]
    capped = set()
    while True:
        free = [s for s in size if s not in capped]
        level = (1.5 * sum(size.values()) - sum(2 * size[s] for s in capped)) / sum(weight[s] for s in free)
        more = {s for s in free if 2 * size[s] <= level * weight[s]}
        if not more:
            break
        capped |= more
    out = []
    for doc, text, s in docs:
        rate = min(2.0 * size[s], level * weight[s]) / size[s]
        u = int(hashlib.md5(f"42:{doc}".encode()).hexdigest()[:13], 16) / (1 << 52)
        out += [(doc, text)] * (int(rate) + (u < rate - int(rate)))
    return out


def test_equal_to_plain_stages(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    docs = [r for r in rows if good(r["text"])]
    prints = [(r["doc_id"], plain_print(r["text"])) for r in docs]
    docs = [r for r, c in zip(docs, plain_classes(prints), strict=True) if r["doc_id"] == c]
    # what is left of a text is checked by its digest below, so cut the texts here
    data = [r["text"].encode() for r in docs]
    count, size = {}, corpus_pipeline.PASSAGE_BYTES
    for d in data:
        for i in range(len(d) - size + 1):
            count[d[i : i + size]] = count.get(d[i : i + size], 0) + 1
    left = []
    for r, d in zip(docs, data, strict=True):
        gone = bytearray(len(d))
        for i in range(len(d) - size + 1):
            if count[d[i : i + size]] > 1:
                gone[i : i + size] = b"\x01" * size
        kept = bytes(b for b, g in zip(d, gone, strict=True) if not g)
        if kept:
            left.append((r["doc_id"], kept.decode("utf-8", "replace"), r["source"]))
    assert [p[3] for p in plain([r["text"] for r in docs], size) if p[0] > p[1]]
    model = pieces.Pieces(pieces._model_bytes(pieces.MODEL))
    want = sorted(mixed(left))
    rows = corpus_pipeline.run(spark, SF).collect()
    got = sorted(zip((r["doc_id"] for r in rows), model.decode(pa.array([r["ids"] for r in rows], pa.list_(pa.int32()))), strict=True))
    assert [g[0] for g in got] == [w[0] for w in want]
    assert got == want


def test_stages_keep_the_columns(spark):
    docs = spark.createDataFrame(
        [(None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0)],
        "doc_id bigint, text string, lang string, source string, n_chars bigint",
    )
    for table in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, table, SF).columns == docs.columns
    assert [len(corpus_pipeline.STAGES), corpus_pipeline.ORACLE_SQL] == [5, None]


@pytest.mark.parametrize("text", ["clean words of the text " + " ".join(f"item{i}" for i in range(60))])
def test_clean_text_passes_all_stages(spark, text):
    docs = spark.createDataFrame([(7, text, "en", "s", len(text))], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for _, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(spark, docs, SF)
    assert docs.first()["text"] == text
