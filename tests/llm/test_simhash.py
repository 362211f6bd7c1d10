"""SimHash classes against all pairs on small tables."""

import random

import numpy as np
import pytest
import xxhash

from loomset.llm import graph, simhash
from tests.llm.helpers import duck  # noqa: F401

SF = "/root/testdata/sf0.001"


def plain_print(text):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + 4]) for i in range(max(len(words) - 3, 1))] if words else []
    value = 0
    for bit in range(64):
        ones = sum(xxhash.xxh64_intdigest(g, 42) >> bit & 1 for g in grams)
        value |= (2 * ones > len(grams)) << bit
    return value


def plain_classes(rows, radius=4):
    """{row position: smallest reachable id} by comparing all pairs."""
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    prints = [p for _, p in rows]
    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                root[find(i)] = find(j)
    best = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            best[find(i)] = min(best.get(find(i), doc), doc)
    return [best.get(find(i)) for i in range(len(rows))]


TEXTS = [
    None,
    "",
    " \n",
    "One",
    "one",
    "a b c",
    "a  b\tc d e",
    "A B C D E",
    "é ü ß É 😀 x y z",
    "w " * 300,
    " ".join(f"w{i}" for i in range(40000)),
    "x" * 100000,
    "\x00 a\x1fb \x85 c d",
]


@pytest.mark.parametrize("text", TEXTS)
def test_fingerprint(text):
    assert simhash.fingerprint(text) == plain_print(text)


def test_long_text_in_blocks(monkeypatch):
    text = " ".join(f"w{i % 977}" for i in range(5000))
    whole = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "_BLOCK", 64)
    assert simhash.fingerprint(text) == whole


def test_documents_equal_all_pairs(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = docs.limit(5).unionByName(docs.selectExpr("cast(null as bigint) doc_id", "text", "lang", "source", "n_chars").limit(3))
    rows = docs.union(extra).withColumn("fingerprint", docs["lang"])  # a clashing column
    got = simhash.near_duplicates(rows, shard_rows=20).collect()
    plain = [(r["doc_id"], plain_print(r["text"])) for r in rows.collect()]
    want = plain_classes(plain)
    assert sorted((str(r["doc_id"]), r["fingerprint"], r["component_id"]) for r in got) == sorted(
        (str(d), f"{p:016x}", c) for (d, p), c in zip(plain, want, strict=True)
    )


def near_prints(seed, groups=40, size=12, noise=600):
    rng = random.Random(seed)
    out = set(rng.getrandbits(64) for _ in range(noise)) | {0, 1, 3}
    for _ in range(groups):
        x = rng.getrandbits(64)
        for _ in range(size):
            out.add(x)
            for _ in range(rng.randint(0, 5)):
                x ^= 1 << rng.randrange(64)
    return sorted(out)


@pytest.mark.parametrize("shard_rows", [10, 100, 5000])
def test_links_connect_all_near_prints(spark, shard_rows):
    values = near_prints(shard_rows)
    df = spark.createDataFrame([(int(np.uint64(v).view(np.int64)),) for v in values], "fingerprint bigint")
    roots = {r["node"]: r["root"] for r in graph.components(simhash.links(df.repartition(3), shard_rows=shard_rows)).collect()}
    got = {}
    for i, v in enumerate(values):
        s = int(np.uint64(v).view(np.int64))
        got.setdefault(roots.get(s, s), set()).add(i)
    want = {}
    for i, c in enumerate(plain_classes(list(enumerate(values)))):
        want.setdefault(c, set()).add(i)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_big_shard_has_a_tree_of_its_own():
    values = np.array(near_prints(7, groups=60, noise=4000), np.uint64)
    mask = simhash.PARTS[1]
    want = {(a, b) for a in range(values.size) for b in np.flatnonzero(np.bitwise_count(values ^ values[a]) <= 4)
            if bin(int(values[a] ^ values[b]) & mask).count("1") <= 1}
    shard = simhash.Shard(values, mask, 4, rows=200)
    assert shard.tree.leaves > 5
    edges = list(shard.ask(values))
    parent = np.arange(values.size)
    place = {int(v): i for i, v in enumerate(values)}
    pairs = [(place[int(a)], place[int(b)]) for x, y in [*edges, shard.joined()] for a, b in zip(x, y, strict=True)]
    parent = simhash._union(parent, np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs]))
    assert all(parent[a] == parent[b] for a, b in want)


def test_components(spark):
    chain = [(i, i + 1) for i in range(200)] + [(500, 400), (400, 500), (500, 450), (7, 7)] + [(1000, i) for i in range(1001, 1100)]
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(chain, "a bigint, b bigint")).collect()}
    assert all(got[i] == 0 for i in range(201)) and got[500] == got[450] == 400 and got[1099] == 1000
    assert graph.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_keep_one(spark):
    text = " ".join(f"word{i}" for i in range(400))
    rows = [(3, text, 1), (2, text + " end", 2), (2, text, 3), (9, "other " * 3 + "text here now", 4), (None, None, 5), (None, "", 6), (2, "x y", 7)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, fingerprint int")
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["2", "2", "9", "None"]
    assert simhash.keep_one(docs.limit(0)).count() == 0 == simhash.near_duplicates(docs.limit(0)).count()
