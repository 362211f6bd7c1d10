"""Delimited files cut at any byte, against the csv module."""

import csv
import io
import json
import random

import pytest
from pyspark.sql import functions as F

from loomset.sources import read_csv, read_tsv
from loomset.sources.delimited import ends_inside, header_names


def by_module(text, sep=","):
    csv.field_size_limit(1 << 30)
    return [
        {k: v or "" for k, v in row.items() if k is not None}
        for row in csv.DictReader(io.StringIO(text.replace("\r\n", "\n").replace("\r", "\n")), delimiter=sep)
    ]


def records(df):
    rows = df.orderBy("path", "block_start", "rid").select(F.to_json("raw").alias("raw"), "json").collect()
    assert all(json.loads(r["raw"]) == json.loads(r["json"]) for r in rows)
    return [json.loads(r["json"]) for r in rows]


@pytest.fixture
def small_splits(spark):
    """Splits of 64 bytes, so that small files have many."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(n) for n in names]
    for n, value in zip(names, ("64b", "1b"), strict=True):
        spark.conf.set(n, value)
    yield
    for n, value in zip(names, before, strict=True):
        spark.conf.set(n, value)


CELLS = ["", "a", "two words", 'say ""x""', "über 中文 😀", 'stray " quote', '5" disk', "x" * 150]
QUOTED = ["", "a,b", 'he said ""no""', "line\nbreak", "\n\n", 'a\n""b"",\nc', "y\n" * 60, '""', ',"",', "\r\n"]


def random_file(rng, sep=","):
    rows = [sep.join(["id", "Text", "text", "id"])]
    for _ in range(rng.randint(0, 40)):
        cells = [f'"{rng.choice(QUOTED)}"' if rng.random() < 0.5 else rng.choice(CELLS) for _ in range(rng.choice([1, 3, 4, 4, 4, 6]))]
        rows.append(sep.join(cells))
        if rng.random() < 0.1:
            rows.append("")
    return rng.choice(["\n", "\r\n"]).join(rows) + rng.choice(["", "\n"])


def test_state_of_lines():
    rng = random.Random(1)
    for _ in range(3000):
        line = "".join(rng.choices(['"', '""', ",", "a", " "], k=rng.randint(0, 9)))
        for inside in (False, True):
            # the module gives back two rows if the line break behind ended the record
            rows = list(csv.reader(io.StringIO(('"' if inside else "") + line + "\nend\n")))
            assert ends_inside(line, inside, ",") == (len(rows) == 1), (line, inside)


def test_header_names():
    assert header_names(["a", "B", "b", "a"]) == (["a", "B", "b"], [3, 1, 2])


def test_many_splits(spark, small_splits, tmp_path):
    rng = random.Random(3)
    want = []
    for k in range(12):
        text = random_file(rng)
        (tmp_path / f"f{k:02}.csv").write_bytes(text.encode())
        want += by_module(text)
    got = read_csv(spark, str(tmp_path))
    assert records(got) == want
    assert got.rdd.getNumPartitions() > 12


def test_a_cell_over_many_splits(spark, small_splits, tmp_path):
    text = 'a,b\n1,"' + "long\n" * 300 + '"\n2,"' + 'q""\n' * 100 + '"\n3,x\n'
    (tmp_path / "x.csv").write_text(text)
    assert records(read_csv(spark, str(tmp_path))) == by_module(text)
    open_end = text + '4,"never closed\n' + "more\n" * 50
    (tmp_path / "x.csv").write_text(open_end)
    assert records(read_csv(spark, str(tmp_path))) == [{k: v.rstrip("\n") for k, v in r.items()} if r["a"] == "4" else r for r in by_module(open_end)]


def test_names_by_position(spark, write):
    write("a.csv", "text,Text,text\n1,2,3\n4\n\n5,6,7,8\n")
    write("b.csv", "\n\nText,text\nx,y\n")
    folder = write("c.tsv", 'q\t"a b"\n"1\t2"\t3\n')
    assert records(read_csv(spark, folder)) == [
        {"text": "3", "Text": "2"}, {"text": "", "Text": ""}, {"text": "7", "Text": "6"}, {"Text": "x", "text": "y"},
    ]
    assert records(read_tsv(spark, folder)) == [{"q": "1\t2", "a b": "3"}]


def test_only_a_header_or_nothing(spark, write):
    write("a.csv", "a,b\n")
    folder = write("b.csv", "")
    assert records(read_csv(spark, folder)) == []


def test_a_header_must_fit_its_split(spark, small_splits, write):
    folder = write("a.csv", '"' + "name\n" * 40 + '",b\n1,2\n')
    with pytest.raises(Exception, match="header"):
        read_csv(spark, folder).count()


def test_long_cells(spark, write):
    text = "a,b\n1,\"" + ("word \n" * 200_000) + '"\n'
    folder = write("a.csv", text)
    assert records(read_csv(spark, folder)) == by_module(text)
